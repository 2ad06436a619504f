"""Line dedup by a log-template tree (operator 5).

A line goes down a tree of fixed depth: its token count, then its first two tokens; tokens with a digit are the variable field <*>
from the start. In the leaf it has a template: a token that stands at its place in lines of enough copy classes is fixed, any other
is a variable field. So lines of any length that differ in some places meet in one template, which does not depend on the order
of arrival. A template counts if it has at most FIELDS learnt fields and one in FIELD_PART of its tokens, and if at least half of its
tokens are no fields at all.

Most lines are seen early not to be such: the tokens below the leaf are cut into one part more than there may be learnt fields, so
one part at least is the same in all lines of a template. Only lines with a part that stands in enough classes are looked into.

A template recurs, and its lines are dropped, if it stands in MIN_CLASSES copy classes or more; in LONG_CLASSES if it has LONG_TOKENS
or more and no learnt field, as no such line is three times the same by accident. The same numbers make a token fixed. Two documents
alone cannot be told from one and a text that quotes it, so their lines stay. A copy class is a component of texts whose sketches of
five-word shingles (128 bits of SimHash, met under minima) are those of a similarity of COPY_SIMILARITY or more: exact copies,
copies and revisions of one document count once, so their text is not taken for boilerplate, while lines that recur together in
otherwise different documents leave those in classes of their own. Near-duplicate removal, not this operator, is for copies.

Everything that is counted is a set of (what, class) first, combined before its shuffle, so a line of a third of all documents, or
a text copied as often, is a row a task. The names of the lines to drop are sent to
the tasks if they are at most BROADCAST_LINES; beyond that, lines meet them in a join.

Defined results: a null text stays null and has no lines; an empty text stays empty; lines of fewer than MIN_TOKENS tokens are kept;
the same line again in one text counts once and is dropped or kept alike; repeated rows are treated alike; very long lines are lines like any
other; there are no ties, as nothing is ranked; an empty table gives an empty result; a dropped line goes with its line end, and
every other byte stays; further columns of the input are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import met_parts, parts_of, per_text, stage, table
from weftline.llm.simhash import sketch_components

MIN_TOKENS = 3
LEADING = 2
LONG_TOKENS = 8
LONG_CLASSES = 3
MIN_CLASSES = 10
FIELDS = 3
FIELD_PART = 4
COPY_SIMILARITY = 0.5
BROADCAST_LINES = 500_000
LEAD_BITS = 20
FIELD = "<*>"
DIGITS = tuple("0123456789")


def has_digit(text: str) -> bool:
    return any(map(text.__contains__, DIGITS))


def masked(token: str) -> str:
    return token if token.isalpha() or not has_digit(token) else FIELD


def tokens_of(line: str) -> list[str]:
    return [*map(masked, line.split())] if has_digit(line) else line.split()


def signed(h: int) -> int:
    return h - (h >> 63 << 64)


def lead(first: str, second: str) -> int:
    return xxhash.xxh64_intdigest(f"{first} {second}") >> 64 - LEAD_BITS


def name(tokens: list[str]) -> int:
    """A line's name: its leading tokens' hash in the upper LEAD_BITS bits, by which most lines are seen not to be wanted, and its own."""
    below = 64 - LEAD_BITS
    return signed(lead(tokens[0], tokens[1]) << below | xxhash.xxh64_intdigest(" ".join(tokens)) & (1 << below) - 1)


class Names:
    """A set of line names."""

    def __init__(self, names: Iterable[int]) -> None:
        self.names = frozenset(names)
        self.leads = frozenset((n & (1 << 64) - 1) >> 64 - LEAD_BITS for n in self.names)

    def tokens(self, line: str) -> list[str] | None:
        """The tokens of a line whose name is in the set, or None."""
        start = line.split(None, LEADING)
        if len(start) <= LEADING or lead(masked(start[0]), masked(start[1])) not in self.leads:
            return None
        tokens = tokens_of(line)
        return tokens if name(tokens) in self.names else None


def parsed(text: str) -> dict[str, list[str]]:
    """The different lines of a text that are long enough, masked and with single spaces, and their tokens."""
    return {" ".join(t): t for t in map(tokens_of, text.split("\n")) if len(t) >= MIN_TOKENS}


def fields_allowed(n: int) -> int:
    return min(FIELDS, n // FIELD_PART)


def place(tokens: list[str]) -> tuple[int, list[int]]:
    """The leaf of a line, and its parts below the leaf."""
    n, below = len(tokens), len(tokens) - LEADING
    leaf = xxhash.xxh64_intdigest(f"{n} {' '.join(tokens[:LEADING])}")
    parts = fields_allowed(n) + 1
    cuts = [LEADING + below * i // parts for i in range(parts + 1)]
    return signed(leaf), [signed(xxhash.xxh64_intdigest(" ".join(tokens[a:b]), leaf + i & (1 << 64) - 1)) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]


def placed_lines(texts: DataFrame) -> DataFrame:
    """(of, name, n, leaf, parts): the different lines of each of ``texts`` (of, text)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(h, name(t), len(t), *place(t)) for h, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for t in parsed(x).values()]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["of", "name", "n", "leaf", "parts"])

    return per_text(texts, run, "of long, name long, n int, leaf long, parts array<long>")


def named_lines(texts: DataFrame, names: DataFrame, limit: int) -> DataFrame:
    """(of, name, line): the lines of ``texts`` (of, text) whose names are in ``names`` (name)."""
    few = names.count() <= limit
    wanted = texts.sparkSession.sparkContext.broadcast(Names(r[0] for r in names.toLocalIterator())) if few else None

    def lines_in(text: str) -> list[list[str]]:
        if wanted is None:
            return [*parsed(text).values()]
        return [t for t in map(wanted.value.tokens, dict.fromkeys(text.split("\n"))) if t]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(h, name(t), " ".join(t)) for h, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for t in lines_in(x)]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string()))], ["of", "name", "line"])

    lines = per_text(texts, run, "of long, name long, line string")
    return lines if few else lines.join(names, "name", "left_semi")


def met(rows: DataFrame, small: DataFrame, on: str, how: str, limit: int) -> DataFrame:
    """A join with a staged table, which is broadcast if it has at most ``limit`` rows; else rows of one key meet it in parts (in a left join
    they are a text's lines, and few)."""
    if small.count() <= limit:
        return rows.join(F.broadcast(small), on, how)
    if how == "left":
        return rows.join(small, on, how)
    rows = rows.withColumn("_by", F.hash(*rows.columns))
    return met_parts(rows, small.join(rows.groupBy(on).agg(parts_of("_by")), on), on, "_by", how).drop("_by")


def words_of(lines: DataFrame) -> DataFrame:
    """(name, words): the names of the tokens below the leaf, each at its place, of ``lines`` (name, leaf, line)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
        words = [[signed(xxhash.xxh64_intdigest(t, leaf + i & (1 << 64) - 1)) for i, t in enumerate(line.split(" ")[LEADING:])] for leaf, line in rows]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.int64()))], ["name", "words"])

    return per_text(lines.select("name", "leaf", "line"), run, "name long, words array<long>")


def fixed_places(words: DataFrame, fixed: DataFrame, limit: int) -> DataFrame:
    """(name, at): the places of a line's fixed tokens, in order."""
    if fixed.count() > limit:
        each = words.select("name", F.posexplode("words").alias("pos", "word")).join(fixed, "word", "left_semi")
        return each.groupBy("name").agg(F.sort_array(F.collect_list(F.col("pos") + LEADING)).alias("at"))
    known = words.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in fixed.toLocalIterator()))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = [[LEADING + i for i, w in enumerate(own) if w in known.value] for own in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.list_(pa.int32()))], ["name", "at"])

    return per_text(words, run, "name long, at array<int>")


def line_templates(docs: DataFrame, text: str = "text", broadcast_limit: int = BROADCAST_LINES) -> DataFrame:
    """(line, name, template, learnt, n, classes): the different lines (masked) in leaves of enough classes, the name of each one's
    template, its number of learnt fields and the copy classes it stands in; only templates that count."""
    texts = docs.where(F.length(text) > 0).select(F.xxhash64(F.col(text)).alias("of"), F.col(text).alias("text"))
    classes = sketch_components(texts.withColumnRenamed("of", "doc_id"), COPY_SIMILARITY)
    copies = stage(classes.where("doc_id <> component_id").distinct().withColumnsRenamed({"doc_id": "of", "component_id": "class"}), "copy-classes")
    enough = F.when(F.col("n") >= LONG_TOKENS, LONG_CLASSES).otherwise(MIN_CLASSES)

    def classed(rows: DataFrame) -> DataFrame:
        own = [c for c in rows.columns if c != "of"]
        return met(rows.distinct(), copies, "of", "left", broadcast_limit).select(*own, F.coalesce("class", "of").alias("class")).distinct()

    def support(rows: DataFrame, *by: str) -> DataFrame:
        return rows.select(*by, "class").distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("classes"))

    every = stage(placed_lines(texts), "placed-lines")
    leaves = stage(support(classed(every.select("of", "leaf", "n")), "leaf", "n").where(F.col("classes") >= enough).select("leaf"), "leaves")
    lines = stage(classed(met(every, leaves, "leaf", "left_semi", broadcast_limit).select("of", "name", "n", "leaf", "parts")), "lines-of-classes")
    parts = support(lines.select("n", "class", F.explode("parts").alias("part")), "n", "part").where(F.col("classes") >= enough).select("part")
    kinds = lines.select("name", "n", "leaf", "parts").distinct()
    names = met(kinds.select("name", F.explode("parts").alias("part")), stage(parts, "parts"), "part", "left_semi", broadcast_limit).select("name").distinct()
    names = stage(names, "names")
    texts_of = stage(named_lines(texts, names, broadcast_limit).select("name", "line").distinct(), "different-lines")
    each = stage(met(kinds.select("name", "n", "leaf"), texts_of, "name", "inner", broadcast_limit), "lines")
    alive = stage(met(lines.select("name", "n", "class"), names, "name", "left_semi", broadcast_limit), "alive-lines")
    words = stage(words_of(each), "words")
    fixed = stage(support(met(alive, words, "name", "inner", -1).withColumn("word", F.explode("words")), "n", "word").where(F.col("classes") >= enough).select("word"), "fixed")
    places = fixed_places(words, fixed, broadcast_limit)
    tokens = F.split("line", " ")
    fields = F.size(F.filter(tokens, lambda x: x == FIELD))
    made = each.join(places, "name", "left").withColumn("at", F.coalesce("at", F.array().cast("array<int>"))).withColumn("learnt", F.col("n") - LEADING - F.size("at"))
    made = made.where((F.col("learnt") <= F.least(F.lit(FIELDS), F.floor(F.col("n") / FIELD_PART))) & (2 * (F.col("learnt") + fields) <= F.col("n")))
    made = stage(made.select("line", "name", "n", "learnt", F.xxhash64("leaf", "at", F.transform("at", lambda p: F.get(tokens, p))).alias("template")), "templates")
    stands = met(alive.select("name", "class"), made.select("name", "template"), "name", "inner", broadcast_limit)
    counts = stage(support(stands, "template"), "template-classes")
    return met(made, counts, "template", "inner", broadcast_limit)


def recurring(docs: DataFrame, text: str = "text", broadcast_limit: int = BROADCAST_LINES) -> DataFrame:
    """(name): the names of the lines whose templates recur across documents."""
    enough = F.when((F.col("n") >= LONG_TOKENS) & (F.col("learnt") == 0), LONG_CLASSES).otherwise(MIN_CLASSES)
    return line_templates(docs, text, broadcast_limit).where(F.col("classes") >= enough).select("name").distinct()


def without(text: str, drop: Names) -> tuple[str, int]:
    """The text without the lines named in ``drop``, and how many those are."""
    lines = text.split("\n")
    keep = [x for x in lines if not drop.tokens(x)]
    return (text, 0) if len(keep) == len(lines) else ("\n".join(keep), len(lines) - len(keep))


def dropped_lines(docs: DataFrame, text: str = "text", broadcast_limit: int = BROADCAST_LINES) -> DataFrame:
    """``docs`` with the text without its recurring lines, and n_lines and n_dropped."""
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped")
    found = stage(recurring(docs, text, broadcast_limit), "recurring")
    columns = docs.columns
    at = columns.index(text)
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", n_lines long, n_dropped long"

    def cut(batch: pa.RecordBatch, drops: Iterable[Names]) -> pa.RecordBatch:
        texts = batch.column(at).to_pylist()
        done = [(t, 0) if not t else without(t, d) for t, d in zip(texts, drops, strict=True)]
        own = [batch.column(i) for i in range(len(columns))]
        own[at] = pa.array([d[0] for d in done], pa.string())
        lines = [0 if not t else t.count("\n") + 1 for t in texts]
        return pa.RecordBatch.from_arrays([*own, pa.array(lines, pa.int64()), pa.array([d[1] for d in done], pa.int64())], [*columns, "n_lines", "n_dropped"])

    if found.count() <= broadcast_limit:
        names = spark.sparkContext.broadcast(Names(r[0] for r in found.toLocalIterator()))
        return per_text(docs, lambda batch: cut(batch, [names.value] * batch.num_rows), out)
    keyed = docs.withColumn("_of", F.xxhash64(F.col(text)))
    lines = named_lines(keyed.where(F.length(text) > 0).select(F.col("_of").alias("of"), F.col(text).alias("text")), found, -1)
    drops = lines.select(F.col("of").alias("_of"), "name").distinct().groupBy("_of").agg(F.collect_list("name").alias("_drops"))
    rows = keyed.join(drops, "_of", "left").select(*[docs[c] for c in columns], "_drops")
    return per_text(rows, lambda b: cut(b, [Names(d or ()) for d in b.column(len(columns)).to_pylist()]), out)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dropped_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "text")


def clean_lines(docs: DataFrame) -> DataFrame:
    """Pipeline stage: the columns of ``docs``, the text without recurring lines and n_chars to match; every row stays."""
    names = [f"c{i}" for i in range(len(docs.columns))]  # so that no column clashes with the operator's
    rows = dropped_lines(docs.toDF(*names), names[docs.columns.index("text")]).select(*names).toDF(*docs.columns)
    return rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else rows
