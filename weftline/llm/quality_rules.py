"""Quality rules as a bitmask ledger (operator 10): each rule is evaluated once, its failure is a bit, policies are masks.

Every step is a DataFrame or SQL function. A row of the ledger keeps the measurements and ``fail_bits``; a policy is a
version name and a mask of the bits that reject, so a new policy or an ablation needs no second look at the texts.

Defined results: a null or empty text has no words, fails ``few_words`` and is rejected; repeated rows are judged alike, one
by one; an empty table gives an empty ledger; columns of the input that clash with those of the ledger are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import WORD_GAP, table

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_digits", "n_stutters")
#: Rules in the order of their bits: name and the condition of failure over the measurements.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeat_words", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("dup_lines", "n_dup_lines >= 3 and 10 * n_dup_lines > 3 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("few_letters", "2 * n_letters < word_chars"),
    ("many_digits", "10 * n_digits > 4 * word_chars"),
    ("stutters", "n_words >= 10 and 5 * n_stutters > n_words"),
)
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: Versioned policies: the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": ("few_words", "repeat_words"),
    "v2": tuple(BITS),
}


def mask(policy: str) -> int:
    return sum(BITS[name] for name in POLICIES[policy])


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of MEASURES."""
    t = F.col("_t")
    words = F.filter(F.split(t, WORD_GAP), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\f\r"))) > 0)
    df = docs.drop(*MEASURES).withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumns({"_words": words, "_lines": lines})
    df = df.withColumns({"_hashes": F.transform("_words", lambda w: F.xxhash64(w)), "n_words": F.size("_words").cast("long"), "n_lines": F.size("_lines").cast("long")})

    def window(i: Column) -> Column:
        return F.xxhash64(*(F.get("_hashes", i + k) for k in range(5)))

    starts = F.when(F.col("n_words") >= 5, F.sequence(F.lit(0), F.size("_hashes") - 5)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_windows", F.transform(starts, window))
    # only a text with a repeated window needs its windows sorted
    repeated = F.size(F.array_distinct("_windows")) < F.size("_windows")
    pairs = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_sorted", F.when(repeated, pairs))

    def h(j: Column) -> Column:
        return F.get("_sorted", j)["h"]

    twice = F.filter(F.sequence(F.lit(0), F.size("_sorted") - 1), lambda j: h(j).eqNullSafe(h(j + 1)) | (h(j).eqNullSafe(h(j - 1))))
    df = df.withColumn("_twice", F.when(F.col("_sorted").isNotNull(), F.sort_array(F.transform(twice, lambda j: F.get("_sorted", j)["i"]))))
    covered = F.aggregate(
        "_twice",
        F.struct(F.lit(-5).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(5), i - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )

    def count(of: str) -> Column:
        return F.regexp_count(t, F.lit(of)).cast("long")

    return df.withColumns({
        "word_chars": F.length(t) - count(r"[\x20\x09-\x0D]"),
        "n_symbols": count(r"[#*$%&|<>]"),
        "n_dup_lines": (F.col("n_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        "n_letters": F.length(t) - count(r"[^\p{L}]"),
        "n_digits": count("[0-9]"),
        "n_stutters": F.size(F.filter("_hashes", lambda x, i: x.eqNullSafe(F.get("_hashes", i - 1)))).cast("long"),
    }).drop("_t", "_words", "_lines", "_hashes", "_windows", "_sorted", "_twice")


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements and ``fail_bits``, the bit of each rule that the text fails."""
    bits = [F.when(F.expr(rule), F.lit(BITS[name])).otherwise(F.lit(0)).cast("long") for name, rule in RULES]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    # Never NULL: the task's row number only makes the column one that filters are not pushed below. Pushed down, a filter would
    # repeat the nested array expressions, once for each element.
    return measured(docs, text).withColumn("fail_bits", F.when(F.monotonically_increasing_id() >= 0, total))


def keeps(policy: str) -> Column:
    """TRUE for a ledger row that the policy keeps."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablation(rows: DataFrame, policies: tuple[str, ...] = tuple(POLICIES)) -> DataFrame:
    """For each policy and each of its rules: texts that fail the rule, and texts that only this rule rejects (what the policy
    would keep without it). One pass of sums over the bits of the ledger."""
    sums = []
    for p in policies:
        own = F.col("fail_bits").bitwiseAND(F.lit(mask(p)).cast("long"))
        sums += [F.sum((own != 0).cast("long")).alias(f"{p}|")]
        for rule in POLICIES[p]:
            sums += [F.sum(F.getbit(own, F.lit(list(BITS).index(rule))).cast("long")).alias(f"{p}|{rule}|failed"), F.sum((own == BITS[rule]).cast("long")).alias(f"{p}|{rule}|alone")]
    one = rows.agg(*sums)
    entries = [
        F.struct(F.lit(p).alias("policy"), F.lit(rule).alias("rule"), F.coalesce(F.col(f"`{p}|{rule}|failed`"), F.lit(0)).alias("failed"), F.coalesce(F.col(f"`{p}|{rule}|alone`"), F.lit(0)).alias("alone"), F.coalesce(F.col(f"`{p}|`"), F.lit(0)).alias("rejected"))
        for p in policies
        for rule in POLICIES[p]
    ]
    return one.select(F.inline(F.array(*entries)))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.col("fail_bits").bitwiseAND(F.lit(mask("v1")).cast("long")) != 0
    return rows.select("doc_id", *MEASURES[:5], base.alias("base_failed"), keeps("v2").alias("kept"), "fail_bits", *MEASURES[5:])


ORACLE_SQL = {
    "op10_quality_rules": r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), cut AS (
  SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM base
), windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM cut)
), twice AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1
), steps AS (
  SELECT doc_id, least(5, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -5)) AS step FROM twice
), covered AS (
  SELECT doc_id, sum(step)::BIGINT AS n FROM steps GROUP BY doc_id
), measures AS (
  SELECT c.doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(v.n, 0)::BIGINT AS n_repeat_words,
         len(lines)::BIGINT AS n_lines, length(regexp_replace(t, '[^\p{L}]+', '', 'g'))::BIGINT AS n_letters,
         length(regexp_replace(t, '[^0-9]+', '', 'g'))::BIGINT AS n_digits,
         len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1]))::BIGINT AS n_stutters
  FROM cut c LEFT JOIN covered v ON v.doc_id = c.doc_id
), bits AS (
  SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 15 * n_words THEN 32 ELSE 0 END
    + CASE WHEN 2 * n_letters < word_chars THEN 64 ELSE 0 END + CASE WHEN 10 * n_digits > 4 * word_chars THEN 128 ELSE 0 END
    + CASE WHEN n_words >= 10 AND 5 * n_stutters > n_words THEN 256 ELSE 0 END)::BIGINT AS fail_bits FROM measures
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept,
       fail_bits, n_lines, n_letters, n_digits, n_stutters FROM bits""",
}
