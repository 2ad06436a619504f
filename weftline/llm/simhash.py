"""SimHash near-duplicates (operator 2): fingerprints of word shingles, linked by tiled exact comparison.

Fingerprints at most RADIUS bits apart agree on at least two of four 16-bit blocks. So every pair that can link meets under
one of six keys, each made of two blocks, and only fingerprints under one key are compared. Under a key they are compared
exactly, tile against tile, by numpy exclusive-or and bit counts; tiles whose population counts differ beyond the radius are
skipped. A large key (copies with small edits) is cut into tiles by population count and hash, and its tile pairs go to
different tasks. Each task returns a spanning star of the links it finds, never all pairs, which leaves the components as they
are. Equal fingerprints are one row throughout.

Defined results: a null text, or one without words, has the fingerprint zero, which links like any other; texts of one or two
words have one shingle; repeated rows share a fingerprint and a component; an empty table gives an empty result; further
columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import components, forest, met_parts, parts_of, per_text, python_tasks, stage, table, with_group

SHINGLE = 3
RADIUS = 2
SEED = 42
BLOCKS = 4
BLOCK_BITS = 64 // BLOCKS
#: Fingerprints of one tile of a large key.
TILE = 2048
#: Runs up to this length are compared by shifting, longer ones tile by tile.
SHORT_RUN = 32


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of a text's word shingles: a bit is 1 if it is 1 in over half the shingle hashes, repeats included."""
    words = text.lower().split() if text else []  # of bytes: A-Z only, and exactly the white space U+0020, U+0009 to U+000D
    if not words:
        return 0
    flat = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    ends = ends.tolist()
    k = min(shingle, len(words)) - 1
    digest, seed = xxhash.xxh64_digest, SEED
    ones = np.zeros(64, np.int64)
    n = len(words) - k
    for at in range(0, n, 16384):
        raw = b"".join([digest(flat[s:e], seed) for s, e in zip(starts[at : min(n, at + 16384)], ends[at + k : at + k + 16384], strict=False)])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = [fingerprint(t, shingle) for t in pc.cast(batch.column(1), pa.binary()).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return per_text(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, fp long")


def linked_tiles(left: np.ndarray, right: np.ndarray | None, radius: int, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Spanning star of the links between two tiles (or within one), both cut into steps in the order of population count."""
    own = right is None
    left = left[np.argsort(np.bitwise_count(left), kind="stable")]
    right = left if own else right[np.argsort(np.bitwise_count(right), kind="stable")]
    weight, heavy = np.bitwise_count(left).astype(np.int64), np.bitwise_count(right).astype(np.int64)
    a, b = [], []
    for i in range(0, len(left), step):
        x, w = left[i : i + step], weight[i : i + step]
        for j in range(i if own else 0, len(right), step):
            v = heavy[j : j + step]
            if v[0] - w[-1] > radius:
                break
            if w[0] - v[-1] > radius:
                continue
            y = right[j : j + step]
            p, q = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= radius)
            keep = x[p] != y[q]
            if keep.any():
                u, r = forest(x[p[keep]], y[q[keep]])
                a.append(u)
                b.append(r)
    if not a:
        return left[:0], left[:0]
    return forest(np.concatenate(a), np.concatenate(b))


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (unit, side, fp) in the order of unit. A run of one unit is one tile (side 0), or a pair of tiles (sides 0 and 1)."""

    def links(unit: np.ndarray, side: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        a, b = [fp[:0]], [fp[:0]]
        cuts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
        size = np.diff(np.r_[cuts, len(unit)])
        run = np.repeat(size, size)
        paired = np.repeat(np.maximum.reduceat(side, cuts) if len(cuts) else side, size) > 0
        short = (run <= SHORT_RUN) & ~paired
        s, u = fp[short], unit[short]
        for d in range(1, min(SHORT_RUN, len(s))):
            same = u[d:] == u[:-d]
            if not same.any():
                break
            x, y = s[d:][same], s[:-d][same]
            near = np.bitwise_count(x ^ y) <= radius
            a.append(x[near])
            b.append(y[near])
        for at, n in zip(cuts[~short[cuts]], size[~short[cuts]], strict=True):
            rows, sides = fp[at : at + n], side[at : at + n]
            x, y = linked_tiles(rows[sides == 0], rows[sides == 1] if sides.any() else None, radius)
            a.append(x)
            b.append(y)
        node, root = forest(np.concatenate(a), np.concatenate(b)) if sum(map(len, a)) else (fp[:0], fp[:0])
        return pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(root.view(np.int64))], ["u", "v"])

    kept: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64))
        unit, side, fp = (np.concatenate(x) for x in zip(*kept, now, strict=True))
        last = int(np.searchsorted(unit, unit[-1]))  # the last run may go on in the next batch
        if last:
            yield links(unit[:last], side[:last], fp[:last])
        kept = [(unit[last:], side[last:], fp[last:])]
    if kept:
        yield links(*kept[0])


def block_keys(fp: Column) -> Column:
    """Under radius 2, the six keys of which two linked fingerprints share at least one: two of four blocks each."""
    blocks = [F.shiftrightunsigned(fp, i * BLOCK_BITS).bitwiseAND((1 << BLOCK_BITS) - 1) for i in range(BLOCKS)]
    keys = [F.lit(n << 2 * BLOCK_BITS).bitwiseOR(F.shiftleft(blocks[i], BLOCK_BITS)).bitwiseOR(blocks[j]) for n, (i, j) in enumerate(combinations(range(BLOCKS), BLOCKS - RADIUS))]
    return F.array(*keys)


def links(distinct: DataFrame) -> DataFrame:
    """(u, v): spanning stars of the links between the fingerprints of ``distinct`` (fp)."""
    keyed = distinct.select("fp", F.explode(block_keys(F.col("fp"))).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), parts_of("fp")).where("n > 1")
    keyed = met_parts(keyed, sizes, "key", "fp").withColumns({"weight": F.bit_count("fp"), "cuts": F.ceil(F.col("n") / TILE)})
    keyed = keyed.withColumn("cut", F.pmod(F.xxhash64("fp"), F.col("cuts")))

    def unit(*of: Column) -> Column:
        return F.xxhash64("key", *of)

    small = keyed.where("cuts = 1").select(F.col("key").alias("unit"), F.lit(0).alias("side"), "fp")
    # tiles of a large key are (weight, cut); a pair of tiles is named by the lower one, then the higher one
    others = F.explode(F.expr(f"flatten(transform(sequence(weight - {RADIUS}, weight + {RADIUS}), w -> transform(sequence(0L, cuts - 1), c -> struct(w as weight, c as cut))))")).alias("other")
    large = keyed.where("cuts > 1").select("*", others)
    mine, theirs = F.struct("weight", "cut"), F.struct(F.col("other.weight"), F.col("other.cut"))
    large = large.select(F.when(mine <= theirs, unit("weight", "cut", F.col("other.weight"), F.col("other.cut"))).otherwise(unit(F.col("other.weight"), F.col("other.cut"), "weight", "cut")).alias("unit"), F.when(mine <= theirs, 0).otherwise(1).alias("side"), "fp")
    spark = distinct.sparkSession
    python_tasks(spark)
    dealt = small.union(large).repartition("unit").sortWithinPartitions("unit")
    return dealt.mapInArrow(lambda batches: _links(batches, RADIUS), "u long, v long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): component_id is the smallest doc_id that links reach."""
    fps = stage(fingerprints(docs, doc_id, text), "fingerprints")
    distinct = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), parts_of("doc_id")), "distinct")
    roots = components(links(distinct.select("fp")))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", "_parts", F.coalesce("root", "fp").alias("root"))
    of_fp = with_group(rooted.withColumnRenamed("_parts", "_docs"), "root", "fp", F.min("first").alias("component_id"))
    return met_parts(fps, of_fp.select("fp", "component_id", F.col("_docs").alias("_parts")), "fp", "doc_id").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


# Near copies at a stated similarity: 64 bits are too few to tell 0.8 from 0.7, so the sketch that picks candidates has WIDE_WORDS
# words, and the shingles themselves decide.

WIDE_WORDS = 4
SIMILARITY = 0.8
WIDE_SHINGLE = 5
#: Keys of a text, each of KEY_ROWS minima over its shingles; texts of similarity 0.8 share one with a probability of 0.9996.
KEYS, KEY_ROWS = 20, 5
#: Standard deviations of the sketches' distance that a candidate may lie beyond the expected one.
SPARE = 4
#: Texts of one tile where shingles are compared.
EXACT_TILE = 512
#: Candidates whose ids are broadcast to the texts; more meet them in a join.
BROADCAST_CANDIDATES = 500_000
_odd = np.random.default_rng(42).integers(0, 1 << 63, KEYS * KEY_ROWS + WIDE_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def wide_radius(similarity: float = SIMILARITY, spare: float = SPARE, bits: int = 64 * WIDE_WORDS) -> int:
    """Bits that two sketches of this Jaccard similarity differ in, with ``spare`` standard deviations to spare: a bit differs with the
    probability (angle between the shingle vectors) / pi."""
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(bits * p + spare * np.sqrt(bits * p * (1 - p)))


def shingle_hashes(text: bytes | None, shingle: int = WIDE_SHINGLE, distinct: bool = True) -> np.ndarray:
    """The hashes of a text's word shingles, distinct and sorted or as they come; a shingle's is made of its words' hashes in their order."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    k = min(shingle, len(words))
    word = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), np.uint64)
    h = word[: len(word) - k + 1].copy()
    for i in range(1, k):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h += word[i : len(word) - k + 1 + i]
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return np.unique(h) if distinct else h


def set_name(h: np.ndarray) -> int:
    """A signed 64-bit name of a set of shingles."""
    return int(np.uint64(xxhash.xxh64_intdigest(h.tobytes())).view(np.int64))


def wide_sketch(h: np.ndarray, words: int = WIDE_WORDS, keys: int = KEYS, key_rows: int = KEY_ROWS) -> tuple[list[int], list[int]]:
    """SimHash of shingles in ``words`` words (of WIDE_WORDS; the others are zero), and the keys. A text without words has zeros."""
    if not len(h):
        return [0] * WIDE_WORDS, [0] * keys
    lows = np.full(keys * key_rows, ~np.uint64(0))
    ones = np.zeros(64 * words, np.int64)
    for at in range(0, len(h), 4080):
        part = h[at : at + 4080]
        lows = np.minimum(lows, (part[:, None] * _odd[None, WIDE_WORDS : WIDE_WORDS + keys * key_rows]).min(axis=0))
        mixed = part[:, None] * _odd[None, :words]
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        bits = np.unpackbits(mixed.view(np.uint8), axis=1)
        for b in range(0, len(bits), 255):  # sums of up to 255 rows fit in a byte
            ones += bits[b : b + 255].sum(axis=0, dtype=np.uint8)
    key = np.zeros(keys, np.uint64)
    for r in range(key_rows):
        key = (key ^ lows[r::key_rows]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return [*np.packbits(2 * ones > len(h)).view(np.int64).tolist(), *[0] * (WIDE_WORDS - words)], key.view(np.int64).tolist()


def near(x: np.ndarray, y: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64) <= radius


def sketch_links(left: tuple, right: tuple | None, radius: int, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Spanning star of the pairs within ``radius`` between two tiles (or within one); a tile is (nodes, sketches)."""
    def rising(tile: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        weight = np.bitwise_count(tile[1]).sum(axis=1, dtype=np.int64)
        order = np.argsort(weight, kind="stable")
        return tile[0][order], tile[1][order], weight[order]

    ids, x, w = rising(left)
    others, y, v = (ids, x, w) if right is None else rising(right)
    a, b = [ids[:0]], [ids[:0]]
    for i in range(0, len(ids), step):
        for j in range(i if right is None else 0, len(others), step):
            if v[j] - w[min(i + step, len(ids)) - 1] > radius:
                break
            if w[i] - v[min(j + step, len(others)) - 1] > radius:
                continue
            p, q = np.nonzero(near(x[i : i + step, None], y[None, j : j + step], radius))
            u, r = forest(ids[i : i + step][p], others[j : j + step][q])
            a.append(u)
            b.append(r)
    return np.concatenate(a), np.concatenate(b)


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets of shingles (sorted, distinct) are of ``similarity`` or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and both / (len(a) + len(b) - both) >= similarity


def exact_links(left: tuple, right: tuple | None, radius: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the parts of the graph of pairs of ``similarity`` between two tiles (or within one); a tile is (nodes, sketches,
    sets of shingles). Only pairs that other links have joined already are not compared."""
    ids, x, sets = left if right is None else (np.concatenate([left[0], right[0]]), np.concatenate([left[1], right[1]]), [*left[2], *right[2]])
    size = np.array([len(s) for s in sets])
    part = np.unique(ids, return_inverse=True)[1]
    first = 0 if right is None else len(left[0])
    a, b = [], []
    for i in range(len(left[0])):
        start = max(first, i + 1)
        open_ = near(x[start:], x[i], radius) & (part[start:] != part[i]) & (np.minimum(size[start:], size[i]) >= similarity * np.maximum(size[start:], size[i]) - 1e-6)
        for j in np.flatnonzero(open_) + start:
            if part[j] != part[i] and alike(sets[i], sets[j], similarity):
                part[part == part[j]] = part[i]
                a.append(ids[i])
                b.append(ids[j])
    return np.array(a, np.int64), np.array(b, np.int64)


def wide_links(batches: Iterator[pa.RecordBatch], radius: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """(u, v): links of rows (unit, side, node, f0, ...) in the order of unit. A run of one unit is one tile (side 0), or a pair of tiles
    (sides 0 and 1). If rows have sets of shingles too, those decide, else the sketches."""

    def links(unit: np.ndarray, side: np.ndarray, node: np.ndarray, f: np.ndarray, sets: list[np.ndarray]) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
        size = np.diff(np.r_[cuts, len(unit)])
        pairs = np.add.reduceat(side, cuts) > 0
        a, b = [node[:0]], [node[:0]]
        short = (size <= SHORT_RUN) & ~pairs & (not sets)
        if short.any():
            run = np.repeat(np.where(short, 0, SHORT_RUN + 1), size)
            for d in range(1, min(SHORT_RUN, len(unit))):
                i = np.flatnonzero((unit[d:] == unit[:-d]) & (run[d:] <= SHORT_RUN))
                if not len(i):
                    break
                i = i[near(f[i + d], f[i], radius)]
                a.append(node[i + d])
                b.append(node[i])
        for at, n, pair in zip(cuts[~short], size[~short], pairs[~short], strict=True):
            rows = np.arange(at, at + n)
            tiles = [rows[side[rows] == 0], rows[side[rows] == 1]] if pair else [rows]
            if not len(tiles[0]):
                continue
            left, *right = ((node[t], f[t], [sets[k] for k in t] if sets else []) for t in tiles)
            other = right[0] if pair else None
            u, r = exact_links(left, other, radius, similarity) if sets else sketch_links(left, other, radius)
            a.append(u)
            b.append(r)
        u, v = forest(np.concatenate(a), np.concatenate(b))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    kept: list[tuple] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        f = np.stack([batch.column(3 + w).to_numpy() for w in range(WIDE_WORDS)], 1).view(np.uint64)
        sets: list[np.ndarray] = []
        if batch.num_columns > 3 + WIDE_WORDS:
            lists = batch.column(3 + WIDE_WORDS)
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
            sets = [values[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        kept.append((*(batch.column(i).to_numpy() for i in range(3)), f, sets))
        if kept[0][0][0] == kept[-1][0][-1]:
            continue  # one run so far
        unit, side, node, f = (np.concatenate(c) for c in list(zip(*kept, strict=True))[:4])
        sets = [s for k in kept for s in k[4]]
        last = int(np.searchsorted(unit, unit[-1]))  # the last run may go on in the next batch
        yield links(unit[:last], side[:last], node[:last], f[:last], sets[:last])
        kept = [(unit[last:], side[last:], node[last:], f[last:], sets[last:])]
    if kept:
        unit, side, node, f = (np.concatenate(c) for c in list(zip(*kept, strict=True))[:4])
        yield links(unit, side, node, f, [s for k in kept for s in k[4]])


def key_links(rows: DataFrame, similarity: float, tile: int, deals: int = 1, radius: int | None = None) -> DataFrame:
    """(u, v): links that join all rows (key, node, f0, ..., sets of shingles or none) of one key that links of any two of them join.
    A key of more than ``tile`` rows is dealt to cuts, each compared in itself. Then all that a key still has to compare are pairs of
    different components: the rows outside of its largest one against all, in tile pairs. So a large group of copies costs in
    proportion to its size, and no pair of a key is left out."""
    own = rows.columns[2:]
    radius = wide_radius(similarity) if radius is None else radius
    sizes = stage(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), parts_of("node")).where("n > 1"), "wide-sizes")
    python_tasks(rows.sparkSession)

    def dealt(met: DataFrame) -> DataFrame:
        return stage(met.repartition("unit").sortWithinPartitions("unit").mapInArrow(lambda batches: wide_links(batches, radius, similarity), "u long, v long"), "wide-links")

    sized = met_parts(rows, sizes, "key", "node", hint="merge").withColumn("cuts", F.ceil(F.col("n") / tile))
    if deals > 1:
        sized = sized.withColumn("deal", F.explode(F.when(F.col("cuts") > 1, F.sequence(F.lit(1), F.lit(deals))).otherwise(F.array(F.lit(1)))))
    else:
        sized = sized.withColumn("deal", F.lit(1))
    cut = F.pmod(F.xxhash64("node", "key", "deal"), F.col("cuts"))
    first = dealt(sized.select(F.when(F.col("cuts") == 1, F.col("key")).otherwise(F.xxhash64("key", "deal", cut)).alias("unit"), F.lit(0).alias("side"), "node", *own))
    large = sizes.where(F.col("n") > tile).select("key", "_parts")
    if large.isEmpty():
        return first
    labelled = met_parts(rows, large, "key", "node").join(components(first), "node", "left").withColumn("label", F.coalesce("root", "node"))
    groups = labelled.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    tops = groups.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("top")).withColumn("m", F.col("n") - F.col("top.n"))
    tops = stage(tops.where("m > 0").select("key", F.col("top.label").alias("top"), F.ceil(F.col("n") / tile).alias("cuts"), F.ceil(F.col("m") / tile).alias("others")), "wide-tops")
    if tops.isEmpty():
        return first
    open_ = met_parts(labelled, tops.join(large, "key"), "key", "node")
    a, b = F.pmod(F.xxhash64("node", "key"), F.col("cuts")), F.pmod(F.xxhash64("node", "key"), F.col("others"))
    left = open_.select("key", a.alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)).alias("b"), F.lit(0).alias("side"), "node", *own)
    right = open_.where("label <> top").select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)).alias("a"), b.alias("b"), F.lit(1).alias("side"), "node", *own)
    return first.union(dealt(left.union(right).select(F.xxhash64("key", "a", "b").alias("unit"), "side", "node", *own)))


SKETCH = [f"f{i}" for i in range(WIDE_WORDS)]
SKETCH_TYPES = ", ".join(f"{f} long" for f in SKETCH)


def sketched(texts: DataFrame, shingle: int = WIDE_SHINGLE, distinct: bool = True, **sketch: int) -> tuple[DataFrame, DataFrame]:
    """Of ``texts`` (doc_id, text), staged: (doc_id, name of its set of shingles), and for each set (name, sketch, node, keys), the
    node being the smallest doc_id. Without ``distinct`` the shingles of a text are taken with their repeats and in their order."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_hashes(t, shingle, distinct) for t in pc.cast(batch.column(1), pa.binary()).to_pylist()]
        made = [wide_sketch(h, **sketch) for h in sets]
        cols = [pa.array([m[0][w] for m in made], pa.int64()) for w in range(WIDE_WORDS)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(set_name, sets), pa.int64()), *cols, pa.array([m[1] for m in made], pa.list_(pa.int64()))], ["doc_id", "name", *SKETCH, "keys"])

    sketches = stage(per_text(texts.select("doc_id", "text"), run, f"doc_id long, name long, {SKETCH_TYPES}, keys array<long>"), "sketches")
    # a set has one sketch and one list of keys, so any of them will do
    return sketches.select("doc_id", "name"), stage(sketches.groupBy("name", *SKETCH).agg(F.min("doc_id").alias("node"), parts_of("doc_id"), F.first("keys").alias("keys")), "sketches-distinct")


def rooted(of: DataFrame, distinct: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc_id, component_id): the root is a component's smallest node, and a node is the smallest doc_id of its set."""
    found = distinct.select("name", "node", "_parts").join(roots, "node", "left").select("name", "_parts", F.coalesce("root", "node").alias("component_id"))
    return met_parts(of, found, "name", "doc_id").select("doc_id", "component_id")


#: The sketches that decide alone: their words and keys, of which texts of 0.8 share one with a probability of 0.995, of 0.5 with 0.48.
LIGHT = {"words": 2, "keys": 10, "key_rows": 4}


def sketch_components(texts: DataFrame, similarity: float, tile: int = TILE) -> DataFrame:
    """(doc_id, component_id): components of ``texts`` (doc_id, text) as similar_components, but light sketches at most as far apart as
    expected decide, not the shingles."""
    of, distinct = sketched(texts.where("doc_id is not null"), distinct=False, **LIGHT)
    rows = distinct.select(F.explode("keys").alias("key"), "node", *SKETCH)
    return rooted(of, distinct, components(key_links(rows, similarity, tile, radius=wide_radius(similarity, 0, 64 * LIGHT["words"]))))


def similar_components(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = WIDE_SHINGLE, tile: int = TILE) -> DataFrame:
    """(doc_id, component_id): components of texts whose sets of word shingles are of ``similarity`` or more. Texts meet under keys of
    minima, and sketches close to one another make them candidates; within the components of the candidates the shingles decide.
    Texts of equal sets are one row throughout."""
    f, words = SKETCH, SKETCH_TYPES
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    of, distinct = sketched(texts, shingle)
    roots = components(key_links(distinct.select(F.explode("keys").alias("key"), "node", *f), similarity, tile))
    roots = roots.union(roots.select("root", "root").distinct())
    nodes = distinct.select("node", "name", *f)
    candidates = stage(nodes.join(roots, "node").select("node", F.col("name").alias("of"), F.col("root").alias("key"), *f), "candidates")
    few = candidates.count() <= BROADCAST_CANDIDATES
    met = texts.join(F.broadcast(candidates) if few else candidates, F.col("doc_id") == F.col("node")).select("text", "of", "key", "node", *f)

    def shingles(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_hashes(t, shingle) for t in pc.cast(batch.column(0), pa.binary()).to_pylist()]
        own = pa.array([set_name(h) == n for h, n in zip(sets, batch.column(1).to_pylist(), strict=True)], pa.bool_())  # rows of one doc_id may differ in text
        lists = pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([*batch.columns[2:], lists], ["key", "node", *f, "shingles"]).filter(own)

    sets = stage(per_text(met, shingles, f"key long, node long, {words}, shingles array<long>"), "shingle-sets")
    # two deals, so that the cuts of a large group of copies are joined through one another
    return rooted(of, distinct, components(key_links(sets, similarity, min(tile, EXACT_TILE), 2)))


def one_of_each(docs: DataFrame) -> DataFrame:
    """Pipeline stage: of each component of near copies the document of the smallest doc_id stays (rows of one doc_id stay or go
    together); rows without a doc_id stay."""
    # the ids that go are staged, so that Spark knows their size: few are broadcast, and the texts are not shuffled
    gone = stage(similar_components(docs).where("doc_id <> component_id").select("doc_id").distinct(), "copies")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
