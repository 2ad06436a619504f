"""Pattern packing (operator 7): sequences of a fixed length filled by patterns of a few documents.

Texts are tokenised once; only a text longer than a sequence is cut, its first piece being the short one, so that every other
piece fills a sequence alone. What is left to pack is a histogram: how many pieces have each length below the capacity. That
has at most ``capacity`` bars at any corpus size and is all that reaches the driver. Patterns of one to four pieces whose lengths add
up to (nearly) the capacity are enumerated from the bars, repeat counts are fitted to the histogram by non-negative least squares,
a share of them is rounded down, and the residual is packed best fit, bar by bar. Pieces are then dealt to the slots of the patterns by their
rank within their length. That rank is (pieces of the length in earlier parts) + (rank within the part), so no length, however
frequent, is ever gathered in one task.

Defined results: a null or empty text is one piece, the end token alone; repeated rows are packed one by one; an empty table gives an
empty result; further columns of the input are not looked at.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import python_tasks, stage, table
from weftline.llm.token_counts import PLAIN, byte_letters, vocabulary_path

CAPACITY = 1024
END = 2
VOCABULARY = "byte_bpe_50k.json"
#: The split of byte-level vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Shares of the fitted counts that are tried.
SHARES = (1.0, 0.9, 0.8, 0.7, 0.6, 0.5)
#: Rows of (length, part, pieces) that are broadcast, a few MB; more meet the pieces in a merge join.
BROADCAST_PARTS = 500_000


class Encoder:
    """Token ids of texts, as little-endian unsigned 32-bit integers, exactly as the tokenizers library gives them. Texts of a plain
    alphabet without special strings go through a faster engine with the same vocabulary, whose ids are the merge order."""

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        byte = {c: b for b, c in byte_letters().items()}
        with open(path, encoding="utf-8") as f:
            ranks = {bytes(map(byte.__getitem__, t)): i for t, i in json.load(f)["model"]["vocab"].items() if t not in self.special}
        self.fast = tiktoken.Encoding(path, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> bytes:
        if PLAIN.fullmatch(text) and not any(x in text for x in self.special):
            return self.fast.encode_to_numpy(text).astype("<u4", copy=False).tobytes()
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, doc_id, piece, start, length, ids_crc32, nth): nth counts the pieces of this length within the task ``part``."""
    python_tasks(docs.sparkSession)
    schema = "part int, doc_id long, piece int, start long, length long, ids_crc32 long, nth long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen, enc = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), encoder(path)
        last = np.array([end], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = enc.ids(t or "") + last
                n = len(ids) // 4
                at, k = 0, 0
                size = n % capacity or capacity
                while at < n:
                    seen[size] += 1
                    rows.append((part, doc, k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), int(seen[size]) - 1))
                    at, k, size = at + size, k + 1, capacity
            if rows:
                names = [x.split()[0] for x in schema.split(", ")]
                kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def patterns(hist: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of four lengths (0: none) that add up to the capacity, or to as much as the bars of the histogram allow: for a
    pair, triple or quadruple, all but the last length are taken from the bars and the last is the longest bar that still fits.
    Every bar is in a single and a pair; their number is bound by the choice of bars, some 17,000 at a capacity of 1,024."""
    bars = np.flatnonzero(hist)
    bars = bars[(bars > 0) & (bars < capacity)]
    if not len(bars):
        return np.zeros((0, 4), np.int64)
    fits = np.zeros(capacity + 1, np.int64)  # the longest bar that fits in so much room
    fits[bars] = bars
    fits = np.maximum.accumulate(fits)
    rows = [np.stack([bars, *[np.zeros_like(bars)] * 3], 1)]
    room = capacity - bars
    rows.append(np.stack([bars, fits[room], *[np.zeros_like(bars)] * 2], 1))
    often = bars[np.argsort(-hist[bars], kind="stable")]
    for k, few in ((3, 150), (4, 24)):  # combinations of the most frequent bars, then of bars spread over all lengths
        for base in (often[:few], bars[np.linspace(0, len(bars) - 1, min(few, len(bars))).astype(int)]):
            mesh = np.stack(np.meshgrid(*[base] * (k - 1), indexing="ij"), -1).reshape(-1, k - 1)
            mesh = mesh[(np.diff(mesh, axis=1) <= 0).all(1)]
            left = capacity - mesh.sum(1)
            mesh, left = mesh[left > 0], left[left > 0]
            rows.append(np.concatenate([mesh, fits[left][:, None], np.zeros((len(mesh), 4 - k), np.int64)], 1))
    found = np.unique(-np.sort(-np.concatenate(rows), axis=1), axis=0)
    return found[np.argsort(-found.sum(1), kind="stable")]


def fit(rows: np.ndarray, hist: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative least squares of the patterns' repeat counts against the histogram, by multiplicative steps: each step
    scales a pattern's count by (bars wanted) / (bars given) along it, which keeps counts non-negative and lowers the error."""
    n = len(rows)
    if not n:
        return np.zeros(0)
    want = hist.astype(float)
    use = rows > 0

    def along(bars: np.ndarray) -> np.ndarray:
        return (bars[rows] * use).sum(1)

    def given(x: np.ndarray) -> np.ndarray:
        return np.bincount(rows[use], np.repeat(x, use.sum(1)), len(hist))

    x = along(want) / np.maximum(use.sum(1), 1)
    x *= want.sum() / max(given(x).sum(), 1)
    top = along(want)
    for _ in range(rounds):
        x *= top / np.maximum(along(given(x)), 1e-9)
    return x


def plan(hist: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, repeats) that hold exactly the histogram's pieces; its size is bound by the capacity, not by the corpus.
    Patterns that fill the capacity take a share of their fitted counts, rounded down, and best fit packs the residual, which packs
    the better the more is left of it: of the plans with the SHARES, the one of the fewest sequences is kept."""
    below = hist.astype(np.int64).copy()
    full = [((capacity,), int(below[capacity]))] if below[capacity] else []
    below[capacity] = 0
    rows = patterns(below, capacity)
    rows = rows[rows.sum(1) == capacity]
    counts = fit(rows, below)
    order = np.argsort(-counts, kind="stable")

    def made(share: float) -> list[tuple[tuple[int, ...], int]]:
        left, out = below.copy(), []
        for i in order:
            lengths = tuple(int(v) for v in rows[i] if v)
            many = int(min(share * counts[i], min(left[v] // lengths.count(v) for v in lengths)))
            if many > 0:
                out.append((lengths, many))
                for v in lengths:
                    left[v] -= many
        return out + best_fit(left, capacity)

    return full + min(map(made, SHARES), key=lambda plan: sum(many for _, many in plan))


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing by bars: the longest bar opens sequences, each then takes the longest piece that fits, again and
    again; as many sequences as the bars allow are filled alike at once."""
    left, out = left.copy(), []
    top = capacity
    while True:
        while top and not left[top]:
            top -= 1
        if not top:
            return out
        use, room = [], capacity
        v = top
        while room > 0 and v > 0:
            v = min(v, room)
            while v and left[v] <= use.count(v):
                v -= 1
            if v:
                use.append(v)
                room -= v
        many = int(min(left[v] // use.count(v) for v in use))
        for v in use:
            left[v] -= many
        out.append((tuple(use), many))


def slots(made: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[str, np.ndarray]:
    """The plan by length: for pieces of a length in the order of their ranks, where each run of ranks goes."""
    rows, sequence, used = [], 0, np.zeros(capacity + 1, np.int64)
    for lengths, many in made:
        offset = 0
        for v in lengths:
            rows.append((v, used[v], sequence, offset))
            used[v] += many
            offset += v
        sequence += many
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 4)
    return {"length": a[:, 0], "first": a[:, 1], "sequence": a[:, 2], "offset": a[:, 3]}


def packed(rows: DataFrame, capacity: int = CAPACITY, broadcast_limit: int = BROADCAST_PARTS) -> DataFrame:
    """Staged pieces with sequence_id and offset."""
    counts = stage(rows.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "histogram")
    hist = np.zeros(capacity + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # at most ``capacity`` rows
        hist[length] = n
    where = slots(plan(hist, capacity), capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    earlier = F.broadcast(earlier) if counts.count() <= broadcast_limit else earlier.hint("merge")
    ranked = rows.join(earlier, ["length", "part"]).withColumn("rank", F.col("earlier") + F.col("nth"))
    span = int(max(hist.max(), 1))
    keys = where["length"] * span + where["first"]  # in order, as the slots are

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            i = np.searchsorted(keys, length * span + rank, side="right") - 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(where["sequence"][i] + rank - where["first"][i]), pa.array(where["offset"][i])], [*names, "sequence_id", "offset"])

    python_tasks(rows.sparkSession)
    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    return packed(stage(pieces(docs, path, capacity, end, doc_id, text), "pieces"), capacity)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary_path(VOCABULARY))
