"""Benchmark decontamination (operator 3): the q-gram lemma filters, a banded alignment decides.

An item of m characters that occurs in a text with at most k edits keeps at least m - Q + 1 - k * Q of its q-grams, and their
diagonals (place in the text less place in the item) differ by at most k. So q-grams shared with an item are counted in
overlapping diagonal bands 2k wide, k apart; a band that reaches the item's count is a region to verify by a banded alignment
(exact edit distance of the item to the best stretch of the region). No occurrence within the budget is missed.

Texts and items are compared in lower case with white space runs as one space. The items are the stated query set: they go to
the tasks in blocks of at most BLOCK_CHARS characters, one pass over the documents for each block.

Defined results: null and empty texts or items match nothing; an item shorter than Q is found as it stands, with a word's end at
both sides; repeated rows match one by one; of several places of an item in a text the one with the fewest edits (then the first)
is given; an empty table on either side gives an empty result; the input's further columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import per_text, stage, table

Q = 8
#: Edits allowed, as a share of the item's characters.
EDIT_RATE = 0.1
BLOCK_CHARS = 8_000_000
#: Characters of documents that a task looks at together.
GROUP_CHARS = 1_000_000
TABLE_BITS = 20


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def grams(codes: np.ndarray) -> np.ndarray:
    """A 64-bit name of the Q characters from each place on."""
    h = codes.astype(np.uint64)
    for step, factor in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F), (4, 0x165667B19E3779F9)):
        if len(h) <= step:
            return h[:0]
        h = h[:-step] * np.uint64(factor) + h[step:]
        h ^= h >> np.uint64(29)
    return h


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def edits_allowed(m: int, rate: float = EDIT_RATE) -> int:
    """The edit budget; never so large that fewer than two q-grams need be shared."""
    return max(0, min(int(m * rate), (m - Q - 1) // Q))


def aligned(item: np.ndarray, region: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the stretch of ``region`` nearest to ``item``, if at most ``most`` edits away. The region begins and
    ends at most ``most`` beyond the band's diagonals, so all its columns are the band."""
    m, n = len(item), len(region)
    width = np.arange(n + 1)
    cost = np.zeros(n + 1, np.int32)  # a match may start anywhere
    start = width.copy()
    for i in range(m):
        lo, hi = max(0, i - most), min(n, n - m + i + most + 1)  # cells from which the item can still end in the region
        step = np.full(n + 1, m + n, np.int32)
        step[0] = cost[0] + 1
        diag = cost[lo:hi] + (region[lo:hi] != item[i])
        up = cost[lo + 1 : hi + 1] + 1
        step[lo + 1 : hi + 1] = np.minimum(diag, up)
        origin = np.empty_like(start)
        origin[0] = start[0]
        origin[lo + 1 : hi + 1] = np.where(diag <= up, start[lo:hi], start[lo + 1 : hi + 1])
        slope = step - width
        low = np.minimum.accumulate(slope)
        first = np.maximum.accumulate(np.where(slope == low, width, 0))  # where the insertions that end here began
        cost = (low + width).astype(np.int32)
        start = origin[first]
        if cost.min() > most:
            return None
    end = int(np.argmin(cost))
    return (int(cost[end]), int(start[end]), end) if cost[end] <= most else None


class Items:
    """The q-gram index of one block of items."""

    def __init__(self, items: list[tuple[int, str]], rate: float) -> None:
        self.ids = [i for i, _ in items]
        self.texts = [normal(t) for _, t in items]
        self.codes = [codes_of(t) for t in self.texts]
        self.short = [n for n, c in enumerate(self.codes) if 0 < len(c) < Q]
        own = [grams(c) for c in self.codes]
        sizes = [len(g) for g in own]
        names = np.concatenate([*own, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(own)), sizes)
        place = np.concatenate([np.arange(n) for n in sizes] or [np.zeros(0, int)]).astype(np.int64)
        order = np.argsort(names, kind="stable")
        self.item, self.place = item[order], place[order]
        self.names, self.first, self.many = np.unique(names[order], return_index=True, return_counts=True)
        self.budget = np.array([edits_allowed(len(c), rate) for c in self.codes] or [0])
        self.needed = np.array([max(1, len(c) - Q + 1 - int(k) * Q) for c, k in zip(self.codes, self.budget, strict=False)] or [1])
        self.least = int(self.needed.min())
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[(self.names >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True

    def regions(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """(item, lowest diagonal) of the bands that reach their item's count, once for each region."""
        h = grams(codes)
        at = np.flatnonzero(self.table[(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
        name = np.minimum(np.searchsorted(self.names, h[at]), len(self.names) - 1)
        same = self.names[name] == h[at] if len(self.names) else np.zeros(0, bool)
        at, low, many = at[same], self.first[name[same]], self.many[name[same]]
        if not len(at):
            return []
        post = np.repeat(low - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
        item, diagonal = self.item[post], np.repeat(at, many) - self.place[post]
        wide = 2 * np.maximum(self.budget[item], 1)
        out = []
        span = len(codes) + 4 * max(map(len, self.codes))
        longest = max(map(len, self.codes))
        for half in (0, 1):
            band = (diagonal + longest + half * (wide // 2)) // wide
            key = item * span + band
            # bins of hashed bands first: only those with enough q-grams for some item are counted apart
            bin_ = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(46)).astype(np.int64)
            some = np.bincount(bin_, minlength=1 << 18)[bin_] >= self.least
            pairs = np.unique(key[some] * longest + self.place[post[some]])  # an item's q-gram counts once in a band
            key, n = np.unique(pairs // longest, return_counts=True)
            found = key // span
            reach = n >= self.needed[found]
            for i, b in zip(found[reach].tolist(), (key[reach] % span).tolist(), strict=True):
                w = 2 * max(int(self.budget[i]), 1)
                out.append((i, b * w - half * (w // 2) - longest))
        return out

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits) in a normalised text."""
        return self.matches_of([text])[0]

    def matches_of(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        """As ``matches``, for texts looked at together."""
        codes = [codes_of(t) for t in texts]
        gap = np.full(1, 0x110000, np.uint32)
        starts = np.cumsum([0, *[len(c) + 1 for c in codes]])
        best: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
        for i, diagonal in self.regions(np.concatenate([x for c in codes for x in (c, gap)] or [gap])):
            m, k = len(self.codes[i]), int(self.budget[i])
            w = 2 * max(k, 1)
            doc = int(np.searchsorted(starts, diagonal + w // 2 + m // 2, side="right")) - 1
            for d in {max(0, doc - 1), min(len(texts) - 1, max(doc, 0)), min(len(texts) - 1, doc + 1)}:
                lo, hi = max(0, diagonal - k - int(starts[d])), min(len(codes[d]), diagonal + w + m + k - int(starts[d]))
                if hi - lo < m - k or best[d].get(i, (1,))[0] == 0:
                    continue
                at = texts[d].find(self.texts[i], lo, hi)
                got = (0, at, at + m) if at >= 0 else aligned(self.codes[i], codes[d][lo:hi], k)
                if got:
                    got = got if at >= 0 else (got[0], got[1] + lo, got[2] + lo)
                    best[d][i] = min(best[d].get(i, got), got)
        for d, t in enumerate(texts):
            for i in self.short:
                at = f" {t} ".find(f" {self.texts[i]} ")
                if at >= 0:
                    best[d][i] = (0, at, at + len(self.texts[i]))
        return [[(i, s, e, n) for i, (n, s, e) in sorted(b.items())] for b in best]


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, start, end, edits): the items found in each document; places are those of the normalised text."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("length(text) > 0")
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // BLOCK_CHARS))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, item_id long, start long, end long, edits int"
    found = None
    for n in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == n).collect() if blocks > 1 else items.collect()
        index = docs.sparkSession.sparkContext.broadcast(Items([(r.item_id, r.text) for r in block], rate))

        def run(batch: pa.RecordBatch, index=index) -> pa.RecordBatch:
            items, out = index.value, []
            group: list[tuple[int, str]] = []
            size = 0
            texts = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for doc, t in [*((d, normal(t)) for d, t in texts if t), (None, None)]:
                if t is None or size > GROUP_CHARS:
                    for (d, _), m in zip(group, items.matches_of([x for _, x in group]) if group else [], strict=True):
                        out += [(d, items.ids[i], s, e, k) for i, s, e, k in m]
                    group, size = [], 0
                if t is not None:
                    group.append((doc, t))
                    size += len(t)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], k) for c, k in enumerate(kinds)], ["doc_id", "item_id", "start", "end", "edits"])

        part = per_text(rows, run, schema) if block else docs.sparkSession.createDataFrame([], schema)
        found = part if found is None else found.unionByName(part)
    return found


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pipeline stage: documents that hold no benchmark item (rows without a doc_id stay)."""
    found = stage(leaks(docs, benchmark).select("doc_id").distinct(), "leaks")  # of a known size: few ids are broadcast
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)
