"""Exact removal of repeated strings (operator 6) by bucket-pointer refinement over sampled suffixes.

Sorting all suffixes of a corpus is avoided by sampling: every
window of LENGTH bytes owns the suffix at its smallest q-gram name (the leftmost of equals). That choice depends on the
window's bytes alone, so equal windows own suffixes of one bucket, at one offset. A suffix's region is what its windows cover.

1. Initial buckets: the q-gram names at the sampled suffixes are counted over the corpus. Buckets of one suffix are done.
2. A bucket whose suffixes all have one region name is done too: all of it is repeated.
3. The other buckets are refined by bucket pointers: the suffixes of their bytes start in exact buckets of GRAM_BYTES bytes; each
   round sorts those of a bucket on the identifiers of the buckets at a later offset, renumbers them and doubles the offset; the
   next round reuses the new identifiers, until they stand for LENGTH bytes. Suffixes alone in their bucket leave the rounds.
4. A bucket of more than HOT_REGIONS regions is too large for a task: names of blocks of its windows are counted, then of the
   windows of the blocks at the ends of what is repeated; all counts are combined before a shuffle.

A region's repeated windows overlap, so they are one span; spans join the texts again by document. Step 3 compares bytes. Steps 1, 2
and 4 use 64-bit names made by doubling, within a bucket of its own 64-bit name, so two different strings are taken for equal
with a probability of about 2**-100 a pair.

Defined results: a null text counts as empty (0 bytes, nothing removed, the hash of no bytes); a text shorter than LENGTH loses nothing;
repeated rows are each other's copies and lose all that lies in windows; an empty table gives an empty result; further columns of the
input are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import per_text, python_tasks, stage, table

LENGTH = 200
GRAM = 48
WINDOWS = LENGTH - GRAM + 1
GRAM_BYTES = 8
HOT_REGIONS = 500
BLOCK_OFFSETS = 16
BROADCAST_BUCKETS = 4_000_000
#: Bytes of documents that are looked at together, and of a long document's block.
GROUP_BYTES = 1 << 17
BLOCK_BYTES = 1 << 20
PLACE_BITS = 21
U = np.uint64


def name_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of two names in this order."""
    h = a * U(0x9E3779B97F4A7C15)
    h += b
    h ^= h >> U(31)
    h *= U(0xD6E8FEB86659FD93)
    return h


def doubled(data: np.ndarray, most: int = 128) -> dict[int, np.ndarray]:
    """Names of 32, 64 and 128 bytes from each place on."""
    h = (data.astype(U) + U(1)) * U(0xC2B2AE3D27D4EB4F)
    n, names = 1, {}
    while n < most:
        h = name_of(h[:-n], h[n:])
        n *= 2
        if n >= 32:
            names[n] = h
    return names


def window_names(names: dict[int, np.ndarray], at: np.ndarray) -> np.ndarray:
    return name_of(names[128][at], names[128][at + LENGTH - 128])


def sampled(data: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray] | None:
    """The sampled suffixes of joined texts that end at ``ends``: bucket, region name, first and last window, place."""
    if len(data) < LENGTH:
        return None
    names = doubled(data)
    gram = name_of(names[32][: len(data) - GRAM + 1], names[32][GRAM - 32 : len(data) - 31])
    low = gram & ~U((1 << PLACE_BITS) - 1)
    low |= np.arange(len(low), dtype=U)
    n = 1
    while 2 * n <= WINDOWS:
        low = np.minimum(low[:-n], low[n:])
        n *= 2
    if WINDOWS > n:
        low = np.minimum(low[: n - WINDOWS], low[WINDOWS - n :])
    own = (low & U((1 << PLACE_BITS) - 1)).astype(np.int64)
    starts = np.r_[0, ends[:-1]]
    whole = np.zeros(len(own) + 1, np.int8)  # windows inside one text
    fits = ends - starts >= LENGTH
    np.add.at(whole, starts[fits], 1)
    np.add.at(whole, ends[fits] - LENGTH + 1, -1)
    at = np.flatnonzero(np.cumsum(whole[:-1]))
    if not len(at):
        return None
    own = own[at]
    new = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)])
    first, last, place = at[new], at[np.r_[new[1:], len(at)] - 1], own[new]
    end = last + LENGTH
    h = names[128]
    shape = ((end - first) * 1024 + (place - first)).astype(U)
    region = name_of(name_of(h[first], h[np.minimum(first + 128, end - 128)]), name_of(h[end - 128], shape))
    return {"bucket": gram[place], "region": region, "first": first, "last": last, "place": place}


def groups(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts joined into arrays of moderate size: bytes, ends, and for each part its text's number and where it begins in it."""
    parts: list[bytes] = []
    rows: list[int] = []
    begins: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        for at in range(0, max(len(t), 1), BLOCK_BYTES):
            part = t[at : at + BLOCK_BYTES + LENGTH - 1]
            if len(part) < LENGTH:
                continue
            if parts and size + len(part) > GROUP_BYTES:
                yield np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts]), np.array(rows), np.array(begins)
                parts, rows, begins, size = [], [], [], 0
            parts.append(part)
            rows.append(i)
            begins.append(at)
            size += len(part)
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts]), np.array(rows), np.array(begins)


def binaries(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in pc.cast(column, pa.binary()).to_pylist()]


def longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == U else values.astype(np.int64))


def initial_buckets(texts: DataFrame) -> DataFrame:
    """(bucket, several): the buckets of two suffixes or more; several: they have more than one region name."""
    python_tasks(texts.sparkSession)

    def combined(found: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
        bucket, region = (np.concatenate([f[k] for f in found]).view(np.int64) for k in ("bucket", "region"))
        order = np.lexsort((region, bucket))
        bucket, region = bucket[order], region[order]
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        n = np.diff(np.r_[cuts, len(bucket)])
        return pa.RecordBatch.from_arrays([longs(bucket[cuts]), longs(n), longs(region[cuts]), longs(region[cuts + n - 1])], ["bucket", "n", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for batch in batches:
            for data, ends, _, _ in groups(binaries(batch.column(0))):
                if s := sampled(data, ends):
                    found.append({k: s[k] for k in ("bucket", "region")})
                    size += len(s["bucket"])
            if size > 500_000:  # combined here before the shuffle
                yield combined(found)
                found, size = [], 0
        if found:
            yield combined(found)

    parts = texts.select("text").mapInArrow(run, "bucket long, n long, low long, high long")
    counts = parts.groupBy("bucket").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    return counts.where("n > 1").select("bucket", (F.col("low") != F.col("high")).alias("several"))


def members(rows: DataFrame, broadcast) -> DataFrame:
    """What the texts (doc, hash, text and, without ``broadcast``, the list of its own buckets) have in buckets of two or more.
    Rows with ``bucket`` null: a repeated span from ``first`` to ``last``. Others: a suffix of a bucket to refine, its windows' first
    and last place, and in one row a task and region the region's ``bytes`` with the place in it and the count of its rows here."""
    schema = "doc long, hash long, bucket long, region long, first long, last long, place int, n long, bytes binary"
    python_tasks(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, key, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(), binaries(batch.column(2))
            out: list[pa.RecordBatch] = []
            regions: dict[tuple[int, int], list] = {}
            for data, ends, row, begins in groups(texts):
                s = sampled(data, ends)
                if s is None:
                    continue
                part = np.searchsorted(ends, s["first"], side="right")
                shift = begins[part] - np.r_[0, ends[:-1]][part]  # from places here to places in the text
                if broadcast is not None:
                    names, several = broadcast.value
                    i = np.minimum(np.searchsorted(names, s["bucket"]), max(len(names) - 1, 0))
                    inside = names[i] == s["bucket"] if len(names) else np.zeros(len(i), bool)
                    many = inside & several[i] if len(names) else inside
                else:
                    inside, many = np.zeros(len(part), bool), np.zeros(len(part), bool)
                    for r in np.unique(row[part]):
                        mine = row[part] == r
                        own = {b & (1 << 64) - 1: m for x in batch.column(3)[int(r)].as_py() or () for b, m in [(x["bucket"], x["several"])]}
                        inside[mine] = [int(b) in own for b in s["bucket"][mine]]
                        many[mine] = [own.get(int(b), False) for b in s["bucket"][mine]]
                alone = np.flatnonzero(inside & ~many)
                if len(alone):  # neighbours in one text are one span
                    lo, hi, of = (s["first"] + shift)[alone], (s["last"] + shift)[alone] + LENGTH, row[part][alone]
                    new = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (lo[1:] > hi[:-1])])
                    tail = np.r_[new[1:], len(lo)] - 1
                    k = len(new)
                    nulls = pa.nulls(k, pa.int64())
                    out.append(pa.RecordBatch.from_arrays([longs(doc[of[new]]), longs(key[of[new]]), nulls, nulls, longs(lo[new]), longs(hi[tail]), pa.nulls(k, pa.int32()), nulls, pa.nulls(k, pa.binary())], NAMES))
                several_at = np.flatnonzero(many)
                if len(several_at):
                    of = row[part][several_at]
                    b, r, lo, hi = s["bucket"][several_at], s["region"][several_at], s["first"][several_at], s["last"][several_at]
                    k = len(several_at)
                    out.append(pa.RecordBatch.from_arrays([longs(doc[of]), longs(key[of]), longs(b), longs(r), longs(lo + shift[several_at]), longs(hi + shift[several_at]), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary())], NAMES))
                    for x, y, f, l, p in zip(b.view(np.int64).tolist(), r.view(np.int64).tolist(), lo.tolist(), hi.tolist(), s["place"][several_at].tolist(), strict=True):
                        if got := regions.get((x, y)):
                            got[0] += 1
                        else:
                            regions[x, y] = [1, l - f, p - f, data[f : l + LENGTH].tobytes()]
            if regions:
                k, v = list(regions), list(regions.values())
                nulls = pa.nulls(len(k), pa.int64())
                cols = [nulls, nulls, pa.array([x[0] for x in k], pa.int64()), pa.array([x[1] for x in k], pa.int64()), pa.array([0] * len(k), pa.int64()), pa.array([x[1] for x in v], pa.int64()), pa.array([x[2] for x in v], pa.int32()), pa.array([x[0] for x in v], pa.int64()), pa.array([x[3] for x in v], pa.binary())]
                out.append(pa.RecordBatch.from_arrays(cols, NAMES))
            yield from out

    return rows.mapInArrow(run, schema)


NAMES = ["doc", "hash", "bucket", "region", "first", "last", "place", "n", "bytes"]


def bucket_pointers(data: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Of each place with ``length`` bytes: the identifier of its bucket, which is the same for the same bytes and no others."""
    gram = data[: len(data) - GRAM_BYTES + 1].astype(U)
    for i in range(1, GRAM_BYTES):
        gram = gram << U(8) | data[i : len(data) - GRAM_BYTES + 1 + i]
    pointer = np.unique(gram, return_inverse=True)[1]
    known, top = GRAM_BYTES, len(data)  # bytes the pointers stand for, and a number above all of them
    while known < length:
        later = min(known, length - known)
        pointer, at = pointer[: len(pointer) - later].copy(), pointer[later:]
        active = np.flatnonzero(np.bincount(pointer)[pointer] > 1)  # the others are alone in their buckets, and stay so
        _, renumbered = np.unique(pointer[active] * top + at[active], return_inverse=True)
        settled = np.ones(len(pointer), bool)
        settled[active] = False
        pointer[active] = renumbered
        pointer[settled] = np.arange(len(pointer) - len(active)) + (renumbered.max() + 1 if len(active) else 0)
        known += later
    return pointer


def windows_of(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows with bytes, last and place: each window's row, start in the region, offset of the suffix and place in the joined bytes,
    and those bytes."""
    texts = batch.column("bytes").to_pylist()
    last, place = batch.column("last").to_numpy().astype(np.int64), batch.column("place").to_numpy().astype(np.int64)
    begins = np.r_[0, np.cumsum([len(t) for t in texts])[:-1]].astype(np.int64)
    many = last + 1
    row = np.repeat(np.arange(len(texts)), many)
    start = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    return row, start, place[row] - start, begins[row] + start, np.frombuffer(b"".join(texts), np.uint8)


def refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Regions in the order of their buckets: (bucket, region, first, last), the windows from first to last that are repeated."""

    def refine(t: pa.Table) -> pa.RecordBatch:
        bucket, region, n = (t.column(c).to_numpy() for c in ("bucket", "region", "n"))
        order = np.lexsort((region, bucket))
        b, r = bucket[order], region[order]
        cuts = np.flatnonzero(np.r_[True, (b[1:] != b[:-1]) | (r[1:] != r[:-1])])
        weight = np.add.reduceat(n[order], cuts)
        t, b, r = t.take(pa.array(order[cuts])), b[cuts], r[cuts]
        # whole buckets of moderate size together, so that the sorts stay small
        room = np.cumsum(t.column("last").to_numpy()) // (GROUP_BYTES // 2)
        first = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
        first = first[np.r_[True, room[first[1:]] != room[first[:-1]]]]
        found = []
        for lo, hi in zip(first, np.r_[first[1:], len(b)], strict=True):
            row, start, _, at, data = windows_of(t.slice(lo, hi - lo))
            which = bucket_pointers(data)[at]
            twice = np.bincount(which, weight[lo + row])[which] > 1
            row, start = row[twice], start[twice]
            if len(row):
                new = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                found.append((lo + row[new], start[new], start[np.r_[new[1:], len(row)] - 1]))
        i, low, high = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (first[:0],) * 3
        return pa.RecordBatch.from_arrays([longs(b[i]), longs(r[i]), longs(low), longs(high)], ["bucket", "region", "lo", "hi"])

    kept: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
        bucket = t.column("bucket").to_numpy()
        last = int(np.flatnonzero(bucket != bucket[-1])[-1]) + 1 if bucket[0] != bucket[-1] else 0
        if last:
            yield refine(t.slice(0, last).combine_chunks())
        kept = t.slice(last)
    if kept is not None:
        yield refine(kept.combine_chunks())


def refined_hot(regions: DataFrame) -> DataFrame:
    """As ``refined``, for buckets too large for a task. Windows are refined in blocks of BLOCK_OFFSETS offsets: where the bytes that all
    windows of a block share (its core) are not repeated, none of its windows is; where all the bytes of a block are, all are. Only the
    windows of the other blocks, at the ends of what is repeated, are counted one by one. All counts are combined before a shuffle."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            row, start, offset, _, _ = windows_of(batch)
            block = offset // BLOCK_OFFSETS
            new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (block[1:] != block[:-1])])  # offsets fall as starts rise
            tail = np.r_[new[1:], len(row)] - 1
            texts = batch.column("bytes").to_pylist()
            begins = np.r_[0, np.cumsum([len(t) for t in texts])[:-1]].astype(np.int64)[row[new]]
            names = doubled(np.frombuffer(b"".join(texts), np.uint8))[128]
            place = batch.column("place").to_numpy().astype(np.int64)[row[new]]
            core_at = begins + place - block[new] * BLOCK_OFFSETS  # the start of the block's last window
            core = name_of(name_of(names[core_at], names[core_at + LENGTH - BLOCK_OFFSETS + 1 - 128]), (2 * block[new]).astype(U))
            at = begins + start[new]
            whole = name_of(name_of(names[at], names[np.minimum(at + LENGTH + BLOCK_OFFSETS - 1 - 128, len(names) - 1)]), (2 * block[new] + 1).astype(U))
            full = tail - new + 1 == BLOCK_OFFSETS
            b, r, n = (batch.column(c).to_numpy()[row[new]] for c in ("bucket", "region", "n"))
            yield pa.RecordBatch.from_arrays([longs(b), longs(r), longs(n), longs(block[new]), longs(start[new]), longs(start[tail]), longs(core), pa.array(whole.view(np.int64), mask=~full)], ["bucket", "region", "n", "block", "lo", "hi", "core", "whole"])

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row, start, offset, at, data = windows_of(batch)
                name = window_names(doubled(data), at)
                own = batch.column("blocks")
                wanted = np.concatenate([x.as_py() for x in own]) + 1024 * np.repeat(np.arange(batch.num_rows), [len(x) for x in own])
                keep = np.isin(row * 1024 + offset // BLOCK_OFFSETS, wanted)
                row, start, name = row[keep], start[keep], name_of(offset[keep].astype(U), name[keep])
                b, r, n = (batch.column(c).to_numpy()[row] for c in ("bucket", "region", "n"))
                yield pa.RecordBatch.from_arrays([longs(b), longs(r), longs(start), longs(name), longs(n)], ["bucket", "region", "start", "name", "n"])

    cut = stage(regions.select("bucket", "region", "last", "place", "n", "bytes").mapInArrow(blocks, "bucket long, region long, n long, block long, lo long, hi long, core long, whole long"), "blocks")
    names = cut.select("bucket", "n", F.explode(F.array_compact(F.array("core", "whole"))).alias("name"))
    twice = stage(names.groupBy("bucket", "name").agg(F.sum("n").alias("n")).where("n > 1").select("bucket", "name"), "repeated-blocks")
    alive = cut.join(twice.withColumnRenamed("name", "core"), ["bucket", "core"], "left_semi")
    alive = stage(alive.join(twice.select("bucket", F.col("name").alias("whole"), F.lit(True).alias("all")), ["bucket", "whole"], "left").select("bucket", "region", "block", "whole", "lo", "hi", F.coalesce("all", F.lit(False)).alias("all")), "alive-blocks")
    # a block that is repeated as a whole is looked into once, as windows of other regions may equal windows of it
    once = alive.where("all").groupBy("bucket", "whole").agg(F.min(F.struct("region", "block")).alias("one")).select("bucket", "one.*")
    lists = alive.where("not all").select("bucket", "region", "block").union(once).groupBy("bucket", "region").agg(F.collect_list("block").alias("blocks"))
    windows = regions.join(lists, ["bucket", "region"]).select("bucket", "region", "last", "place", "n", "bytes", "blocks").mapInArrow(opened, "bucket long, region long, start long, name long, n long")
    same = windows.groupBy("bucket", "name").agg(F.sum("n").alias("n")).where("n > 1").select("bucket", "name")
    ends = windows.join(same, ["bucket", "name"], "left_semi").select("bucket", "region", F.col("start").alias("lo"), F.col("start").alias("hi"))
    return alive.where("all").select("bucket", "region", "lo", "hi").union(ends).groupBy("bucket", "region").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def repeated_spans(texts: DataFrame, broadcast_limit: int = BROADCAST_BUCKETS, hot: int = HOT_REGIONS) -> DataFrame:
    """(doc, hash, start, end) of the repeated spans of ``texts`` (doc, hash, text); spans of a text may touch or overlap."""
    spark = texts.sparkSession
    buckets = stage(initial_buckets(texts), "buckets")
    if buckets.count() <= broadcast_limit:
        rows = buckets.toArrow()
        names = rows.column("bucket").to_numpy().view(U)
        order = np.argsort(names)
        several = rows.column("several").to_numpy()
        found = members(texts, spark.sparkContext.broadcast((names[order], several[order])))
    else:
        found = members(with_buckets(texts, buckets), None)
    found = stage(found, "members")
    regions = found.where("bytes is not null").select("bucket", "region", "last", "place", "n", "bytes")
    sizes = regions.groupBy("bucket").agg(F.count(F.lit(1)).alias("regions")).where(F.col("regions") > hot).select("bucket")
    python_tasks(spark)
    if sizes.isEmpty():
        spans = regions.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(refined, "bucket long, region long, lo long, hi long")
    else:
        sizes = stage(sizes, "hot")
        cool = regions.join(sizes, "bucket", "left_anti").repartition("bucket").sortWithinPartitions("bucket")
        same = regions.join(sizes, "bucket", "left_semi").groupBy("bucket", "region").agg(F.sum("n").alias("n"), *[F.first(c).alias(c) for c in ("last", "place", "bytes")])
        spans = cool.mapInArrow(refined, "bucket long, region long, lo long, hi long").unionByName(refined_hot(stage(same, "hot-regions")))
    places = found.where("bytes is null and bucket is not null").select("doc", "hash", "bucket", "region", "first")
    inside = places.join(spans, ["bucket", "region"]).select("doc", "hash", (F.col("first") + F.col("lo")).alias("start"), (F.col("first") + F.col("hi") + LENGTH).alias("end"))
    return inside.union(found.where("bucket is null and bytes is null").select("doc", "hash", "first", "last"))


def with_buckets(texts: DataFrame, buckets: DataFrame) -> DataFrame:
    """``texts`` with the list ``own`` of their buckets of two suffixes or more, for more buckets than are broadcast."""
    python_tasks(texts.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, key = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
        parts = []
        for data, ends, row, _ in groups(binaries(batch.column(2))):
            if s := sampled(data, ends):
                of = row[np.searchsorted(ends, s["first"], side="right")]
                parts.append(np.stack([doc[of], key[of], s["bucket"].view(np.int64)]))
        rows = np.unique(np.concatenate(parts, 1), axis=1) if parts else np.zeros((3, 0), np.int64)
        return pa.RecordBatch.from_arrays([longs(x) for x in rows], ["doc", "hash", "bucket"])

    own = per_text(texts, run, "doc long, hash long, bucket long").join(buckets, "bucket").groupBy("doc", "hash").agg(F.collect_list(F.struct("bucket", "several")).alias("own"))
    return texts.join(own, ["doc", "hash"], "left").select("doc", "hash", "text", "own")


def removed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_text: bool = True, **limits: int) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) and with ``keep_text`` the bytes that are kept."""
    # a null doc_id joins as -1 beside the text's hash; equal texts have equal spans
    texts = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-1)).alias("doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash"), F.col(text).alias("text"), F.col(doc_id).cast("long").alias("doc_id"))
    spans = repeated_spans(texts.select("doc", "hash", "text"), **limits)
    lists = spans.groupBy("doc", "hash").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    met = texts.join(lists, ["doc", "hash"], "left").select("doc_id", "text", "spans")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for doc, t, spans in zip(batch.column(0).to_pylist(), binaries(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            kept, at, n = [], 0, 0
            end = -1
            for s, e in sorted((x["start"], x["end"]) for x in spans or ()):
                if s > end:
                    kept.append(t[max(at, 0) : s])
                    n += 1
                end = max(end, e)
                at = end
            kept.append(t[at:])
            rest = b"".join(kept)
            out.append((doc, len(t), len(t) - len(rest), n, hashlib.sha256(rest).hexdigest(), rest))
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()][: 1 + keep_text]
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(kinds)])

    return per_text(met, cut, schema)


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents"), keep_text=False)
