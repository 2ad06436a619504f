"""Quality classifier by nearest-neighbour voting (operator 4).

A text is a vector of hashed words and of word classes (symbols, digits, very long or short words, a word equal to the one before,
a 3-word window seen before in the text). Weights are the square root of the share of the words times the inverse document
frequency over all documents. A truncated SVD of a bounded sample of labelled vectors (LABELLED rows) gives the latent space; the
labelled latent vectors are sent to the tasks, whose size is LABELLED x LATENT numbers. Every document is compared with all of
them by exact cosines, block by block, and its NEIGHBOURS nearest vote with their labels, weighted by similarity.

Labels, lang, source and doc_id are no inputs of a score.

Defined results: a text without words (null, empty) has no direction and gets the share of label 1 among the labelled rows; the score is
that share (0 without labelled rows) for all texts if nothing is labelled; labelled rows without a document or with a null label are not learnt
from; of labels that contradict one another for a doc_id the smallest counts; similarities are rounded to DECIMALS, so that the shape of
a batch is not seen in them, and equal ones go to the labelled row of the smaller doc_id; repeated rows are scored one by one; an empty table gives an
empty result; further columns of the input are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import per_text, table
from weftline.llm.language_id import document_frequencies, fold, grouped, inverse

WORDS = 1 << 12
CLASSES = 16
SAME, SEEN = WORDS + CLASSES, WORDS + CLASSES + 1
DIMENSIONS = WORDS + CLASSES + 2
LABELLED = 4096
LATENT = 48
NEIGHBOURS = 15
DECIMALS = 6
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>{}[]=+_~^@\\"))
DIGITS = np.isin(np.arange(256), list(b"0123456789"))
GAP = np.isin(np.arange(256), list(b" \t\n\x0b\f\r"))
RADIX = np.uint64(0x9E3779B97F4A7C15)


def shares(texts: list[str]) -> np.ndarray:
    """Of each text: the share of its words that have each term."""
    data = [b" " + t.encode() + b" " for t in texts]
    ends = np.cumsum([len(d) for d in data])
    b = np.frombuffer(b"".join(data), np.uint8)
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    gap = GAP[b]
    start = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    if not len(start):
        return out
    stop = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    length = stop - start
    row = np.searchsorted(ends, start, side="right")
    # a word's name: its bytes' values, mixed with their place in the word, summed
    place = np.arange(len(b)) - np.repeat(np.r_[0, start], np.diff(np.r_[0, start, len(b)]))
    mixed = (b.astype(np.uint64) + np.uint64(1)) * RADIX ^ (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    mixed[gap] = 0
    name = np.add.reduceat(mixed, start)
    symbol = np.add.reduceat(SYMBOLS[b].astype(np.int32), start) > 0
    digit = np.add.reduceat(DIGITS[b].astype(np.int32), start) > 0
    kind = symbol + 2 * digit + 4 * (length > 20) + 8 * (length <= 2)
    flat = [row * DIMENSIONS + ((name * RADIX) >> np.uint64(52)).astype(np.int64), row * DIMENSIONS + WORDS + kind]
    same = np.flatnonzero((name[1:] == name[:-1]) & (row[1:] == row[:-1])) + 1
    flat.append(row[same] * DIMENSIONS + SAME)
    if len(name) > 2:
        window = (name[:-2] * RADIX + name[1:-1]) * RADIX + name[2:]
        inside = np.flatnonzero(row[2:] == row[:-2])
        key = window[inside] ^ row[inside].astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        _, first = np.unique(key, return_index=True)
        seen = np.ones(len(key), bool)
        seen[first] = False
        flat.append(row[inside[seen]] * DIMENSIONS + SEEN)
    n = np.bincount(np.concatenate(flat), minlength=out.size).reshape(out.shape)
    return (n / np.maximum(np.bincount(row, minlength=len(texts)), 1)[:, None]).astype(np.float32)


def weighted(texts: list[str], idf: np.ndarray) -> np.ndarray:
    x = np.sqrt(shares(texts)) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def truncated_svd(x: np.ndarray, k: int, rounds: int = 5) -> np.ndarray:
    """The k leading right singular vectors, by subspace iteration from a fixed start."""
    k = min(k, *x.shape)
    q = np.linalg.qr(x.T @ np.random.default_rng(7).standard_normal((x.shape[0], k + 8)).astype(np.float32))[0]
    for _ in range(rounds):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v.T)[:, :k].astype(np.float32)


class Voters:
    """Labelled latent vectors and what scores a text by them."""

    def __init__(self, idf: np.ndarray, basis: np.ndarray, latent: np.ndarray, labels: np.ndarray, neighbours: int) -> None:
        self.idf, self.basis, self.latent, self.labels, self.neighbours = idf, basis.astype(np.float64), latent.astype(np.float64), labels, neighbours
        self.base = float(labels.mean()) if len(labels) else 0.0

    def place(self, texts: list[str]) -> np.ndarray:
        z = weighted(texts, self.idf).astype(np.float64) @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), self.base)
        k = min(self.neighbours, len(self.labels))
        if not k:
            return out
        for at, to in grouped(texts):
            z = self.place(texts[at:to])
            near = np.round(z @ self.latent.T, DECIMALS)
            least = np.partition(near, near.shape[1] - k, axis=1)[:, -k, None]
            over, at_edge = near > least, near == least
            room = k - over.sum(1, keepdims=True)
            votes = over | (at_edge & (np.cumsum(at_edge, axis=1) <= room))  # voters are in the order of doc_id
            weight = np.where(votes, np.maximum(near, 0), 0) ** 4
            some = weight.sum(1) > 0
            out[at:to][some] = (weight @ self.labels)[some] / weight.sum(1)[some]
        return np.clip(np.round(out, 9), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", labelled: int = LABELLED, latent: int = LATENT, neighbours: int = NEIGHBOURS) -> Voters:
    """``labels`` (doc_id, label): rows to learn from, of which about ``labelled`` are used, chosen by a hash of doc_id."""
    df, n = document_frequencies(docs.select("text"), DIMENSIONS, shares)
    idf = inverse(df, n)
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col(label).cast("int")).alias("label"))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit("labelled")), F.lit(1_000_000)) < 1_000_000 * min(1.0, labelled / max(known.count(), 1)))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = weighted([t or "" for t in batch.column(2).to_pylist()], idf)
        cells = [np.flatnonzero(v) for v in x]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([i.astype(np.int32).tolist() for i in cells], pa.list_(pa.int32())), pa.array([v[i].tolist() for v, i in zip(x, cells, strict=True)], pa.list_(pa.float32()))], ["doc_id", "label", "at", "value"])

    # the labelled sample is small by its bound, so documents meet it where they lie
    rows = per_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text"), run, "doc_id long, label int, at array<int>, value array<float>").toArrow().sort_by("doc_id")
    x = np.zeros((rows.num_rows, DIMENSIONS), np.float32)
    for i, (at, value) in enumerate(zip(rows.column("at"), rows.column("value"), strict=True)):
        x[i, at.values.to_numpy()] = value.values.to_numpy()
    if not len(x):
        return Voters(idf, np.zeros((DIMENSIONS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), neighbours)
    basis = truncated_svd(x, latent)
    z = x @ basis
    return Voters(idf, basis, z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9), rows.column("label").to_numpy().astype(np.float64), neighbours)


def scored(docs: DataFrame, voters: Voters, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores([t or "" for t in batch.column(1).to_pylist()]), pa.float64())], ["doc_id", "score"])

    return per_text(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, score double")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", FOLDS) != HELD_OUT)
    rows = scored(docs, fit(docs, labels))
    return rows.select("doc_id", F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
