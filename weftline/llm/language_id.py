"""Language identification by nearest centroid (operator 9).

A text is the vector of its hashed byte 3-grams (lower case; what is no letter is one space) with TF-IDF weights, normalised. Document
frequencies are counted over all learning rows. From a bounded sample of SAMPLE texts a language, spherical k-means makes CENTROIDS
normalised centroids a language, in one task per language; each keeps the cosine below which a text is too far (its members' mean
less REJECT_SPREAD standard deviations). A text gets the language of its nearest centroid, and ``rejected`` if it is too far from it.

Defined results: ``und`` with score 0 and not rejected for a null text or one without a letter, and for every text if there are no
learning rows; rows with a null lang or text are not learnt from; equal cosines go to the first language by name; repeated rows are
judged one by one; an empty table gives an empty result; further columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import per_text, python_tasks, table

DIMENSIONS = 1 << 13
#: Texts of a language from which centroids are made, and centroids of a language.
SAMPLE = 400
CENTROIDS = 4
#: Values of lang that are learnt, the most frequent ones: the bound of the model, whatever stands in lang.
LANGUAGES = 500
REJECT_SPREAD = 4.0
#: Of a language's sampled texts, the share that a centroid stands for at least.
LEAST_SHARE = 0.05
FOLDS, HELD_OUT = 4, 2
GROUP_BYTES = 1 << 17
#: What is no part of a word: combining marks are, as the vowel signs of many scripts.
OTHER = regex.compile(r"[^\p{L}\p{M}]+")
LETTER = regex.compile(r"\p{L}")


def counts(texts: list[str]) -> np.ndarray:
    """3-gram counts of the texts, a row each."""
    data = [f" {OTHER.sub(' ', t.lower())} ".encode() for t in texts]
    ends = np.cumsum([len(d) for d in data])
    b = np.frombuffer(b"".join(data), np.uint8).astype(np.uint32)
    h = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    h = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13)
    row = np.searchsorted(ends, np.arange(len(h)), side="right")
    inside = np.arange(len(h)) + 2 < ends[row]
    flat = row[inside] * DIMENSIONS + h[inside]
    return np.bincount(flat, minlength=len(texts) * DIMENSIONS).reshape(len(texts), DIMENSIONS)


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts(texts)).astype(np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def grouped(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of moderate size together."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= GROUP_BYTES or i - at >= 63:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def document_frequencies(texts: DataFrame, dimensions: int, per_group) -> tuple[np.ndarray, int]:
    """Of all rows of ``texts`` (text): in how many of them each dimension of ``per_group(list of texts)`` is not zero, and their number.
    Each task sends one row a dimension at most; the sums have ``dimensions`` + 1 rows."""
    python_tasks(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dimensions + 1, np.int64)
        for batch in batches:
            rows = [t or "" for t in batch.column(0).to_pylist()]
            for at, to in grouped(rows):
                total[:-1] += (per_group(rows[at:to]) > 0).sum(axis=0)
            total[-1] += len(rows)
        i = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(total[i])], ["dimension", "n"])

    out = np.zeros(dimensions + 1, np.int64)
    for d, n in texts.mapInArrow(run, "dimension long, n long").groupBy("dimension").agg(F.sum("n")).collect():
        out[d] = n
    return out[:-1], int(out[-1])


def inverse(df: np.ndarray, n: int) -> np.ndarray:
    return (np.log((n + 1) / (df + 1)) + 0.05).astype(np.float32)


def clustered(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: normalised centroids, and for each the cosine below which a vector is rejected. Starts from the vector
    nearest to the mean, then from those farthest from the centroids so far, so it is the same in every run."""
    centres = [int(np.argmax(x @ x.mean(0)))]
    while len(centres) < min(k, len(x)):
        centres.append(int(np.argmin((x @ x[centres].T).max(1))))
    c = x[centres]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    size = np.bincount(np.argmax(x @ c.T, axis=1), minlength=len(c))
    c = c[size >= min(size.max(), LEAST_SHARE * len(x))]  # a few odd texts are no cluster
    near = x @ c.T
    own = np.argmax(near, axis=1)
    spread = [near[own == j, j] for j in range(len(c))]
    return c, np.array([s.mean() - REJECT_SPREAD * s.std() if len(s) else -1.0 for s in spread])


def sample_by(rows: DataFrame, key: str, most: int, unique: str, values: int) -> DataFrame:
    """At most about ``most`` rows of each of the ``values`` most frequent values of ``key`` (equals by name), by a hash of ``unique``:
    the same rows in every run, and no value's rows are gathered to choose among them."""
    sizes = rows.groupBy(key).count().orderBy(F.desc("count"), key).limit(values).collect()
    if not sizes:
        return rows.where("false")
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r[0], int(1_000_000 * min(1.0, most / r[1])))])
    return rows.where(F.pmod(F.xxhash64(unique, F.lit("sample")), F.lit(1_000_000)) < F.try_element_at(share, F.col(key)))


class Model:
    def __init__(self, idf: np.ndarray, langs: list[str], centroids: np.ndarray, floor: np.ndarray) -> None:
        self.idf, self.langs, self.centroids, self.floor = idf, langs, centroids, floor

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        out: list[tuple[str, float, bool]] = [("und", 0.0, False)] * len(texts)
        some = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if self.langs else []
        for at, to in grouped([texts[i] for i in some]):
            near = vectors([texts[i] for i in some[at:to]], self.idf) @ self.centroids.T
            best = near.argmax(axis=1)
            for i, j, s in zip(some[at:to], best.tolist(), near.max(axis=1).tolist(), strict=True):
                out[i] = (self.langs[j], min(1.0, max(0.0, s)), bool(s < self.floor[j]))
        return out


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """The model of labelled rows; ``sample`` bounds the texts a language that are clustered, LANGUAGES the languages."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    df, n = document_frequencies(rows.select("text"), DIMENSIONS, counts)
    idf = inverse(df, n)

    def cluster(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.concatenate([vectors(frame.text[at:to].tolist(), idf) for at, to in grouped(frame.text.tolist())])
        c, floor = clustered(x, centroids)
        return pd.DataFrame({"lang": frame.lang.iloc[0], "centroid": [v.astype(np.float32).tobytes() for v in c], "floor": floor})

    made = sample_by(rows, "lang", sample, "doc_id", LANGUAGES).select("lang", "text").groupBy("lang").applyInPandas(cluster, "lang string, centroid binary, floor double").collect()
    made.sort(key=lambda r: r.lang)
    c = np.stack([np.frombuffer(r.centroid, np.float32) for r in made]) if made else np.zeros((0, DIMENSIONS), np.float32)
    return Model(idf, [r.lang for r in made], c, np.array([r.floor for r in made]))


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = shared.value.predict(batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([o[0] for o in out]), pa.array([o[1] for o in out], pa.float64()), pa.array([o[2] for o in out], pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return per_text(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, lang_pred string, score double, rejected boolean")


def fold(doc_id: str, folds: int):
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(folds))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(fold("doc_id", FOLDS) != HELD_OUT))
    return identify(docs, model).select("doc_id", F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
