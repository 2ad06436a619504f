"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, best-fit packing.

STAGES are (name, function) in order; each function takes (spark, docs, sf_dir) and returns a DataFrame, all but the last with the
columns of ``docs``. ``run`` writes each stage as Parquet in the shared folder and gives it, read again, to the next one.

* quality rules: documents that policy v2 of the rule ledger rejects go
* line dedup: lines of templates that recur across document families go from the texts; every document stays
* near-dedup: of each component of near copies (five-word shingles, similarity 0.8 or more) the smallest doc_id stays
* decontamination: documents that hold a benchmark item within the edit budget go
* packing: pieces of the documents that are left, with their sequence and offset
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontaminate, line_dedup, packing, quality_rules, simhash
from weftline.llm.common import stage, table
from weftline.llm.token_counts import vocabulary_path

#: SQL has no near-copy components, templates or token ids: the stages are tested against brute force instead.
ORACLE_SQL = None


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # the row travels as a struct, so that no column of it clashes with the ledger's
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "text")
    return quality_rules.ledger(rows).where(quality_rules.keeps("v2")).select("_row.*")


def by_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.clean_lines(docs)


def by_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def by_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary_path(packing.VOCABULARY))


STAGES = [("quality rules", by_quality), ("line dedup", by_lines), ("near-dedup", by_copies), ("decontamination", by_benchmark), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
