"""A corpus pipeline of five stages over documents.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept, and returns a DataFrame; all but the last return the columns of docs.
``run`` writes each stage's rows to the folder that driver and executors share
and reads them again, so a lost executor costs at most one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvidex.llm import bpe, decontam, langid, neardup, quality
from corvidex.llm._common import cut, remainder, shared_dir, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language that was learned; others are rejected."""
    model = langid.fit(docs.where(remainder("doc_id", 3) != 1))
    return langid.keep_known(docs, model)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as good; the labels of a fifth of the documents are never learned from."""
    known = table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0)
    # The statistics of all texts, without the texts, are what is joined; moving the texts would cost more than reading them twice.
    stats = cut(quality.with_statistics(docs.select("doc_id", "text")).drop("text"))
    model = quality.fit(quality.labelled(stats, known), times="times")
    return quality.keep_good(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group that five-word shingles link at a similarity of 0.8 or more.

    Candidates are what operator 6's covering masks bring together, with fingerprints over these shingles. Most similar
    pairs differ in more than its three bits, so min-hashes give the other candidates; all are compared exactly.
    """
    return neardup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontam.remove(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of the ids and of the text decoded from them."""
    return bpe.digests(docs, with_ids=True)


STAGES = [
    ("language", language_stage),
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("tokens", token_stage),
]
#: SQL can't express the models of the first two stages; tests hold every stage against brute force.
ORACLE_SQL = None


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, one after the other.

    A stage's rows are deleted once the next stage's are written, so two copies are kept at most.
    """
    folder = shared_dir(spark)
    docs = table(spark, sf_dir, "documents")
    written: list[str] = []
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            written.append(f"{folder}/{i}-{name}")
            docs.write.parquet(written[-1])
            docs = spark.read.parquet(written[-1])
            for path in written[:-1]:
                _delete(spark, path)
    return docs
