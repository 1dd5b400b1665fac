"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.lineage import cut, shared_folder

__all__ = ["BPE_FILE", "PIECE_FILE", "TOKENIZERS", "bounded_batches", "cut", "remainder", "shared_dir", "table"]

#: Where the public vocabulary files lie unless a caller says otherwise.
TOKENIZERS = "/opt/tokenizers"
BPE_FILE = f"{TOKENIZERS}/byte_bpe_50k.json"
PIECE_FILE = f"{TOKENIZERS}/piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 512, size: int = 64 << 20) -> None:
    """Arrow batches of whole texts must fit a Python worker: never more than ``rows`` rows, nor than ``size`` bytes and one row."""
    conf = spark.conf
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(conf.get(key)) not in range(1, rows + 1):
        conf.set(key, str(rows))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(key).lower().rstrip("b")
    if not now.isdigit() or int(now) not in range(1, size + 1):  # -1: no bound
        conf.set(key, str(size))


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which the driver and all executors see."""
    return shared_folder(spark, "corvidex")


def remainder(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo n; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % F.lit(n)
