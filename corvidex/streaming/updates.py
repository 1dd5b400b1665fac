"""Update collections as streams: raw records arrive, the newest document of an id hides older ones.

An extension in Structured Streaming form. Each micro-batch is written below its
batch number, so a batch that runs again after a failure replaces itself;
validity is worked out when the table is read, by one aggregate over ids.
Documents without an id hide nothing and are never hidden.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.plugins import Parser


def read_stream(spark: SparkSession, path: str, parser: Parser) -> DataFrame:
    """Parsed records of text files as they appear below a path."""
    end = parser.format.end if parser.format else None
    reader = spark.readStream.format("text")
    if parser.format and not parser.format.columns:
        reader = reader.option("lineSep", f"\n{end}\n") if end and not end.startswith("^") else reader.option("wholetext", "true")
    return parser.rows(reader.load(path))


def keep(rows: DataFrame, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Starts writing a stream of documents (doc_id, …) below ``folder``; ``once`` ends when all that is there was read."""

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    writer = rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(spark: SparkSession, folder: str, within: str | None = None) -> DataFrame:
    """All documents with is_valid: true for the newest of each id. ``within`` orders documents of one batch."""
    rows = spark.read.option("basePath", folder).parquet(f"{folder}/batch=*")
    order = F.struct("batch", F.col(within)) if within else F.struct("batch")
    newest = rows.where("doc_id is not null").groupBy("doc_id").agg(F.max(order).alias("_newest"))
    return rows.join(newest, "doc_id", "left").withColumn("is_valid", F.coalesce(order == F.col("_newest"), F.lit(True))).drop("_newest")
