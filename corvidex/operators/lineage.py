"""Where intermediate tables are kept so that lost executors cost little."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Only for a session with a local master and no setting of its own, as in tests.
LOCAL = "file:///tmp/corvidex-checkpoints"


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, as a whole URI; a name without a scheme lies in the default file system.

    Where it is unset, a local session gets a local folder; on a cluster that is an error, as executors would not see each other's files.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = LOCAL
    path = context._jvm.org.apache.hadoop.fs.Path(root)
    root = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if root.startswith("file:/") and not root.startswith("file://"):  # as URIs are usually written
        root = "file://" + root.removeprefix("file:")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root.rstrip("/")


def shared_folder(spark: SparkSession, what: str = "collections") -> str:
    """A new folder that the driver and all executors see."""
    return f"{checkpoint_root(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` from a reliable checkpoint: read twice, it has the same rows in the same partitions."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)
