"""The shared folder of a session: checkpoints, staged tables, fitted models."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees, as the cluster names it in spark.checkpoint.dir.

    Only a local master may go without the setting; it then gets a temporary folder.
    """
    root = spark.conf.get(_SETTING, None)
    context = spark.sparkContext
    if not root:
        root = context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError(f"set {_SETTING} to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tallywright-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def scratch(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has used before."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once; later readers all see those same rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
