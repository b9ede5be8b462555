"""The folder that driver and executors share, and tables in it that cut an iteration's lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's spark.checkpoint.dir. Where that is unset, a temporary folder will do on one machine
    alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not base and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = base or f"file://{tempfile.gettempdir()}/lexgrove"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Folders of steps that this process has written.
_STEPS: list[str] = []


def remove_steps(spark: SparkSession) -> int:
    """Removes the tables that ``cut_lineage`` has written, once no table that was made with them is read any more."""
    context, n = spark.sparkContext, len(_STEPS)
    while _STEPS:
        at = context._jvm.org.apache.hadoop.fs.Path(_STEPS.pop())
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
    return n


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder and reads them back."""
    path = shared_folder(df.sparkSession, "step")
    _STEPS.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
