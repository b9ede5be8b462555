"""Tables in the folder that driver and executors share: one stage writes them and a later one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..tables import shared_folder


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows as a Parquet table in the shared folder and reads them back: lineage ends there."""
    return Scratch().written(df, name)


class Scratch:
    """Tables of one computation, which are removed once nothing reads them any more."""

    def __init__(self) -> None:
        self.paths: dict[str, str] = {}

    def written(self, df: DataFrame, name: str) -> DataFrame:
        spark = df.sparkSession
        path = self.paths[name] = shared_folder(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame, *names: str) -> None:
        """Removes tables by name. Only for tables whose readers have written what they made of them."""
        context = df.sparkSession.sparkContext
        for name in names:
            if path := self.paths.pop(name, None):
                at = context._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
