"""A table of versions: a batch is there whole or not at all.

A batch's rows are written to a folder of their own, which nothing reads yet; then one small file is put in the table's log by a
rename that fails if that number is taken. Readers go by the log alone, so they never meet half a batch, a batch that
fails leaves the table as it was, and a batch that runs again is known by its name. What a batch costs follows its own rows:
older rows that it replaces or is merged with are left out, or merged, when the table is read, until they are compacted. On a
file system whose rename isn't atomic (some object stores) the log must be elsewhere.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Folder:
    """Small files of a folder on Spark's file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.gateway, self.path = spark.sparkContext._gateway, path
        self.files = self.at("").getFileSystem(self.conf)

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.files.listStatus(self.at(""))) if self.files.exists(self.at("")) else []

    def read(self, name: str) -> str:
        stream = self.files.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> bool:
        """Whether the file could be put there: not if there is one already."""
        new = f".{uuid.uuid4().hex}"
        stream = self.files.create(self.at(new))
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.files.getUri(), self.conf)
        none = self.gateway.new_array(getattr(self.jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(self.at(new), self.at(name), none)
        except Py4JJavaError as error:
            self.files.delete(self.at(new), False)
            if "FileAlreadyExists" in str(error.java_exception.getClass()):
                return False
            raise
        return True

    def remove(self, name: str) -> None:
        self.files.delete(self.at(name), True)


@dataclass
class Versions:
    """schema: the rows', as DDL. source: a column; a batch's rows of a source replace all that the source has. merge: of
    rows of several batches to those that the table has; it must give the same whatever the batches, also for rows that come twice.
    every: batches after which old versions are written as one."""

    path: str
    schema: str
    source: str | None = None
    merge: Callable[[DataFrame], DataFrame] | None = None
    every: int = 32

    def log(self, spark: SparkSession) -> list[dict]:
        """What the table is made of, in order: number, batch (its name) and data (its folder); first what was written as one, with the
        names of all ``batches`` up to its number. Older entries aren't read."""
        folder = Folder(spark, f"{self.path}/log")
        names = folder.names()
        whole = max((n for n in names if n.endswith("-whole")), default=None)
        entries = [] if whole is None else [json.loads(folder.read(whole)) | {"number": int(whole.removesuffix("-whole"))}]
        upto = entries[0]["number"] if entries else 0
        return entries + [json.loads(folder.read(n)) | {"number": int(n)} for n in names if n.isdigit() and int(n) > upto]

    @staticmethod
    def _batches(entries: list[dict]) -> list[str]:
        return [b for e in entries for b in e.get("batches", [e["batch"]])]

    def _switch(self, spark: SparkSession, entry: dict, entries: list[dict]) -> None:
        number = max((e["number"] for e in entries), default=0) + 1
        folder = Folder(spark, f"{self.path}/log")
        while not folder.put(f"{number:012d}", json.dumps(entry)):
            number += 1  # another writer was first

    def commit(self, rows: DataFrame, batch: str) -> bool:
        """Adds a batch, unless one of its name is there."""
        spark = rows.sparkSession
        entries = self.log(spark)
        if batch in self._batches(entries):
            return False
        data = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/version={data}")
        self._switch(spark, {"batch": batch, "data": data}, entries)
        return True

    def work(self, batch: DataFrame, i: int) -> None:
        """For a stream's ``foreachBatch``."""
        self.commit(batch, f"batch-{i}")
        if len(self.log(batch.sparkSession)) > self.every:
            self.compact(batch.sparkSession)

    def _read(self, spark: SparkSession, live: list[dict]) -> DataFrame:
        if not live:
            return spark.createDataFrame([], self.schema)
        rows = spark.read.option("basePath", f"{self.path}/data").schema(f"{self.schema}, version string").parquet(*(f"{self.path}/data/version={e['data']}" for e in live))
        if self.source is not None and len(live) > 1:
            order = F.broadcast(spark.createDataFrame([(e["data"], i) for i, e in enumerate(live)], "version string, _turn long"))  # as many as are not compacted
            rows = rows.join(order, "version")
            last = rows.groupBy(self.source).agg(F.max("_turn").alias("_last")).withColumnRenamed(self.source, "_source")
            rows = rows.join(last, F.col(self.source).eqNullSafe(F.col("_source")) & (F.col("_turn") == F.col("_last")), "left_semi").drop("_turn")
        rows = rows.drop("version")
        return rows if self.merge is None else self.merge(rows).select(*spark.createDataFrame([], self.schema).columns)

    def read(self, spark: SparkSession) -> DataFrame:
        """The table as of the last batch."""
        return self._read(spark, self.log(spark))

    def compact(self, spark: SparkSession) -> None:
        """Writes all versions as one. Batches that are added meanwhile have higher numbers and come after it."""
        live = self.log(spark)
        if len(live) < 2:
            return
        data = uuid.uuid4().hex
        self._read(spark, live).write.parquet(f"{self.path}/data/version={data}")
        Folder(spark, f"{self.path}/log").put(f"{live[-1]['number']:012d}-whole", json.dumps({"batch": None, "data": data, "batches": self._batches(live)}))

    def vacuum(self, spark: SparkSession) -> int:
        """Removes folders that no version names any more, those of failed batches and of compacted ones, and the log's older entries.
        Not while others write or read older versions."""
        live, data, log = self.log(spark), Folder(spark, f"{self.path}/data"), Folder(spark, f"{self.path}/log")
        used = {f"version={e['data']}" for e in live}
        gone = [n for n in data.names() if n not in used]
        for n in gone:
            data.remove(n)
        if live and "batches" in live[0]:
            whole = live[0]["number"]
            for n in log.names():
                if n.isdigit() and int(n) <= whole or n.endswith("-whole") and int(n.removesuffix("-whole")) < whole:
                    log.remove(n)
        return len(gone)
