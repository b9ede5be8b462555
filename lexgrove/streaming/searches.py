"""Searches that deliver as they go, can be stopped, and are listened to."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener

from .versions import Versions


class Search:
    """A search over parts of the data, each of which is delivered whole to a table of versions. Another thread may stop it: the part
    that is being searched is broken off and leaves nothing, and what was delivered stays."""

    def __init__(self, spark: SparkSession, found: Versions):
        self.spark, self.found, self.tag = spark, found, f"search-{uuid.uuid4().hex}"
        self._stop = threading.Event()

    def run(self, parts: Iterable[tuple[str, DataFrame]]) -> list[str]:
        """Names of the parts that were delivered."""
        done = []
        context = self.spark.sparkContext
        context.addJobTag(self.tag)
        try:
            for name, rows in parts:
                if self._stop.is_set():
                    break
                try:
                    self.found.commit(rows, name)
                except (Py4JError, PySparkException):
                    if not self._stop.is_set():
                        raise
                    break
                done.append(name)
        finally:
            context.removeJobTag(self.tag)
        return done

    def stop(self) -> None:
        self._stop.set()
        self.spark.sparkContext.cancelJobsWithTag(self.tag)


class SearchEvents(StreamingQueryListener):
    """What an observer hears of a streamed search, in order: (start, None), then for each batch (found, the number of results that the
    search observes as ``found``) and (progress, the number of rows read so far), at last (end, an error or None)."""

    def __init__(self, name: str):
        self.name, self.events, self._ids, self._rows = name, [], set(), 0
        self._ended = threading.Event()

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self._ids.add(event.runId)
            self.events.append(("start", None))

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if progress.runId in self._ids and progress.numInputRows:
            for row in progress.observedMetrics.values():
                self.events.append(("found", row["found"]))
            self._rows += progress.numInputRows
            self.events.append(("progress", self._rows))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.runId in self._ids:
            self.events.append(("end", event.exception))
            self._ended.set()

    def wait(self, seconds: float = 30) -> list[tuple]:
        """The events, once the search's end was heard."""
        if not self._ended.wait(seconds):
            raise TimeoutError(f"{self.name} has not ended")
        return self.events


def observed_stream(rows: DataFrame, name: str, path: str, checkpoint: str, *metrics) -> list[tuple]:
    """Runs a streamed search to its end, appending what it finds to ``path``; its events."""
    spark = rows.sparkSession
    heard = SearchEvents(name)
    spark.streams.addListener(heard)
    try:
        query = rows.observe("search", *metrics).writeStream.queryName(name).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return heard.wait()
    finally:
        spark.streams.removeListener(heard)
