"""A work queue of four priorities that runs by cycles, each given a micro-batch of new items."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import sorting
from ..tables import cut_lineage

#: Priorities, the first one first; milliseconds between runs of low items, after a run that took too long, and for a run.
HIGH, NORMAL, BELOW, LOW = range(4)
LOW_EVERY, LOW_SOON, LOW_TIME = 60_000, 10_000, 500


@dataclass
class ThrottledQueue:
    """Items (``seq``, ``priority``, ``cost`` in milliseconds, at least 1; ``tries`` is added). Each cycle runs all items that
    are ready, but for low ones, by priority and seq; those that aren't ready are tried again as normal ones in the next cycle.
    Low items that are ready run when their time has come, in order of seq, until LOW_TIME is used up.

    What waits, and when low items ran last, is written for each cycle, so a cycle that is run again starts from the same. Done
    items are in ``done``, with their cycle and turn. clock: milliseconds."""

    queue: str
    done: str
    ready: Column
    clock: Callable[[], int] = lambda: int(time.time() * 1000)
    began: int | None = field(default=None)

    def work(self, batch: DataFrame, i: int) -> None:
        spark, c = batch.sparkSession, F.col
        now = self.clock()
        self.began = now if self.began is None else self.began
        new = batch.withColumn("tries", F.lit(0))
        last, wait = self.began, LOW_EVERY
        if i:
            new = new.unionByName(spark.read.schema(new.schema).parquet(f"{self.queue}/after={i - 1}"))
            last, wait = spark.read.schema("last long, wait long").parquet(f"{self.queue}-low/after={i - 1}").first()
        items = cut_lineage(new.withColumn("_ready", F.coalesce(self.ready, F.lit(False))))
        run = items.where((c("priority") < LOW) & c("_ready"))
        waiting = items.where((c("priority") < LOW) & ~c("_ready")).withColumns({"priority": F.lit(NORMAL), "tries": c("tries") + 1})
        low = items.where(c("priority") == LOW)
        if now - last > wait:
            # each takes a millisecond at least, so no more than LOW_TIME of them can begin
            first = low.where("_ready").orderBy("seq").limit(LOW_TIME).select("seq", F.greatest("cost", F.lit(1)).alias("cost")).collect()
            spent, taken = 0, []
            for r in first:
                if spent >= LOW_TIME:
                    break
                spent += r.cost
                taken.append(r.seq)
            last, wait = now + spent, LOW_SOON if spent > LOW_TIME else LOW_EVERY
            chosen = c("seq").isin(taken)
            run, low = run.unionByName(low.where(chosen)), low.where(~chosen)
        turned = sorting.place(run.drop("_ready"), [c("priority")], "seq", [], "turn")
        turned.withColumn("cycle", F.lit(i)).write.mode("overwrite").parquet(f"{self.done}/cycle={i}")
        waiting.unionByName(low).drop("_ready").write.mode("overwrite").parquet(f"{self.queue}/after={i}")
        spark.createDataFrame([(last, wait)], "last long, wait long").coalesce(1).write.mode("overwrite").parquet(f"{self.queue}-low/after={i}")
