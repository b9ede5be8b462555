"""Queries that run as streams, in several micro-batches each, with SQL for DuckDB over all that has come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import maintenance
from ..streaming.queues import ThrottledQueue
from ..streaming.searches import observed_stream
from ..streaming.versions import Versions
from .shared import query, shared_folder, table


def in_batches(spark: SparkSession, sf_dir: str, run: Callable[[DataFrame], None], which: Column | None = None, batches: int = 3) -> None:
    """The events as they might come: each time some files are added (dealt by ``which``), and the stream, which goes on from its
    checkpoint, runs until they are done."""
    path = shared_folder(spark, "arriving")
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    which = F.pmod("event_id", F.lit(batches)) if which is None else which
    for i in range(batches):
        events.where(which == i).write.mode("append").parquet(path)
        run(spark.readStream.schema(events.schema).parquet(path))


#: Events by the day, thirds of a month, of which every 17th comes with the next batch.
BATCH = "least(2, (day(ts) - 1) // 10 + CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END)"


def by_time() -> Column:
    return F.least(F.lit(2), F.floor((F.dayofmonth("ts") - 1) / 10).cast("int") + F.when(F.col("event_id") % 17 == 0, 1).otherwise(0))


def kept_sql(end: str, late: str) -> str:
    """SQL of the events that aren't too late: what they count for doesn't end before the watermark that earlier batches left."""
    return f"""b AS (SELECT *, {BATCH} AS batch FROM events), m AS (SELECT batch, max(ts) AS top FROM b GROUP BY batch), w AS (SELECT a.batch, max(m.top) - INTERVAL {late} AS mark FROM (SELECT DISTINCT batch FROM b) a LEFT JOIN m ON m.batch < a.batch GROUP BY a.batch),
k AS (SELECT b.*, mark FROM b JOIN w USING (batch) WHERE mark IS NULL OR {end} > mark)"""


@query(f"WITH {kept_sql("date_trunc('hour', ts) + INTERVAL 1 HOUR", "'2 days'")} SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM k GROUP BY ALL")
def streamed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by the hour. What comes more than two days late is left out, and its hours' state is let go; each batch's hours
    stand for those before."""
    out = Versions(shared_folder(spark, "counts"), "event_type string, hour timestamp, n long", merge=lambda rows: rows.groupBy("event_type", "hour").agg(F.max("n").alias("n")))
    at = shared_folder(spark, "checkpoint")

    def run(events: DataFrame) -> None:
        counts = maintenance.windowed_counts(events, "ts", "event_type", late="2 days").select("event_type", F.col("w.start").alias("hour"), "n")
        counts.writeStream.outputMode("update").foreachBatch(out.work).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()

    in_batches(spark, sf_dir, run, by_time())
    return out.read(spark)


@query("SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY ALL")
def streamed_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user and type, merged over the batches."""
    out = Versions(shared_folder(spark, "replaced"), "user_id long, event_id long, event_type string", merge=lambda rows: rows.groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id")))
    at = shared_folder(spark, "checkpoint")
    in_batches(spark, sf_dir, lambda events: maintenance.run_batches(events.select("user_id", "event_id", "event_type"), out.work, at))
    return out.read(spark).select("user_id", "event_type", "event_id")


@query("SELECT event_id, event_type FROM events WHERE event_id % 3 = CASE event_type WHEN 'error' THEN 1 ELSE 2 END")
def streamed_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each batch replaces all rows of the types that it has: those of the last batch with a type stay."""
    out = Versions(shared_folder(spark, "purged"), "event_id long, event_type string", source="event_type")
    at = shared_folder(spark, "checkpoint")
    in_batches(spark, sf_dir, lambda events: maintenance.run_batches(events.where("event_type <> 'error' or event_id % 3 < 2").select("event_id", "event_type"), out.work, at))
    return out.read(spark)


@query("""WITH m AS (SELECT user_id, event_type, min(event_id) AS place, max(event_id) AS last, arg_max(value, event_id) AS value FROM events GROUP BY ALL) SELECT user_id, event_type, place, last, row_number() OVER (PARTITION BY value > 20 ORDER BY place) AS turn FROM m""")
def coalesced_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal jobs become one; the queue is dealt by priority."""
    jobs = table(spark, sf_dir, "events").withColumn("urgent", F.col("value") > 20)
    return maintenance.coalesced(jobs, ["user_id", "event_type"], "event_id", "urgent").select("user_id", "event_type", "place", "last", "turn")


@query("SELECT user_id, event_type, min(event_id) AS place, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def streamed_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A queue that grows: an equal job that comes again changes the one that waits, and keeps its place."""
    merge = lambda rows: rows.groupBy("user_id", "event_type").agg(F.min("place").alias("place"), F.max_by("value", "last").alias("value"), F.max("last").alias("last"))
    out = Versions(shared_folder(spark, "queue"), "user_id long, event_type string, place long, value double, last long", merge=merge)
    at = shared_folder(spark, "checkpoint")
    in_batches(spark, sf_dir, lambda events: maintenance.run_batches(events.select("user_id", "event_type", F.col("event_id").alias("place"), "value", F.col("event_id").alias("last")), out.work, at))
    return out.read(spark).select("user_id", "event_type", "place", "value")


@query("""WITH e AS (SELECT event_id, event_type = 'error' AS urgent, event_id % 3 AS b FROM events WHERE event_type <> 'signup'), z AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS k FROM e WHERE NOT urgent AND b = 0),
one AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS k FROM (SELECT event_id FROM z WHERE k > 40 UNION ALL SELECT event_id FROM e WHERE NOT urgent AND b = 1)),
two AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS k FROM (SELECT event_id FROM one WHERE k > 40 UNION ALL SELECT event_id FROM e WHERE NOT urgent AND b = 2))
SELECT event_id, b AS batch FROM e WHERE urgent UNION ALL SELECT event_id, 0 FROM z WHERE k <= 40 UNION ALL SELECT event_id, 1 FROM one WHERE k <= 40 UNION ALL SELECT event_id, 2 FROM two WHERE k <= 40""")
def prioritised_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent jobs with each batch, others as the budget allows; what is not ready waits."""
    queue, done = shared_folder(spark, "waiting"), shared_folder(spark, "done")
    work = maintenance.drain(queue, done, ready=F.col("event_type") != "signup", urgent=F.col("event_type") == "error", most=40, order="event_id")
    at = shared_folder(spark, "checkpoint")
    in_batches(spark, sf_dir, lambda events: maintenance.run_batches(events.select("event_id", "event_type"), work, at))
    return spark.read.schema("event_id long, event_type string, batch int, step int").parquet(done).select("event_id", F.col("batch").cast("long").alias("batch"))


@query("SELECT event_id FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'view' AND CAST(floor(epoch(ts)) AS BIGINT) % 97 > c_nationkey * 3")
def drained_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of files that are known but stale."""
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_nationkey") * 3).alias("indexed"))
    out, at = shared_folder(spark, "stale"), shared_folder(spark, "checkpoint")

    def run(events: DataFrame) -> None:
        changes = events.where("event_type = 'view'").select("event_id", "user_id", (F.unix_timestamp("ts") % 97).alias("time"))
        maintenance.delivered(maintenance.stale_changes(changes, known, "user_id").select("event_id"), out, at)

    in_batches(spark, sf_dir, run)
    return spark.read.schema("event_id long").parquet(out)


@query(f"""WITH {kept_sql("ts + INTERVAL '5 hours'", "'1 day'")}, l AS (SELECT *, lag(ts) OVER o AS before, lag(batch) OVER o AS old FROM k WINDOW o AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL '5 hours' OR old < batch AND before + INTERVAL '5 hours' <= mark THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM l)
SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS changes FROM s GROUP BY user_id, session HAVING max(ts) + INTERVAL '5 hours' <= (SELECT max(ts) FROM events) - INTERVAL '1 day'""")
def pending_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that have settled for five hours, again each time; what comes more than a day late is left out."""
    at = shared_folder(spark, "checkpoint")
    settling = maintenance.SettledChanges(shared_folder(spark, "unsettled"), shared_folder(spark, "pending"), "user_id", "ts", "5 hours", "1 day")
    in_batches(spark, sf_dir, lambda events: maintenance.run_batches(events.select("user_id", "ts"), settling.work, at), by_time())
    return spark.read.schema("user_id long, first timestamp, last timestamp, changes long, step int").parquet(settling.done).drop("step")


@query("SELECT user_id, CAST((row_number() OVER (ORDER BY ts, user_id) - 1) // 10 AS BIGINT) AS cycle FROM (SELECT user_id, min(ts) AS ts FROM events WHERE event_type = 'error' GROUP BY 1) ORDER BY ts, user_id LIMIT 20")
def pending_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten sources to a cycle, two cycles; what is left waits."""
    pending = table(spark, sf_dir, "events").where("event_type = 'error'")
    one = maintenance.next_cycle(pending, "user_id", "ts").withColumn("cycle", F.lit(0).cast("long"))
    two = maintenance.next_cycle(pending.join(one.select("user_id"), "user_id", "left_anti"), "user_id", "ts").withColumn("cycle", F.lit(1).cast("long"))
    return one.unionByName(two).select("user_id", "cycle")


THROTTLED = """WITH e AS (SELECT event_id AS seq, event_id % 3 AS batch, CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS priority, event_id % 90 + 30 AS cost, event_id % 5 = 0 AS bad FROM events),
d AS (SELECT seq, CASE WHEN bad THEN batch + 1 ELSE batch END AS cycle, CASE WHEN bad THEN 1 ELSE priority END AS priority FROM e WHERE priority < 3 AND (NOT bad OR batch < 2)),
a AS (SELECT seq FROM (SELECT seq, sum(cost) OVER (ORDER BY seq) - cost AS before FROM e WHERE priority = 3 AND batch = 0 AND NOT bad) WHERE before < 500),
z AS (SELECT seq FROM (SELECT seq, sum(cost) OVER (ORDER BY seq) - cost AS before FROM e WHERE priority = 3 AND NOT bad AND seq NOT IN (SELECT seq FROM a)) WHERE before < 500)
SELECT seq AS event_id, CAST(cycle AS BIGINT) AS cycle, row_number() OVER (PARTITION BY cycle ORDER BY priority, seq) AS turn FROM (SELECT * FROM d UNION ALL SELECT seq, 0, 3 FROM a UNION ALL SELECT seq, 2, 3 FROM z)"""


@query(THROTTLED)
def throttled_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of four priorities: what isn't ready comes back as normal, and the low ones run half a second in a minute by a clock that is
    set: at first, and again at the third cycle, as the second is too early."""
    c, times = F.col, iter([61_000, 65_000, 140_000])
    queue = ThrottledQueue(shared_folder(spark, "waiting"), shared_folder(spark, "done"), (c("seq") % 5 != 0) | (c("tries") > 0), lambda: next(times), began=0)
    kind = F.when(c("event_type") == "error", 0).when(c("event_type") == "purchase", 1).when(c("event_type") == "click", 2).otherwise(3)
    at = shared_folder(spark, "checkpoint")
    in_batches(spark, sf_dir, lambda events: maintenance.run_batches(events.select(c("event_id").alias("seq"), kind.alias("priority"), (c("event_id") % 90 + 30).alias("cost")), queue.work, at))
    return spark.read.schema("seq long, turn long, cycle int").parquet(queue.done).select(c("seq").alias("event_id"), c("cycle").cast("long").alias("cycle"), "turn")


@query("""WITH n AS (SELECT b, count(*) AS n, count(*) FILTER (event_type = 'error') AS found FROM (SELECT event_id % 3 AS b, event_type FROM events) GROUP BY b) SELECT b AS batch, found, n FROM n""")
def search_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an observer hears of a search that runs as a stream: its start, what each batch found and how far it came, its end."""
    out, at, heard = shared_folder(spark, "heard"), shared_folder(spark, "checkpoint"), []
    found = F.count_if(F.col("event_type") == "error").alias("found")
    in_batches(spark, sf_dir, lambda events: heard.append(observed_stream(events, f"search-{len(heard)}", out, at, found)))
    rows = []
    for i, events in enumerate(heard):
        if [e for e, _ in events] != ["start", "found", "progress", "end"]:
            raise ValueError(f"events out of order: {events}")
        rows.append((i, events[1][1], events[2][1]))
    return spark.createDataFrame(rows, "batch long, found long, n long")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error' AND CAST(json_extract_string(props, '$.k') AS BIGINT) > 50")
def delivered_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of a search, delivered with each batch."""
    out, at = shared_folder(spark, "results"), shared_folder(spark, "checkpoint")
    wanted = (F.col("event_type") == "error") & (F.get_json_object("props", "$.k").cast("long") > 50)
    in_batches(spark, sf_dir, lambda events: maintenance.delivered(events.where(wanted).select("event_id", "user_id"), out, at), batches=4)
    return spark.read.schema("event_id long, user_id long").parquet(out)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def restarted_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream that is stopped after each batch and goes on from its checkpoint: nothing is lost or counted twice."""
    at, out = shared_folder(spark, "checkpoint"), shared_folder(spark, "resumed")
    in_batches(spark, sf_dir, lambda events: maintenance.delivered(events.select("event_type"), out, at))
    return spark.read.schema("event_type string").parquet(out).groupBy("event_type").agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT user_id, event_type, max(ts) AS ts FROM events GROUP BY ALL) SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type) AS place FROM l""")
def streamed_recently_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's list after the last batch: a batch's lists are merged with those of their users."""
    lists = lambda uses: maintenance.most_recent(uses, "user_id", "event_type", "ts")
    out = Versions(shared_folder(spark, "recent"), "user_id long, event_type string, ts timestamp, place int", merge=lists)
    at = shared_folder(spark, "checkpoint")
    in_batches(spark, sf_dir, lambda events: maintenance.run_batches(events, lambda batch, i: out.work(lists(batch), i), at))
    return out.read(spark).select("user_id", "event_type", F.col("place").cast("long").alias("place"))
