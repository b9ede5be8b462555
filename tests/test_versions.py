"""Batches that are there whole or not at all, queues by the clock, searches that are stopped or listened to."""

import threading
import time

import pytest
from lexgrove.streaming import queues, searches, versions
from lexgrove.streaming.versions import Versions
from pyspark.sql import functions as F

SCHEMA = "source string, n long"


def rows(df):
    return sorted(((r.source, r.n) for r in df.collect()), key=str)


def test_a_batch_that_fails_leaves_the_table(spark, tmp_path, monkeypatch):
    table = Versions(str(tmp_path / "t"), SCHEMA, source="source")
    frame = lambda x: spark.createDataFrame(x, SCHEMA)
    assert rows(table.read(spark)) == []
    table.work(frame([("a", 1), ("a", 2), ("b", 3), (None, 4)]), 0)
    real = Versions._switch
    monkeypatch.setattr(Versions, "_switch", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    before = table.read(spark)
    with pytest.raises(OSError):
        table.work(frame([("a", 9), (None, 9)]), 1)
    assert rows(table.read(spark)) == rows(before) == [("a", 1), ("a", 2), ("b", 3), (None, 4)]
    monkeypatch.setattr(Versions, "_switch", real)
    table.work(frame([("a", 9), (None, 9)]), 1)
    table.work(frame([("a", 9), (None, 9)]), 1)  # runs again
    assert rows(table.read(spark)) == [("a", 9), ("b", 3), (None, 9)] and rows(before) == [("a", 1), ("a", 2), ("b", 3), (None, 4)]
    table.work(frame([]), 2)
    assert rows(table.read(spark)) == [("a", 9), ("b", 3), (None, 9)]
    assert table.vacuum(spark) == 1 and rows(table.read(spark)) == [("a", 9), ("b", 3), (None, 9)]
    table.compact(spark)
    assert table.vacuum(spark) == 3 and rows(table.read(spark)) == [("a", 9), ("b", 3), (None, 9)]
    table.work(frame([("b", 5)]), 3)
    table.work(frame([("b", 6)]), 1)  # known by name, though compacted
    assert rows(table.read(spark)) == [("a", 9), ("b", 5), (None, 9)]


def test_writers_that_meet_both_count(spark, tmp_path, monkeypatch):
    table = Versions(str(tmp_path / "t"), SCHEMA)
    real = Versions.log
    table.commit(spark.createDataFrame([("a", 1)], SCHEMA), "one")
    monkeypatch.setattr(Versions, "log", lambda self, spark: [])  # has not seen the other's batch
    table.commit(spark.createDataFrame([("b", 2)], SCHEMA), "two")
    monkeypatch.setattr(Versions, "log", real)
    assert [e["batch"] for e in table.log(spark)] == ["one", "two"] and rows(table.read(spark)) == [("a", 1), ("b", 2)]


def test_merged_and_compacted_by_itself(spark, tmp_path):
    table = Versions(str(tmp_path / "t"), SCHEMA, merge=lambda x: x.groupBy("source").agg(F.max("n").alias("n")), every=3)
    for i in range(8):
        table.work(spark.createDataFrame([("a", i), ("b", -i), (f"c{i}", 0)], SCHEMA), i)
    assert rows(table.read(spark)) == sorted([("a", 7), ("b", 0)] + [(f"c{i}", 0) for i in range(8)])
    assert len(table.log(spark)) <= 4 and table._batches(table.log(spark)) == [f"batch-{i}" for i in range(8)]
    table.vacuum(spark)
    table.work(spark.createDataFrame([("a", 99)], SCHEMA), 3)  # known, though its entry is gone
    assert rows(table.read(spark))[0] == ("a", 7)


def test_queue_by_the_clock(spark, tmp_path):
    now = [1_000]
    queue = queues.ThrottledQueue(str(tmp_path / "q"), str(tmp_path / "d"), F.col("name").startswith("ok") | (F.col("tries") > 0), lambda: now[0])
    schema = "seq long, priority int, cost long, name string"
    cycles = [
        (1_000, [(1, 3, 300, "ok"), (2, 3, 150, "ok"), (3, 3, 100, "ok"), (4, 3, 100, "ok"), (5, 2, 1, "ok"), (6, 0, 1, "no"), (7, 1, 1, "ok"), (8, 0, 1, "ok")]),
        (61_000, [(9, 0, 1, "ok"), (10, 2, 1, "no")]),  # not more than a minute yet; 6 comes back as a normal one
        (61_001, [(11, 3, 700, "ok"), (12, 3, 1, "no")]),  # low ones until 500 ms are used up: 1, 2, 3
        (71_500, []),  # the run took too long, but 10 s aren't over since
        (71_552, [(13, 1, 1, "ok")]),  # now 4, and 11, which begins in time
        (140_000, [(14, 3, 5, "ok")]),
    ]
    for i, (at, items) in enumerate(cycles):
        now[0] = at
        queue.work(spark.createDataFrame(items, schema), i)
    done = spark.read.schema(schema + ", tries int, turn long, cycle int").parquet(str(tmp_path / "d")).orderBy("cycle", "turn").collect()
    got = {}
    for r in done:
        got.setdefault(r.cycle, []).append((r.seq, r.priority))
    assert got == {0: [(8, 0), (7, 1), (5, 2)], 1: [(9, 0), (6, 1)], 2: [(10, 1), (1, 3), (2, 3), (3, 3)], 4: [(13, 1), (4, 3), (11, 3)], 5: [(14, 3)]}
    assert [r.seq for r in spark.read.parquet(str(tmp_path / "q/after=5")).collect()] == [12]
    # a cycle that runs again does the same
    queue.work(spark.createDataFrame([(14, 3, 5, "ok")], schema), 5)
    assert spark.read.parquet(str(tmp_path / "d/cycle=5")).count() == 1


def test_a_stopped_search_keeps_whole_parts(spark, tmp_path):
    found = Versions(str(tmp_path / "found"), "part long, n long")
    part = lambda k: spark.range(1000).repartition(4).select(F.lit(k).cast("long").alias("part"), F.col("id").alias("n"))

    def slow(batches):
        for batch in batches:
            time.sleep(60)
            yield batch

    parts = [("0", part(0)), ("1", part(1)), ("2", part(2).mapInArrow(slow, "part long, n long")), ("3", part(3))]
    search, done = searches.Search(spark, found), []
    thread = threading.Thread(target=lambda: done.extend(search.run(parts)))
    began = time.time()
    thread.start()
    while len(found.log(spark)) < 2:
        time.sleep(0.2)
    time.sleep(2)
    search.stop()
    thread.join(50)
    assert not thread.is_alive() and time.time() - began < 55
    assert done == ["0", "1"] and sorted((r.part, r["count"]) for r in found.read(spark).groupBy("part").count().collect()) == [(0, 1000), (1, 1000)]
    # the context is as before, and another search finds the rest
    assert searches.Search(spark, found).run([("1", part(1)), ("3", part(3))]) == ["1", "3"]
    assert found.read(spark).count() == 3000
    stopped = searches.Search(spark, found)
    stopped.stop()
    assert stopped.run([("4", part(4))]) == []
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        searches.Search(spark, found).run([("5", spark.range(3).select(F.lit(1).cast("long").alias("part"), F.expr("1 div (id - id)").alias("n")))])


def test_events_of_a_streamed_search_in_order(spark, tmp_path):
    source = str(tmp_path / "in")
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source).where("id % 4 = 0")
    events = searches.observed_stream(stream, "fours", str(tmp_path / "out"), str(tmp_path / "c"), F.count(F.lit(1)).alias("found"))
    assert [e for e, _ in events] == ["start", *["found", "progress"] * 3, "end"]
    assert sum(n for e, n in events if e == "found") == 8 and [n for e, n in events if e == "progress"] == sorted(n for e, n in events if e == "progress")
    assert events[-1] == ("end", None) and spark.read.parquet(str(tmp_path / "out")).count() == 8
    bad = spark.readStream.schema("id long").parquet(source).select((F.col("id") / (F.col("id") - F.col("id"))).alias("x"))
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        searches.observed_stream(bad, "bad", str(tmp_path / "out2"), str(tmp_path / "c2"), F.count(F.lit(1)).alias("found"))
