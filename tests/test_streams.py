"""Streams with timers and restartable jobs against their batch twins."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from wordloom.operators import assemble
from wordloom.streaming import jobs, timers, windows

from tests.test_operators import rows_of, run_stream

PAGES = "vol int, page int, text string"


def feed(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))


@pytest.fixture
def only_with_data(spark):
    """A run over what is new ends there: else a timer by the clock keeps it alive."""
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


def test_pages_out_of_order_give_the_batch_result(spark, tmp_path, only_with_data):
    rng = random.Random(5)
    pages = [(v, p, rng.choice(["tail only", "a ॥ 1 ॥ b", "॥ 2 ॥", "x ॥ 3 ॥ y ॥ 4 ॥", "", "end ॥ 5-6 ॥"]) + f" {v}.{p}") for v in (1, 2) for p in range(1, 13)]
    want = assemble.assemble_units(spark.createDataFrame(pages, PAGES).withColumn("paragraphs", F.array("text")), ["vol"], "page").where("closed")
    want = [(r["vol"], r["unit"], r["text"], min(r["pages"]), max(r["pages"])) for r in want.collect()]
    rng.shuffle(pages)
    got = []
    for part in (pages[:7], pages[7:]):
        feed(spark, tmp_path, "pages", part, PAGES)
        stream = timers.assemble_unordered(spark.readStream.schema(PAGES).parquet(str(tmp_path / "pages")))
        got += run_stream(stream, tmp_path, "unordered", "append")
    assert {r["status"] for r in got} == {"unit"}
    assert sorted((r["vol"], r["unit"], r["text"], r["first_page"], r["last_page"]) for r in got) == sorted(want)


def test_a_missing_page_is_given_up(spark, tmp_path, only_with_data):
    def run(rows):
        feed(spark, tmp_path, "gap", rows, PAGES)
        stream = timers.assemble_unordered(spark.readStream.schema(PAGES).parquet(str(tmp_path / "gap")), patience_ms=6000)
        return [(r["unit"], r["text"], r["first_page"], r["status"]) for r in run_stream(stream, tmp_path, "gap", "append")]

    assert run([(1, 1, "one ॥ 1 ॥ open"), (1, 3, "three ॥ 3 ॥")]) == [(0, "one", 1, "unit")]
    time.sleep(7)
    # The next batch fires the timer: page 2 is given up, and is late when it comes.
    assert run([(2, 1, "z")]) == [(1, "open three", 1, "unit")]
    assert run([(1, 2, "two ॥ 2 ॥"), (1, 4, "four ॥ 4 ॥")]) == [(2, "four", 4, "unit"), (None, "two ॥ 2 ॥", 2, "late")]


EVENTS = "event_id long, user_id long, ts timestamp, event_type string, value double"


def test_debounced_stream_is_the_batch(spark, sf_dir, tmp_path):
    table = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", F.col("value").cast("double").alias("value"))
    rows = [tuple(r) for r in table.orderBy("ts", "event_id").limit(150).collect()]
    rows = [(e, u % 5, *rest) for e, u, *rest in rows]
    want = rows_of(windows.debounced(spark.createDataFrame(rows, EVENTS), ["user_id"], "30 minutes"), "event_id", "value")
    last = spark.createDataFrame(rows, EVENTS).agg(F.max("ts") + F.expr("interval 3 days")).first()[0]
    rng, got = random.Random(1), []
    # Arrival is out of order within the lateness; the last event pushes the watermark on.
    late = sorted(rows, key=lambda r: r[2].timestamp() + rng.random() * 500)
    for part in (late[:80], late[80:], [(10**6, 99, last, "close", None)], [(10**6 + 1, 99, last, "close", None)]):
        feed(spark, tmp_path, "events", part, EVENTS)
        stream = timers.debounce_stream(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "events")), ["user_id"], 30 * 60_000)
        got += run_stream(stream, tmp_path, "events", "append")
    assert sorted(((r["event_id"], r["value"]) for r in got), key=str) == want
    assert 0 < len(want) < len(rows)


def squares(rows):
    return rows.select("id", (F.col("id") * F.col("id")).alias("square"))


def test_a_job_goes_on_where_it_stopped(spark, tmp_path):
    items = spark.range(25).withColumn("x", F.lit(1)).unionByName(spark.range(5).withColumn("x", F.lit(2)))
    job = jobs.Job(spark, str(tmp_path / "job"), ["id"], squares)
    with pytest.raises(ValueError):
        job.results()
    assert job.run(items, chunk=4, budget=10) == {"done": 10, "left": 15}
    # A crash between the results and the ledger: the batch is done anew, no key twice.
    real = jobs.replace_file
    try:
        jobs.replace_file = lambda *a: (_ for _ in ()).throw(RuntimeError("killed"))
        with pytest.raises(RuntimeError):
            job.run(items, chunk=6, budget=6)
    finally:
        jobs.replace_file = real
    assert job.results().count() == 10
    again = jobs.Job(spark, str(tmp_path / "job"), ["id"], squares)
    assert again.run(items, chunk=6, budget=100) == {"done": 15, "left": 0}
    assert rows_of(again.results(), "id", "square") == sorted(((k, k * k) for k in range(25)), key=str)
    assert again.run(items, chunk=6, budget=100) == {"done": 0, "left": 0}


def test_a_streaming_job_is_killed_and_resumed(spark, tmp_path):
    for k in range(4):
        feed(spark, tmp_path, "in", [(10 * k + j,) for j in range(6)] + [(0,)], "id long")
    calls = []

    def work(rows):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("killed")
        if len(calls) == 4:
            raise jobs.BudgetSpent
        return squares(rows)

    def follow(budget=None):
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        return jobs.Job(spark, str(tmp_path / "sjob"), ["id"], work).follow(stream, budget)

    with pytest.raises(Exception, match="killed"):
        follow()
    done = jobs.Job(spark, str(tmp_path / "sjob"), ["id"], work)
    assert done.results().count() == 6
    assert follow() == {"done": 6, "stopped": 1}  # the allowance is used up at the next batch
    assert follow(budget=6) == {"done": 6, "stopped": 1}  # a batch beyond the budget isn't begun
    assert follow()["stopped"] == 0 and follow() == {"done": 0, "stopped": 0}
    assert rows_of(done.results(), "id", "square") == sorted(((10 * k + j, (10 * k + j) ** 2) for k in range(4) for j in range(6)), key=str)
