"""Streams with state: pages put together, windows with late rows."""

import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from patrika.operators import pages as pg
from patrika.streaming import windows as w
from patrika.streaming.assembly import assemble_inbox

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def told(df):
    return sorted((r["doc_id"], r["text"], r["total_pages"], r["pages_with_text"]) for r in df.collect())


def test_pages_out_of_order_over_three_batches(spark, tmp_path):
    inbox, table, checkpoint = (str(tmp_path / x) for x in ("inbox", "table", "checkpoint"))
    rng = random.Random(5)
    rows = [(d, p, n, rng.choice([None, " ", f"text {d} {p}", "ಕನ್ನಡ"])) for d in range(40) for n in [rng.randint(1, 6)] for p in range(1, n + 1)]
    rng.shuffle(rows)
    df = lambda some: spark.createDataFrame(some, "doc_id long, page_num int, total_pages int, page_text string").coalesce(1)
    for part in range(3):  # each call is a restart
        df(rows[part::3]).write.mode("append").parquet(inbox)
        assemble_inbox(spark, inbox, table, checkpoint).awaitTermination()
    got = spark.read.parquet(table)
    assert told(got) == told(pg.assemble(df(rows))) and got.filter("not complete").count() == 0


def test_documents_that_wait_too_long(spark, tmp_path):
    inbox, table, checkpoint = (str(tmp_path / x) for x in ("inbox", "table", "checkpoint"))
    df = lambda some: spark.createDataFrame(some, "doc_id long, page_num int, total_pages int, page_text string").coalesce(1)
    for some in ([(1, 2, 3, "b"), (2, 1, 1, "x")], [(1, 1, 3, "a"), (3, 1, 2, "y")], [(4, 1, 1, "z")], [(5, 1, 1, "z")]):
        df(some).write.mode("append").parquet(inbox)
        assemble_inbox(spark, inbox, table, checkpoint, wait_seconds=0.0).awaitTermination()
    got = {(r["doc_id"], r["text"]): r["complete"] for r in spark.read.parquet(table).collect()}
    assert got[2, "x\n\n"] and got[4, "z\n\n"] and not any(v for (d, _), v in got.items() if d in (1, 3))
    pages = "".join(t for (d, t) in got if d == 1)
    assert "b\n\n" in pages and "a\n\n" in pages and (3, "y\n\n") in got


@pytest.mark.parametrize("kind", ["tumbling", "sliding", "session"])
def test_windows_of_a_stream_are_those_of_its_table(spark, tmp_path, kind):
    window = {"tumbling": w.tumbling("ts", "10 minutes"), "sliding": w.sliding("ts", "10 minutes", "5 minutes"), "session": w.session("ts", "3 minutes")}[kind]
    rng, inbox = random.Random(7), str(tmp_path / "inbox")
    at = lambda minute: F.timestamp_seconds(F.lit(1_700_000_000) + minute * 60)
    schema = "minute double, k string, value double"
    first = [(rng.uniform(0, 100), rng.choice("ab"), rng.random()) for _ in range(150)] + [(200.0, "a", 1.0)]
    late = [(5.0, "a", 1.0), (50.0, "b", 1.0)]  # more than 20 minutes behind
    second = [(rng.uniform(190, 260), rng.choice("ab"), None if i % 9 == 0 else rng.random()) for i in range(80)] + [(1000.0, "a", 0.0)]
    df = lambda rows: spark.createDataFrame(rows, schema).withColumn("ts", at(F.col("minute"))).coalesce(1)
    between = [(201.0, "a", 1.0)]  # rows are late by the watermark of the batch before
    for rows in (first, between, late + second, [(1001.0, "b", 0.0)], [(1002.0, "b", 0.0)]):
        df(rows).write.mode("append").parquet(inbox)
    stream = spark.readStream.schema(df(first).schema).option("maxFilesPerTrigger", 1).parquet(inbox)
    # one file after the other, in the order in which they were written
    query = w.summed(stream, window, ["k"], late="20 minutes").writeStream.format("memory").queryName(f"windows_{kind}").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted(map(tuple, spark.table(f"windows_{kind}").collect()))
    whole = w.summed(df(first + between + second), window, ["k"])
    want = sorted(map(tuple, whole.filter(F.col("end") < at(F.lit(900.0))).collect()))
    assert got == want and len(want) > 10
    assert w.late_rows(query) == (4 if kind == "sliding" else 2)
