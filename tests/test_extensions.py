"""Joins by time, sketches and runs of pages against plain Python."""

import math
import random

from pyspark.sql import functions as F

from patrika.functions.rewrite import repaired_digital
from patrika.operators import joins, runs, sketches


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _asof(left, right):
    out = []
    for i, k, t in left:
        fits = [(rt, v) for rk, rt, v in right if k is not None and t is not None and rk == k and rt is not None and rt <= t]
        out.append((i, max(fits)[1] if fits else None))
    return sorted(out, key=repr)


def test_asof_join_with_one_key_for_all_rows(spark):
    rng = random.Random(2)
    for keys, n in (([7], 1), ([7], 40), ([1, 2, None], 8), (range(300), 16)):
        left = [(i, rng.choice(keys), rng.choice([None, *range(200)])) for i in range(500)] + [(900, 7, 50)] * 30
        right = [(rng.choice(keys), rng.choice([None, *range(200)]), rng.randint(0, 9)) for _ in range(150)]
        a = spark.createDataFrame(left, "i int, k int, t int").repartition(5)
        b = spark.createDataFrame(right, "k int, at int, v int").repartition(3)
        out = joins.asof_join(a, b, ["k"], "t", "at", ["v"], partitions=n)
        assert sorted(((r["i"], r["v"]) for r in out.collect()), key=repr) == _asof(left, right), (keys, n)
    assert out.columns == ["i", "k", "t", "v"]
    empty = b.limit(0)
    assert joins.asof_join(a, empty, ["k"], "t", "at", ["v"]).filter("v is not null").count() == 0 and joins.asof_join(a.limit(0), b, ["k"], "t", "at", ["v"]).count() == 0


def test_asof_join_deals_a_hot_key_to_many_tasks(spark):
    left = spark.range(8000).select("id", F.lit(1).alias("k"), (F.col("id") % 997).alias("t"))
    right = spark.range(50).select(F.lit(1).alias("k"), (F.col("id") * 20).alias("at"), F.col("id").alias("v"))
    out = joins.asof_join(left, right, ["k"], "t", "at", ["v"], partitions=16)
    assert out.groupBy(F.spark_partition_id()).count().count() > 1 and out.filter("v <> t div 20").count() == 0 and out.count() == 8000
    assert "CartesianProduct" not in plan_of(out) and "NestedLoop" not in plan_of(out)


def test_interval_join(spark):
    rng = random.Random(3)
    spans = lambda n, k: [(i, s, s + rng.choice([0, 1, 2, 5, 90, 1000, -4]), rng.choice(k)) for i in range(n) for s in [rng.randint(-500, 3000)]]
    left, right = [*spans(200, "ab"), (500, -(10**9), 10**9, "a"), (501, None, 5, "a"), (502, 3, 7, None)], [*spans(200, "ab"), (600, -(2**40), 2**40, "b"), (601, 3, None, "a"), (602, 3, 7, None)]
    a = spark.createDataFrame(left, "i int, start long, end long, k string")
    b = spark.createDataFrame(right, "j int, r_start long, r_end long, k string")
    fine = lambda x: x[1] is not None and x[2] is not None and x[1] < x[2]
    for on in (["k"], []):
        out = joins.interval_join(a, b.drop("k") if not on else b, on)
        want = sorted((x[0], y[0]) for x in left for y in right if fine(x) and fine(y) and x[1] < y[2] and y[1] < x[2] and (not on or (x[3] == y[3] and x[3])))
        assert sorted((r["i"], r["j"]) for r in out.collect()) == want and len(want) > 200
        assert "CartesianProduct" not in plan_of(out) and "NestedLoop" not in plan_of(out)
    assert joins.interval_join(a.limit(0), b, ["k"]).count() == 0


def test_sketches_merge_to_what_all_rows_give(spark):
    rng = random.Random(4)
    rows = [(f"d{rng.randint(1, 4)}", rng.choice("xyz"), rng.choice([None, rng.randint(0, 9000)]), rng.choice([None, rng.expovariate(1.0)])) for _ in range(30_000)] + [("d9", "x", None, None)]
    df = spark.createDataFrame(rows, "day string, source string, user_id int, value double")
    got = sketches.rolled_up(sketches.sketched(df, ["day", "source"]), ["day", "source"]).collect()
    assert len(got) == 1 + 5 + 13
    for r in got:
        own = [x for x in rows if (r["day"] is None or x[0] == r["day"]) and (r["source"] is None or x[1] == r["source"])]
        ids, values = {x[2] for x in own} - {None}, sorted(x[3] for x in own if x[3] is not None)
        assert r["level"] == (r["day"] is None) + (r["source"] is None) and r["n"] == len(own)
        assert r["total"] == (sum(round(v * 1_000_000) for v in values) if values else None) or abs(r["total"] - sum(v * 1_000_000 for v in values)) < len(values)
        assert abs(r["distinct_ids"] - len(ids)) <= max(1, 4 * 1.04 / math.sqrt(2**sketches.LOG) * len(ids))
        for name, q in (("q50", 0.5), ("q90", 0.9)):
            assert (r[name] is None) == (not values)
            if values:
                rank = sum(v <= r[name] for v in values) / len(values)
                assert abs(rank - q) <= 2 * sketches.RANK_ERROR + 1 / len(values)


def test_runs_of_pages(spark):
    enc, kan = "ªÀ £À", "ಕನ್ನಡ ಪಠ್ಯ ಇಲ್ಲಿ ಇದೆ"
    data = [(1, 1, kan), (1, 2, enc), (1, 3, enc + " x"), (1, 5, enc), (1, 6, None), (2, 4, enc), (2, 5, kan), (None, 1, kan)]
    pages = spark.createDataFrame(data, "doc_id long, page_num int, page_text string").repartition(3)
    got = {(r["doc_id"], r["run"]): (r["first_page"], r["last_page"], r["font_encoded"], r["text"]) for r in runs.font_runs(pages).collect()}
    assert got == {
        (1, 1): (1, 1, False, kan + "\n\n"), (1, 2): (2, 3, True, f"{enc}\n\n{enc} x\n\n"), (1, 3): (5, 5, True, enc + "\n\n"), (1, 4): (6, 6, False, "\n\n"),
        (2, 1): (4, 4, True, enc + "\n\n"), (2, 2): (5, 5, False, kan + "\n\n"), (None, 1): (1, 1, False, kan + "\n\n"),
    }
    fixed = {(r["doc_id"], r["run"]): r["text"] for r in runs.repaired_runs(pages).collect()}
    assert fixed == {k: repaired_digital(v[3], v[2]) for k, v in got.items()}
