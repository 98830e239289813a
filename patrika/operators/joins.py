"""Joins by time: the latest row before, and overlapping intervals (extensions)."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the folder that the cluster names in spark.checkpoint.dir, and read from there. A local session that
    names none gets one; a cluster has to name one."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        here = sc.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not here and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(here or tempfile.mkdtemp(prefix="patrika-"))
    return df.checkpoint()


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str, columns: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Each row of left with `columns` of the latest row of right that has the same keys and a time not after its own; null
    where there is none. Of right rows equal in keys and time, the one that is largest by `columns` counts. Rows of left
    with a null key or time match nothing; right's are left out. `columns` must have other names than left's.

    A distributed scan: both sides are dealt by range of keys and time and sorted, each partition remembers its last right
    row, and takes for its first key the last one that earlier partitions had. So a key may hold any share of the rows.
    """
    ok = F.lit(True)
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    key = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(1).alias("one"))
    shown = F.struct(*[F.col(c) for c in columns])
    kind = right.select(shown.alias("_r")).schema["_r"].dataType
    a = left.select(F.struct("*").alias("_l"), F.lit(1).alias("_side"), F.when(ok & F.col(left_ts).isNotNull(), key).alias("_key"), F.col(left_ts).alias("_ts"), F.lit(None).cast(kind).alias("_r"))
    b = right.filter(ok & F.col(right_ts).isNotNull()).select(F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), F.lit(0).alias("_side"), key.alias("_key"), F.col(right_ts).cast(a.schema["_ts"].dataType).alias("_ts"), shown.alias("_r"))
    order = ["_key", "_ts", "_side", "_r"]
    n = partitions or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # equal rows of left may be dealt to several partitions, in any way
    both = a.unionByName(b).withColumn("_tie", F.when(F.col("_side") == 1, F.monotonically_increasing_id()))
    placed = checkpointed(both.repartitionByRange(n, *order, "_tie").withColumn("_part", F.spark_partition_id()))
    so_far = Window.partitionBy("_part", "_key").orderBy("_ts", "_side", "_r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scanned = placed.withColumn("_seen", F.last("_r", ignorenulls=True).over(so_far))
    ends = placed.groupBy("_part", "_key").agg(F.max_by("_r", F.when(F.col("_side") == 0, F.struct("_ts", "_r"))).alias("_last"))
    earlier = F.last("_last", ignorenulls=True).over(Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    # only a partition's first key goes back to earlier ones: a row for each partition at most
    carried = ends.withColumn("_before", earlier).filter(F.col("_before").isNotNull() & F.col("_key").isNotNull()).select("_part", "_key", "_before")
    rows = scanned.filter("_side = 1").join(F.broadcast(carried), ["_part", "_key"], "left").withColumn("_f", F.when(F.col("_key").isNotNull(), F.coalesce("_seen", "_before")))
    return rows.select("_l.*", *[F.col(f"_f.{c}").alias(c) for c in columns])


def length_class(start: Column, end: Column) -> Column:
    """The power of two that is at least the interval's length: 0 for lengths up to 1."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(end - start, F.lit(1)).cast("double")))).cast("int")


def interval_join(left: DataFrame, right: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """Pairs of rows of left (start, end, ...) and right (r_start, r_end, ...) whose intervals [start, end) overlap, and whose
    columns `on` (of the same names) are equal: all columns of both. Times are whole numbers (longs). Empty intervals and
    those with a null end or start overlap nothing.

    Intervals are cut into bins as wide as the power of two that holds the longer one of a pair, of which either touches
    two at most: the longer one stands in the bins of its own class, the shorter one looks in those of each class that
    the other side has. An equi-join on class and bin finds the pairs, and the bin in which an overlap begins, once.
    """
    a = left.filter("start < end").withColumn("_a", F.struct("*")).withColumn("_ac", length_class(F.col("start"), F.col("end")))
    b = right.filter("r_start < r_end").withColumn("_b", F.struct("*")).withColumn("_bc", length_class(F.col("r_start"), F.col("r_end")))
    classes = {c: sorted(r[0] for r in df.select(c).distinct().collect()) for df, c in ((a, "_ac"), (b, "_bc"))}  # 64 each at most

    def bins(df: DataFrame, start: str, end: str, width: Column) -> DataFrame:
        return df.withColumn("_class", width).withColumn("_bin", F.explode(F.sequence(F.expr(f"shiftright({start}, _class)"), F.expr(f"shiftright({end} - 1, _class)"))))

    def looked(own: str, there: list[int], strict: bool) -> Column:
        wide = F.array(*[F.lit(c) for c in there]).cast("array<int>")
        return F.explode(F.filter(wide, lambda c: (c > F.col(own)) if strict else (c >= F.col(own))))

    a_long, b_short = bins(a, "start", "end", F.col("_ac")), bins(b, "r_start", "r_end", looked("_bc", classes["_ac"], False))
    b_long, a_short = bins(b, "r_start", "r_end", F.col("_bc")), bins(a, "start", "end", looked("_ac", classes["_bc"], True))
    out = None
    for x, y in ((a_long, b_short), (a_short, b_long)):
        y = y.select("_class", "_bin", "r_start", "r_end", "_b", *[F.col(c).alias(f"_on_{c}") for c in on])
        test = (x["_class"] == y["_class"]) & (x["_bin"] == y["_bin"])
        for c in on:
            test = test & (x[c] == y[f"_on_{c}"])
        met = x.join(y, test).filter((F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end")))
        met = met.select(x["_class"].alias("_w"), x["_bin"].alias("_at"), "start", "r_start", "_a", "_b").filter(F.expr("_at = shiftright(greatest(start, r_start), _w)"))
        part = met.select("_a.*", *[F.col(f"_b.{c}").alias(c) for c in right.columns if c not in on])
        out = part if out is None else out.unionByName(part)
    return out
