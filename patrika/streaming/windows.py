"""Aggregates over windows of time, for tables and for streams with late rows (an extension).

The same DataFrame serves both: on a table every row counts; on a stream the watermark says how late a row may be, and
windows come out once it has passed them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def tumbling(ts: Column | str, width: str) -> Column:
    return F.window(ts, width)


def sliding(ts: Column | str, width: str, slide: str) -> Column:
    return F.window(ts, width, slide)


def session(ts: Column | str, gap: str) -> Column:
    """A window for each run of rows that follow each other by less than the gap."""
    return F.session_window(ts, gap)


def summed(events: DataFrame, window: Column, keys: list[str], value: str = "value", late: str | None = None, ts: str = "ts") -> DataFrame:
    """A row for each window and keys: start, end, n (rows), total (of `value`, in millionths, so that sums don't depend on
    the order) and largest. `late`: on a stream, how late rows may be; later ones are dropped and counted (late_rows).
    Rows without a time belong to no window; null values count as rows only."""
    rows = events.withWatermark(ts, late) if late else events
    out = rows.groupBy(window.alias("_w"), *keys).agg(F.count("*").alias("n"), F.sum(F.round(F.col(value) * 1_000_000).cast("long")).alias("total"), F.max(value).alias("largest"))
    return out.select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *keys, "n", "total", "largest")


def late_rows(query: StreamingQuery) -> int:
    """How many rows a query has dropped as too late, as far as its progress is kept. Rows of one batch that agree in window
    and keys are one."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])
