"""Sketches of a day that are stored once and merged for any grouping afterwards (an extension).

Distinct ids by HyperLogLog and quantiles by KLL: both merge exactly, so what is merged from days is as good as a sketch
of all rows, and a report over years reads a row for each day and source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Logarithm of an HLL sketch's registers: a standard error of 1.04 / sqrt(2**LOG) for distinct counts, 0.8 %.
LOG = 14
#: Size of a KLL sketch: a quantile's rank is off by less than RANK_ERROR in 99 of 100 cases.
SIZE, RANK_ERROR = 200, 0.0133


def sketched(rows: DataFrame, keys: list[Column | str], id_col: str = "user_id", value_col: str = "value") -> DataFrame:
    """A row for each of `keys`: n, total (of the value, in millionths), ids and values (sketches). Null ids and values are
    in no sketch, and null values in no total."""
    total = F.sum(F.round(F.col(value_col) * 1_000_000).cast("long"))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), total.alias("total"), F.hll_sketch_agg(id_col, F.lit(LOG)).alias("ids"), F.kll_sketch_agg_double(F.col(value_col).cast("double"), F.lit(SIZE)).alias("values"))


def rolled_up(sketches: DataFrame, keys: list[str], quantiles: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """sketched() rows merged through ROLLUP: keys, level (how many of them are rolled up), n, total, distinct_ids (estimate)
    and q50, q90 (estimates; null where there are no values)."""
    some = F.kll_sketch_get_n_double("_values") > 0
    merged = sketches.rollup(*keys).agg(F.grouping_id().alias("_g"), F.sum("n").alias("n"), F.sum("total").alias("total"), F.hll_union_agg("ids").alias("_ids"), F.kll_merge_agg_double("values").alias("_values"))
    estimates = [F.when(some, F.kll_sketch_get_quantile_double("_values", F.lit(x))).alias(f"q{x * 100:g}") for x in quantiles]
    return merged.select(*keys, F.bit_count("_g").cast("int").alias("level"), "n", "total", F.hll_sketch_estimate("_ids").alias("distinct_ids"), *estimates)
