"""Connected components as Spark joins, with every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, with_lookup


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the smallest node of its component) for the nodes of edges (a, b), all long and not null.

    Each round every node takes the smallest label among its own, its neighbours' and its label's label, so stars of
    any size and long chains end in few rounds. Minima over neighbours are combined before the shuffle; labels of hubs,
    and of the roots of large components, are repeated for salts of the rows that look them up.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")), "labels")
    while True:
        near = with_lookup(both, labels.select(F.col("a").alias("b"), F.col("comp").alias("_l")), "b", ["a"]).groupBy("a").agg(F.min("_l").alias("_near"))
        met = stored(labels.join(near, "a").select("a", F.col("comp").alias("_was"), F.least("comp", "_near").alias("comp")), "labels-near")
        jump = labels.select(F.col("a").alias("comp"), F.col("comp").alias("_next"))
        labels = stored(with_lookup(met, jump, "comp", ["a"]).select("a", "_was", F.least("comp", "_next").alias("comp")), "labels")
        if labels.filter("comp < _was").isEmpty():
            return labels.select(F.col("a").alias("node"), "comp")
        labels = labels.select("a", "comp")
