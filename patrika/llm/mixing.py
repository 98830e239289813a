"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets the same expected number of copies. The whole part is taken outright. Fractional
parts are rounded in pairs: a random transfer of words between two documents makes one of them whole, keeps both
expectations and keeps the words of the pair. What a group leaves is at most one fractional document, and these
residuals meet in further rounds of groups, a reduction tree, until each source has one, which is rounded by a coin.
So a source's taken words miss the target by less than one document. Rows that agree in id, source and size are one row
that stands for so many: the whole part of all their copies is dealt among them, and one fraction is left to round.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, defined_id, stored, with_group

#: Documents that one task rounds together, about; and of repeated rows so many come out of one at a time.
FAN_IN, AT_ONCE = 2048, 1 << 14


def _ranked(sources: DataFrame) -> DataFrame:
    """sources with `_rank`, from 0 in code-point order with null last, without one task for all of them."""
    parts = stored(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id()), "mix-sources")
    before = parts.groupBy("_part").count().withColumn("_before", F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))  # a row per partition
    own = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())) - 1
    return parts.withColumn("_own", own).join(before, "_part").withColumn("_rank", F.col("_own") + F.coalesce("_before", F.lit(0))).drop("_part", "_own", "_before", "count")


def targets(sized: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """source, source_size, target, from rows (source, size, _rows): `share` of all sizes dealt by the weights, `weights` repeating over the sources
    in code-point order (null last). A target stops at `most` times its source's size; the excess is dealt again by
    weight among the others until none is above. Loops over sums only; the sources stay distributed."""
    sizes = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("_rows")).alias("source_size"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_rank") % len(weights)).cast("int") + 1)
    table = stored(_ranked(sizes).select("source", "source_size", w.alias("_w")), "mix-weights")
    cap = F.col("source_size") * most
    total = float(table.agg(F.sum("source_size")).first()[0] or 0) * share
    level, capped = 0.0, F.lit(False)
    while True:
        got = table.agg(F.sum(F.when(capped, cap)).alias("full"), F.sum(F.when(~capped, F.col("_w"))).alias("w")).first()
        if not got["w"]:
            break
        level, before = (total - float(got["full"] or 0)) / float(got["w"]), level
        if level <= before:  # none was above
            break
        capped = (F.lit(level) * F.col("_w")) > cap
    return table.select("source", "source_size", F.least(F.lit(level) * F.col("_w"), cap.cast("double")).alias("target"))


def _named(col: str) -> Column:
    """The source as a key that is never null: '' for null, else '=' and the name."""
    return F.coalesce(F.concat(F.lit("="), F.col(col)), F.lit(""))


def _coin(seed: int, *parts: object) -> float:
    raw = hashlib.blake2b(repr((seed, *parts)).encode(), digest_size=8).digest()
    return int.from_bytes(raw, "big") / 2**64


def _rounder(seed: int):
    def rounded(rows: pd.DataFrame) -> pd.DataFrame:
        return _round_group(rows, seed)

    return rounded


def _round_group(rows: pd.DataFrame, seed: int) -> pd.DataFrame:
    """Rounds `_p` in pairs, from the largest document on; at most one row stays fractional, none if the source has but this group."""
    last = bool((rows["_n"] == 1).all())
    # large documents first: those that stay fractional to the end, and miss the target, are small
    rows = rows.sort_values(["size", "_key", "doc_id"], ascending=[False, True, True], kind="stable", na_position="first")
    keys, size, p = rows["_key"].tolist(), rows["size"].astype(float).tolist(), rows["_p"].tolist()
    held = None
    for i in range(len(p)):
        if p[i] <= 0 or p[i] >= 1:
            continue
        if held is None:
            held = i
            continue
        a, b = size[held], size[i]
        up = min((1 - p[held]) * a, p[i] * b)  # words that may go to the held one
        down = min(p[held] * a, (1 - p[i]) * b)
        if _coin(seed, keys[held], keys[i], i) * (up + down) < down:
            p[held], p[i] = p[held] + up / a, p[i] - up / b
        else:
            p[held], p[i] = p[held] - down / a, p[i] + down / b
        for j in (held, i):
            p[j] = 0.0 if p[j] < 1e-9 else 1.0 if p[j] > 1 - 1e-9 else p[j]
        left = [j for j in (held, i) if 0 < p[j] < 1]
        held = left[0] if left else None
    if held is not None and last:
        p[held] = float(_coin(seed, keys[held], "last") < p[held])
    rows["_p"] = p
    return rows


def mix(docs: DataFrame, seed: int = 17, weights: tuple[float, ...] = (1.0, 2.0, 3.0), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """A row per document: doc_id, source, size, source_size, target, copies, taken (= copies * size).

    Size is the number of words (null text: 0), of very long texts as of others. Equal inputs give equal results, however they are partitioned: the
    coins and the groups of the tree depend on ids and sizes only. Documents without words take the whole part of
    their source's copies. Which of rows with equal id, source and size takes a copy makes no difference. An empty table
    gives an empty result. Sources may be null; ids too. Columns other than doc_id, source and text are not looked at.
    """
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"))
    sized = stored(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("_rows")), "mix-sizes")
    goal = targets(sized, weights, share, most).withColumn("_s", _named("source"))
    key = F.xxhash64(F.lit(seed), defined_id("doc_id"), "size")
    flat = sized.withColumn("_s", _named("source")).drop("source").withColumn("_key", key)
    # the targets go to each salt of a source, so a source with a third of the documents is spread
    grouped = with_group(flat, ["_s"], [F.count("*").alias("_docs")], ["_key"], salts=32)
    salted = grouped.withColumn("_salt", F.pmod("_key", F.lit(32)).cast("int"))
    goals = goal.select("_s", "source_size", "target", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("_salt"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = salted.join(goals, ["_s", "_salt"]).withColumn("_base", F.floor(rate + 1e-12))
    part = F.when(F.col("size") > 0, F.greatest(rate - F.col("_base"), F.lit(0.0))).otherwise(0.0) * F.col("_rows")
    # of so many equal rows, _more have a copy beyond _base, and one has another with probability _p
    rows = rows.withColumn("_more", F.floor(part + 1e-12)).withColumn("_p", F.greatest(part - F.col("_more"), F.lit(0.0)))
    # groups of FAN_IN documents on average, by a hash that does not depend on how rows are partitioned
    rows = rows.withColumn("_n", F.ceil(F.col("_docs") / FAN_IN).cast("long")).select("doc_id", "_s", "size", "source_size", "target", "_rows", "_base", "_more", "_p", "_key", "_n")
    schema = rows.schema
    done, level = None, 0
    # _n is the number of groups of the row's source at this level
    widest = int(rows.agg(F.max("_n")).first()[0] or 0)
    while widest:
        ends = widest == 1
        out = stored(rows.groupBy("_s", F.pmod(F.xxhash64(F.lit(level), "_key"), "_n").alias("_group")).applyInPandas(_rounder(seed + level), schema), f"mix-level{level}")
        whole = (F.col("_p") <= 0) | (F.col("_p") >= 1)
        done = out.filter(whole) if done is None else done.unionByName(out.filter(whole))
        rows = out.filter(~whole).withColumn("_n", F.ceil(F.col("_n") / FAN_IN).cast("long"))
        widest, level = (0 if ends else -(-widest // FAN_IN)), level + 1
    out = rows if done is None else done
    # each row for itself again; very many equal ones in pieces
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_rows") - 1) / AT_ONCE)))
    out = out.withColumn("_piece", piece)
    nth = F.explode(F.sequence(F.col("_piece") * AT_ONCE, F.least(F.col("_piece") * AT_ONCE + AT_ONCE, "_rows") - 1))
    out = out.withColumn("_nth", nth)
    copies = (F.col("_base") + (F.col("_nth") < F.col("_more") + F.col("_p")).cast("long")).cast("long")
    return out.select("doc_id", F.expr("if(_s = '', null, substr(_s, 2))").alias("source"), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
