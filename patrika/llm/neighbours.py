"""Approximate nearest neighbours by a forest of random-projection trees.

A tree splits the space by random directions, one for each level and orthogonal to each other, at the medians of a bounded
sample (SAMPLE vectors); every vector of the table then has a leaf in each tree. A query takes leaves from one priority
queue that all trees share: the queue's order is a leaf's squared distance from the query along the directions on whose
far side it lies, which is 0 for the query's own leaves. How many leaves are taken is measured, not set: for a sample of
queries the true neighbours are found by a scan of everything, and the queue is followed until RECALL of them are in it.
So data in which neighbours are clear cost a few leaves, and data without structure a large share of all.

Equal vectors are one, with as many of the smallest ids as a result can hold, so copies of any number are a row each for
a query. Rows and queries meet by leaf, in blocks of rows (a block is held, queries stream through), so a leaf that holds
much of the data is dealt to many tasks. There, a product of matrices finds what may be among the nearest, and those are
ranked by the exact cosine of the vectors as they are, in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import defined_id, real_id, stored, tidy, with_lookup
from .textarrays import mixed

#: Trees, vectors they are fitted on at most (about), and rows of a leaf in the table and of the sample at least.
TREES, SAMPLE, LEAF, LEAF_SAMPLE = 3, 1 << 15, 512, 16
#: Queries whose true neighbours are looked up, and the share of these that the queue has to reach.
MEASURED, RECALL = 256, 0.95
#: Rows of a leaf that a task holds at a time; queries compared with them at a time; results after which a task keeps only
#: the nearest of each query.
BLOCK, QUERIES, RESULTS = 4096, 256, 1 << 16
#: Products of matrices differ from exact cosines by less.
SLACK = 1e-9


def exact_cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row in double precision; sums go along each row, so equal vectors give equal numbers wherever they stand."""
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Vectors times powers of two, which changes no cosine, so that no square is too large or too small."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0))[1][:, None])


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


@dataclass
class Forest:
    """directions: (dimensions, TREES * depth), tree by tree; thresholds[t][level]: one for each node of the level, counted
    from the left; counts[t]: vectors of the sample in each leaf."""

    depth: int
    directions: np.ndarray
    thresholds: list[list[np.ndarray]]
    counts: np.ndarray

    @property
    def leaves(self) -> int:
        return 1 << self.depth

    def leaf_of(self, units: np.ndarray) -> np.ndarray:
        """For each vector, its leaf in each tree; leaves are numbered through all trees."""
        along, out = units @ self.directions, np.zeros((len(units), len(self.thresholds)), np.int64)
        for t, levels in enumerate(self.thresholds):
            for level, limit in enumerate(levels):
                out[:, t] = 2 * out[:, t] + (along[:, t * self.depth + level] > limit[out[:, t]])
            out[:, t] += t * self.leaves
        return out

    def queue(self, units: np.ndarray) -> np.ndarray:
        """For each vector, all leaves of all trees in the order in which the shared queue gives them."""
        along, parts = units @ self.directions, []
        for t, levels in enumerate(self.thresholds):
            away = np.zeros((len(units), 1))
            for level, limit in enumerate(levels):
                margin = along[:, [t * self.depth + level]] - limit[None, :]
                both = np.stack([away + np.where(margin > 0, margin**2, 0), away + np.where(margin > 0, 0, margin**2)], 2)
                away = both.reshape(len(units), -1)
            parts.append(away)
        return np.argsort(np.concatenate(parts, 1), axis=1, kind="stable")


def fit(sample: np.ndarray, depth: int, trees: int = TREES) -> Forest:
    """A forest over unit vectors."""
    rng, thresholds, directions = np.random.default_rng(11), [], []
    counts = np.zeros((trees, 1 << depth), np.int64)
    for t in range(trees):
        own, _ = np.linalg.qr(rng.standard_normal((sample.shape[1], max(depth, 1))))
        while own.shape[1] < depth:  # more levels than dimensions
            own = np.concatenate([own, np.linalg.qr(rng.standard_normal((sample.shape[1], depth)))[0]], 1)
        directions.append(own[:, :depth])
        along, leaf, levels = sample @ own[:, :depth], np.zeros(len(sample), np.int64), []
        for level in range(depth):
            order = np.lexsort((along[:, level], leaf))
            start = np.searchsorted(leaf[order], np.arange((1 << level) + 1))
            middle = np.minimum((start[:-1] + start[1:] - 1) // 2, len(sample) - 1)
            after = np.minimum(middle + 1, np.maximum(start[1:] - 1, 0))  # between two vectors, so that none lies on the plane
            levels.append(np.where(start[1:] > start[:-1], (along[order[middle], level] + along[order[after], level]) / 2, 0.0))
            leaf = 2 * leaf + (along[:, level] > levels[-1][leaf])
        thresholds.append(levels)
        counts[t] = np.bincount(leaf, minlength=1 << depth)
    return Forest(depth, np.concatenate(directions, 1), thresholds, counts)


def needed(queue: np.ndarray, leaves: np.ndarray, recall: float) -> int:
    """Leaves to take from each queue (a row each) until `recall` of the neighbours is met; leaves: rows (query, leaf in
    each tree), one for each neighbour."""
    if not len(leaves):
        return queue.shape[1]
    place = np.empty_like(queue)
    np.put_along_axis(place, queue, np.broadcast_to(np.arange(queue.shape[1]), queue.shape), 1)
    first = place[leaves[:, 0][:, None], leaves[:, 1:]].min(1)
    return int(np.sort(first)[min(len(first) - 1, int(np.ceil(recall * len(first))) - 1)]) + 1


def _vectors(column: pa.Array, kind: np.dtype) -> np.ndarray:
    """Rows of a binary column as vectors in double precision."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(float)


def _packed(kind: np.dtype, dimensions: int):
    """Rows (node, ids, vector) with lists as bytes."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.ascontiguousarray(batch.column(2).flatten().to_numpy(zero_copy_only=False), kind).reshape(batch.num_rows, dimensions)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([r.tobytes() for r in flat], pa.binary())], ["node", "ids", "vector"])

    return run


def _nearest_of_all(forest: Forest, queries: np.ndarray, own: np.ndarray, kind: np.dtype, k: int):
    """Rows (query, cosine, leaves) of a task's vectors nearest to each query, itself left out, from rows (node, vector)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, leaf = np.full((len(queries), k), -9.0), np.zeros((len(queries), k, len(forest.thresholds)), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            units = _units(_scaled(_vectors(batch.column(1), kind)))
            close = queries @ units.T
            close[own[:, None] == batch.column(0).to_numpy()[None, :]] = -9
            both = np.concatenate([score, close], 1)
            top = np.argpartition(-both, min(k, both.shape[1] - 1), axis=1)[:, :k]
            old = np.take_along_axis(leaf, np.minimum(top, k - 1)[:, :, None], 1)
            leaf = np.where((top < k)[:, :, None], old, forest.leaf_of(units)[np.maximum(top - k, 0)])
            score = np.take_along_axis(both, top, 1)
        q, i = np.nonzero(score > -2)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(score[q, i]), pa.array(leaf[q, i].tolist(), pa.list_(pa.int64()))], ["query", "cosine", "leaves"])

    return run


def _leaf_sizes(forest: Forest, kind: np.dtype):
    """Rows (leaf, n) from rows (vector)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(forest.counts.size, np.int64)
        for batch in batches:
            if batch.num_rows:
                n += np.bincount(forest.leaf_of(_units(_scaled(_vectors(batch.column(0), kind)))).ravel(), minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], ["leaf", "n"])

    return run


def _in_leaves(forest: Forest, kind: np.dtype, blocks: np.ndarray):
    """A row (leaf, block, side 0, node, ids, vector) for each tree."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaves = forest.leaf_of(_units(_scaled(_vectors(batch.column(2), kind))))
                nth = mixed(batch.column(0).to_numpy().view(np.uint64))
                for t in range(leaves.shape[1]):
                    block = (nth % blocks[leaves[:, t]].astype(np.uint64)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(leaves[:, t]), pa.array(block), pa.array([0] * len(nth), pa.int32()), *batch.columns], ["leaf", "block", "side", "node", "ids", "vector"])

    return run


def _queued(forest: Forest, kind: np.dtype, blocks: np.ndarray, take: int, k: int):
    """A row (leaf, block, side 1, node, ids: null, vector) for each block of the first `take` leaves of a query's queue, and
    of more while these may hold less than k + 1 vectors, from rows (node, vector)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = forest.counts.ravel()
        for whole in batches:
            for lo in range(0, whole.num_rows, QUERIES):
                batch = whole.slice(lo, QUERIES)
                queue = forest.queue(_units(_scaled(_vectors(batch.column(1), kind))))
                held = np.cumsum(counts[queue], 1) - counts[queue]
                use = (np.arange(queue.shape[1])[None, :] < take) | (held < (k + 1) * len(forest.thresholds))
                row, place = np.nonzero(use)
                leaf = queue[row, place]
                many = blocks[leaf]
                block = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                leaf, row = np.repeat(leaf, many), pa.array(np.repeat(row, many))
                node, vector = (c.take(row) for c in batch.columns)
                yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(block.astype(np.int32)), pa.array([1] * len(leaf), pa.int32()), node, pa.nulls(len(leaf), pa.list_(pa.int64())), vector], ["leaf", "block", "side", "node", "ids", "vector"])

    return run


def _themselves(kind: np.dtype):
    """Rows (query, node, ids, score) of queries found by themselves, from rows (node, ids, vector): their copies are near,
    whatever leaves are taken."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _scaled(_vectors(batch.column(2), kind))
                yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[:2], pa.array(exact_cosines(x, x))], ["query", "node", "ids", "score"])

    return run


def _compared(kind: np.dtype, k: int):
    """Rows (leaf, block, side, node, ids, vector) sorted by the first three, a block's vectors (side 0) before its queries:
    rows (query, node, ids, score), the k + 1 nearest vectors for each query that a task sees, the one of the smaller id
    first; a few more where it sees very many queries."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, many = [], 0
        for part in results(batches):
            found, many = [*found, part], many + part.num_rows
            if many > RESULTS:
                best = fewer(found)
                if best.num_rows > RESULTS // 2:  # many queries rather than many results of each
                    yield from best.to_batches()
                    found, many = [], 0
                else:
                    found, many = best.to_batches(), best.num_rows
        if found:
            yield from fewer(found).to_batches()

    def fewer(found: list[pa.RecordBatch]) -> pa.Table:
        table = pa.Table.from_batches(found).combine_chunks()
        query, node, score = (table.column(c).to_numpy() for c in ("query", "node", "score"))
        first = pc.list_element(table.column("ids"), 0).to_numpy()
        order = np.lexsort((node, first, -score, query))
        query, node = query[order], node[order]
        new = np.concatenate([[True], (query[1:] != query[:-1]) | (node[1:] != node[:-1])])
        order, query = order[new], query[new]  # trees find the same
        return table.take(pa.array(order[np.arange(len(query)) - np.searchsorted(query, query) < k + 1]))

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, vectors, nodes, ids, held = None, None, None, None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            leaf, block, side = (batch.column(i).to_numpy() for i in range(3))
            edges = np.flatnonzero((leaf[1:] != leaf[:-1]) | (block[1:] != block[:-1]) | (side[1:] != side[:-1])) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                part, here = batch.slice(lo, hi - lo), (leaf[lo], block[lo])
                if side[lo] == 0:
                    if here != key:
                        key, held = here, []
                    held.append(part)
                    vectors = None
                elif here == key:  # else the leaf has no vectors
                    if vectors is None:
                        vectors = _scaled(np.concatenate([_vectors(p.column(5), kind) for p in held]))
                        nodes = np.concatenate([p.column(3).to_numpy() for p in held])
                        ids = [x for p in held for x in p.column(4).to_pylist()]
                        first = np.array([x[0] for x in ids])
                        units = _units(vectors)
                    for at in range(0, part.num_rows, QUERIES):
                        yield nearest(part.slice(at, QUERIES), vectors, units, nodes, ids, first)

    def nearest(part: pa.RecordBatch, vectors: np.ndarray, units: np.ndarray, nodes: np.ndarray, ids: list, first: np.ndarray) -> pa.RecordBatch:
        asked = _scaled(_vectors(part.column(5), kind))
        close = _units(asked) @ units.T
        if close.shape[1] > k + 1:
            q, i = np.nonzero(close >= np.partition(close, -(k + 1), axis=1)[:, [-(k + 1)]] - SLACK)
        else:
            q, i = np.repeat(np.arange(len(close)), close.shape[1]), np.tile(np.arange(close.shape[1]), len(close))
        score = np.empty(len(q))
        for lo in range(0, len(q), 1 << 14):
            score[lo : lo + (1 << 14)] = exact_cosines(asked[q[lo : lo + (1 << 14)]], vectors[i[lo : lo + (1 << 14)]])
        order = np.lexsort((first[i], -score, q))
        q, i, score = q[order], i[order], score[order]
        some = np.flatnonzero(np.arange(len(q)) - np.searchsorted(q, q) < k + 1)
        q, i, score = q[some], i[some], score[some]
        return pa.RecordBatch.from_arrays([pa.array(part.column(3).to_numpy()[q]), pa.array(nodes[i]), pa.array([ids[x] for x in i], pa.list_(pa.int64())), pa.array(score)], ["query", "node", "ids", "score"])

    return run


def search(table: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """For each row whose id is divisible by `every`, the k nearest other rows that are found: query_id, rank from 1,
    vec_id, score (cosine in double precision), nearest first, of equally near ones the smaller id first.

    Vectors that are null, zero or empty, or hold null or non-finite components, take no part. Vectors of different
    lengths are not compared. Repeated rows are rows of their own: each copy is a candidate for the others. A null id is
    the smallest, and no query. With fewer than k candidates all are found; an empty table gives an empty result. Columns
    other than those named are not looked at. `recall` of the neighbours are found, as measured on MEASURED queries.
    """
    vector = F.col(vector_col)
    fine = F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(vector, lambda x: x != 0), F.lit(False))
    rows = table.filter(fine).select(defined_id(id_col).alias("id"), F.col(id_col).isNull().alias("nameless"), vector.alias("vector"))
    rows = rows.withColumn("key", F.struct(F.xxhash64("vector").alias("a"), F.xxhash64(F.lit(7), "vector").alias("b")))
    place = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    # the smallest ids of equal vectors, more of which can't be among the nearest
    few = rows.withColumn("_place", place).filter(F.col("_place") <= k + 1)
    same = few.groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.min_by("vector", "_place").alias("vector"))
    same = stored(same.select(F.monotonically_increasing_id().alias("node"), "key", "ids", F.size("vector").alias("size"), "vector"), "neighbours-vectors")
    asked = rows.filter(~F.col("nameless") & (F.col("id") % every == 0)).select("id", "key")
    asked = stored(with_lookup(asked, same.select("key", "node", "size"), "key", ["id"]).select("id", "node", "size"), "neighbours-queries")
    kind = np.dtype("<f4" if table.schema[vector_col].dataType.elementType.simpleString() == "float" else "<f8")
    sizes = [r["size"] for r in asked.select("size").distinct().orderBy("size").collect()]  # lengths of vectors
    out = None
    for size in sizes:
        found = _found(same.filter(F.col("size") == size), asked.filter(F.col("size") == size), size, kind, k, recall)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return out


def _found(same: DataFrame, asked: DataFrame, size: int, kind: np.dtype, k: int, recall: float) -> DataFrame:
    nodes = stored(same.select("node", "ids", "vector").mapInArrow(_packed(kind, size), "node long, ids array<long>, vector binary"), "neighbours-packed")
    many = nodes.count()
    drawn = lambda df, share: df.filter(F.pmod(F.xxhash64(F.lit(3), "node"), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30)))
    sample = drawn(nodes, SAMPLE / max(1, many)).select("vector").toArrow()  # about SAMPLE vectors
    sample = _units(_scaled(_vectors(sample.column(0).combine_chunks(), kind)))
    depth = max(0, int(np.log2(max(1, min(many / LEAF, len(sample) / LEAF_SAMPLE)))))
    forest = fit(sample, depth, TREES if depth else 1)
    queries = stored(asked.select("node").distinct().join(nodes, "node").select("node", "ids", "vector"), "neighbours-asked")
    take = forest.counts.size
    if depth:
        some = drawn(queries.select("node", "vector"), MEASURED / max(1, queries.count())).limit(4 * MEASURED).toArrow()  # about MEASURED vectors, to measure with
        units = _units(_scaled(_vectors(some.column("vector").combine_chunks(), kind))) if some.num_rows else np.zeros((0, size))
        if len(units):
            own = some.column("node").to_numpy()
            near = nodes.select("node", "vector").mapInArrow(_nearest_of_all(forest, units, own, kind, k), "query long, cosine double, leaves array<long>")
            near = near.withColumn("_place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine")))).filter(F.col("_place") <= k)
            true = near.select("query", "leaves").toArrow()  # k for each of them
            leaves = np.array([[q, *x] for q, x in zip(true.column(0).to_pylist(), true.column(1).to_pylist(), strict=True)], np.int64)
            take = needed(forest.queue(units), leaves, recall)
    sizes = nodes.select("vector").mapInArrow(_leaf_sizes(forest, kind), "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).toArrow()  # at most TREES * SAMPLE / LEAF_SAMPLE
    blocks = np.zeros(forest.counts.size, np.int64)
    blocks[sizes.column(0).to_numpy()] = -(-sizes.column(1).to_numpy() // BLOCK)
    schema = "leaf long, block int, side int, node long, ids array<long>, vector binary"
    both = nodes.mapInArrow(_in_leaves(forest, kind, np.maximum(blocks, 1)), schema).unionByName(queries.select("node", "vector").mapInArrow(_queued(forest, kind, blocks, take, k), schema))
    both = both.repartition("leaf", "block").sortWithinPartitions("leaf", "block", "side")
    schema = "query long, node long, ids array<long>, score double"
    near = both.mapInArrow(_compared(kind, k), schema).unionByName(queries.mapInArrow(_themselves(kind), schema))
    first = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("ids")[0], "node"))
    few = near.withColumn("_place", first).filter(F.col("_place") <= (k + 1) * (forest.counts.shape[0] + 1)).drop("_place")  # each tree may find the same, and so may the query itself
    best = few.dropDuplicates(["query", "node"]).withColumn("_place", first).filter(F.col("_place") <= k + 1)
    entry = F.struct((-F.col("score")).alias("away"), "id", "own")
    lists = best.select("query", "score", (F.col("node") == F.col("query")).alias("own"), F.explode("ids").alias("id")).groupBy("query").agg(F.slice(F.array_sort(F.collect_list(entry)), 1, k + 1).alias("entries"))
    joined = with_lookup(asked.select("id", F.col("node").alias("query")), lists, "query", ["id"])
    own = F.array_position(F.transform("entries", lambda e: e["own"] & (e["id"] == F.col("id"))), F.lit(True)).cast("int")
    rest = F.slice(F.filter("entries", lambda e, i: i + 1 != F.col("_own")), 1, k)
    out = joined.withColumn("_own", own).select(F.col("id").alias("query_id"), F.posexplode(rest).alias("_at", "_e"))
    return out.select("query_id", (F.col("_at") + 1).alias("rank"), real_id("_e.id").alias("vec_id"), (-F.col("_e.away")).alias("score"))


def digest(table: DataFrame) -> DataFrame:
    """The contract's rows: the 5 nearest of each vector whose id 50 divides."""
    return search(table)
