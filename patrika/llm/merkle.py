"""Merkle manifest of a dataset: a tree for each group of rows, a tree over the groups, and a proof for each row.

A fragment is a set of nodes, keyed by tree, level and index, whose parents aren't known yet. Fragments are merged by
union, and a run of siblings becomes its parent as soon as it is complete; as a tree's number of leaves is known, so is
how many siblings each run has, the last one of a level included. The merge is associative, so any grouping gives the same:
tasks hold what their rows leave open, which for consecutive rows is two nodes a level at most, and a reduction tree of
Spark shuffles merges FAN fragments a round. The root of a complete tree is a leaf of the tree over the groups, so that
one reduction makes everything up to the one root.

1. Leaves are hashed natively, in one pass over the texts, and written. From then on a row has some 150 bytes.
2. They are dealt by range of group, id and leaf, and sorted: a row's tree and index follow from its place in its partition
   and from a summary of each partition (its first and last group, and how many rows these have).
3. Fragments, and their reduction. Every round's nodes are kept.
4. Each partition takes from them what lies beside and above its own nodes, builds its part of the trees again, and gives
   each of its rows its siblings, from which the proof and the folded root are worked out row by row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import defined_id, fresh_path, groups_of, named, stored, tidy

#: Fragments that a task of the reduction merges; siblings of a run, of which the last of a level may have fewer.
FAN, ARITY = 8, 2
#: Bytes of leaves for a partition, about.
PART_BYTES, LEAF_BYTES = 64 << 20, 160
#: The tree over the groups' trees, which are numbered from 0.
ROOT = -1
#: Rows that get their proofs at a time, and levels from which on neighbours share a path.
ROWS, SHARED = 4096, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def joined(fields: Sequence[Column]) -> Column:
    """A leaf: the SHA-256 of the fields one after the other, `-` for null, else the number of bytes, `:` and the value."""
    parts = []
    for c in fields:
        value = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def is_tampered(id_: Column) -> Column:
    """Whether 7 divides the unsigned CRC-32 of the id in decimal digits; never for null."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 7 == 0, F.lit(False))


def parent(children: Sequence[bytes]) -> bytes:
    return sha256(b"".join(children)).hexdigest().encode()


Node = tuple[int, int, int]


class Forest:
    """Nodes whose parents aren't known, by (tree, level, index); `leaves` of a tree tells how many it has. With `made`,
    a list, every node that a merge makes is noted there."""

    def __init__(self, leaves: dict[int, int], made: list[tuple[Node, bytes]] | None = None):
        self.open: dict[Node, bytes] = {}
        self.leaves, self.made = leaves, made

    def add(self, node: Node, digest: bytes) -> None:
        """Adds a node and makes the parents that it completes."""
        while True:
            tree, level, index = node
            width = width_at(self.leaves[tree], level)
            if width == 1:
                if tree == ROOT:
                    self.open[node] = digest
                    return
                node = (ROOT, 0, tree)  # a whole tree is a leaf of the tree over trees
            else:
                first = index - index % ARITY
                run = [(tree, level, i) for i in range(first, min(first + ARITY, width))]
                self.open[node] = digest
                if not all(n in self.open for n in run):
                    return
                digest, node = parent([self.open.pop(n) for n in run]), (tree, level + 1, index // ARITY)
            if self.made is not None:
                self.made.append((node, digest))


def width_at(leaves: int, level: int) -> int:
    """Nodes of a level."""
    for _ in range(level):
        leaves = -(-leaves // ARITY)
    return leaves


def height(leaves: int) -> int:
    level = 0
    while leaves > 1:
        leaves, level = -(-leaves // ARITY), level + 1
    return level


# -- numbering --------------------------------------------------------------------------------------------------------


class Numbers:
    """Which trees a partition's rows belong to, from a row for each partition: part, its first and last group and their
    rows, and how many groups it has. As large as the number of partitions."""

    def __init__(self, summary: list):
        self.first_tree: dict[int, int] = {}
        #: rows that earlier partitions have of a partition's first group
        self.before: dict[int, int] = {}
        #: leaves of the trees that lie in several partitions
        self.total: dict[int, int] = {}
        tree, last, held = -1, None, 0
        for r in sorted(summary, key=lambda r: r["_part"]):
            low, high = (r["low"]["named"], r["low"]["lang"]), (r["high"]["named"], r["high"]["lang"])
            if low == last:
                self.first_tree[r["_part"]], self.before[r["_part"]] = tree, held
                self.total[tree] = held + r["low"]["n"]
            else:
                self.first_tree[r["_part"]], self.before[r["_part"]] = tree + 1, 0
            tree = self.first_tree[r["_part"]] + r["groups"] - 1
            held = r["high"]["n"] + (self.before[r["_part"]] if r["groups"] == 1 else 0)
            last = high
        self.trees = tree + 1
        self.parts = max((r["_part"] for r in summary), default=0) + 1

    def of(self, part: int, group: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
        """For the rows of a partition, given the number of each row's group in it and the size of each group there: tree
        and index, and the trees' leaves."""
        tree = self.first_tree[part] + np.arange(len(count))
        start = np.cumsum(count) - count
        index = np.arange(len(group)) - start[group]
        index[group == 0] += self.before[part]
        leaves = {int(t): int(n) for t, n in zip(tree, count, strict=True)}
        return tree[group], index, leaves | {t: self.total[t] for t in (int(tree[0]), int(tree[-1])) if t in self.total}


def _whole_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table, np.ndarray, np.ndarray]]:
    """Rows (_part, named, lang, ...) sorted by these: part, rows, the number of each one's group, the groups' sizes."""
    for table in groups_of(batches, 1):
        parts = table.column("_part").to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(np.diff(parts)) + 1, [len(parts)]])
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            rows = table.slice(lo, hi - lo).combine_chunks()
            code = rows.column("lang").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64) * 2 + rows.column("named").to_numpy(zero_copy_only=False)
            new = np.concatenate([[False], code[1:] != code[:-1]])
            group = np.cumsum(new)
            yield int(parts[lo]), rows, group, np.bincount(group)


# -- bottom up --------------------------------------------------------------------------------------------------------

_NODES = "_part long, tree long, level int, index long, leaves long, digest string"


def _node_rows(part: int, forest: dict[Node, bytes], leaves: dict[int, int]) -> pa.RecordBatch:
    nodes = list(forest)
    cols = [pa.array([part] * len(nodes), pa.int64()), pa.array([n[0] for n in nodes], pa.int64()), pa.array([n[1] for n in nodes], pa.int32()), pa.array([n[2] for n in nodes], pa.int64())]
    cols += [pa.array([leaves[n[0]] for n in nodes], pa.int64()), pa.array([forest[n].decode() for n in nodes], pa.string())]
    return pa.RecordBatch.from_arrays(cols, ["_part", "tree", "level", "index", "leaves", "digest"])


def _levels(digests: np.ndarray, first: int, leaves: int) -> list[tuple[int, np.ndarray]]:
    """The part of a tree above consecutive leaves: for each level the first index, and the digests (64 bytes each)."""
    out, width = [(first, digests)], leaves
    while width > 1 and len(digests):
        skip = -first % ARITY
        last = first + len(digests)
        stop = last if last == width else last - last % ARITY
        size = max(0, stop - first - skip)
        raw = digests[skip : skip + size].tobytes()
        made = b"".join(sha256(raw[i : i + 64 * ARITY]).hexdigest().encode() for i in range(0, len(raw), 64 * ARITY))
        first, digests, width = (first + skip) // ARITY, np.frombuffer(made, "S64"), -(-width // ARITY)
        out.append((first, digests))
    return out


def _open_nodes(tree: int, levels: list[tuple[int, np.ndarray]], leaves: int) -> dict[Node, bytes]:
    """The nodes of _levels() whose parents it doesn't hold, from the leaves up."""
    out, width = {}, leaves
    for level, (first, digests) in enumerate(levels):
        above = levels[level + 1] if level + 1 < len(levels) else (0, ())
        for i in {*range(first, min(first + ARITY, first + len(digests))), *range(max(first, first + len(digests) - ARITY), first + len(digests))}:
            if not above[0] <= i // ARITY < above[0] + len(above[1]):
                out[tree, level, i] = bytes(digests[i - first])
        width = -(-width // ARITY)
    return out


def _digests(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    raw = column.cast(pa.large_binary()).combine_chunks() if isinstance(column, pa.ChunkedArray) else column.cast(pa.large_binary())
    return np.array(raw.to_pylist(), "S64")


def _fragments(numbers: Numbers):
    """Rows of _NODES: what each partition's rows leave open."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows, group, count in _whole_parts(batches):
            tree, index, leaves = numbers.of(part, group, count)
            forest, digests = Forest(leaves | {ROOT: numbers.trees}), _digests(rows.column("leaf"))
            start = np.cumsum(count) - count
            for lo, n in zip(start.tolist(), count.tolist(), strict=True):
                t = int(tree[lo])
                for node, digest in _open_nodes(t, _levels(digests[lo : lo + n], int(index[lo]), leaves[t]), leaves[t]).items():
                    forest.add(node, digest)
            yield _node_rows(part, forest.open, forest.leaves)

    return run


@tidy
def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _NODES sorted by part: what is open after merging each part's nodes (`made` false), and the nodes that merging
    made (true)."""
    for table in groups_of(batches, 1):
        parts = table.column("_part").to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(np.diff(parts)) + 1, [len(parts)]])
        cols = {c: table.column(c).to_pylist() for c in ("tree", "level", "index", "leaves", "digest", "trees")}
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            leaves = dict(zip(cols["tree"][lo:hi], cols["leaves"][lo:hi], strict=True)) | {ROOT: cols["trees"][lo]}
            forest = Forest(leaves, [])
            for i in range(lo, hi):
                forest.add((cols["tree"][i], cols["level"][i], cols["index"][i]), cols["digest"][i].encode())
            for made, nodes in ((False, forest.open), (True, dict(forest.made))):
                rows = _node_rows(int(parts[lo]), nodes, leaves)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([made] * rows.num_rows, pa.bool_())], [*rows.schema.names, "made"])


def _reduced(fragments: DataFrame, parts: int, trees: int) -> tuple[DataFrame, str]:
    """Merges fragments FAN at a time until one is left. All nodes that ever were open or were made, without their part;
    and the root."""
    spark, path = fragments.sparkSession, fresh_path(fragments.sparkSession, "merkle-nodes")
    keep = lambda df: df.select("tree", "level", "index", "leaves", "digest").write.mode("append").parquet(path)
    keep(fragments)
    while True:
        parts = -(-parts // FAN)
        dealt = fragments.select(F.floor(F.col("_part") / FAN).alias("_part"), *fragments.columns[1:]).withColumn("trees", F.lit(trees))
        merged = stored(dealt.repartition("_part").sortWithinPartitions("_part").mapInArrow(_merge, _NODES + ", made boolean"), "merkle-merged")
        keep(merged.filter("made"))
        fragments = merged.filter("not made").drop("made")
        if parts == 1:
            return spark.read.schema("tree long, level int, index long, leaves long, digest string").parquet(path).dropDuplicates(["tree", "level", "index"]), fragments.first()["digest"]


# -- top down ---------------------------------------------------------------------------------------------------------


def _asked(numbers: Numbers):
    """Rows (part, tree, level, index) from rows (part, tree, level, index, leaves), each part's open nodes: the siblings of
    these and of all that lies above them, and the roots of their trees."""
    trees = numbers.trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted: set[tuple[int, int, int, int]] = set()
            for part, tree, level, index, leaves in zip(*(batch.column(c).to_pylist() for c in ("_part", "tree", "level", "index", "leaves")), strict=True):
                while True:
                    top = height(leaves)
                    while level < top:
                        first, width = index - index % ARITY, width_at(leaves, level)
                        wanted |= {(part, tree, level, i) for i in range(first, min(first + ARITY, width)) if i != index}
                        level, index = level + 1, index // ARITY
                    if tree == ROOT:
                        break
                    wanted.add((part, ROOT, 0, tree))
                    tree, level, index, leaves = ROOT, 0, tree, trees
            cols = list(zip(*wanted, strict=True)) if wanted else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int32() if i == 2 else pa.int64()) for i, c in enumerate(cols)], ["_part", "tree", "level", "index"])

    return run


def _fold(leaf: bytes, siblings: list[tuple[bytes, bytes]]) -> str:
    """The root that a leaf and its path give: the siblings to its left and to its right, level by level."""
    for left, right in siblings:
        leaf = sha256(left + leaf + right).hexdigest().encode()
    return leaf.decode()


class _Local:
    """A partition's part of the trees, and the nodes beside and above it."""

    def __init__(self, rows: pa.Table, tree: np.ndarray, index: np.ndarray, count: np.ndarray, leaves: dict[int, int], trees: int, beside: dict[Node, bytes]):
        self.leaves, self.trees, self.above = leaves | {ROOT: trees}, trees, {}
        self.levels: dict[int, list[tuple[int, np.ndarray]]] = {}
        digests, start = _digests(rows.column("leaf")), np.cumsum(count) - count
        forest = Forest(leaves | {ROOT: trees}, made := [])
        for lo, n in zip(start.tolist(), count.tolist(), strict=True):
            t = int(tree[lo])
            self.levels[t] = _levels(digests[lo : lo + n], int(index[lo]), leaves[t])
            for node, digest in _open_nodes(t, self.levels[t], leaves[t]).items():
                forest.add(node, digest)
        # merging makes few nodes more here: those of the tree over trees
        self.beside = {**beside, **forest.open, **dict(made)}

    def find(self, node: Node) -> bytes:
        if (own := self.levels.get(node[0])) and node[1] < len(own):
            first, digests = own[node[1]]
            if first <= node[2] < first + len(digests):
                return bytes(digests[node[2] - first])
        return self.beside[node]

    def path(self, tree: int, index: int) -> list[tuple[bytes, bytes]]:
        """The siblings to the left and to the right of a leaf and of what lies above it, up to the root."""
        low = self._siblings(tree, 0, SHARED, index)
        shared = (tree, index // ARITY**SHARED)
        if shared not in self.above:  # neighbours have the same
            rest = self._siblings(tree, SHARED, height(self.leaves[tree]), shared[1])
            self.above = {shared: rest + self._siblings(ROOT, 0, height(self.trees), tree)}
        return low + self.above[shared]

    def _siblings(self, tree: int, level: int, top: int, index: int) -> list[tuple[bytes, bytes]]:
        out, width = [], width_at(self.leaves[tree], level)
        while width > 1 and level < top:
            first = index - index % ARITY
            run = range(first, min(first + ARITY, width))
            out.append((b"".join(self.find((tree, level, k)) for k in run if k < index), b"".join(self.find((tree, level, k)) for k in run if k > index)))
            level, index, width = level + 1, index // ARITY, -(-width // ARITY)
        return out


def _proofs(numbers: Numbers, root: str):
    """Rows (_part, _side, named, lang, pos, leaf, tampered, ..., tree, level, index, digest) sorted by the first two: nodes
    beside a partition's (_side 0), then its leaves (1), which come out with their proofs."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, 1):
            parts = table.column("_part").to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(parts)) + 1, [len(parts)]])
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                both = table.slice(lo, hi - lo)
                split = int((both.column("_side").to_numpy() == 0).sum())
                near, rows = both.slice(0, split), both.slice(split)
                nodes = zip(*(near.column(c).to_pylist() for c in ("tree", "level", "index")), strict=True)
                beside = dict(zip(nodes, (d.encode() for d in near.column("digest").to_pylist()), strict=True))
                for _, own, group, count in _whole_parts(iter(rows.to_batches())):
                    tree, index, leaves = numbers.of(int(parts[lo]), group, count)
                    yield from proven(own, _Local(own, tree, index, count, leaves, numbers.trees, beside), tree, index)

    def proven(rows: pa.Table, local: _Local, tree: np.ndarray, index: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, rows.num_rows, ROWS):
            some = rows.slice(lo, ROWS).combine_chunks()
            subroot, proof, folded = [], [], []
            for t, i, leaf, tampered in zip(tree[lo : lo + ROWS].tolist(), index[lo : lo + ROWS].tolist(), some.column("leaf").to_pylist(), some.column("tampered").to_pylist(), strict=True):
                path = local.path(t, i)
                subroot.append(local.find((ROOT, 0, t)).decode())
                proof.append(sha256(b"".join(left + right for left, right in path)).hexdigest())
                folded.append(_fold((tampered or leaf).encode(), path))
            n = some.num_rows
            columns = [some.column(c).combine_chunks() for c in ("doc_id", "leaf")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(subroot, pa.string()), pa.array([root] * n, pa.string()), pa.array(proof, pa.string()), pa.array(folded, pa.string()), pa.array([f == root for f in folded], pa.bool_())], ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return run


def manifest(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """A row for each row of docs: doc_id, leaf, subroot (of its lang), root, proof_sha256 (of its siblings' digests from
    the bottom to the root, left to right), folded_root and verified (whether the row, as it is found now, still leads to
    the root; is_tampered() picks the rows that are found changed).

    Columns other than FIELDS are not looked at. A null doc_id is the first of its lang, a null lang the first of all.
    Rows equal in lang and doc_id follow each other by leaf, so equal rows are leaves side by side. Texts of any length
    are hashed by the JVM; null texts are `-`, empty ones `0:`. An empty table gives an empty result.
    """
    fields = {c: named(c) for c in FIELDS}
    more = fields | {"n_chars": fields["n_chars"].cast("decimal(20,0)") + 1}
    changed = F.when(is_tampered(fields["doc_id"]) & fields["n_chars"].isNotNull(), joined(list(more.values())))
    leaves = docs.select(fields["doc_id"].cast("long").alias("doc_id"), fields["lang"].isNotNull().alias("named"), F.coalesce(fields["lang"].cast("string"), F.lit("")).alias("lang"), joined(list(fields.values())).alias("leaf"), changed.alias("tampered"))
    leaves = stored(leaves, "merkle-leaves")
    many = leaves.count()
    if not many:
        return leaves.select("doc_id", "leaf", *(F.col("leaf").alias(c) for c in ("subroot", "root", "proof_sha256", "folded_root")), F.lit(True).alias("verified"))
    order = ["named", "lang", "_id", "leaf", "_row"]
    # rows that are equal in everything are dealt by their own number
    rows = leaves.select(defined_id("doc_id").alias("_id"), *leaves.columns, F.monotonically_increasing_id().alias("_row"))
    parts = max(2, int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-many * LEAF_BYTES // part_bytes))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = stored(placed.select(F.spark_partition_id().cast("long").alias("_part"), F.monotonically_increasing_id().alias("pos"), "named", "lang", "doc_id", "leaf", "tampered"), "merkle-placed")
    groups = placed.groupBy("_part", "named", "lang").agg(F.count("*").alias("n"))
    end = F.struct("named", "lang", "n")
    numbers = Numbers(groups.groupBy("_part").agg(F.min(end).alias("low"), F.max(end).alias("high"), F.count("*").alias("groups")).collect())  # a row for each partition
    dealt = placed.repartition("_part").sortWithinPartitions("_part", "pos")
    fragments = stored(dealt.select("_part", "named", "lang", "leaf").mapInArrow(_fragments(numbers), _NODES), "merkle-fragments")
    nodes, root = _reduced(fragments, numbers.parts, numbers.trees)
    asked = fragments.drop("digest").mapInArrow(_asked(numbers), "_part long, tree long, level int, index long").distinct()
    near = asked.join(nodes.drop("leaves"), ["tree", "level", "index"]).withColumn("_side", F.lit(0))
    both = placed.withColumn("_side", F.lit(1)).unionByName(near, allowMissingColumns=True)
    both = both.repartition("_part").sortWithinPartitions("_part", "_side", "pos")
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return both.select("_part", "_side", "named", "lang", "pos", "doc_id", "leaf", "tampered", "tree", "level", "index", "digest").mapInArrow(_proofs(numbers, root), schema)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's row per document."""
    return manifest(docs)


#: DuckDB SQL for digest(): trees by recursion over levels, and each leaf folded up its path.
SQL = r"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, doc_id::VARCHAR AS id, n_chars,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS number,
    coalesce(strlen((n_chars::HUGEINT + 1)::VARCHAR) || ':' || (n_chars::HUGEINT + 1), '-') AS next_number,
    coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM documents
), crc AS (
  SELECT *, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(id) + 1), lambda i: ord(id[i])::UBIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, (v & 1) * 3988292384::UBIGINT))) AS c
  FROM hashed
), leaves AS (
  SELECT doc_id, tree, leaf, coalesce(tampered, leaf) AS now, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
    count(*) OVER (PARTITION BY tree) AS n, row_number() OVER () AS rid
  FROM (SELECT doc_id, tree, sha256(head || number || tail) AS leaf, CASE WHEN xor(c, 4294967295::UBIGINT) % 7 = 0 THEN sha256(head || next_number || tail) END AS tampered FROM crc)
), nodes AS (
  SELECT tree, 0 AS level, idx, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT tree, level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 2, n
), subroots AS (
  SELECT tree, digest FROM nodes WHERE n = 1
), upper_nodes AS (
  SELECT 0 AS level, tree AS idx, (SELECT count(*) FROM subroots) AS n, digest FROM subroots
  UNION ALL
  SELECT level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM upper_nodes WHERE n > 1 GROUP BY level, idx // 2, n
), steps AS (
  SELECT rid, step, CASE WHEN odd THEN coalesce(digest, '') ELSE '' END AS l, CASE WHEN odd THEN '' ELSE coalesce(digest, '') END AS r, row_number() OVER (PARTITION BY rid ORDER BY step) AS k
  FROM (
    SELECT rid, v.level AS step, (l.idx >> v.level) % 2 = 1 AS odd, s.digest
    FROM leaves l JOIN (SELECT DISTINCT tree, level FROM nodes WHERE n > 1) v ON v.tree = l.tree
    LEFT JOIN nodes s ON s.tree = l.tree AND s.level = v.level AND s.idx = xor(l.idx >> v.level, 1)
    UNION ALL
    SELECT rid, 1000 + v.level, (l.tree >> v.level) % 2 = 1, s.digest
    FROM leaves l CROSS JOIN (SELECT DISTINCT level FROM upper_nodes WHERE n > 1) v
    LEFT JOIN upper_nodes s ON s.level = v.level AND s.idx = xor(l.tree >> v.level, 1))
), fold AS (
  SELECT rid, 0 AS k, now AS digest FROM leaves
  UNION ALL
  SELECT f.rid, f.k + 1, sha256(s.l || f.digest || s.r) FROM fold f JOIN steps s ON s.rid = f.rid AND s.k = f.k + 1
)
SELECT l.doc_id, l.leaf, b.digest AS subroot, t.digest AS root, sha256(coalesce(p.siblings, '')) AS proof_sha256, f.digest AS folded_root, f.digest = t.digest AS verified
FROM leaves l JOIN subroots b ON b.tree = l.tree CROSS JOIN (SELECT digest FROM upper_nodes WHERE n = 1) t
LEFT JOIN (SELECT rid, string_agg(l || r, '' ORDER BY step) AS siblings FROM steps GROUP BY rid) p ON p.rid = l.rid
JOIN (SELECT rid, arg_max(digest, k) AS digest FROM fold GROUP BY rid) f ON f.rid = l.rid
"""
