"""N-gram Jaccard join by chosen paths.

Documents are sets of word shingles; equal sets are one. A set is embedded as SLOTS minhash tokens, so that two sets
share each token with a probability of their Jaccard similarity. From the root of each run, every bucket is split on
tokens sampled by its path. Buckets of up to LEAF sets are compared by brute force, and so are, in blocks, those of up to
WIDE times as many. The first splits take two tokens, so a set goes on along two paths; deeper ones take a second for one bucket in DEEP, so sets that share four
fifths of their tokens with many others make no more rows from level to level. A large bucket of which most sets are
nearly as similar as wanted to one of them, the pivot, is a group of near copies that splitting can't part: there, sets
near the pivot go no further, and whatever could resemble one of those, by the triangle inequality of the Jaccard
distance, is tied to the pivot.

Brute force looks at the tokens first. Where these agree often enough, a second sketch decides, the least shingle in
each of BINS bins, which for sets of few shingles is nearly all of them: a pair goes on unless the bins rule `similarity`
out. Sets linked directly or through others in this way form a candidate group. In a group of more than BLOCK sets that
have many times as many shingles as bins, pairs are looked at once more, with FINE bins, which tell sets of a template from
near copies; what this leaves connected are the groups of which all pairs are compared exactly, large ones in blocks of bounded bytes. So
similarities are exact, groups hold little but links, and what can be missed is a share 1 - RECALL of the pairs at just
the wanted similarity, and less of more similar ones: a fourth each by tokens that agree too seldom, by never meeting,
and by bins and fine bins.

Two sets whose tokens agree in a share m meet in a run of depth d with probability q(d) = 1 - (1 - m q(d - 1))**2 or,
where one token is taken, m q(d - 1). Runs are added until the recall is reached for the depth that they reach, over the
distribution of m.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import defined_id, fresh_path, groups_of, real_id, salts_of, stored, tidy, with_group
from .graph import components
from .textarrays import blocks, mixed

SLOTS, BINS, LEAF, BLOCK, SALTS = 64, 512, 1024, 128, 32
#: Bins of the second look at large groups, sets of a block there, and how many shingles a set has at least to have them:
#: fewer are seen well by BINS, and more have texts that are longer than FINE bytes.
FINE, FINE_BLOCK, FINE_FROM = 4096, 512, 1024
#: Bytes of a block's sets that are compared exactly, about.
BLOCK_BYTES = 16 << 20
#: Levels that split on two tokens; deeper ones take the second token of one bucket in DEEP.
TWO_TOKENS, DEEP = 4, 4
#: Buckets of so many times LEAF are compared in blocks of a fourth of it.
WIDE = 8
#: Share of the pairs at just the wanted similarity that are found: all but 1 in 65,000.
RECALL = 1 - 1 / 65_000
#: How far below the wanted similarity sets still are near copies of a pivot, and by how much estimates from the bins are
#: off at most there.
NEAR, OFF = 0.1, 0.07
_U = np.uint64
_MULTIPLIERS = mixed(np.arange(1, SLOTS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)


def _agreeing(similarity: float) -> np.ndarray:
    """Probability of each number of agreeing tokens."""
    return np.array([math.comb(SLOTS, k) * similarity**k * (1 - similarity) ** (SLOTS - k) for k in range(SLOTS + 1)])


def likely_share(similarity: float, recall: float) -> float:
    """Share of equal tokens that makes a candidate; a fourth of what may be missed lies under it."""
    below = np.cumsum(_agreeing(similarity))
    return int(np.searchsorted(below, (1 - recall) / 4, "right")) / SLOTS


def runs_needed(similarity: float, recall: float, depth: int) -> int:
    """Runs of so many levels until at most a fourth of what may be missed is a candidate that never meets."""
    least = round(likely_share(similarity, recall) * SLOTS)
    share, chance = np.arange(least, SLOTS + 1) / SLOTS, _agreeing(similarity)[least:]
    meet = np.ones(len(share))
    for level in reversed(range(depth)):
        two = 1 - (1 - share * meet) ** 2
        meet = two if level < TWO_TOKENS else share * meet * (1 - 1 / DEEP) + two / DEEP
    runs = 1
    while (chance * (1 - meet) ** runs).sum() > (1 - recall) / 4:
        runs += 1
    return runs


def bins_of(h: np.ndarray, sizes: np.ndarray, bins: int = BINS) -> np.ndarray:
    """For each set, from its sorted hashes: 8 bits of the least hash in each bin, 0 where it has none."""
    out = np.zeros((len(sizes), bins), np.uint8)
    owner, where = np.repeat(np.arange(len(sizes)), sizes), (h >> _U(64 - bins.bit_length() + 1)).astype(np.int64)
    if len(h):
        first = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]) | (owner[1:] != owner[:-1])]))
        out[owner[first], where[first]] = 1 + ((h[first] >> _U(20)) % _U(255)).astype(np.uint8)
    return out


def _in_bins(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row by row: bins that agree, and bins that either set has."""
    return ((a == b) & (a > 0)).sum(1), ((a | b) > 0).sum(1)


def may_link(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, similarity: float, recall: float) -> np.ndarray:
    """Which pairs the bins don't rule out. Of the union's elements some are hidden behind smaller ones of their bin, a
    random choice of them; what those can hold of the intersection is bounded by its mean and deviation."""
    agree, any_ = _in_bins(a, b)
    union = (size_a + size_b) / (1 + similarity)
    hidden = np.maximum(union - any_, 0)
    z = -NormalDist().inv_cdf((1 - recall) / 4) + 0.6  # the tail is a little heavier than the normal one's
    deviation = np.sqrt(hidden * similarity * (1 - similarity) * np.maximum(0, 1 - hidden / np.maximum(union, 1)))
    return agree >= similarity * union - np.minimum(hidden, hidden * similarity + z * deviation + 1) - 1e-9


def _sets(block, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the block's texts, sorted within each, and the number of each text's shingles."""
    block.words()
    h = block.word_hashes()
    window, at = block.windows(width, h)
    doc = block.doc[at]
    short = np.flatnonzero((block.n_words > 0) & (block.n_words < width))
    if len(short):  # all words of a short text are its one shingle
        alone = []
        for i in short:
            words, total = h[block.first_word[i] : block.first_word[i + 1]], 0
            for w in words.tolist():
                total = (total * 0xD6E8FEB86659FD93 + w + 1) & 0xFFFFFFFFFFFFFFFF
            alone.append(total)
        window, doc = np.concatenate([window, mixed(np.array(alone, _U))]), np.concatenate([doc, short])
    order = np.lexsort((window, doc))
    window, doc = window[order], doc[order]
    if len(window):
        new = np.concatenate([[True], (window[1:] != window[:-1]) | (doc[1:] != doc[:-1])])
        window, doc = window[new], doc[new]
    return window, np.bincount(doc, minlength=block.n)


def _sketch(width: int) -> Callable:
    """Rows (id, tie, k1, k2, size, sig, bins, fine) for each text: the set's key of two hashes, its size and its sketches;
    `fine` is null for short sets."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(2)):
                h, sizes = _sets(b, width)
                full = np.flatnonzero(sizes)
                start = (np.cumsum(sizes) - sizes)[full]
                sig = np.zeros((b.n, SLOTS), np.uint32)
                for j in range(SLOTS) if len(full) else ():
                    x = h * _MULTIPLIERS[j]
                    x ^= x >> _U(31)
                    x *= _U(0x94D049BB133111EB)
                    x >>= _U(32)
                    sig[full, j] = np.minimum.reduceat(x, start)
                k1, k2 = _keys(h, sizes)
                end = np.cumsum(sizes)
                fine = [bins_of(h[e - n : e], np.array([n]), FINE)[0].tobytes() if n > FINE_FROM else None for e, n in zip(end.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(c.slice(b.first, b.n) for c in batch.columns[:2]), pa.array(k1), pa.array(k2), pa.array(sizes.astype(np.int64)), pa.array([s.tobytes() for s in sig], pa.binary()),
                        pa.array([s.tobytes() for s in bins_of(h, sizes)], pa.binary()), pa.array(fine, pa.binary()),
                    ],
                    ["id", "tie", "k1", "k2", "size", "sig", "bins", "fine"],
                )

    return run


def _keys(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set, as signed numbers."""
    k1, k2, full = np.zeros(len(sizes), _U), np.zeros(len(sizes), _U), np.flatnonzero(sizes)
    if len(full):
        start = (np.cumsum(sizes) - sizes)[full]
        k1[full], k2[full] = np.add.reduceat(mixed(h ^ _U(0x1234567)), start), np.add.reduceat(mixed(h + _U(0x7654321)), start)
    return k1.view(np.int64), k2.view(np.int64)


def _signatures(column: pa.Array, kind: type = np.uint32, width: int = SLOTS) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _children(path: np.ndarray, sig: np.ndarray, level: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Paths on which sets go on, and which sets: the bucket's path samples slots, the set has the tokens there."""
    one = (mixed(path + _U(1)) % _U(SLOTS)).astype(np.int64)
    two = (one + 1 + (mixed(path + _U(2)) % _U(SLOTS - 1)).astype(np.int64)) % SLOTS
    every = np.arange(len(path))
    for s, rows in ((one, every), (two, every if level < TWO_TOKENS else np.flatnonzero(mixed(path + _U(3)) % _U(DEEP) == 0))):
        s = s[rows]
        yield mixed(mixed(path[rows] + s.astype(_U) * _U(0x9E3779B97F4A7C15)) ^ mixed(sig[rows, s].astype(_U) + _U(7))), rows


def _split(roots: Sequence[int], level: int = 0) -> Callable:
    """Rows (path, node) from the roots of these runs and rows (node, sig), or from rows (node, sig, path) one level on."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig, nodes = _signatures(batch.column(1)), batch.column(0).to_numpy()
            starts = [np.full(len(sig), mixed(np.array([r + 11], _U))[0]) for r in roots] or [batch.column(2).to_numpy().view(_U)]
            for start in starts:
                for child, rows in _children(start, sig, level):
                    yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(nodes[rows])], ["path", "node"])

    return run


def _group_ids(table: pa.Table, n_keys: int) -> np.ndarray:
    keys = [table.column(k).to_numpy() for k in range(n_keys)]
    return np.cumsum(np.concatenate([[0], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))


def _merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index of each index's component under the edges (a, b) and those that `label` stands for."""
    label = label.copy()
    while len(a) and (label[a] != label[b]).any():
        x, y = label[a], label[b]  # roots are joined, so what hangs on them comes along
        np.minimum.at(label, x, y)
        np.minimum.at(label, y, x)
        while (label[label] != label).any():
            label = label[label]
    return label


def _brute_force(batches: Iterator[pa.RecordBatch], similarity: float, recall: float) -> Iterator[pa.RecordBatch]:
    """Rows (path, one, two, node, sig, bins, size, mine) sorted by the first four: a star of edges for each candidate
    group in each bucket or pair of its blocks."""
    least = likely_share(similarity, recall) * SLOTS - 1e-9
    for table in groups_of(batches, 3):
        group, node, size = _group_ids(table, 3), table.column("node").to_numpy(), table.column("size").to_numpy().astype(float)
        within, mine = table.column("one").to_numpy() == table.column("two").to_numpy(), table.column("mine").to_numpy()
        sig, bins = _signatures(table.column("sig").combine_chunks()), _signatures(table.column("bins").combine_chunks(), np.uint8, BINS)
        after = np.cumsum(np.bincount(group))[group] - np.arange(len(group)) - 1  # partners that follow in the bucket
        label = np.arange(len(node))
        for lo, hi in _pieces(after, 1 << 17):
            i = np.repeat(np.arange(lo, hi), after[lo:hi])
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after[lo:hi]) - after[lo:hi], after[lo:hi])
            like = np.flatnonzero(((sig[i] == sig[j]).sum(1) >= least) & (label[i] != label[j]) & (within[i] | (mine[i] != mine[j])))
            for k in range(0, len(like), 1 << 13):
                a, b = i[like[k : k + (1 << 13)]], j[like[k : k + (1 << 13)]]
                apart = label[a] != label[b]
                a, b = a[apart], b[apart]
                ok = may_link(bins[a], bins[b], size[a], size[b], similarity, recall)
                label = _merged(label, a[ok], b[ok])
        at = np.flatnonzero(label != np.arange(len(node)))
        yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(node[label[at]])], ["a", "b"])


def _pieces(counts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    total, lo = np.cumsum(counts), 0
    while lo < len(counts):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def _with_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, sig, path, pivot, near): how similar each set and its bucket's pivot are, by their bins."""
    for batch in batches:
        if batch.num_rows:
            agree, any_ = _in_bins(_signatures(batch.column(4), np.uint8, BINS), _signatures(batch.column(5), np.uint8, BINS))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(agree / np.maximum(any_, 1))], ["node", "sig", "path", "pivot", "near"])


def candidates(reps: DataFrame, similarity: float = 0.8, recall: float = RECALL) -> DataFrame:
    """Edges (a, b) that tie each candidate group together, from rows (node, size, sig, bins) with a row for each set."""
    spark, path = reps.sparkSession, fresh_path(reps.sparkSession, "jaccard-edges")
    done, depth = 0, 1
    while done < (wanted := runs_needed(similarity, recall, depth)):
        depth = max(depth, _run(reps, range(done, wanted), similarity, recall, path))
        done = wanted
    return spark.read.schema("a long, b long").parquet(path)


def _run(reps: DataFrame, runs: Sequence[int], similarity: float, recall: float, path: str) -> int:
    """Adds the edges that these runs find to the table at `path`; gives the levels they took."""
    tied = max(0.0, 2 * similarity - NEAR - 1 - 2 * OFF)
    rows, level = reps.select("node", "sig").mapInArrow(_split(runs), "path long, node long"), 0
    while True:
        met = stored(with_group(rows.select("path", "node").distinct() if level else rows, ["path"], [F.count("*").alias("_n")], ["node"], having=F.col("_n") > 1), "jaccard-buckets")
        tokens = met.join(reps.select("node", "sig", "bins", "size"), "node")
        most = WIDE * LEAF
        parts = F.when(F.col("_n") <= LEAF, 1).otherwise(F.ceil(F.col("_n") / max(1, LEAF // 4))).cast("int")
        leaf = tokens.filter(F.col("_n") <= most).withColumn("mine", F.pmod(F.xxhash64("node", F.lit(3)), parts).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), parts - 1)))
        leaf = leaf.select("path", F.least("mine", "_other").alias("one"), F.greatest("mine", "_other").alias("two"), "node", "sig", "bins", "size", "mine")
        leaf.repartition("path", "one", "two").sortWithinPartitions("path", "one", "two", "node").mapInArrow(lambda batches: _brute_force(batches, similarity, recall), "a long, b long").write.mode("append").parquet(path)
        big = met.filter(F.col("_n") > most)
        if big.isEmpty():
            return level + 1
        # the smallest node, so that buckets of one group mostly have the same pivot and edges repeat instead of adding up
        pivots = big.groupBy("path").agg(F.min("node").alias("node"), F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(node), {SALTS}) as int))")).alias("_held"))
        pivots = pivots.join(reps.select("node", "bins"), "node").select("path", F.col("node").alias("pivot"), F.col("bins").alias("pivot_bins"), salts_of("_held", SALTS).alias("_salt"))
        salted = tokens.filter(F.col("_n") > most).withColumn("_salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
        compared = salted.join(pivots, ["path", "_salt"]).select("node", "sig", "path", "pivot", "bins", "pivot_bins")
        compared = stored(compared.mapInArrow(_with_pivot, "node long, sig binary, path long, pivot long, near double"), "jaccard-pivots")
        close = F.col("near") >= similarity - NEAR
        judged = stored(with_group(compared, ["path"], [(F.avg(close.cast("double")) >= 0.5).alias("_copies")], ["node"]), "jaccard-judged")
        judged.filter(F.col("_copies") & (F.col("near") >= tied) & (F.col("node") != F.col("pivot"))).select(F.col("node").alias("a"), F.col("pivot").alias("b")).write.mode("append").parquet(path)
        level += 1
        rows = judged.filter(~(F.col("_copies") & close)).select("node", "sig", "path").mapInArrow(_split((), level), "path long, node long")


def _look_again(similarity: float, recall: float) -> Callable:
    """Rows (comp, one, two, node, size, mine, fine) sorted by the first four: a star of edges for each group of sets that
    fine bins leave connected, in each pair of blocks. Sets that are connected already aren't compared again."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, 3):
            group, node, size = _group_ids(table, 3), table.column("node").to_numpy(), table.column("size").to_numpy().astype(float)
            within, mine = table.column("one").to_numpy() == table.column("two").to_numpy(), table.column("mine").to_numpy()
            bins, end = _signatures(table.column("fine").combine_chunks(), np.uint8, FINE), np.cumsum(np.bincount(group))
            label = np.arange(len(node))
            for i in range(len(node)):
                j = np.arange(i + 1, end[group[i]])
                j = j[(label[j] != label[i]) & (within[i] | (mine[j] != mine[i]))]
                for lo in range(0, len(j), 256):
                    part = j[lo : lo + 256]
                    ok = may_link(np.broadcast_to(bins[i], (len(part), FINE)), bins[part], np.full(len(part), size[i]), size[part], similarity, recall)
                    label = _merged(label, np.full(ok.sum(), i), part[ok])
            at = np.flatnonzero(label != np.arange(len(node)))
            yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(node[label[at]])], ["a", "b"])

    return run


def _in_blocks(members: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (comp, one, two, node, mine, ...) for each pair of its component's blocks that a member takes part in."""
    dealt = members.withColumn("mine", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("comp", F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two"), "node", "mine", *columns)
    return dealt.repartition("comp", "one", "two").sortWithinPartitions("comp", "one", "two", "node")


def _tightened(groups: DataFrame, reps: DataFrame, similarity: float, recall: float) -> DataFrame:
    """node, comp: the groups as they are up to BLOCK sets and where sets are short, others as far as fine bins leave them
    connected."""
    sized = groups.join(reps.select("node", "size"), "node")
    counted = stored(with_group(sized, ["comp"], [F.count("*").alias("_m"), F.min("size").alias("_least")], ["node"]), "jaccard-groups")
    loose = (F.col("_m") > BLOCK) & (F.col("_least") > FINE_FROM)
    large = counted.filter(loose)
    if large.isEmpty():
        return groups
    fine = large.withColumn("blocks", F.ceil(F.col("_m") / FINE_BLOCK).cast("int")).join(reps.select("node", "fine"), "node")
    order = ["comp", "one", "two", "node", "size", "mine", "fine"]
    edges = stored(_in_blocks(fine, ["size", "fine"]).select(order).mapInArrow(_look_again(similarity, recall), "a long, b long"), "jaccard-fine")
    return counted.filter(~loose).select("node", "comp").unionByName(components(edges).select("node", "comp"))


def _set_bytes(width: int) -> Callable:
    """Rows (text, k1, k2, comp, node, weight, blocks): the text's shingle hashes in its place, if its key is the wanted one."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(0)):
                h, sizes = _sets(b, width)
                k1, k2 = _keys(h, sizes)
                same = pa.array((batch.column(1).slice(b.first, b.n).to_numpy() == k1) & (batch.column(2).slice(b.first, b.n).to_numpy() == k2))
                raw = np.split(h, np.cumsum(sizes)[:-1]) if b.n else []
                yield pa.RecordBatch.from_arrays([*(c.slice(b.first, b.n) for c in batch.columns[3:]), pa.array([r.tobytes() for r in raw], pa.binary())], ["comp", "node", "weight", "blocks", "hashes"]).filter(same)

    return run


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of incidence matrices over slices of the shared hashes."""
    n = len(sets)
    h, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(h, kind="stable")
    h, owner = h[order], owner[order]
    column = np.cumsum(np.concatenate([[0], h[1:] != h[:-1]])) if len(h) else np.zeros(0, int)
    shared = np.bincount(column)[column] > 1 if len(h) else np.zeros(0, bool)
    owner, column = owner[shared], column[shared]
    inter = np.zeros((n, n), np.float32)
    if len(column):
        column = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]]))
        for lo in range(0, int(column[-1]) + 1, 8192):
            a, b = np.searchsorted(column, [lo, lo + 8192])
            x = np.zeros((n, min(8192, int(column[-1]) + 1 - lo)), np.float32)
            x[owner[a:b], column[a:b] - lo] = 1
            inter += x @ x.T
    return inter


def _exact(similarity: float) -> Callable:
    """Rows (comp, one, two, node, weight, mine, hashes) sorted by the first four: links of each set, and stars of edges.

    In a pair of blocks (one < two) only links across them count; `mine` is a set's own block. Repeated nodes are one.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, 3):
            group = _group_ids(table, 3)
            one, two, node = (table.column(c).to_numpy() for c in ("one", "two", "node"))
            weight, mine, raw = table.column("weight").to_numpy(), table.column("mine").to_numpy(), table.column("hashes").to_pylist()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]])
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                at = lo + np.flatnonzero(np.concatenate([[True], node[lo + 1 : hi] != node[lo : hi - 1]]))
                if len(at) < 2:
                    continue
                sets = [np.frombuffer(raw[i], _U) for i in at]
                size = np.array([len(s) for s in sets], np.float64)
                inter = _overlaps(sets).astype(np.float64)  # exact for sets of fewer than 2 ** 24 shingles
                link = inter >= similarity * (size[:, None] + size[None, :] - inter) - 1e-9
                np.fill_diagonal(link, False)
                if one[lo] != two[lo]:
                    link &= mine[at][:, None] != mine[at][None, :]
                label = _merged(np.arange(len(at)), *np.nonzero(link))
                links = link.astype(np.int64) @ weight[at]
                some = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(node[at][some]), pa.array(node[at][label[some]]), pa.array(links[some])], ["a", "b", "links"])

    return run


def _classes(docs: DataFrame, width: int, similarity: float, id_col: str, text_col: str, recall: float) -> DataFrame:
    """A row per document: id (never null), tie (hash of the text), class_id, n_links, first (whether id and tie are the
    smallest of the class), blank (whether the text has no words)."""
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    source = docs.select(defined_id(id_col).alias("id"), F.xxhash64(raw).alias("tie"), raw.alias("text"))
    sets = stored(source.mapInArrow(_sketch(width), "id long, tie long, k1 long, k2 long, size long, sig binary, bins binary, fine binary"), "jaccard-sets")
    salted = sets.filter("size > 0").withColumn("_salt", F.pmod(F.xxhash64("id", "tie"), F.lit(SALTS)).cast("int"))
    reps = salted.groupBy("k1", "k2").agg(F.min(F.struct("id", "tie", "size", "sig", "bins", "fine")).alias("_f"), F.count("*").alias("weight"), F.bit_or(F.expr("shiftleft(1L, _salt)")).alias("_held"))
    # a number of its own for each set, as ids may have several; what is written keeps it
    reps = stored(reps.select(F.monotonically_increasing_id().alias("node"), "k1", "k2", "_f.*", "weight", "_held"), "jaccard-reps")
    groups = components(candidates(reps.select("node", "size", "sig", "bins"), similarity, recall))
    sized = _tightened(groups, reps, similarity, recall).join(reps.select("node", "size", "weight", "k1", "k2", "id", "tie"), "node")
    counted = with_group(sized, ["comp"], [F.count("*").alias("_m"), F.sum("size").alias("_s")], ["node"])
    members = counted.withColumn("blocks", F.greatest(F.ceil(F.col("_m") / BLOCK), F.ceil(F.col("_s") * 8 / BLOCK_BYTES)).cast("int"))
    texts = members.select("id", "tie", "k1", "k2", "comp", "node", "weight", "blocks").join(source, ["id", "tie"])
    hashed = texts.select("text", "k1", "k2", "comp", "node", "weight", "blocks").mapInArrow(_set_bytes(width), "comp long, node long, weight long, blocks int, hashes binary")
    dealt = _in_blocks(hashed, ["weight", "hashes"]).select("comp", "one", "two", "node", "weight", "mine", "hashes")
    found = stored(dealt.mapInArrow(_exact(similarity), "a long, b long, links long"), "jaccard-links")
    classes = components(found.filter("a <> b").select("a", "b"))
    named = with_group(classes.join(reps.select("node", "id", "tie"), "node"), ["comp"], [F.min(F.struct("id", "tie")).alias("_first")], ["node"]).select("node", "_first")
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    table = reps.select("k1", "k2", "node", "id", "tie", "weight", "_held").join(named, "node", "left").join(links, "node", "left")
    table = table.select("k1", "k2", F.coalesce("_first", F.struct("id", "tie")).alias("_first"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), salts_of("_held", SALTS).alias("_salt"))
    linked = salted.select("id", "tie", "k1", "k2", "_salt").join(table, ["k1", "k2", "_salt"])
    linked = linked.select("id", "tie", F.col("_first.id").alias("class_id"), "n_links", (F.struct("id", "tie") == F.col("_first")).alias("first"), F.lit(False).alias("blank"))
    alone = sets.filter("size = 0").select("id", "tie", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("first"), F.lit(True).alias("blank"))
    return linked.unionByName(alone)


def join(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL) -> DataFrame:
    """A row per document: the id, class_id, n_links.

    n_links: the number of other documents whose word shingles have a Jaccard similarity of `similarity` or more with
    this one's. class_id: the smallest id among the documents that links connect with this one, itself included. A text
    of fewer than `width` words has one shingle, all its words; null and empty texts, and those of white space, have
    none and link to nothing. Rows with equal ids are documents of their own, each counted and classed by its text. A
    null id is the smallest. Very long texts are sets of all their shingles. Links are found with probability `recall` or more.
    """
    out = _classes(docs, width, similarity, id_col, text_col, recall)
    return out.select(real_id("id").alias(id_col), real_id("class_id").alias("class_id"), "n_links")


def keep_first(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL) -> DataFrame:
    """docs without near duplicates: of each class one document stays, with its own columns: that with the smallest id,
    of rows with this id that with the smallest hash of its text, of rows that agree in both any one. Texts without
    words, null ones included, all stay."""
    rows = _classes(docs, width, similarity, id_col, text_col, recall).filter("first")
    kept = stored(rows.groupBy(F.col("id").alias("_kept"), F.col("tie").alias("_tie")).agg(F.count("*").alias("_rows"), F.max("blank").alias("_blank")), "jaccard-kept")
    tie = F.xxhash64(F.coalesce(docs[text_col], F.lit("")).cast("binary"))
    held = lambda some: docs.join(some, (defined_id(docs[id_col]) == some["_kept"]) & (tie == some["_tie"]), "left_semi")
    many = kept.filter((F.col("_rows") > 1) & ~F.col("_blank"))
    if many.isEmpty():
        return held(kept)
    once = held(many).withColumns({"_jaccard_id": defined_id(id_col), "_jaccard_tie": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))})
    once = once.dropDuplicates(["_jaccard_id", "_jaccard_tie"]).drop("_jaccard_id", "_jaccard_tie")
    return held(kept.filter((F.col("_rows") == 1) | F.col("_blank"))).unionByName(once)


def digest(docs: DataFrame) -> DataFrame:
    """join() of the documents with five-word shingles and a similarity of 0.8."""
    return join(docs)


#: DuckDB SQL for digest(): all pairs that share a shingle, and the components of the links.
SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END)) AS s FROM split
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), links AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN sizes m ON m.doc_id = p.a JOIN sizes k ON k.doc_id = p.b WHERE 5 * p.both >= 4 * (m.n + k.n - p.both)
), reached AS (
  SELECT doc_id, doc_id AS class_id FROM documents
  UNION
  SELECT l.b, r.class_id FROM reached r JOIN links l ON l.a = r.doc_id WHERE r.class_id < l.b
)
SELECT d.doc_id, c.class_id, coalesce(k.n, 0)::BIGINT AS n_links
FROM documents d JOIN (SELECT doc_id, min(class_id) AS class_id FROM reached GROUP BY doc_id) c ON c.doc_id = d.doc_id
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) k ON k.a = d.doc_id
"""
