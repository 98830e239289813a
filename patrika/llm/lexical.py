"""Ranked lexical search over a quantised index of two levels.

The index has a row for each document: its terms that some item asks for, and for each of them

- level one: the impact, which is what an occurrence counts before the term's weight, as a byte rounded up;
- level two: how often it occurs, and once for the document how many terms it has, from which the exact impact follows.

Bytes times weights bound a document's score from above, and one step less of each from below. The k-th largest of the
lower bounds is reached by every document of an item's best k, so only documents whose upper bound reaches it are scored
exactly, in integers, ties and copies included, however many they are.

The texts are read once for a block of items, and the index twice: for the bounds and for the scores. Tasks give the k
best they have of each item and no more, which Spark ranks. What goes to all tasks is the items' terms and weights, in
blocks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import defined_id, real_id, stored, tidy
from .textarrays import Block, Lookup, binary_parts, blocks, same_bytes

#: Results for an item.
K = 10
#: Items, and words of theirs, that go to the tasks at a time; items and cells of a matrix of weights.
MOST_ITEMS, MOST_WORDS, GROUP, CELLS = 1024, 1 << 18, 128, 1 << 22
#: Impacts are under WHOLE; a byte stands for so much of it.
WHOLE = 1_000_000
STEP = -(-WHOLE // 255)
#: Terms of documents that are multiplied with weights at a time.
ENTRIES = 1 << 14
_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BETWEEN = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def _terms_of(block: Block) -> Block:
    """The block in lower case, with its terms as words."""
    b = Block(_LOWER[block.data], block.offsets, block.first)
    b.words(_BETWEEN)
    return b


class Vocabulary:
    """The distinct terms of items, numbered in the order of their hashes, and found by their bytes."""

    def __init__(self, block: Block):
        h = block.word_hashes()
        hashes, first, self.number = np.unique(h, return_index=True, return_inverse=True)
        self.data, self.starts, self.ends = block.data, block.starts[first], block.ends[first]
        all_ = np.arange(len(h))
        if not same_bytes(block.data, block.starts, block.ends, block.data, self.starts[self.number[all_]], self.ends[self.number[all_]]).all():
            raise ValueError("two terms of the items have the same hash")
        self.look = Lookup(hashes)

    def __len__(self) -> int:
        return len(self.starts)

    def of(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the block's words that are terms, and which terms."""
        at, term = self.look(block.word_hashes())
        ok = same_bytes(block.data, block.starts[at], block.ends[at], self.data, self.starts[term], self.ends[term])
        return at[ok], term[ok]


@dataclass
class Items:
    """Items: ids, terms (numbers, of the vocabulary, with repeats) from start[i] to start[i + 1]."""

    ids: list
    terms: np.ndarray
    start: np.ndarray
    vocabulary: Vocabulary


def _items(rows: pa.Table) -> Items:
    data, offsets = binary_parts(rows.column("text").combine_chunks().cast(pa.large_binary()))
    block = _terms_of(Block(data, offsets, 0))
    vocabulary = Vocabulary(block)
    return Items(rows.column("id").to_pylist(), vocabulary.number, block.first_word, vocabulary)


# -- the index --------------------------------------------------------------------------------------------------------


def _posted(vocabulary: Vocabulary):
    """Rows (doc, n, terms, times) for each text with a term: how many terms it has, those of the vocabulary and how often."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(1, len(vocabulary))
        for batch in batches:
            for b in map(_terms_of, blocks(batch.column(1))):
                at, term = vocabulary.of(b)
                key, times = np.unique(b.doc[at] * size + term, return_counts=True)
                some = np.flatnonzero(b.n_words)
                offsets = np.searchsorted(key // size, np.append(some, b.n)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in ((key % size).astype(np.int32), times.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some + b.first)), pa.array(b.n_words[some].astype(np.int64)), *lists], ["doc", "n", "terms", "times"])

    return run


def impacts(times: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """Exact impacts: what `times` occurrences count in a document of n terms, of `docs` documents with `total` terms."""
    if int(n.max(initial=0)) * 75 * docs < 1 << 62:
        m = 25 + (75 * docs * n) // total
    else:
        m = np.array([25 + 75 * docs * int(x) // total for x in n.tolist()])
    return (1_000_000_000 * times) // (1000 * times + 8 * m)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, and how many each row has."""
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def _quantised(docs: int, total: int):
    """Rows (doc, n, terms, times) with `bytes_`: the impacts in STEPs, rounded up."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            times, many = _lists(batch.column(3))
            exact = impacts(times, np.repeat(batch.column(1).to_numpy(), many), docs, total)
            offsets = np.concatenate([[0], np.cumsum(many)]).astype(np.int32)
            up = pa.ListArray.from_arrays(pa.array(offsets), pa.array((-(-exact // STEP)).astype(np.int16)))
            yield pa.RecordBatch.from_arrays([*batch.columns, up], [*batch.schema.names, "bytes_"])

    return run


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (term, n) from rows (terms): in how many of the task's documents a term is."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        seen = np.bincount(_lists(batch.column(0))[0], minlength=len(total))
        seen[: len(total)] += total
        total = seen
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "n"])


# -- the search -------------------------------------------------------------------------------------------------------


@dataclass
class Group:
    """Some items: the first one's position, the row of each term of the vocabulary (-1: none), and the weights."""

    first: int
    row: np.ndarray
    weights: np.ndarray
    whole: np.ndarray  # the weights as whole numbers


def _groups(items: Items, weight: np.ndarray) -> list[Group]:
    """The items in groups of up to GROUP, with matrices of up to CELLS weights; repeated terms weigh as often."""
    out, lo = [], 0
    while lo < len(items.ids):
        hi = lo + 1
        while hi < len(items.ids) and hi - lo < GROUP and int(items.start[hi + 1] - items.start[lo]) * (hi + 1 - lo) <= CELLS:
            hi += 1
        used, row = np.unique(items.terms[items.start[lo] : items.start[hi]], return_inverse=True)
        weights = np.zeros((len(used), hi - lo))
        np.add.at(weights, (row, np.repeat(np.arange(hi - lo), np.diff(items.start[lo : hi + 1]))), weight[used[row]] if len(used) else 0)
        place = np.full(len(items.vocabulary), -1, np.int32)
        place[used] = np.arange(len(used))
        out.append(Group(lo, place, weights, weights.astype(np.int64)))
        lo = hi
    return out


def _sums(rows: np.ndarray, factor: np.ndarray | None, many: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each document, of `many` entries, the sum of its entries' rows of weights, times `factor` each."""
    out = np.zeros((len(many), weights.shape[1]), weights.dtype)
    full = np.flatnonzero(many)
    if len(full):
        picked = weights[rows] if factor is None else weights[rows] * factor[:, None]
        out[full] = np.add.reduceat(picked, (np.cumsum(many) - many)[full], axis=0)
    return out


class _Chunk:
    """Documents' entries that belong to a group's terms."""

    def __init__(self, group: Group, terms: np.ndarray, up: np.ndarray, many: np.ndarray):
        row = group.row[terms]
        self.used = np.flatnonzero(row >= 0)
        self.row, self.up = row[self.used], up[self.used].astype(float)
        self.doc = np.repeat(np.arange(len(many)), many)[self.used]
        self.many = np.bincount(self.doc, minlength=len(many))
        self.weights = group.weights

    def upper(self) -> np.ndarray:
        return _sums(self.row, self.up, self.many, self.weights) * STEP

    def some(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries of these documents, and how many each has."""
        take = np.zeros(len(self.many), bool)
        take[docs] = True
        return np.flatnonzero(take[self.doc]), self.many[docs]

    def steps(self, docs: np.ndarray) -> np.ndarray:
        """What a STEP less of each impact takes from the sums of these documents."""
        at, many = self.some(docs)
        return _sums(self.row[at], None, many, self.weights) * STEP


def _chunks(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """First and last document, and terms, bytes, and numbers of entries, of some documents of rows whose columns `at` and
    following are terms and bytes_; and the entries' places."""
    (terms, many), (up, _) = _lists(batch.column(at)), _lists(batch.column(at + 1))
    total, lo = np.concatenate([[0], np.cumsum(many)]), 0
    while lo < len(many):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + ENTRIES, "right")) - 1)
        hi = min(hi, len(many), lo + 1024)
        yield lo, hi, terms[total[lo] : total[hi]], up[total[lo] : total[hi]], many[lo:hi], np.arange(total[lo], total[hi])
        lo = hi


def _bounds(groups: list[Group], items: int, k: int):
    """Rows (item, low): the k largest lower bounds that a task's documents have for each item, from rows (terms, bytes_)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((k, items))
        for batch in batches:
            for _, _, terms, up, many, _ in _chunks(batch, 0):
                for g in groups:
                    own = best[:, g.first : g.first + g.weights.shape[1]]
                    chunk = _Chunk(g, terms, up, many)
                    upper = chunk.upper()
                    hit = upper > own[0]
                    docs = np.flatnonzero(hit.any(1))
                    if len(docs):
                        low = np.where(hit[docs], upper[docs] - chunk.steps(docs), 0)
                        own[:] = np.sort(np.concatenate([own, low]), axis=0)[-k:]
        some = np.argwhere(best > 0)
        yield pa.RecordBatch.from_arrays([pa.array(some[:, 1]), pa.array(best[some[:, 0], some[:, 1]].astype(np.int64))], ["item", "low"])

    return run


def _scores(groups: list[Group], least: np.ndarray, docs: int, total: int, k: int):
    """Rows (item, doc, score): the k best of a task's documents for each item, of those whose upper bound reaches `least`,
    from rows (doc, n, times, terms, bytes_)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[int, int]]] = [[] for _ in range(len(least))]  # (-score, doc), best first
        for batch in batches:
            ids, n, (times, _) = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _lists(batch.column(2))
            for lo, hi, terms, up, many, place in _chunks(batch, 3):
                for g in groups:
                    own = slice(g.first, g.first + g.weights.shape[1])
                    chunk = _Chunk(g, terms, up, many)
                    hit = chunk.upper() >= np.maximum(least[own], 1)
                    reach = np.flatnonzero(hit.any(1))
                    if not len(reach):
                        continue
                    at, own_many = chunk.some(reach)
                    exact = impacts(times[place[chunk.used[at]]], np.repeat(n[lo:hi][reach], own_many), docs, total)
                    score = _sums(chunk.row[at], exact, own_many, g.whole)
                    score[~hit[reach]] = 0
                    for i in np.flatnonzero(score.any(0)):
                        better(held, g.first + int(i), score[:, i], ids[lo:hi][reach])
        rows = [(i, doc, -score) for i, own in enumerate(held) for score, doc in own]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], ["item", "doc", "score"])

    def better(held: list[list[tuple[int, int]]], item: int, score: np.ndarray, ids: np.ndarray) -> None:
        some = np.flatnonzero(score > 0)
        if len(held[item]) == k:
            some = some[-score[some] <= held[item][-1][0]]
        some = some[np.lexsort((ids[some], -score[some]))[:k]]
        held[item] = sorted([*held[item], *zip((-score[some]).tolist(), ids[some].tolist(), strict=True)])[:k]

    return run


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The k documents with the highest scores above 0 for each row of `items` (item_col, text): item, rank from 1, the
    document's id, score; equal scores by ascending id.

    Terms are runs of ASCII letters and digits and of other characters than ASCII, A-Z in lower case, of the whole text. A
    null text has none. Items without terms find nothing; items equal in id and text are one, others with equal ids are
    ranked together, as one list each. Rows of equal ids are documents of their own; a null id is the smallest. A very
    long text is one entry of the index for each different term that items ask for. Without documents or items the result
    is empty. Columns other than those named are not looked at.
    """
    spark = docs.sparkSession
    source = items.select(F.col(item_col).cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    source = stored(source.withColumn("_key", F.xxhash64("id", "text")), "lexical-items")
    texts = docs.select(defined_id(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    n_items, n_bytes = source.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    n_blocks = max(-(-int(n_items) // MOST_ITEMS), -(-int(n_bytes or 0) // (2 * MOST_WORDS)))  # a word has two bytes at least, with what ends it
    out = []
    for block in range(n_blocks):
        mine = source.filter(F.pmod(F.xxhash64("_key"), F.lit(n_blocks)) == block) if n_blocks > 1 else source
        out.append(_ranked(texts, _items(mine.select("id", "text").orderBy("id", "text").toArrow()), k))  # a block's items
    if not out:
        return spark.createDataFrame([], f"{item_col} long, rank int, {id_col} long, score long")
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole.select(F.col("item_id").alias(item_col), "rank", real_id("doc").alias(id_col), "score")


def _ranked(texts: DataFrame, items: Items, k: int) -> DataFrame:
    spark = texts.sparkSession
    post = stored(texts.mapInArrow(_posted(items.vocabulary), "doc long, n long, terms array<int>, times array<long>"), "lexical-posted")
    docs, total = post.agg(F.count("*"), F.sum("n")).first()
    names = spark.createDataFrame(pa.table({"item": pa.array(range(len(items.ids)), pa.int64()), "item_id": pa.array(items.ids, pa.int64())}))
    counts = post.select("terms").mapInArrow(tidy(_document_counts), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # the items' terms
    df = dict(zip(counts.column(0).to_pylist(), counts.column(1).to_pylist(), strict=True))
    weight = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(items.vocabulary))], float)
    groups = _groups(items, weight)
    index = stored(post.mapInArrow(_quantised(docs, total or 1), "doc long, n long, terms array<int>, times array<long>, bytes_ array<short>"), "lexical-index")
    lows = index.select("terms", "bytes_").mapInArrow(_bounds(groups, len(items.ids), k), "item long, low long")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("low")))
    kth = lows.withColumn("_place", place).filter(F.col("_place") <= k).filter(F.col("_place") == k).select("item", "low").toArrow()  # a row for each item
    least = np.zeros(len(items.ids))
    least[kth.column(0).to_numpy()] = kth.column(1).to_numpy()
    found = index.select("doc", "n", "times", "terms", "bytes_").mapInArrow(_scores(groups, least, docs, total or 1, k), "item long, doc long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc"))).filter(F.col("rank") <= k)
    return ranked.join(names, "item").select("item_id", "rank", "doc", "score")


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's rows: the 10 best documents of each benchmark item."""
    return search(docs, benchmark)


#: DuckDB SQL for digest().
SQL = r"""
WITH doc_terms AS (
  SELECT rid, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT *, row_number() OVER () AS rid FROM documents)
), counted AS (
  SELECT rid, doc_id, term, count(*) AS tf FROM doc_terms GROUP BY ALL
), sizes AS (
  SELECT rid, sum(tf)::BIGINT AS n FROM counted GROUP BY rid
), corpus AS (
  SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM sizes
), weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM counted GROUP BY term), corpus
), asked AS (
  SELECT item_id, text, term, count(*) AS q FROM (
    SELECT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT DISTINCT item_id, text FROM benchmark))
  GROUP BY ALL
), scored AS (
  SELECT item_id, a.text, c.rid, c.doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))))::BIGINT AS score
  FROM asked a JOIN counted c USING (term) JOIN weights USING (term) JOIN sizes s ON s.rid = c.rid, corpus
  GROUP BY item_id, a.text, c.rid, c.doc_id
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scored WHERE score > 0)
WHERE rank <= 10
"""
