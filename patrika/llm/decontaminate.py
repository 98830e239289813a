"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into passages, windows of two segments of words. A randomised SVD of TF-IDF rows, of all passages and of the
items, which weigh twice as much, gives a latent space: each task adds every passage with a random sign to a row of a narrow
sketch, Spark adds the sketches up. Terms and document frequencies are counted over all passages.

Every passage of every text is searched. Whoever holds `subsequence` of an item's words holds some of the item's rarest
ones, so an inverted index from those to items leaves out the passages that can't be one of an item, and loses none; it
is a gate of which chance, by a bound that is far from tight, opens at most GATE. Those are projected, and an item is a candidate
if the cosine of its projection with the passage is high enough. How high follows from the item: a share of what the
item's least telling words would reach among average words, so items of light words are found as well. A candidate counts
if the longest common subsequence of words holds enough of the item, and enough of its answer. Word order, inserted and
exchanged words are thus tolerated as far as the thresholds go.

The corpus is read three times for items of up to MOST_WORDS words altogether; more items
are taken in blocks of so many words, each of which counts and searches once more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, defined_id, real_id, released, tidy
from .textarrays import Block, Lookup, blocks, mixed

SEGMENT = 16
#: Dimensions of the space at most (and at most as many as items), rows of the sketch of all passages, rows of items beside
#: it at most, the texts' most frequent terms at most, and as many of the items' terms.
DIMENSIONS, SKETCH, ITEM_ROWS, TERMS = 128, 256, 1024, 1 << 14
#: Chance with which a passage of average words may come through an item's gate.
GATE = 0.5
#: Words of the items that go to the tasks at a time.
MOST_WORDS = 1 << 22
#: Terms that a task counts before it hands the counts on, and counts of segments that travel in a row.
MOST_TERMS, CHUNK = 1 << 20, 1 << 16
#: By how much more often than on average a text may use the words of an item, by its topic or language.
TYPICAL = 4
COSINE, SUBSEQUENCE, ANSWER = 0.7, 0.6, 0.5
_U = np.uint64
#: ASCII letters in lower case, other ASCII signs as blanks.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[:128] = [ord(chr(i).lower()) if chr(i).isalnum() else 32 for i in range(128)]


def _plain(block: Block) -> Block:
    b = Block(_PLAIN[block.data], block.offsets, block.first)
    b.words()
    return b


@dataclass
class Items:
    """Benchmark items: ids, the hashes of each one's words, and which of them are its answer (None: not told)."""

    ids: list[int]
    words: list[np.ndarray]
    answers: list[np.ndarray | None]

    def terms(self) -> np.ndarray:
        return np.unique(np.concatenate([*self.words, np.zeros(0, _U)]))


def _items(rows: pa.Table) -> Items:
    words = []
    for name in ("text", "answer"):
        own = []
        for b in map(_plain, blocks(rows.column(name).cast(pa.large_string()).combine_chunks())):
            own += np.split(b.word_hashes(), np.cumsum(b.n_words)[:-1])
        words.append(own)
    return Items(rows.column("id").to_pylist(), words[0], [np.isin(w, a) if np.isin(w, a).any() else None for w, a in zip(*words, strict=True)])


def _segments(b: Block, size: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """Each text's first segment of `size` words (and one past the last), and each word's segment."""
    first = np.concatenate([[0], np.cumsum(-(-b.n_words // size))])
    return first, first[b.doc] + (np.arange(len(b.doc)) - b.first_word[b.doc]) // size


# -- the latent space -------------------------------------------------------------------------------------------------


def _starts(group: np.ndarray) -> np.ndarray:
    """Where the runs of equal numbers begin."""
    return np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))


def _some_passages(share: float) -> Callable:
    """Rows (words: the hashes of a passage) for about this share of the texts' passages, chosen by their words."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in map(_plain, blocks(batch.column(0))):
                h = b.word_hashes()
                passage = _segments(b, 2 * SEGMENT)[1]
                if not len(h):
                    continue
                start = _starts(passage)
                key = mixed(np.add.reduceat(mixed(h + np.arange(len(h)).astype(_U) % _U(97)), start)) >> _U(11)
                end = np.append(start[1:], len(h))
                pick = np.flatnonzero(key < _U(int(share * 2**53)))
                yield pa.RecordBatch.from_arrays([pa.array([h[start[i] : end[i]].tobytes() for i in pick], pa.binary())], ["words"])

    return run


def _passages(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the passages, and each word's passage."""
    rows = [np.frombuffer(r, _U) for r in batch.column(0).to_pylist()]
    return np.concatenate([*rows, np.zeros(0, _U)]), np.repeat(np.arange(len(rows)), [len(r) for r in rows])


@tidy
def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (term, n): how often each word occurs in the texts of a task, or in MOST_TERMS of them."""
    terms, counts = [np.zeros(0, _U)], [np.zeros(0, np.int64)]

    def summed() -> tuple[list[np.ndarray], list[np.ndarray]]:
        term, n = np.concatenate(terms), np.concatenate(counts)
        order = np.argsort(term)
        start = _starts(term[order]) if len(term) else np.zeros(0, np.int64)
        return [term[order][start]], [np.add.reduceat(n[order], start) if len(start) else n]

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(terms[0].view(np.int64)), pa.array(counts[0])], ["term", "n"])

    for batch in batches:
        for b in map(_plain, blocks(batch.column(0))):
            h, n = np.unique(b.word_hashes(), return_counts=True)
            terms.append(h)
            counts.append(n)
            if sum(map(len, terms)) > MOST_TERMS:
                terms, counts = summed()
                if len(terms[0]) > MOST_TERMS // 2:
                    yield rows()
                    terms, counts = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
    terms, counts = summed()
    yield rows()


def _add_signed(total: np.ndarray, key: np.ndarray, term: np.ndarray) -> None:
    """Adds terms to a sketch (SKETCH rows of numbers, one after the other), in the row and with the sign that the hashes of their passages say."""
    np.add.at(total, (key >> _U(1)).astype(np.int64) % SKETCH * (len(total) // SKETCH) + term, (key & _U(1)).astype(np.float32) * 2 - 1)


def _rows(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    rows = total.reshape(SKETCH, -1)
    for i in np.flatnonzero(rows.any(1)):
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([rows[i].tobytes()], pa.binary())], ["row", "sums"])


def _sketch(terms: np.ndarray) -> Callable:
    """Rows (row, sums): the task's share of a sketch of the passages' counts of terms. Each passage is added, with a sign
    of its own, to one of SKETCH rows, so the products of such rows' columns are on average those of all passages'."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, total, seen = Lookup(terms), np.zeros(SKETCH * len(terms), np.float32), 0
        for batch in batches:
            h, passage = _passages(batch)
            if not len(h):
                continue
            # by its words and its place in the task: equal passages must not go together
            start = _starts(passage)
            key = np.zeros(batch.num_rows, _U)
            key[passage[start]] = mixed(mixed(np.add.reduceat(mixed(h), start)) + (passage[start] + seen).astype(_U))
            at, term = look(h)
            _add_signed(total, key[passage[at]], term)
            seen += batch.num_rows
        yield from _rows(total)

    return run


def _count(terms: np.ndarray, row: np.ndarray, n_rows: int) -> Callable:
    """Rows (row, sums) of all that the space is made of, in one reading of (doc, text): the task's share of the sketch of
    the terms that `row` gives a place among n_rows (-1: none), and under -1 and less, CHUNK at a time, in how many segments
    each term occurs, followed by the numbers of segments and words."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, total, size = Lookup(terms), np.zeros(SKETCH * n_rows, np.float32), max(1, len(terms))
        df = np.zeros(len(terms) + 2, np.int64)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).view(_U)
            for b in map(_plain, blocks(batch.column(1))):
                h = b.word_hashes()
                if not len(h):
                    continue
                first, segment = _segments(b)
                at, term = look(h)
                np.add.at(df, np.unique(segment[at] * size + term) % size, 1)
                df[-2:] += int(first[-1]), len(h)
                # by its words and its place in a document: equal passages must not go together, wherever the rows are
                first, passage = _segments(b, 2 * SEGMENT)
                doc = np.repeat(np.arange(b.n), np.diff(first))
                own = mixed(np.add.reduceat(mixed(h), _starts(passage))) + mixed(ids[b.first + doc]) + (np.arange(len(doc)) - first[doc]).astype(_U)
                use = row[term] >= 0
                _add_signed(total, mixed(own)[passage[at[use]]], row[term[use]])
        if n_rows:
            yield from _rows(total)
        for i, at in enumerate(range(0, len(df), CHUNK)):
            yield pa.RecordBatch.from_arrays([pa.array([-1 - i], pa.int64()), pa.array([df[at : at + CHUNK].tobytes()], pa.binary())], ["row", "sums"])

    return run


@tidy
def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the rows of equal numbers of a partition up: of the sketch, or (negative ones) of counts."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for row, new in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            new = np.frombuffer(new.as_buffer(), np.float32 if row >= 0 else np.int64)
            sums[row] = sums[row] + new if row in sums else new.copy()
    for row, v in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([v.tobytes()], pa.binary())], ["row", "sums"])


def _sketched(passages: DataFrame, terms: np.ndarray, more: int = 0) -> np.ndarray:
    """The sketch of all passages, summed by Spark. `more` null rows follow."""
    return _summed(passages, _sketch(terms), len(terms), more)[0] if len(terms) else np.zeros((SKETCH + more, 0), np.float32)


def _summed(rows: DataFrame, make: Callable, n_rows: int, more: int, n_counts: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """What `make` makes of the rows, summed by Spark: a sketch of SKETCH rows of TERMS numbers, and as many for the items'
    terms, at most, which `more` null rows follow; and the counts."""
    out, counts, schema = np.zeros((SKETCH + more, n_rows), np.float32), np.zeros(n_counts, np.int64), "row long, sums binary"
    sums = rows.mapInArrow(make, schema).repartition("row").mapInArrow(_added, schema).toArrow()
    for row, v in zip(sums.column(0).to_pylist(), sums.column(1), strict=True):
        if row >= 0:
            out[row] = np.frombuffer(v.as_buffer(), np.float32)
        else:
            at = (-1 - row) * CHUNK
            counts[at : at + CHUNK] = np.frombuffer(v.as_buffer(), np.int64)
    return out, counts


def _add_items(out: np.ndarray, items: Items, terms: np.ndarray, passages: float) -> None:
    """Adds the items' counts of terms to null rows, so weighed that they are twice as much as all passages. Where there are
    fewer rows than items several share one, each with a sign of its own."""
    look = Lookup(terms)
    signs = mixed(np.arange(len(items.words)).astype(_U)) & _U(1)
    for i, w in enumerate(items.words):
        np.add.at(out[i % len(out)], look(w)[1], 1 if len(items.words) <= len(out) or signs[i] else -1)
    out *= np.float32(np.sqrt(max(1.0, 2 * passages / max(1, len(items.words)))))


def singular_vectors(a: np.ndarray, k: int) -> np.ndarray:
    """The k leading right singular vectors (n x k) of a matrix of few rows, from the eigenvectors of its rows' products."""
    if not a.size:
        return np.zeros((a.shape[1], 0), np.float32)
    value, vector = np.linalg.eigh((a @ a.T).astype(float))
    good = np.argsort(-value)[:k]
    good = good[value[good] > max(0.0, value.max()) * 1e-6]
    return a.T @ (vector[:, good] / np.sqrt(value[good])).astype(np.float32)


@dataclass
class Space:
    """Sorted terms, the vector's row of each (-1: none, the null vector), vectors and their mean over the corpus' words;
    squares of the terms' weights, and their mean, which stands for words that are no terms."""

    terms: np.ndarray
    row: np.ndarray
    vectors: np.ndarray
    mean: np.ndarray
    squares: np.ndarray
    square: float

    def of(self, h: np.ndarray) -> np.ndarray:
        """A vector for each word."""
        at, term = Lookup(self.terms)(h)
        out = np.zeros((len(h), self.vectors.shape[1]), np.float32)
        use = self.row[term] >= 0
        out[at[use]] = self.vectors[self.row[term[use]]]
        return out


def _places(known: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """The place of each of the terms among `known`, or -1."""
    row = np.full(len(terms), -1, np.int32)
    row[np.searchsorted(terms, known)] = np.arange(len(known), dtype=np.int32)
    return row


def _space(passages: DataFrame | np.ndarray, known: np.ndarray, terms: np.ndarray, df: np.ndarray, total: int, words: int, k: int, items: Items | None = None) -> Space:
    """The space over the terms `known`, of passages or of their sketch with null rows for the items; terms, df: all terms
    and in how many of `total` segments each occurs."""
    row = _places(known, terms)
    own = df[row >= 0]
    weights = np.log((1 + total) / (1 + df)) + 1
    weight = weights[row >= 0].astype(np.float32)
    rows = passages if isinstance(passages, np.ndarray) else _sketched(passages, known, min(ITEM_ROWS, len(items.words)) if items is not None else 0)
    if items is not None:
        _add_items(rows[SKETCH:], items, known, total / 2)
    rows *= weight
    vectors = weight[:, None] * singular_vectors(rows, k)
    squares = weights**2
    return Space(terms, row, vectors, own @ vectors.astype(np.float64) / max(1, words), squares, float(df @ squares / max(1.0, df.sum())))


# -- the search -------------------------------------------------------------------------------------------------------


def common_words(item: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Which words of `item` belong to a longest common subsequence with `words`, by one bit vector for each word."""
    where: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        where[w] = where.get(w, 0) | 1 << i
    full, row, rows = (1 << len(item)) - 1, (1 << len(item)) - 1, []
    for w in words.tolist():
        u = row & where.get(w, 0)
        row = ((row + u) | (row - u)) & full
        rows.append(row)
    # back from the end: a cleared bit is where the length grows
    used, i, j = np.zeros(len(item), bool), len(item), len(words) - 1
    while i > 0 and j >= 0:
        if rows[j] >> (i - 1) & 1:
            i -= 1
        elif j > 0 and not rows[j - 1] >> (i - 1) & 1:
            j -= 1
        elif int(item[i - 1]) == int(words[j]):
            used[i - 1] = True
            i, j = i - 1, j - 1
        else:
            j -= 1
    return used


def needed_words(n: int, subsequence: float) -> int:
    """Words of an item of n words that a text must hold."""
    return max(1, int(np.ceil(n * subsequence - 1e-9)))


def thresholds(vectors: list[np.ndarray], squares: list[np.ndarray], mean: np.ndarray, square: float, cosine: float, subsequence: float) -> np.ndarray:
    """The cosine that makes a candidate, for each item's word vectors and their weights' squares: `cosine` times what a
    passage reaches that holds of the needed words those that say least, and average words beside them. -1 for items that
    the space doesn't know."""
    out = np.full(len(vectors), -1.0)
    for i, v in enumerate(vectors):
        q = v.sum(0)
        if not (length := np.linalg.norm(q)) > 1e-6:
            continue
        need = needed_words(len(v), subsequence)
        least = np.argsort(v @ q, kind="stable")[:need]
        held = min(need, 2 * SEGMENT * 3 // 4)  # of a longer run, some passage holds three quarters of a passage at least
        others, share = 2 * SEGMENT - held, held / need
        whole, norm = v[least].sum(0) * share + others * mean, np.sqrt(squares[i][least].sum() * share + others * square)
        out[i] = cosine * max(0.0, float(whole @ q)) / (length * norm + 1e-12)
    return out


def _index(items: Items, terms: np.ndarray, df: np.ndarray, words: int, subsequence: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The inverted index: where each term's items start (one more than terms), the items, and how many of an item's
    words in the index must be met. Whoever holds the needed words of n holds j at least of the n - needed + j rarest;
    each item takes the smallest j that chance meets in a text of average words no more often than GATE says, or else the
    one that it meets least often."""
    term, item, least = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(len(items.words), np.int64)
    for i, w in enumerate(items.words):
        if not len(w):
            continue
        need, at = needed_words(len(w), subsequence), np.searchsorted(terms, w)
        at = at[np.lexsort((at, df[at]))]
        j = np.arange(1, need + 1)
        # words that chance brings, in a text of a topic or language of which they are typical
        met = TYPICAL * (4 * SEGMENT + 2 * len(w)) * np.cumsum(df[at])[len(w) - need + j - 1] / max(1, words)
        chance = np.where(met < j, j * (np.log(np.maximum(met, 1e-12) / j) + 1) - met, 0.0)  # the logarithm of a bound
        open_ = np.flatnonzero(chance <= np.log(GATE))
        least[i] = j[open_[0] if len(open_) else chance.argmin()]
        rare = np.unique(at[: len(w) - need + least[i]])
        term.append(rare)
        item.append(np.full(len(rare), i))
    term, item = np.concatenate(term), np.concatenate(item)
    order = np.argsort(term, kind="stable")
    return np.searchsorted(term[order], np.arange(len(terms) + 1)), item[order], least


def _search(items: Items, space: Space, df: np.ndarray, words: int, cosine: float, subsequence: float, answer: float, checks: bool) -> Callable:
    """Rows (doc, item, cosine, subsequence, answer) for each text and item that pass all checks; without `checks` a row for
    each passage and item that the latent search names, and nothing for the last two."""
    start, posted, least = _index(items, space.terms, df, words, subsequence)
    vectors = [space.of(w) for w in items.words]
    level = thresholds(vectors, [space.squares[np.searchsorted(space.terms, w)] for w in items.words], space.mean, space.square, cosine, subsequence)
    query = np.array([v.sum(0) for v in vectors], np.float32).reshape(len(vectors), space.vectors.shape[1])
    query /= np.maximum(np.linalg.norm(query, axis=1, keepdims=True), 1e-9)
    lengths = np.array([len(w) for w in items.words])
    radius = -(-lengths // SEGMENT)
    answers = []  # without an answer of its own, an item's rarest third of words stands for one
    for w, a in zip(items.words, items.answers, strict=True):
        own = df[np.searchsorted(space.terms, w)]
        answers.append(a if a is not None else own <= np.sort(own)[max(1, len(w) // 3) - 1] if len(w) else np.zeros(0, bool))
    # each item's distinct words, and how often it has them, to see how many of them a window holds
    size = len(space.terms)
    pairs, times = np.unique(np.concatenate([np.zeros(0, np.int64), *(i * size + np.searchsorted(space.terms, w) for i, w in enumerate(items.words))]), return_counts=True)
    maybe = np.zeros(1 << 20, bool)
    slot = lambda pair: (mixed(pair.astype(_U)) >> _U(44)).astype(np.int64)
    maybe[slot(pairs)] = True
    needed = np.array([needed_words(len(w), subsequence) for w in items.words])
    # where words hit many items each, smaller blocks
    hits = float(df @ np.diff(start)) / max(1.0, df.sum())
    block = int(min(1 << 20, max(1 << 16, (1 << 22) / max(hits, 1e-9))))

    def near(b: Block, h: np.ndarray, first: np.ndarray, segment: np.ndarray, at: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Passages and items that are candidates, and their cosines."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        many, n = np.diff(start)[term], int(first[-1])
        use = np.flatnonzero(many)
        many, place = many[use], segment[at[use]]
        item = posted[np.repeat(start[term[use]], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
        key, count = np.unique(item * n + np.repeat(place, many), return_counts=True)
        if not len(key):
            return none
        total = np.concatenate([[0], np.cumsum(count)])
        item, place = key // n, key % n
        doc = np.searchsorted(first, place, "right") - 1
        lo, hi = np.maximum(place - radius[item] - 1, first[doc]), np.minimum(place + radius[item] + 1, first[doc + 1] - 1)
        met = total[np.searchsorted(key, item * n + hi, "right")] - total[np.searchsorted(key, item * n + lo, "left")]
        keep = np.flatnonzero(met >= least[item])
        # the passages that hold the segment: it and the next one, it and the one before
        before = keep[place[keep] > first[doc[keep]]]
        key = np.unique(np.concatenate([key[keep], key[before] - 1]))
        if not len(key):
            return none
        item, place = key // n, key % n
        doc = np.searchsorted(first, place, "right") - 1
        follows = place + 1 < first[doc + 1]
        some = np.unique(np.concatenate([place, place[follows] + 1]))
        row = np.full(n, -1)
        row[some] = np.arange(len(some))
        here = np.flatnonzero(row[segment] >= 0)
        square = np.full(len(h), space.square)
        square[at] = space.squares[term]
        norms = np.bincount(row[segment[here]], square[here], len(some))
        word = np.flatnonzero((row[segment[at]] >= 0) & (space.row[term] >= 0))
        sums = np.zeros((len(some), space.vectors.shape[1]), np.float32)
        if len(word):
            where = row[segment[at[word]]]
            edge = _starts(where)
            many = np.diff(np.append(edge, len(word)))
            # the first words of all segments, then the second ones, and so on; those with most words come first
            order = np.argsort(-many, kind="stable")
            edge, many, vector = edge[order], many[order], space.row[term[word]]
            own = space.vectors[vector[edge]]
            for j in range(1, int(many[0])):
                more = int(np.searchsorted(-many, -j, "left"))
                own[:more] += space.vectors[vector[edge[:more] + j]]
            sums[where[edge]] = own
        passage = sums[row[place]] + np.where(follows[:, None], sums[row[np.minimum(place + 1, n - 1)]], 0)
        norm = norms[row[place]] + np.where(follows, norms[row[np.minimum(place + 1, n - 1)]], 0)
        close = np.einsum("ij,ij->i", passage, query[item]) / np.sqrt(np.maximum(norm, 1e-9))
        good = close >= level[item]
        order = np.flatnonzero(good)[np.lexsort((item[good], place[good]))]
        return place[order], item[order], close[order]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(space.terms)
        for batch in batches:
            ids, out = batch.column(0), []
            for b in map(_plain, blocks(batch.column(1), block)):
                h = b.word_hashes()
                first, segment = _segments(b)
                if len(h):
                    at, term = look(h)
                    places, found, scores = near(b, h, first, segment, at, term)
                    if not checks:
                        where = np.searchsorted(first, places, "right") - 1 + b.first
                        out += [(d, items.ids[i], score, None, None) for d, i, score in zip(where.tolist(), found.tolist(), scores.tolist(), strict=True)]
                        continue
                    known = np.full(len(h), -1)
                    known[at] = term
                    some = enough(b, known, first, places, found)
                    out += checked(b, h, first, places[some], found[some], scores[some])
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[o[0]].as_py() for o in out], pa.int64()), *(pa.array([o[i] for o in out], k) for i, k in ((1, pa.int64()), (2, pa.float64()), (3, pa.float64()), (4, pa.float64())))],
                ["doc", "item", "cosine", "subsequence", "answer"],
            )

    def windows(b: Block, first: np.ndarray, places: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The texts of the passages, and where the words around them begin and end, as many on both sides as the item has."""
        d, n = np.searchsorted(first, places, "right") - 1, lengths[found]
        lo = b.first_word[d] + (places - first[d]) * SEGMENT
        return d, np.maximum(b.first_word[d], lo - n), np.minimum(b.first_word[d + 1], lo + 2 * SEGMENT + n)

    def enough(b: Block, known: np.ndarray, first: np.ndarray, places: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Which candidates' windows hold enough of the item's words, in any order."""
        _, begin, end = windows(b, first, places, found)
        out, total = [np.zeros(0, np.int64)], np.cumsum(end - begin)
        lo = 0
        while lo < len(places):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + (1 << 20), "right")))
            many = (end - begin)[lo:hi]
            which = np.repeat(np.arange(hi - lo), many)
            term = known[np.repeat(begin[lo:hi], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
            pair = np.where(term >= 0, found[lo:hi][which] * size + term, -1)
            use = np.flatnonzero((term >= 0) & maybe[slot(pair)])
            at = np.searchsorted(pairs, pair[use])
            hit = pairs[np.minimum(at, len(pairs) - 1)] == pair[use]
            held = np.unique(which[use[hit]] * len(pairs) + at[hit])
            out.append(lo + np.flatnonzero(np.bincount(held // len(pairs), times[held % len(pairs)], hi - lo) >= needed[found[lo:hi]]))
            lo = hi
        return np.concatenate(out)

    def checked(b: Block, h: np.ndarray, first: np.ndarray, places: np.ndarray, found: np.ndarray, scores: np.ndarray) -> list[tuple]:
        best: dict[tuple[int, int], tuple] = {}
        looked: dict[tuple[int, int], int] = {}
        docs, begin, end = windows(b, first, places, found)
        for d, s, i, score, lo, hi in zip(docs.tolist(), places.tolist(), found.tolist(), scores.tolist(), begin.tolist(), end.tolist(), strict=True):
            item, here = items.words[i], int(b.first_word[d] + (s - first[d]) * SEGMENT)
            # neighbouring passages see nearly the same words: one look for each half item
            if (last := looked.get((d, i))) is not None and here - last < max(SEGMENT, len(item) // 2) and (d, i) in best:
                best[d, i] = (*best[d, i][:2], max(best[d, i][2], score), *best[d, i][3:])
                continue
            looked[d, i] = here
            used = common_words(item, h[lo:hi])
            share, told = used.mean(), used[answers[i]].mean() if answers[i].any() else 1.0
            if share >= subsequence - 1e-9 and told >= answer and (share, told) > best.get((d, i), (0, 0, 0, -1.0, 0))[3:]:
                best[d, i] = (d + b.first, items.ids[i], score, float(share), float(told))
        return list(best.values())

    return run


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", answer_col: str | None = None,
    cosine: float = COSINE, subsequence: float = SUBSEQUENCE, answer: float = ANSWER,
) -> DataFrame:
    """Rows for each document and benchmark item that it holds: ids, cosine, subsequence (share of the item's words in a
    longest common subsequence), answer (share of the answer's words among those).

    Words are compared without ASCII case and punctuation. Null texts, and items without words, hold nothing and are
    held by nothing. Of items with equal ids each counts; rows come once for an id and item with the highest figures. A
    null id is kept as null. Without items, or documents, the result is empty. Repeated rows are one, as ids are. Very long texts are
    searched whole, passage by passage. Columns
    other than those named are not looked at, whatever their names.
    """
    out = _searched(docs, benchmark, id_col, text_col, item_col, answer_col, cosine, subsequence, answer, True)
    best = out.groupBy("doc", "item").agg(F.max(F.struct("subsequence", "answer", "cosine")).alias("_b"))
    return best.select(real_id("doc").alias(id_col), real_id("item").alias(item_col), "_b.cosine", "_b.subsequence", "_b.answer")


def candidates(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", cosine: float = COSINE, subsequence: float = SUBSEQUENCE) -> DataFrame:
    """What the latent search names and leaks() then checks: a row (ids, cosine) for each passage and item."""
    out = _searched(docs, benchmark, id_col, text_col, item_col, None, cosine, subsequence, ANSWER, False)
    return out.select(real_id("doc").alias(id_col), real_id("item").alias(item_col), "cosine")


def _searched(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, answer_col: str | None, cosine: float, subsequence: float, answer: float, checks: bool) -> DataFrame:
    """Rows of _search() over all blocks of items."""
    spark, schema = docs.sparkSession, "doc long, item long, cosine double, subsequence double, answer double"
    told = F.coalesce(F.col(answer_col).cast("string"), F.lit("")) if answer_col else F.lit("")
    source = benchmark.select(defined_id(item_col).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), told.alias("answer"))
    texts = docs.select(defined_id(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    n_items, n_words = source.agg(F.count("*"), F.sum(F.regexp_count("text", F.lit(WORD)))).first()
    n_blocks = -(-int(n_words or 0) // MOST_WORDS)
    common = texts.select("text").mapInArrow(_terms, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).filter("n > 1")
    known = np.sort(common.orderBy(F.desc("n"), "term").limit(TERMS).select("term").toArrow().column(0).to_numpy().view(_U))  # TERMS rows at most
    out = spark.createDataFrame([], schema)
    for block in range(n_blocks):
        mine = source.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)) == block) if n_blocks > 1 else source
        items = _items(mine.orderBy("id", "text").toArrow())  # about MOST_WORDS words
        own, times = np.unique(np.concatenate([*items.words, np.zeros(0, _U)]), return_counts=True)
        told = np.union1d(known, own[np.argsort(-times, kind="stable")[:TERMS]])
        terms = np.union1d(own, known)
        sketch, counts = _summed(texts, _count(terms, _places(told, terms), len(told)), len(told), min(ITEM_ROWS, len(items.words)), len(terms) + 2)
        df, total, words = counts[:-2].astype(float), int(counts[-2]), int(counts[-1])
        space = _space(sketch, told, terms, df, total, words, min(DIMENSIONS, max(1, n_items)), items)
        # the driver needs the space alone from here on, which goes to the tasks
        del sketch, counts
        released()
        out = out.unionByName(texts.mapInArrow(_search(items, space, df, words, cosine, subsequence, answer, checks), schema))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that hold a benchmark item, with their own columns. All rows of an id go if one of them
    holds an item; rows with a null id are one document, and null texts hold nothing."""
    bad = leaks(docs, benchmark, id_col, text_col).select(defined_id(id_col).alias("_bad")).distinct()
    return docs.join(bad, defined_id(docs[id_col]) == bad["_bad"], "left_anti")


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """leaks() of the documents: a row for each document and item that it holds."""
    return leaks(docs, benchmark)
