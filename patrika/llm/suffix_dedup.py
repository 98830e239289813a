"""Suffix-array de-duplication of byte passages across the whole corpus.

A byte goes if a string of `width` bytes that covers it also starts earlier: in a smaller document, or earlier in the
same one. Four steps, all dealt by Spark:

1. Each window of `width` bytes is owned by the smallest hash among its `KGRAM`-byte grams (its anchor), so equal
   windows have equal anchors. Consecutive windows with one anchor form a span. Only (anchor, span hash, place) is
   sent, a plain row for some 35 bytes of text, however many partitions there are. Of equal spans in a batch the first
   is sent; the others go at once, so a passage that a third of the documents hold is a row for each batch.
2. By anchor: all but the first of equal spans go. That much is a join by hash: equal spans are one suffix, and the
   first place is the longest previous factor of all others. Anchors with several different spans need their bytes, and
   so do first spans in which a window occurs again.
3. Those spans' bytes are cut out of the texts and sorted by anchor: the suffixes that start a window in suffix order,
   their common prefixes, and the previous and next smaller positions give each suffix's longest previous factor.
   Where it has `width` bytes or more, the window goes.
4. By document: the bytes of all windows that go are removed.

An anchor that very many documents share is found on a sample of the documents; its windows travel one by one under
their own hash, where equal ones collapse in each batch. The sample decides only how records travel, never the result.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import defined_id, groups_of, real_id, stored, tidy
from .textarrays import Block, binary_parts, blocks, mixed

KGRAM = 32
#: Windows in a span at most.
LONGEST = 128
#: Bytes of text for a bucket, about, and for a partition, which works its buckets off one by one; and of a long text for a
#: piece, whose windows are found by themselves.
BUCKET_BYTES, PART_BYTES, PIECE = 16 << 20, 64 << 20, 4 << 20
#: One document in so many is looked at for anchors that very many share, and how often those are seen there.
SAMPLE, OFTEN, MOST_HOT = 64, 24, 1 << 16
_U = np.uint64


def pack(cols: dict[str, np.ndarray]) -> bytes:
    """Columns of equal length as compressed bytes."""
    size = len(next(iter(cols.values())))
    return struct.pack("<q", size) + zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(v).tobytes() for v in cols.values()))


def unpack(raw: bytes, kinds: tuple[tuple[str, str], ...]) -> dict[str, np.ndarray]:
    size, data, at, out = struct.unpack("<q", raw[:8])[0], zstandard.ZstdDecompressor().decompress(raw[8:]), 0, {}
    for name, kind in kinds:
        out[name] = np.frombuffer(data, kind, size, at)
        at += out[name].nbytes
    return out


def _joined(raws: list[bytes], kinds: tuple[tuple[str, str], ...]) -> dict[str, np.ndarray]:
    parts = [unpack(r, kinds) for r in raws]
    return {name: np.concatenate([p[name] for p in parts]) if parts else np.zeros(0, kind) for name, kind in kinds}


def _taken(cols: dict[str, np.ndarray], at: np.ndarray) -> dict[str, np.ndarray]:
    return {k: v[at] for k, v in cols.items()}


def _bucket_of(doc: np.ndarray, tie: np.ndarray, n: int) -> np.ndarray:
    return (mixed(doc.astype(np.int64).view(_U) ^ mixed(tie.astype(np.int64).view(_U))) % _U(n)).astype(np.int64)


def _dealt(cols: dict[str, np.ndarray], bucket: np.ndarray) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, edges):
        if len(part):
            yield int(bucket[part[0]]), _taken(cols, part)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while step * 2 <= width:
        x, step = np.minimum(x[:-step], x[step:]), step * 2
    return x if step == width else np.minimum(x[: len(x) - (width - step)], x[width - step :])


def spans_of(block, width: int) -> dict[str, np.ndarray]:
    """The block's spans: anchor, span (hash of the span's bytes), row (the text's index), at (in the text), n (windows),
    again (whether a window occurs in it more than once)."""
    none = {k: np.zeros(0, t) for k, t in (("anchor", _U), ("span", _U), ("row", np.int64), ("at", np.int64), ("n", np.int64), ("again", bool))}
    if len(block.data) < width:
        return none
    k = min(KGRAM, width)
    grams = block.grams(k)
    low = _sliding_min(grams, width - k + 1)
    lengths = np.diff(block.offsets)
    row = np.repeat(np.arange(block.n), lengths)[: len(low)]
    inside = np.arange(len(low)) + width <= block.offsets[1:][row]
    starts = np.flatnonzero(inside)
    if not len(starts):
        return none
    v, r = low[starts], row[starts]
    new = np.concatenate([[True], (v[1:] != v[:-1]) | (r[1:] != r[:-1])])
    first = np.flatnonzero(new)
    n = np.diff(np.concatenate([first, [len(starts)]]))
    if n.max() > LONGEST:  # a repeated gram: cut into pieces
        pieces = -(-n // LONGEST)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first, n = np.repeat(first, pieces) + nth * LONGEST, np.minimum(np.repeat(n, pieces) - nth * LONGEST, LONGEST)
    begin = starts[first]
    span = n.astype(_U)
    for at in range(0, LONGEST - 1 + width, width):  # windows that cover the span, the last ones overlapping
        span = mixed(span * _U(0xD6E8FEB86659FD93) + _window_hashes(grams, begin + np.minimum(at, n - 1), width))
    again = _repeating(grams, width, v[first], begin, n)
    return {"anchor": v[first], "span": span, "row": r[first] + block.first, "at": begin - block.offsets[r[first]], "n": n, "again": again}


def _window_hashes(grams: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """A hash of the `width` bytes at each place, from the hashes of grams that cover them."""
    k, out = min(KGRAM, width), np.zeros(len(at), _U)
    for step in range(0, width, k):
        out = mixed(out * _U(0xD6E8FEB86659FD93) + grams[at + min(step, width - k)])
    return out


def _repeating(grams: np.ndarray, width: int, anchor: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which spans hold a window more than once. Equal windows have their anchors in equal places, so only spans whose
    first and last anchors are two are looked into."""
    view = np.lib.stride_tricks.sliding_window_view(grams, width - min(KGRAM, width) + 1)
    two = np.zeros(len(n), bool)
    for lo in range(0, len(n), 1 << 12):
        i = slice(lo, lo + (1 << 12))
        end = begin[i] + n[i] - 1
        leading = (view[begin[i]] == anchor[i, None]).argmax(1) + begin[i]
        last = end + view.shape[1] - 1 - (view[end] == anchor[i, None])[:, ::-1].argmax(1)
        two[i] = leading < last
    again, some = np.zeros(len(n), bool), np.flatnonzero(two & (n > 1))
    for lo in range(0, len(some), 1 << 12):
        s = some[lo : lo + (1 << 12)]
        span = np.repeat(s, n[s])
        at = begin[span] + np.arange(len(span)) - np.repeat(np.cumsum(n[s]) - n[s], n[s])
        window = _window_hashes(grams, at, width)
        order = np.lexsort((window, span))
        same = (window[order][1:] == window[order][:-1]) & (span[order][1:] == span[order][:-1])
        again[span[order][1:][same]] = True
    return again


def _windows_of(block, width: int, spans: dict[str, np.ndarray], hot: np.ndarray) -> dict[str, np.ndarray]:
    """The spans with those of hot anchors taken apart into windows, each anchored by its own hash."""
    split = np.isin(spans["anchor"], hot)
    if not split.any():
        return spans
    s = _taken(spans, np.flatnonzero(split))
    nth = np.arange(s["n"].sum()) - np.repeat(np.cumsum(s["n"]) - s["n"], s["n"])
    row, at = np.repeat(s["row"], s["n"]), np.repeat(s["at"], s["n"]) + nth
    begin = at + block.offsets[row - block.first]
    window = _window_hashes(block.grams(min(KGRAM, width)), begin, width)
    alone = {"anchor": mixed(window ^ _U(0xA5A5A5A5A5A5A5A5)), "span": mixed(window + _U(1)), "row": row, "at": at, "n": np.ones(len(at), np.int64), "again": np.zeros(len(at), bool)}
    rest = _taken(spans, np.flatnonzero(~split))
    return {k: np.concatenate([rest[k], alone[k]]) for k in spans}


def _placed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)


def _found_in(block: Block, width: int, hot: np.ndarray) -> dict[str, np.ndarray]:
    """The block's spans, those of hot anchors taken apart; a long text piece by piece, with the bytes that windows share."""
    if block.n > 1 or len(block.data) <= PIECE:
        return _windows_of(block, width, spans_of(block, width), hot)
    parts = []
    for lo in range(0, len(block.data), PIECE):
        data = block.data[lo : lo + PIECE + width - 1]
        piece = Block(data, np.array([0, len(data)]), block.first)
        found = _windows_of(piece, width, spans_of(piece, width), hot)
        parts.append(found | {"at": found["at"] + lo})
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def _leaders(c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of columns sorted by anchor, span and place: where groups of equal spans start, and which spans have an equal one at
    an earlier place."""
    if not len(c["at"]):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    start = np.flatnonzero(np.concatenate([[True], (c["anchor"][1:] != c["anchor"][:-1]) | (c["span"][1:] != c["span"][:-1])]))
    lead = np.repeat(start, np.diff(np.concatenate([start, [len(c["at"])]])))
    return start, (c["doc"] != c["doc"][lead]) | (c["tie"] != c["tie"][lead]) | (c["at"] != c["at"][lead])


def _sent(bucket: np.ndarray, cols: dict[str, np.ndarray], names: tuple[str, ...]) -> tuple[list[int], list[bytes]]:
    """The columns `names` packed by bucket, in order of place."""
    cols = _taken(cols | {"_b": bucket}, np.lexsort((cols["at"], cols["doc"])))
    dealt = list(_dealt({k: cols[k] for k in names}, cols["_b"]))
    return [b for b, _ in dealt], [pack(x) for _, x in dealt]


_SPANS = "anchor long, span long, doc long, tie long, place long, bucket long, data binary"


def _find_spans(width: int, buckets: int, hot: np.ndarray) -> Callable:
    """Rows of _SPANS: a batch's first of equal spans, `place` being where, how many windows, and whether one occurs again;
    and packed, by the document's bucket, those that go already."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tie = _placed(batch)
            parts = [_found_in(b, width, hot) for b in blocks(batch.column(2))]
            if not parts:
                continue
            s = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
            c = {"anchor": s["anchor"], "span": s["span"], "doc": doc[s["row"]], "tie": tie[s["row"]], "at": s["at"], "n": s["n"].astype(np.uint16), "again": s["again"].astype(np.int64)}
            c = _taken(c, np.lexsort((c["at"], c["tie"], c["doc"], c["span"], c["anchor"])))
            start, later = _leaders(c)
            gone = _runs(_taken({k: c[k] for k in ("doc", "tie", "at", "n")}, np.flatnonzero(later)))
            held, data = _sent(_bucket_of(gone["doc"], gone["tie"], buckets), gone, ("doc", "tie", "at", "n"))
            c = _taken(c, start)
            c = _taken(c, np.lexsort((c["at"], c["doc"])))  # near equal values stand together, for the compressor
            place = c["at"] << 9 | c["n"].astype(np.int64) << 1 | c["again"]
            none = lambda n, kind: pa.nulls(n, kind)
            longs = [pa.array(x.view(np.int64)) for x in (c["anchor"], c["span"], c["doc"], c["tie"], place)]
            more = [pa.array(held, pa.int64()), *[pa.array([0] * len(held), pa.int64())] * 4]
            yield pa.RecordBatch.from_arrays(
                [*(pa.concat_arrays([a, b]) for a, b in zip(longs, more, strict=True)), pa.concat_arrays([none(len(start), pa.int64()), pa.array(held, pa.int64())]), pa.concat_arrays([none(len(start), pa.binary()), pa.array(data, pa.binary())])],
                ["anchor", "span", "doc", "tie", "place", "bucket", "data"],
            )

    return run


def _hot_anchors(texts: DataFrame, width: int) -> np.ndarray:
    """Anchors found in OFTEN of a sample of the documents, the MOST_HOT most frequent of them."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(2)):
                s = _found_in(b, width, np.zeros(0, _U))
                seen = np.unique(np.stack([s["anchor"], s["row"].astype(_U)], 1), axis=0)[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64))], ["anchor"])

    some = texts.filter(F.pmod(F.xxhash64("doc", "tie", F.lit(5)), F.lit(SAMPLE)) == 0)
    seen = some.mapInArrow(run, "anchor long").groupBy("anchor").count().filter(F.col("count") >= OFTEN)
    top = seen.orderBy(F.desc("count"), "anchor").limit(MOST_HOT).select("anchor").collect()  # MOST_HOT rows at most
    return np.array([r["anchor"] for r in top], np.int64).view(_U)


def _compare(buckets: int) -> Callable:
    """Rows of _SPANS sorted by anchor, span and place: what goes already, and which spans need their bytes; both packed by
    the document's bucket."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, 1):
            done = table.filter(pc.is_valid(table.column("data")))
            yield from pa.table([done.column("bucket"), pa.array([False] * done.num_rows), done.column("data")], ["bucket", "asked", "data"]).to_batches()
            table = table.filter(pc.is_null(table.column("data")))
            c = {k: table.column(k).to_numpy() for k in ("anchor", "span", "doc", "tie")}
            place = table.column("place").to_numpy()
            c |= {"at": place >> 9, "n": (place >> 1 & 255).astype(np.uint16)}
            start, later = _leaders(c)
            ask = np.zeros(len(place), bool)
            ask[start] = place[start] & 1 > 0
            if len(start):
                anchor = c["anchor"][start]
                first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
                many = np.diff(np.concatenate([first, [len(anchor)]]))
                ask[start[np.repeat(many > 1, many)]] = True
            for asked, keep, names in ((False, later, ("doc", "tie", "at", "n")), (True, ask & ~later, ("anchor", "doc", "tie", "at", "n"))):
                x = _taken(c, np.flatnonzero(keep))
                if not asked:
                    x = _runs({k: x[k] for k in names})
                held, data = _sent(_bucket_of(x["doc"], x["tie"], buckets), x, names)
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array([asked] * len(held), pa.bool_()), pa.array(data, pa.binary())], ["bucket", "asked", "data"])

    return run


_GONE = (("doc", "<i8"), ("tie", "<i8"), ("at", "<i8"), ("n", "<u2"))
_ASKED = (("anchor", "<i8"), *_GONE)


def _distinct(doc: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each place, in order, and how many rows it has."""
    order = np.lexsort((tie, doc))
    d, t = doc[order], tie[order]
    start = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (t[1:] != t[:-1])])) if len(d) else np.zeros(0, np.int64)
    first, many = order[start], np.diff(np.concatenate([start, [len(d)]]))
    by_row = np.argsort(first)
    return first[by_row], many[by_row]


def _pack_texts(buckets: int) -> Callable:
    """Texts by bucket of their document, compressed; those of a batch that are equal in id and text as one."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            doc, tie = _placed(batch)
            data, offsets = binary_parts(batch.column(2))
            out = []
            row, many = _distinct(doc, tie)
            for b, x in _dealt({"doc": doc[row], "tie": tie[row], "row": row, "rows": many}, _bucket_of(doc[row], tie[row], buckets)):
                text = b"".join(data[offsets[i] : offsets[i + 1]].tobytes() for i in x["row"])
                out.append((b, pack({"doc": x["doc"], "tie": x["tie"], "size": np.diff(offsets)[x["row"]].astype(np.int64), "rows": x["rows"].astype(np.int64)}), squeeze.compress(text)))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.binary())], ["bucket", "places", "texts"])

    return run


def _unpacked_texts(table: pa.Table) -> Iterator[tuple[int, int, int, bytes]]:
    """doc, tie, for how many rows it stands, and the text."""
    for places, texts in zip(table.column("places").to_pylist(), table.column("texts").to_pylist(), strict=True):
        p = unpack(places, (("doc", "<i8"), ("tie", "<i8"), ("size", "<i8"), ("rows", "<i8")))
        data = zstandard.ZstdDecompressor().decompress(texts) if texts else b""
        ends = np.cumsum(p["size"])
        for doc, tie, size, rows, end in zip(*(p[c].tolist() for c in ("doc", "tie", "size", "rows")), ends.tolist(), strict=True):
            yield doc, tie, rows, data[end - size : end]


def _by_text(c: dict[str, np.ndarray]) -> dict[tuple[int, int], np.ndarray]:
    """Row numbers of each (doc, tie)."""
    order = np.lexsort((c["at"], c["tie"], c["doc"]))
    doc, tie = c["doc"][order], c["tie"][order]
    edges = np.flatnonzero((doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1])) + 1
    return {(int(c["doc"][p[0]]), int(c["tie"][p[0]])): p for p in np.split(order, edges) if len(p)}


def _cut(width: int, buckets: int) -> Callable:
    """Cuts the bytes of the spans that were asked for out of the texts, by anchor."""

    def run(asked: pa.Table, texts: pa.Table) -> pa.Table:
        c = _joined(asked.column("data").to_pylist(), _ASKED)
        where, pieces, done = _by_text(c), [b""] * len(c["at"]), np.zeros(len(c["at"]), bool)
        for doc, tie, _, text in _unpacked_texts(texts):
            for i in where.pop((doc, tie), ()):
                pieces[i], done[i] = text[c["at"][i] : c["at"][i] + c["n"][i] + width - 1], True
        squeeze, out = zstandard.ZstdCompressor(level=1), []
        for b, x in _dealt(c | {"i": np.arange(len(done))}, (mixed(c["anchor"].view(_U)) % _U(buckets)).astype(np.int64)):
            rows = x.pop("i")
            out.append((b, pack(x), squeeze.compress(b"".join(pieces[i] for i in rows))))
        return pa.table({"bucket": pa.array([o[0] for o in out], pa.int64()), "places": pa.array([o[1] for o in out], pa.binary()), "pieces": pa.array([o[2] for o in out], pa.binary())})

    return run


def smaller_neighbours(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the previous and of the next smaller value (-1 and len(value) where there is none), by pointer jumps."""
    padded = np.concatenate([[np.iinfo(np.int64).min], value, [np.iinfo(np.int64).min]])
    out = []
    for step in (-1, 1):
        link = np.arange(len(padded)) + step
        link[0], link[-1] = 0, len(padded) - 1
        at = np.arange(1, len(padded) - 1)
        while len(at):
            at = at[padded[link[at]] >= padded[at]]
            link[at] = link[link[at]]
        out.append(link[1:-1] - 1)
    return out[0], out[1]


def previous_factors(order: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """Longest previous factors from a suffix order and the common prefixes of its neighbours.

    order: the suffixes' positions in suffix order; prefix[i]: length of the common prefix of order[i - 1] and order[i].
    For each suffix in that order: the longest prefix that also starts at a smaller position, which is the longer of the
    prefixes shared with the previous and with the next smaller position.
    """
    before, after = smaller_neighbours(order)
    out = np.zeros(len(order), np.int64)
    # lowest common prefix on the way, by a sparse table
    table, width = [prefix], 1
    while width * 2 <= len(prefix):
        table.append(np.minimum(table[-1][:-width], table[-1][width:]))
        width *= 2
    for a, b, ok in ((before, np.arange(len(order)), before >= 0), (np.arange(len(order)), after, after < len(order))):
        lo, hi = a[ok] + 1, b[ok] + 1  # prefix[lo:hi]
        level = np.log2(np.maximum(hi - lo, 1)).astype(int)
        got = np.zeros(len(lo), np.int64)
        for k in np.unique(level):
            m = level == k
            got[m] = np.minimum(table[k][lo[m]], table[k][hi[m] - (1 << k)])
        out[ok] = np.maximum(out[ok], got)
    return out


def _suffix_step(width: int, buckets: int) -> Callable:
    """By anchor: longest previous factors of the suffixes that start a window; windows with `width` bytes of it go."""

    def run(table: pa.Table) -> pa.Table:
        parts = [unpack(r, _ASKED) for r in table.column("places").to_pylist()]
        c = {k: np.concatenate([p[k] for p in parts]) for k, _ in _ASKED}
        text = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(x) for x in table.column("pieces").to_pylist()), np.uint8)
        n = c["n"].astype(np.int64)
        base = np.cumsum(n + width - 1) - (n + width - 1)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        span = np.repeat(np.arange(len(n)), n)
        at, anchor = c["at"][span] + nth, c["anchor"][span]
        gone = np.zeros(len(at), bool)
        place = np.empty(len(at), np.int64)  # rank of the window's place in the corpus, equal for equal places
        by_place = np.lexsort((at, c["tie"][span], c["doc"][span]))
        s = span[by_place]
        moved = np.concatenate([[False], (at[by_place][1:] != at[by_place][:-1]) | (c["doc"][s][1:] != c["doc"][s][:-1]) | (c["tie"][s][1:] != c["tie"][s][:-1])])
        place[by_place] = np.cumsum(moved)
        del by_place, s
        # runs of whole anchors, so that the matrix of suffixes stays small
        by_anchor = np.argsort(anchor, kind="stable")
        edges = np.flatnonzero(np.diff(anchor[by_anchor])) + 1
        bounds, held = [0], 0
        for e in [*edges.tolist(), len(at)]:
            if e - bounds[-1] >= 1 << 16:
                bounds.append(e)
        if bounds[-1] != len(at):
            bounds.append(len(at))
        view = np.lib.stride_tricks.sliding_window_view(text, width)
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            w = by_anchor[lo:hi]
            w = w[np.argsort(place[w], kind="stable")]
            suffixes = np.ascontiguousarray(view[base[span[w]] + nth[w]])
            order = np.argsort(suffixes.view(f"V{width}").ravel(), kind="stable")
            sorted_ = suffixes[order]
            differ = sorted_[1:] != sorted_[:-1]
            prefix = np.concatenate([[0], np.where(differ.any(1), differ.argmax(1), width)]).astype(np.int64)
            gone[w[order]] = previous_factors(place[w[order]], prefix) >= width
        at_gone = np.flatnonzero(gone)
        x = {"doc": c["doc"][span[at_gone]], "tie": c["tie"][span[at_gone]], "at": at[at_gone], "n": np.ones(len(at_gone), np.uint16)}
        x = _runs(x)
        out = [(b, pack(y)) for b, y in _dealt(x, _bucket_of(x["doc"], x["tie"], buckets))]
        return pa.table({"bucket": pa.array([o[0] for o in out], pa.int64()), "data": pa.array([o[1] for o in out], pa.binary())})

    return run


def _runs(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Windows that follow each other as one record, in order of place."""
    x = _taken(x, np.lexsort((x["at"], x["tie"], x["doc"])))
    if not len(x["at"]):
        return x
    end = x["at"] + x["n"].astype(np.int64)
    go_on = (x["doc"][1:] == x["doc"][:-1]) & (x["tie"][1:] == x["tie"][:-1]) & (x["at"][1:] <= end[:-1])
    start = np.flatnonzero(np.concatenate([[True], ~go_on]))
    n = np.maximum.reduceat(end, start) - x["at"][start]
    x, pieces = _taken(x, start), -(-n // 60_000)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    x = {k: np.repeat(v, pieces) for k, v in x.items()}
    return x | {"at": x["at"] + nth * 60_000, "n": np.minimum(np.repeat(n, pieces) - nth * 60_000, 60_000).astype(np.uint16)}


def _removed(width: int, keep_text: bool) -> Callable:
    def run(gone: pa.Table, texts: pa.Table) -> pa.Table:
        c = _joined(gone.column("data").to_pylist(), _GONE)
        where, rows = _by_text(c), []
        for doc, tie, many, text in _unpacked_texts(texts):
            i = where.get((doc, tie))
            if i is None:
                rows.append((doc, many, len(text), 0, 0, hashlib.sha256(text).hexdigest(), text if keep_text else None))
                continue
            depth = np.zeros(len(text) + 1, np.int32)
            np.add.at(depth, c["at"][i], 1)
            np.add.at(depth, c["at"][i] + c["n"][i].astype(np.int64) + width - 1, -1)
            off = np.cumsum(depth[:-1], dtype=np.int32, out=depth[:-1]) > 0
            kept = np.frombuffer(text, np.uint8)[~off].tobytes()
            spans = int(off[0]) + int((off[1:] & ~off[:-1]).sum())
            rows.append((doc, many, len(text), int(off.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 7
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        names = ("doc", "rows", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
        out = {n: pa.array(list(v), k) for n, v, k in zip(names, cols, kinds, strict=True)}
        return pa.table(out if keep_text else {k: v for k, v in out.items() if k != "kept"})

    return run


def dedup_passages(docs: DataFrame, width: int = 100, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """A row per document: the id, n_bytes, n_removed, n_spans, kept_sha256, and with `keep_text` the bytes `kept`.

    A null text is an empty one; texts under `width` bytes stay whole. A null id is the smallest. Rows with equal ids
    and texts are one place, so they get equal results; rows with equal ids and different texts are ordered by a hash
    of the text. Cuts may fall inside a UTF-8 character, which is why `kept` is binary. An empty table gives none.
    """
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    texts = docs.select(defined_id(id_col).alias("doc"), F.xxhash64(raw).alias("tie"), raw.alias("text"))
    size = int(texts.agg(F.sum(F.length("text"))).first()[0] or 0)
    buckets = max(8, -(-size // BUCKET_BYTES))
    hot = _hot_anchors(texts, width)
    parts = max(8, -(-size // PART_BYTES))
    dealt = lambda df: df.repartition(parts, "bucket").groupBy("bucket")
    by_anchor = texts.mapInArrow(_find_spans(width, buckets, hot), _SPANS).repartition(parts, "anchor").sortWithinPartitions("anchor", "span", "doc", "tie", "place")
    compared = stored(by_anchor.mapInArrow(_compare(buckets), "bucket long, asked boolean, data binary"), "suffix-compared")
    packed = texts.mapInArrow(_pack_texts(buckets), "bucket long, places binary, texts binary")
    asked = compared.filter("asked").select("bucket", "data")
    pieces = dealt(asked).cogroup(dealt(packed)).applyInArrow(_cut(width, buckets), "bucket long, places binary, pieces binary")
    found = dealt(pieces).applyInArrow(_suffix_step(width, buckets), "bucket long, data binary")
    gone = compared.filter("not asked").select("bucket", "data").unionByName(found)
    schema = "doc long, rows long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    out = dealt(gone).cogroup(dealt(packed)).applyInArrow(_removed(width, keep_text), schema)
    out = out.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return out.select(real_id("doc").alias(id_col), *out.columns[2:-1])


def digest(docs: DataFrame) -> DataFrame:
    """The contract's row per document."""
    return dedup_passages(docs, keep_text=False)
