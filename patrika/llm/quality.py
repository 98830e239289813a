"""Quality rules by weak supervision.

Rules vote good or bad or abstain on each document. Expectation-maximisation over the counts of vote patterns, which
are bounded by 3 to the number of rules, estimates each rule's accuracy without labels; the posterior probability of
good quality takes the place of a filter that wants every rule passed.

Votes tell classes apart only where rules agree with each other, so each kind of junk has to be seen by several rules of
different evidence: signs in excess by signs a word, by characters that are no letters, by words with signs in them and
by signs in a row; repetition by windows, by lines and by the variety of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, tidy
from .textarrays import blocks

WINDOW = 8
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SIGN = np.zeros(256, bool)
_SIGN[[i for i in range(33, 127) if not chr(i).isalnum()]] = True
_ODD = _SIGN.copy()
_ODD[list(b".,;:!?'\"()-")] = False
_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_upper", "n_digits", "n_signs", "n_odd_words", "n_in_runs")


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _in_runs(b) -> np.ndarray:
    """Which bytes belong to three or more equal ASCII signs in a row."""
    on = np.zeros(len(b.data), bool)
    if len(b.data) > 2:
        on[2:] = (b.data[2:] == b.data[1:-1]) & (b.data[2:] == b.data[:-2]) & _SIGN[b.data[2:]]
        edge = b.offsets[:-1]
        for k in (0, 1):  # the first two bytes of a text end no run
            on[edge[edge + k < b.offsets[1:]] + k] = False
    out = on.copy()
    for k in (1, 2):
        out[: max(0, len(on) - k)] |= on[k:]
    return out


def _block_stats(b) -> dict[str, np.ndarray]:
    b.words()
    hashes, space = b.word_hashes(), _SPACE[b.data]
    out = {"n_words": b.n_words, "word_chars": _per_text(~space & ((b.data & 0xC0) != 0x80), b.offsets), "n_symbols": _per_text(_SYMBOL[b.data], b.offsets)}
    out["n_upper"] = _per_text((b.data >= 65) & (b.data <= 90), b.offsets)
    out["n_digits"] = _per_text((b.data >= 48) & (b.data <= 57), b.offsets)
    out["n_signs"] = _per_text(_SIGN[b.data], b.offsets)
    odd = np.zeros(len(b.starts), bool)
    odd[np.searchsorted(b.starts, np.flatnonzero(_ODD[b.data]), "right") - 1] = True
    out["n_odd_words"] = np.bincount(b.doc[odd], minlength=b.n)
    out["n_in_runs"] = _per_text(_in_runs(b), b.offsets)
    # words in windows that occur twice in their text: equal (text, window hash) pairs
    window, at = b.windows(WINDOW, hashes)
    repeated = np.zeros(len(hashes) + 1, np.int64)
    if len(at):
        order = np.lexsort((window, b.doc[at]))
        w, d = window[order], b.doc[at][order]
        same = (w[1:] == w[:-1]) & (d[1:] == d[:-1])
        twice = at[order][np.concatenate([same, [False]]) | np.concatenate([[False], same])]
        np.add.at(repeated, twice, 1)
        np.add.at(repeated, np.minimum(twice + WINDOW, len(hashes)), -1)
    out["n_repeat_words"] = np.bincount(b.doc[np.flatnonzero(np.cumsum(repeated)[:-1] > 0)], minlength=b.n) if len(hashes) else np.zeros(b.n, np.int64)
    order = np.lexsort((hashes, b.doc))
    h, d = hashes[order], b.doc[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])]) if len(h) else np.zeros(0, bool)
    out["n_distinct_words"] = np.bincount(d[new], minlength=b.n)
    # lines with a word, exactly as they are
    raw, n_lines, dup = b.data.tobytes(), np.zeros(b.n, np.int64), np.zeros(b.n, np.int64)
    for i in range(b.n):
        lines = [x for x in raw[b.offsets[i] : b.offsets[i + 1]].split(b"\n") if x.strip()]
        n_lines[i], dup[i] = len(lines), len(lines) - len(set(lines))
    return out | {"n_lines": n_lines, "n_dup_lines": dup}


def statistics(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns and the counts of _STATS (long) for each whole text; a null text has none of anything."""
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), *(f"{s} long" for s in _STATS)])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_block_stats(b) for b in blocks(batch.column(len(keep)))]
            cols = [np.concatenate([p[s] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64) for s in _STATS]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *map(pa.array, cols)], [*keep, *_STATS])

    return docs.select(*keep, F.col(text_col).cast("binary").alias("_text")).mapInArrow(run, schema)


def _rule(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes over the statistics: -1 bad, 1 good, 0 abstains. A rule abstains where its evidence is thin. Every rule can
    vote bad on documents that the base rules of judge() leave open, which are those that the model learns from."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    symbols, mean = F.col("n_symbols") / words, F.col("word_chars") / words
    repeats, dups = F.col("n_repeat_words") / words, F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    variety, upper = F.col("n_distinct_words") / words, F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "symbols": _rule(symbols > 0.3, symbols < 0.1),
        "word_length": _rule((mean < 3.2) | (mean > 10), mean.between(3.8, 8.5)),
        "repeats": _rule(repeats > 0.15, repeats < 0.05),
        "dup_lines": _rule(dups > 0.3, (dups < 0.1) & (F.col("n_lines") >= 3)),
        "variety": _rule(variety < 0.2 * F.least(F.lit(1.0), F.lit(400) / words), (variety > 0.35) & (words >= 30)),
        "capitals": _rule(upper > 0.4, upper < 0.15),
        "digits": _rule(F.col("n_digits") > 0.3 * F.col("word_chars"), F.col("n_digits") < 0.1 * F.col("word_chars")),
        "letters": _rule(F.col("n_signs") > 0.25 * F.col("word_chars"), F.col("n_signs") < 0.12 * F.col("word_chars")),
        "odd_words": _rule(F.col("n_odd_words") > 0.4 * words, F.col("n_odd_words") < 0.1 * words),
        "sign_runs": _rule(F.col("n_in_runs") > 0.1 * F.col("word_chars"), F.col("n_in_runs") < 0.02 * F.col("word_chars")),
    }


#: Beliefs before any vote, each worth so many votes: shares of bad votes on bad and on good documents, share of good ones.
WEIGHT, BAD_ON_BAD, BAD_ON_GOOD, GOOD = 20.0, 0.4, 0.05, 0.9


@dataclass
class Fit:
    """Posterior probability of good for each pattern; each rule's share of bad votes on bad and on good documents; the
    share of good documents; and the objective, the log likelihood and the log of the beliefs, round by round."""

    posterior: np.ndarray
    bad_on_bad: np.ndarray
    bad_on_good: np.ndarray
    good: float
    objective: list[float]


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500) -> Fit:
    """Expectation-maximisation for two classes and rules that vote independently within a class.

    patterns: rows of -1 (bad), 0 and 1 (good), counts: documents of each. A rule's vote depends on the class, whether it
    abstains does not. Beliefs enter as Beta priors of a fixed weight, so votes outweigh them as they grow. The first
    round takes documents with a bad vote for bad. Without documents every posterior is the prior share.
    """
    bad, cast = (patterns == -1).astype(float), (patterns != 0).astype(float)
    post, objective = np.where(bad.any(1), 1 - GOOD, GOOD), []
    for _ in range(rounds):
        good = ((counts @ post) + WEIGHT * GOOD) / (counts.sum() + WEIGHT)
        on_bad, on_good = (((counts * w) @ bad + WEIGHT * belief) / ((counts * w) @ cast + WEIGHT) for w, belief in ((1 - post, BAD_ON_BAD), (post, BAD_ON_GOOD)))
        vote = lambda share: bad @ np.log(share) + (cast - bad) @ np.log1p(-share)
        for_bad, for_good = np.log1p(-good) + vote(on_bad), np.log(good) + vote(on_good)
        either = np.logaddexp(for_bad, for_good)
        told = lambda share, belief: WEIGHT * np.sum(belief * np.log(share) + (1 - belief) * np.log1p(-share))
        objective.append(float(counts @ either + told(good, GOOD) + told(on_bad, BAD_ON_BAD) + told(on_good, BAD_ON_GOOD)))
        new = np.exp(for_good - either)
        if len(new) == 0 or np.abs(new - post).max() < 1e-9:
            break
        post = new
    return Fit(new, on_bad, on_good, float(good), objective)


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """A row per document: doc_id, the statistics, base_failed, quality (posterior of good), kept.

    Columns other than doc_id and text are not looked at. base_failed: fewer than 20 words, or over 30% of the words in repeated 8-word windows. kept: false if base_failed,
    else whether the posterior is `threshold` or more. Null and empty texts fail; very long texts are counted whole, a
    block of their own; repeated rows are judged alike; an empty table gives an empty result. EM sees the counts of vote
    patterns of all documents that base_failed leaves open.
    """
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    stats = stored(statistics(docs).withColumn("base_failed", base), "quality-stats")
    names = list(rules())
    voted = stats.withColumns({f"_v{i}": r for i, r in enumerate(rules().values())})
    code = sum(((F.col(f"_v{i}") + 1) * 3**i for i in range(len(names))), F.lit(0))
    voted = voted.withColumn("_code", code)
    seen = voted.groupBy("_code").agg(F.count_if(~F.col("base_failed")).alias("count")).orderBy("_code").toArrow()  # at most 3 ** 10 rows
    codes = seen.column("_code").to_numpy().astype(np.int64)
    patterns = np.stack([codes // 3**i % 3 - 1 for i in range(len(names))], 1)
    post = fit(patterns, seen.column("count").to_numpy().astype(float)).posterior
    table = docs.sparkSession.createDataFrame([(int(c), float(p)) for c, p in zip(codes, post, strict=True)], "_code int, quality double")
    out = voted.join(F.broadcast(table), "_code", "left")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality", (~F.col("base_failed") & (F.col("quality") >= threshold)).alias("kept"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's row per document, as judge() gives it, and its posterior."""
    return judge(docs)
