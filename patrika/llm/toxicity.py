"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Folding lowers case, undoes homoglyphs, full-width forms and digit substitutions, and turns everything else that is not
a letter into one blank. The lexicon is learned: words and word beginnings whose document frequency among toxic rows
exceeds that among clean ones get their log ratio as weight. So are the exceptions: phrases of a lexicon word and one of
its neighbours that are more typical of clean rows. One automaton per task holds lexicon and exception phrases. A text's weight, as such and normalised by its length, goes through a logistic curve fitted on rows that the
lexicon has not seen.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import named, stored, tidy, with_measured

# Look-alikes of Latin letters, by letter.
LOOK_ALIKES = {
    "a": "аα4@", "b": "Ьв", "c": "сϲ", "d": "ԁ", "e": "еε3", "g": "ɡ", "h": "һ", "i": "іι1ı", "j": "ј", "k": "кκ", "l": "ӏ", "m": "м",
    "n": "ո", "o": "оο0", "p": "рρ", "s": "ѕ5$", "t": "т7τ", "u": "υ", "v": "ν", "w": "ѡ", "x": "хχ", "y": "уγ",
}
STEMS = (5, 6, 7)
#: Terms that a task counts before it hands the counts on.
MAX_FEATURES = 60_000
#: Texts whose measures make a partition of what the curve is fitted on, where there are so many.
CURVE_ROWS = 1 << 20


class _Folding(dict):
    """Code point to what it folds to, worked out when first met."""

    def __init__(self):
        super().__init__({ord(c): letter for letter, many in LOOK_ALIKES.items() for c in many})
        self.update(dict.fromkeys((0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF), ""))

    def __missing__(self, point: int) -> str:
        c = unicodedata.normalize("NFKC", chr(point)).lower()
        out = "".join(self.get(ord(x), x if x.isalpha() or unicodedata.category(x) == "Mn" else " ") for x in c)
        self[point] = out
        return out


def fold(text: str, folding: _Folding) -> str:
    """The words of the folded text, a blank before, between and after them."""
    text = text if text.isascii() else unicodedata.normalize("NFC", text)
    return f" {' '.join(text.translate(folding).split())} "


def features(folded: str) -> set[str]:
    """Each word as ' word ' and its beginnings of 5 to 7 letters as ' begin'."""
    words = set(folded.split())
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in STEMS if len(w) > n}


class Matcher:
    def __init__(self, lexicon: dict[str, float], exceptions: Sequence[str] = ()):
        self.folding, self.automaton = _Folding(), ahocorasick.Automaton()
        for term, weight in lexicon.items():
            self.automaton.add_word(term, (len(term), weight))
        for phrase in exceptions:
            term = fold(phrase, self.folding)
            self.automaton.add_word(term, (len(term), None))
        self.automaton.make_automaton()

    def hits(self, folded: str) -> tuple[dict[int, float], list[tuple[int, int]]]:
        """Where words with a match start, with the largest weight of each, and where exceptions start and end."""
        best, excepted = {}, []
        for end, (length, weight) in self.automaton.iter(folded) if len(self.automaton) else ():
            at = end - length + 1
            if weight is None:
                excepted.append((at, end))
            elif weight > best.get(at, 0):
                best[at] = weight
        return best, excepted

    def weigh(self, text: str | None) -> tuple[float, int, int]:
        """Sum over words of the largest weight that matches there, the number of such words, and of all words.
        Words inside an exception phrase do not count."""
        folded = fold(text or "", self.folding)
        best, excepted = self.hits(folded)
        for at, end in excepted:
            for k in range(at, end):
                best.pop(k, None)
        return sum(best.values()), len(best), folded.count(" ") - 1 if best or folded.strip() else 0

    def phrases(self, text: str | None) -> set[str]:
        """Each word with a match, with the word before and with the word after it."""
        folded, out = fold(text or "", self.folding), set()
        for at in self.hits(folded)[0]:
            end = folded.find(" ", at + 1)
            before, after = folded.rfind(" ", 0, at), folded.find(" ", end + 1)
            if at:
                out.add(folded[before + 1 : end])
            if after > 0:
                out.add(folded[at + 1 : after])
        return out


def _measures(total: float, hits: int, words: int) -> list[float]:
    return [math.log1p(total), math.log1p(100 * total / (words + 10)), math.log1p(hits)]


def remainder(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string").cast("binary")) % 5


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic and remainder of all labelled documents outside the held-out fifth. Labels that are null don't count; of
    several for an id the largest does. The join is a merge of sorted rows at every size: a broadcast of the labels would
    end where they get too many for it, and what is shuffled would then jump by all texts."""
    rows = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = rows.withColumn("rest", remainder()).filter("rest <> 0")
    return docs.select("doc_id", "text").join(rows.hint("merge"), "doc_id").select("text", "toxic", "rest")


def _counted(rows: DataFrame, make: Callable[[], Callable[[str | None], set[str]]]) -> tuple[DataFrame, int, int]:
    """Rows (term, clean, toxic): how many clean and toxic texts of `rows` have each term; and how many such texts there
    are. Terms are counted by text in each task and summed by Spark."""

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms_of, seen = make(), (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            terms = list(seen[0].keys() | seen[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([seen[0][t] for t in terms], pa.int64()), pa.array([seen[1][t] for t in terms], pa.int64())], ["term", "clean", "toxic"])
            seen[0].clear()
            seen[1].clear()
            return out

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1), strict=True):
                seen[1 if toxic.as_py() else 0].update(terms_of(text.as_py()))
                if len(seen[0]) + len(seen[1]) > MAX_FEATURES:
                    yield flush()
        yield flush()

    sizes = {bool(r["toxic"]): r["count"] for r in rows.groupBy("toxic").count().collect()}  # two rows
    terms = rows.select("text", "toxic").mapInArrow(count, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    return terms, sizes.get(False, 0), sizes.get(True, 0)


def learn_lexicon(rows: DataFrame, size: int = 2000, min_docs: int = 5, min_weight: float = 2.5) -> dict[str, float]:
    """The `size` heaviest terms of at least `min_docs` toxic documents; only these come to the driver. Ties by the term."""

    def terms_of() -> Callable[[str | None], set[str]]:
        folding = _Folding()
        return lambda text: features(fold(text or "", folding))

    terms, clean, toxic = _counted(rows, terms_of)
    if not toxic or not clean:
        return {}
    weight = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    heavy = terms.filter(F.col("toxic") >= min_docs).withColumn("weight", F.round(weight, 6)).filter(F.col("weight") >= min_weight)
    top = heavy.orderBy(F.desc(F.col("weight") * F.log1p("toxic")), "term").limit(size)
    return {r["term"]: float(r["weight"]) for r in top.collect()}


def learn_exceptions(rows: DataFrame, lexicon: dict[str, float], size: int = 1000, min_docs: int = 3, min_weight: float = 1.0) -> list[str]:
    """The `size` most frequent phrases of a lexicon word and a neighbour that at least `min_docs` clean documents have, and
    a larger share of them than of the toxic ones, by `min_weight` as a log ratio. Ties by the phrase."""
    phrases, clean, toxic = _counted(rows, lambda: Matcher(lexicon).phrases)
    weight = F.log((F.col("clean") + 0.5) / (clean + 1)) - F.log((F.col("toxic") + 0.5) / (toxic + 1))
    top = phrases.filter(F.col("clean") >= min_docs).filter(weight >= min_weight).orderBy(F.desc("clean"), "term").limit(size)
    return [r["term"] for r in top.collect()]


def fit_curve(rows: DataFrame, lexicon: dict[str, float], exceptions: Sequence[str] = ()) -> tuple[list[float], float]:
    """Coefficients and intercept of the logistic curve over the measures, by Spark's logistic regression. A text's measures
    are four numbers, so they go to as few partitions as the cores need: each step of the fit runs a task for each, and
    the driver keeps books of all tasks."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    @tidy
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon, exceptions)
        for batch in batches:
            x = [_measures(*matcher.weigh(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1).cast(pa.float64())], ["x", "label"])

    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // CURVE_ROWS))
    data = rows.select("text", "toxic").mapInArrow(measure, "x array<double>, label double").repartition(parts)
    data = data.select(array_to_vector("x").alias("features"), "label").cache()
    try:
        if data.select("label").distinct().count() < 2:
            return [0.0, 1.0, 0.0], -5.0
        model = LogisticRegression(regParam=1e-4, maxIter=50).fit(data)
        return [float(c) for c in model.coefficients], float(model.intercept)
    finally:
        data.unpersist()


def score(docs: DataFrame, labels: DataFrame, lexicon_size: int = 2000, out_col: str = "toxicity") -> DataFrame:
    """docs with the column `out_col` (0 to 1), which replaces one of that name. Learns from all labelled rows whose id's remainder is not
    0: the lexicon and its exceptions from remainders 1 to 3, the curve from 4. Scores every whole text, and from it
    alone; a null text scores like an empty one, repeated rows alike; of a very long text every word is looked at. Without labels of both kinds the lexicon is empty
    and scores are near 0."""
    rows = stored(training_rows(docs, labels), "toxicity-rows")
    learn, rest = rows.filter("rest < 4"), rows.filter("rest = 4")
    lexicon = learn_lexicon(learn, lexicon_size)
    exceptions = learn_exceptions(learn, lexicon) if lexicon else []
    slope, start = fit_curve(rest, lexicon, exceptions) if lexicon else ([0.0, 1.0, 0.0], -5.0)

    def measure(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = Matcher(lexicon, exceptions)
        for column in texts:
            z = [start + sum(a * b for a, b in zip(slope, _measures(*matcher.weigh(t.as_py())), strict=True)) for t in column]
            yield pa.array([1 / (1 + math.exp(-max(-500, min(500, v)))) for v in z], pa.float64())

    return with_measured(docs, F.col("text"), out_col, "double", measure)


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents whose toxicity is under the threshold, with their own columns. Null and empty texts score like
    each other and stay unless the curve says otherwise; repeated rows stay or go together."""
    return score(docs, labels, out_col="_toxicity_score").filter(F.col("_toxicity_score") < threshold).select(*map(named, docs.columns))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's row per document: doc_id, held_out (false for a null id), score, predicted."""
    s = score(docs.select("doc_id", "text"), labels)
    return s.select("doc_id", F.coalesce(remainder() == 0, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
