"""Text quality, document types and page sampling as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import ANY, QUALITY_NOTES, SPACE, WORD
from ..functions.script import count_of, is_blank, is_script, runs_of, strip, text_of

MIN_QUALITY, SAMPLE_PAGES = 0.3, 5


def artifact_count(c: Column | str) -> Column:
    """Characters outside script and Latin, runs of five equal word characters, runs of 20 letters, and texts of signs only."""
    t = text_of(c)
    odd = count_of(t, f"^ಀ-೿ -~ -ÿ{SPACE}")
    runs = F.regexp_count(t, F.lit(rf"([{WORD}])\1{{4,}}"))
    signs = F.regexp_count(t, F.lit(f"^[^{WORD}{SPACE}]*$"))
    return odd + runs + signs + F.regexp_count(t, F.lit("[A-Za-z]{20,}"))


def _measures(t: Column) -> dict[str, Column]:
    return {"_length": F.length(strip(t)), "_words": runs_of(t, ANY[1:-1]), "_script": is_script(t), "_artifacts": artifact_count(t), "_blank": is_blank(t)}


def with_quality(docs: DataFrame, normal: Column | str, out: str = "quality") -> DataFrame:
    """docs with a struct of score, sample, languages and notes for a text in normal form (see functions.rewrite.normalize).

    What the score counts are columns of their own first, so that each is worked out once."""
    measured = docs.withColumn("_normal", text_of(normal)).withColumns(_measures(F.col("_normal")))
    return measured.withColumn(out, _quality(F.col("_normal"))).drop("_normal", *_measures(F.col("_normal")))


def _quality(t: Column) -> Column:
    n, words, script, blank = F.col("_length"), F.col("_words"), F.col("_script"), F.col("_blank")
    ratio = F.col("_artifacts").cast("double") / F.greatest(n, F.lit(1))
    part = lambda test, v: F.when(test, F.lit(v)).otherwise(0.0)
    score = F.least(part(script, 0.4) + part(n > 100, 0.2) + part(ratio < 0.1, 0.3) + part(words > 10, 0.1), F.lit(1.0))
    notes = F.array_compact(
        F.array(
            F.when(script, QUALITY_NOTES["script"]).otherwise(QUALITY_NOTES["no_script"]),
            F.when(n > 100, F.format_string(QUALITY_NOTES["length"], n)),
            F.when(ratio < 0.1, QUALITY_NOTES["few"]).otherwise(F.format_string(QUALITY_NOTES["many"], ratio)),
            F.when(words > 10, F.format_string(QUALITY_NOTES["words"], words)),
        )
    )
    none = F.array().cast("array<string>")
    return F.struct(
        F.when(blank, 0.0).otherwise(score).alias("score"),
        F.when(blank, "").otherwise(F.substring(t, 1, 500)).alias("sample"),
        F.when(~blank & script, F.array(F.lit("kannada"))).otherwise(none).alias("languages"),
        F.when(blank, F.array(F.lit(QUALITY_NOTES["none"]))).otherwise(notes).alias("notes"),
    )


def document_type(has_text: Column, score: Column, in_script: Column, pages_with_text: Column, total_pages: Column) -> Column:
    """struct of type, needs_ocr and confidence, by a decision tree."""
    leaf = lambda kind, ocr, sure: F.struct(F.lit(kind).alias("type"), F.lit(ocr).alias("needs_ocr"), (sure if isinstance(sure, Column) else F.lit(sure)).alias("confidence"))
    sparse = pages_with_text.cast("double") / F.greatest(total_pages, F.lit(1)) < 0.3
    return (
        F.when(~has_text, leaf("scanned", True, 0.9))
        .when((score >= MIN_QUALITY) & in_script, leaf("digital", False, score))
        .when(score >= MIN_QUALITY, leaf("hybrid", True, 0.6))
        .when(sparse, leaf("scanned", True, 0.8))
        .otherwise(leaf("hybrid", True, 0.7))
    )


def sample_indices(total: int, most: int = SAMPLE_PAGES) -> list[int]:
    """What sample_pages() says, for a task that has a file open."""
    if total <= most:
        return list(range(total))
    picks = [0, total - 1, total // 2][:most]
    left = most - len(picks)
    return sorted({*picks, *(total // (left + 1) * i for i in range(1, left + 1))})


def sample_pages(total: Column, most: int = SAMPLE_PAGES) -> Column:
    """Sorted indices of at most `most` pages: all, or the first, last and middle ones and some at even steps between."""
    picks = [F.lit(0), total - 1, F.floor(total / 2)][:most]
    if (left := most - len(picks)) > 0:
        step = F.floor(total / (left + 1))
        picks += [step * i for i in range(1, left + 1)]
    some = F.array_sort(F.array_distinct(F.array(*[p.cast("int") for p in picks])))
    every = F.when(total > 0, F.sequence(F.lit(0), (total - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.when(total <= most, every).otherwise(some)
