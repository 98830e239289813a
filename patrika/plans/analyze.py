"""Analysis of documents: which are digital, scanned or hybrid, and how good their text is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import FAILURE_NOTES, FALLBACK, FORCED_NOTE
from ..functions.rewrite import normalize
from ..functions.script import is_blank
from ..operators.pages import PAGE_END, cascade, file_notes
from ..operators.quality import document_type, sample_pages, with_quality


def analyze(docs: DataFrame, text: str = "text", total_pages: Column | None = None, pages_with_text: Column | None = None, notes: Column | None = None, forced: Column | None = None, error: Column | None = None) -> DataFrame:
    """docs with an `analysis` struct. `forced` rows get the record of forced recognition instead, others whose `error` is
    not null that of a failed analysis."""
    total = F.coalesce(total_pages, F.lit(1)) if total_pages is not None else F.lit(1)
    layer = ~is_blank(text)
    found = pages_with_text if pages_with_text is not None else layer.cast("int")
    rows = with_quality(docs, normalize(text), "_q").withColumn("_layer", layer)
    kind = document_type(F.col("_layer"), F.col("_q.score"), F.size("_q.languages") > 0, found, total)
    rows = rows.withColumn("_k", kind)
    none = F.array().cast("array<string>")
    force = F.coalesce(forced, F.lit(False)) if forced is not None else F.lit(False)
    failed = error if error is not None else F.lit(None).cast("string")
    failure = F.array(F.format_string(FAILURE_NOTES[0], failed), F.lit(FAILURE_NOTES[1]))
    pick = lambda fixed, own, broken=None: F.when(force, fixed).when(failed.isNotNull(), fixed if broken is None else broken).otherwise(own)
    analysis = F.struct(
        pick(F.lit("forced_ocr"), F.col("_k.type"), F.lit("unknown")).alias("pdf_type"),
        pick(F.lit(False), F.col("_layer")).alias("has_text_layer"),
        pick(F.lit(0.0), F.col("_q.score")).alias("text_quality_score"),
        pick(total, total, F.lit(1)).cast("int").alias("total_pages"),
        pick(F.lit(0), found.cast("int")).alias("pages_with_text"),
        pick(F.lit(""), F.substring("_q.sample", 1, 200)).alias("sample_text"),
        pick(none, F.col("_q.languages")).alias("detected_languages"),
        pick(F.lit(True), F.col("_k.needs_ocr")).alias("needs_ocr"),
        pick(F.lit(1.0), F.col("_k.confidence"), F.lit(0.5)).alias("confidence"),
        pick(F.array(F.lit(FORCED_NOTE)), F.concat(notes if notes is not None else none, F.col("_q.notes")), failure).alias("analysis_notes"),
    )
    return rows.withColumn("analysis", analysis).drop("_q", "_k", "_layer")


def analyze_pages(pages: DataFrame, doc: str = "path", forced: Column | None = None) -> DataFrame:
    """A row (doc, analysis) for each document, from rows as sources.pagesource gives them: total_pages, encrypted, creator,
    producer, fallback, page_index, extractor, page_text, error.

    Only the sampled pages count, whether the rows hold others or not. Each extractor's nonblank pages are joined in order,
    and the second and third are added where the ones before found little; rows that a lazy read left out are not missed.
    Notes come in order: the file's, the extractors', the text's. A document with an error gets the record of a failed
    analysis, a `forced` one (a column of the rows) that of forced recognition. Null texts are blank; a null id is one
    document. Of a document a few pages meet in one task, however many it has."""
    fallback = F.coalesce("fallback", F.lit(False))
    sample = sample_pages(F.when(fallback, 1).otherwise(F.col("total_pages")))
    rows = pages.withColumn("_forced", forced if forced is not None else F.lit(False))
    rows = rows.filter(F.array_contains(sample, F.col("page_index")) | F.col("error").isNotNull())
    found = [F.collect_list(F.when((F.col("extractor") == e) & ~is_blank("page_text"), F.struct("page_index", "page_text"))) for e in (1, 2, 3)]
    docs = rows.groupBy(doc).agg(
        F.max("total_pages").alias("_total"), F.bool_or("encrypted").alias("_encrypted"), F.max("creator").alias("_creator"), F.max("producer").alias("_producer"),
        F.bool_or(fallback).alias("_fallback"), F.max("error").alias("_error"), F.bool_or("_forced").alias("_forced"), *[c.alias(f"_t{e}") for e, c in enumerate(found, 1)],
    )
    joined = [F.aggregate(F.array_sort(f"_t{e}"), F.lit(""), lambda a, p: F.concat(a, p["page_text"], F.lit(PAGE_END))) for e in (1, 2, 3)]
    docs = docs.withColumn("_c", cascade(*joined, tuple(F.size(f"_t{e}") for e in (1, 2, 3))))
    own = F.when(F.col("_fallback"), F.array(F.lit(FALLBACK))).otherwise(file_notes(F.col("_encrypted"), F.col("_creator"), F.col("_producer")))
    docs = docs.select(doc, "_total", "_error", "_forced", F.col("_c.text").alias("_text"), F.col("_c.pages_with_text").alias("_found"), F.concat(own, "_c.notes").alias("_notes"))
    return analyze(docs, "_text", F.col("_total"), F.col("_found"), F.col("_notes"), F.col("_forced"), F.col("_error")).select(doc, "analysis")


def analyze_files(spark: SparkSession, path: str, format_name: str = "document_pages", forced: bool = False, **options: str) -> DataFrame:
    """A row (path, analysis) for each file, through the registered page source: five pages of it are extracted at most, by
    the second and third extractor only where they are needed, and none where recognition is `forced`."""
    pages = spark.read.format(format_name).options(**options | ({"texts": "false"} if forced else {})).load(path)
    return analyze_pages(pages.filter("sampled AND needed"), forced=F.lit(forced))
