"""Runs of pages: consecutive pages of a file that agree in something (an extension)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rewrite import repair_digital
from ..functions.script import is_font_encoded, text_of
from .pages import PAGE_END


def with_runs(pages: DataFrame, same: Column, doc: str = "doc_id", page: str = "page_num", out: str = "run") -> DataFrame:
    """pages with the number of the run, from 1, of pages that follow each other without a gap and agree in `same`, which may
    be null.

    A file's pages are numbered in one pass over them in order; files are dealt to tasks, a file is not."""
    place = Window.partitionBy(doc).orderBy(page)
    rows = pages.withColumn("_same", same)
    new = ~(F.lag("_same").over(place).eqNullSafe(F.col("_same"))) | (F.col(page) - F.lag(page).over(place) > 1) | F.lag(page).over(place).isNull()
    rows = rows.withColumn("_new", new.cast("int"))
    return rows.withColumn(out, F.sum("_new").over(place.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_same", "_new")


def font_runs(pages: DataFrame, doc: str = "doc_id", page: str = "page_num", text: str = "page_text") -> DataFrame:
    """Rows (doc, run, first_page, last_page, font_encoded, text): runs of pages that are meant for a legacy font or aren't,
    each with its pages' texts in order."""
    encoded = is_font_encoded(text)
    rows = with_runs(pages.withColumn("_encoded", encoded), F.col("_encoded"), doc, page, "_run")
    row = F.struct(F.col(page).alias("n"), text_of(text).alias("t"))
    joined = F.aggregate(F.array_sort(F.collect_list(row)), F.lit(""), lambda a, p: F.concat(a, p["t"], F.lit(PAGE_END)))
    return rows.groupBy(doc, F.col("_run").alias("run")).agg(F.min(page).alias("first_page"), F.max(page).alias("last_page"), F.bool_or("_encoded").alias("font_encoded"), joined.alias("text"))


def repaired_runs(pages: DataFrame, doc: str = "doc_id", page: str = "page_num", text: str = "page_text") -> DataFrame:
    """font_runs() with each run's text repaired as one, by the dictionary where the run is font-encoded: what a single short
    page doesn't show of its font, its neighbours do."""
    return font_runs(pages, doc, page, text).withColumn("text", repair_digital("text", F.col("font_encoded")))
