"""From page rows to finished texts: digital files, and recognised pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import DIGITAL_PLACEHOLDER, EMPTIED, FAILED, RECOGNISED_PLACEHOLDER
from ..functions.rewrite import normalize, repair_digital, repair_recognised
from ..functions.script import is_blank
from ..operators.pages import assemble, conversion_status, final_text, summary


def digital(pages: DataFrame, fonts: Column | None = None, error: Column | None = None, kinds: bool = False) -> DataFrame:
    """Pages (doc_id, page_num, page_text) to a row per document: text, total_pages, pages_with_text, status, and with
    `kinds` the `kind` of its paragraph: text, bold where there was none, italic where the repair left none.

    A document without text, one of whose text the repair leaves nothing, and one with an `error` on any page each get a
    text that says so. A null id is a document of its own."""
    told = (fonts if fonts is not None else F.lit(False), error if error is not None else F.lit(None).cast("string"))
    docs = assemble(pages.withColumns({"_fonts": told[0], "_error": told[1]}), more={"_fonts": F.bool_or("_fonts"), "_error": F.max("_error")})
    docs = docs.withColumn("_done", repair_digital("text", F.col("_fonts")))
    pick = lambda failed, none, emptied, done: F.when(F.col("_error").isNotNull(), failed).when(is_blank("text"), none).when(is_blank("_done"), emptied).otherwise(done)
    if kinds:
        docs = docs.withColumn("kind", pick(F.lit("text"), F.lit("bold"), F.lit("italic"), F.lit("text")))
    text = pick(F.concat(F.lit(FAILED), F.col("_error")), F.lit(DIGITAL_PLACEHOLDER), F.lit(EMPTIED), F.col("_done"))
    return docs.withColumn("text", text).withColumn("status", conversion_status(F.col("text"), False)).drop("_fonts", "_error", "_done")


def scanned(pages: DataFrame, debug: bool = False) -> DataFrame:
    """Recognised pages to a row per document: text, total_pages, successful pages, summary, status."""
    done = pages.withColumn("page_text", repair_recognised("page_text", debug))
    docs = assemble(done).withColumn("text", final_text(normalize("text"), RECOGNISED_PLACEHOLDER))
    docs = docs.withColumn("summary", summary(F.col("pages_with_text"), F.col("total_pages")))
    return docs.withColumn("status", conversion_status(F.col("text"), True))


def coalesced_pages(pages: DataFrame, primary: str, fallback: str) -> DataFrame:
    """page_text: the primary extraction, or the fallback where that is blank."""
    return pages.withColumn("page_text", F.when(is_blank(primary), F.coalesce(F.col(fallback), F.lit(""))).otherwise(F.col(primary)))


#: The name under which the conversion of scanned files is known as well.
convert_scanned = scanned
