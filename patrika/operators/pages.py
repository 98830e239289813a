"""Pages: order, assembly into documents, counts, breaks; extractors in turn; what a conversion says in the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import DIGITAL_PLACEHOLDER, ENCRYPTED, EXTRACTED, FONTS, NO_TEXT, PAGE_FAILED, PAGE_HEADING, PAGE_OF, SCANNED_BY, SCANNERS, SUMMARY
from ..functions.script import has_any, is_blank, is_font_encoded, is_script, strip, text_of

PAGE_END = "\n\n"


def assemble(pages: DataFrame, doc: str = "doc_id", page: str = "page_num", text: str = "page_text", more: dict[str, Column] | None = None) -> DataFrame:
    """A row per document: its nonblank pages in order, each with an empty line after it, and counts of pages.

    Pages with equal numbers come in order of their texts. Null texts are blank. `more` names further aggregates."""
    row = F.struct(F.col(page).alias("n"), text_of(text).alias("t"))
    some = F.filter(F.array_sort(F.collect_list(row)), lambda p: ~is_blank(p["t"]))
    return pages.groupBy(doc).agg(
        F.aggregate(some, F.lit(""), lambda a, p: F.concat(a, p["t"], F.lit(PAGE_END))).alias("text"),
        F.count("*").alias("total_pages"),
        F.count_if(~is_blank(text)).alias("pages_with_text"),
        *[c.alias(name) for name, c in (more or {}).items()],
    )


def numbered(pages: DataFrame, doc: str = "doc_id", pos: str = "pos", vision_pages: int = 20) -> DataFrame:
    """page_num from 1, whether a break follows (all but the last), and whether the page may go to the costly recogniser."""
    w = Window.partitionBy(doc)
    n = F.row_number().over(w.orderBy(pos))
    return pages.select("*", n.alias("page_num"), (n < F.count("*").over(w)).alias("page_break"), (n <= vision_pages).alias("within_limit"))


def final_text(normal: Column, placeholder: str = DIGITAL_PLACEHOLDER) -> Column:
    return F.when(is_blank(normal), placeholder).otherwise(normal)


def summary(successful: Column, total: Column) -> Column:
    return F.format_string("%d/%d", successful, total)


def paragraphs(text: Column) -> Column:
    """Nonblank parts between empty lines, stripped."""
    return F.filter(F.transform(F.split(text_of(text), PAGE_END), strip), lambda p: p != "")


def cascade(first: Column, second: Column, third: Column, pages: tuple[Column, Column, Column]) -> Column:
    """Three extractors' texts in turn: the second is added while there are under 100 characters, the third under 50.
    struct of text, has_text_layer, pages_with_text and notes."""
    texts = [text_of(first), text_of(second), text_of(third)]
    use = [~is_blank(texts[0])]
    acc = F.when(use[0], texts[0]).otherwise("")
    count = F.when(use[0], pages[0]).otherwise(0)
    for t, p, least in zip(texts[1:], pages[1:], (100, 50), strict=True):
        use.append((F.length(acc) < least) & ~is_blank(t))
        acc, count = F.when(use[-1], F.concat(acc, F.lit("\n"), t)).otherwise(acc), F.when(use[-1], F.greatest(count, p)).otherwise(count)
    notes = F.array_compact(
        F.array(
            F.when(use[0], F.format_string(EXTRACTED[0], F.length(texts[0]), pages[0])),
            F.when(use[1], F.format_string(EXTRACTED[1], F.length(texts[1]))),
            F.when(use[2], F.format_string(EXTRACTED[2], F.length(texts[2]))),
        )
    )
    return F.struct(acc.alias("text"), (use[0] | use[1] | use[2]).alias("has_text_layer"), count.alias("pages_with_text"), notes.alias("notes"))


def has_legacy_font(fonts: Column) -> Column:
    """Whether the name of any font in an array holds one of the known ones, without regard to case."""
    return F.coalesce(F.exists(fonts, lambda f: has_any(F.lower(f), [x.lower() for x in FONTS])), F.lit(False))


def file_notes(encrypted: Column, creator: Column, producer: Column) -> Column:
    c, p = F.lower(text_of(creator)), F.lower(text_of(producer))
    found = has_any(c, SCANNERS) | has_any(p, SCANNERS)
    named = F.concat(F.lit(SCANNED_BY), F.when(c != "", c).otherwise(p))
    return F.array_compact(F.array(F.when(encrypted, ENCRYPTED), F.when(found, named)))


def conversion_status(text: Column, scanned: bool) -> Column:
    """blank, legacy (digital files only), no_script or success: what is said about a finished conversion."""
    out = F.when(is_blank(text), "blank")
    if not scanned:
        out = out.when(is_font_encoded(text), "legacy")
    return out.when(~is_script(text), "no_script").otherwise("success")


BLOCK = "kind string, text string, image binary"


def page_header(page: Column, total: Column) -> Column:
    return F.format_string(PAGE_OF, page, total)


def _block(kind: str, text: Column, image: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), text.alias("text"), (F.lit(None) if image is None else image).cast("binary").alias("image"))


def _by_number(a: Column, b: Column) -> Column:
    return F.when(a["n"] < b["n"], -1).when(a["n"] > b["n"], 1).otherwise(0)


def _gathered(pages: DataFrame, doc: str, page: str, blocks: Column) -> DataFrame:
    """Arrays of blocks of a document's pages, one after the other in order of page numbers."""
    rows = pages.select(F.col(doc).alias(doc), F.struct(F.col(page).alias("n"), blocks.alias("b")).alias("_row"))
    return rows.groupBy(doc).agg(F.flatten(F.transform(F.array_sort(F.collect_list("_row"), _by_number), lambda r: r["b"])).alias("blocks"))


def recognised_blocks(pages: DataFrame, doc: str = "doc_id", page: str = "page_num", text: str = "page_text", image: str | None = None, error: str | None = None) -> DataFrame:
    """A row per document: `blocks` for files.as_documents, from its recognised and repaired pages.

    For each page a heading, its image if there is one, and its text or a line that says that there is none; for a page
    with an error one line with that. A break follows all but the last page, and a summary of pages with text the end."""
    ok, said = ~is_blank(text), F.col(error) if error else F.lit(None).cast("string")
    n, none = F.col(page), F.array().cast(f"array<struct<{BLOCK.replace(' string', ':string').replace(' binary', ':binary')}>>")
    shown = F.when(F.col(image).isNotNull(), F.array(_block("image", F.lit(None).cast("string"), F.col(image)))).otherwise(none) if image else none
    whole = F.concat(F.array(_block("heading", F.format_string(PAGE_HEADING, n))), shown, F.array(F.when(ok, _block("text", F.col(text))).otherwise(_block("italic", F.lit(NO_TEXT)))))
    failed = F.array(_block("italic", F.format_string(PAGE_FAILED, n, said)))
    row = F.struct(n.alias("n"), F.when(said.isNotNull(), failed).otherwise(whole).alias("b"))
    docs = pages.groupBy(doc).agg(F.array_sort(F.collect_list(row), _by_number).alias("_rows"), F.count_if(ok & said.isNull()).alias("_some"))
    all_, stop = F.size("_rows"), F.array(_block("break", F.lit(None).cast("string")))
    body = F.flatten(F.transform("_rows", lambda r: F.when(r["n"] < all_, F.concat(r["b"], stop)).otherwise(r["b"])))
    return docs.select(doc, F.concat(body, F.array(_block("bold", F.format_string(SUMMARY, F.col("_some"), all_)))).alias("blocks"))


def simple_blocks(pages: DataFrame, doc: str = "doc_id", page: str = "page_num", text: str = "page_text") -> DataFrame:
    """A row per document: `blocks` of the nonblank paragraphs of its pages; a break before each page with text but the first."""
    rows = F.transform(paragraphs(F.col(text)), lambda p: _block("text", p))
    broken = F.when((F.col(page) > 1) & ~is_blank(text), F.concat(F.array(_block("break", F.lit(None).cast("string"))), rows)).otherwise(rows)
    return _gathered(pages, doc, page, broken)


def image_blocks(pages: DataFrame, doc: str = "doc_id", page: str = "page_num", image: str = "image") -> DataFrame:
    """A row per document: `blocks` of its pages' images, with breaks between pages."""
    one = F.array(_block("image", F.lit(None).cast("string"), F.col(image)))
    return _gathered(pages, doc, page, F.when(F.col(page) > 1, F.concat(F.array(_block("break", F.lit(None).cast("string"))), one)).otherwise(one))
