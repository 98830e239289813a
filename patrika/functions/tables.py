"""Table functions for SQL: paragraphs of documents, images under configurations, images of files.

    SELECT * FROM page_paragraphs(TABLE(pages) PARTITION BY doc_id ORDER BY page_num)

An extension: each gives the rows of a DataFrame form, which is the one to prefer in DataFrames. What `analyze` returns
follows from the argument's columns, so a wrong column is told when the query is planned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..operators.pages import PAGE_END, paragraphs
from ..sources.adapters import IMAGES, ImageReader, configured_text, image_rows


def _columns(table: AnalyzeArgument, *wanted: str) -> StructType:
    """The types of these columns of a table argument."""
    if not table.isTable:
        raise ValueError("the first argument has to be TABLE(...)")
    missing = [c for c in wanted if c not in table.dataType.names]
    if missing:
        raise ValueError(f"the table has no column {', '.join(missing)}; it has {', '.join(table.dataType.names)}")
    out = StructType()
    for c in wanted:
        out = out.add(table.dataType[c])
    return out


class PageParagraphs:
    """Nonblank paragraphs of pages (doc_id, page_num, page_text): doc_id, page_num, number (of the paragraph in its
    document, from 1) and paragraph. Give it TABLE(...) PARTITION BY doc_id ORDER BY page_num: it counts as rows come."""

    def __init__(self) -> None:
        self.number = 0

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        _columns(table, "page_text")
        return AnalyzeResult(_columns(table, "doc_id", "page_num").add("number", LongType()).add("paragraph", StringType()))

    def eval(self, row: Row) -> Iterator[tuple]:
        for part in (row["page_text"] or "").split(PAGE_END):
            if text := part.strip():
                self.number += 1
                yield row["doc_id"], row["page_num"], self.number, text


def page_paragraphs(pages: DataFrame) -> DataFrame:
    """The same as a DataFrame: of pages with equal numbers the order is that of their texts."""
    place = Window.partitionBy("doc_id").orderBy("page_num", "page_text", "_at")
    rows = pages.select("doc_id", "page_num", "page_text", F.posexplode(paragraphs(F.col("page_text"))).alias("_at", "paragraph"))
    return rows.select("doc_id", "page_num", F.row_number().over(place).cast("long").alias("number"), "paragraph")


def configurations_function(make_recogniser: Callable[[], Callable[[bytes, str], str]]) -> type:
    """A table function of images (path, page_num, image) and the names of configurations: path, page_num, config, text, an
    error being the text of its row; as sources.adapters.compare_configurations has them."""

    class ImageConfigurations:
        def __init__(self) -> None:
            self.recognise = make_recogniser()

        @staticmethod
        def analyze(table: AnalyzeArgument, *options: AnalyzeArgument) -> AnalyzeResult:
            if not options or not all(isinstance(o.value, str) for o in options):
                raise ValueError("name one configuration at least, as constant text")
            _columns(table, "image")
            return AnalyzeResult(_columns(table, "path", "page_num").add("config", StringType()).add("text", StringType()))

        def eval(self, row: Row, *options: str) -> Iterator[tuple]:
            for i, option in enumerate(options):
                yield row["path"], row["page_num"], f"config_{i}", configured_text(self.recognise, row["image"], option)

    return ImageConfigurations


def images_function(make_reader: Callable[[], ImageReader]) -> type:
    """A table function of files (path, content): a row for each image, as sources.adapters.read_images has them."""

    schema = StructType.fromDDL(IMAGES)  # here, as tasks have no session to read it with

    class FileImages:
        def __init__(self) -> None:
            self.reader = make_reader()

        @staticmethod
        def analyze(table: AnalyzeArgument) -> AnalyzeResult:
            _columns(table, "path", "content")
            return AnalyzeResult(schema)

        def eval(self, row: Row) -> Iterator[tuple]:
            yield from image_rows(self.reader, row["path"], bytes(row["content"]))

    return FileImages


def register(spark: SparkSession, make_recogniser: Callable[[], Callable[[bytes, str], str]] | None = None, make_reader: Callable[[], ImageReader] | None = None) -> None:
    """Makes page_paragraphs known to the session's SQL, and image_configurations and file_images where their engine is
    given."""
    spark.udtf.register("page_paragraphs", F.udtf(PageParagraphs))
    if make_recogniser:
        spark.udtf.register("image_configurations", F.udtf(configurations_function(make_recogniser)))
    if make_reader:
        spark.udtf.register("file_images", F.udtf(images_function(make_reader)))
