"""Documents as files, streamed: a PySpark data source writer that never holds a document in a row.

    write_documents(recognised_rows(pages), folder)

A document comes as rows of blocks, its pictures before its text, sorted by document; the writer keeps one file open and
appends to it, so a document of any length costs no more memory than its largest picture. Names that end with .txt
become plain text, others word-processor files. Every attempt at a task writes into a folder of its own, and a commit
moves the folders of the attempts that count, one move for a task however many documents it has; what retried, lost or
stopped tasks have written goes with the job's temporary folder.
"""

from __future__ import annotations

import urllib.parse
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.constants import NO_TEXT, PAGE_FAILED, PAGE_HEADING, SUMMARY
from ..functions.script import is_blank
from ..operators.pages import paragraphs
from .files import CONTENT_TYPES, DOCUMENT_RELATIONS, block_xml, core_xml, picture_info, picture_xml, relations_xml

#: side 0: pictures (content), side 1: blocks in order of page and seq. A picture's block has the same page and seq.
ROWS = "file string, side int, page int, seq int, kind string, text string, title string, author string, content binary"
_BODY = '<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>'
_LAST = 2**31 - 1


class _WordFile:
    """A word-processor file, written as its rows come."""

    def __init__(self, out, row: dict, inches: float):
        self.inches, self.pictures, self.body, self.drawn = inches, {}, None, 0
        self.out, self.zip = out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
        for name, text in CONTENT_TYPES, DOCUMENT_RELATIONS, ("docProps/core.xml", core_xml(row["title"], row["author"])):
            self.zip.writestr(name, text)

    def add(self, row: dict) -> None:
        key = (row["page"], row["seq"])
        if row["side"] == 0:
            info = picture_info(row["content"])
            name = f"image{row['page']}_{row['seq']}.{info[0]}"
            if key not in self.pictures:  # of repeated pages the first one's
                self.zip.writestr(zipfile.ZipInfo(f"word/media/{name}"), row["content"])
                self.pictures[key] = (name, *info[1:])
            return
        if self.body is None:
            self._begin()
        if row["kind"] == "image":
            if key in self.pictures:
                name, width, height = self.pictures[key]
                self.drawn += 1
                self.body.write(picture_xml(self.drawn, name.partition(".")[0], width, height, self.inches).encode())
        else:
            self.body.write(block_xml(row["kind"], row["text"]).encode())

    def _begin(self) -> None:
        self.body = self.zip.open("word/document.xml", "w", force_zip64=True)
        self.body.write(_BODY.encode())

    def close(self) -> None:
        if self.body is None:
            self._begin()
        self.body.write(b"</w:body></w:document>")
        self.body.close()
        self.zip.writestr("word/_rels/document.xml.rels", relations_xml({name.partition(".")[0]: name for name, *_ in self.pictures.values()}))
        self.zip.close()
        self.out.close()


class _TextFile:
    """A text file: the texts of its rows, one after the other."""

    def __init__(self, out, row: dict, inches: float):
        self.out = out

    def add(self, row: dict) -> None:
        if row["side"] == 1:
            self.out.write((row["text"] or "").encode())

    def close(self) -> None:
        self.out.close()


@dataclass
class _Written(WriterCommitMessage):
    folder: str | None
    files: int


class DocumentWriter(DataSourceArrowWriter):
    """Rows of ROWS, sorted by file, side, page and seq, all rows of a file in one partition."""

    def __init__(self, options: dict, overwrite: bool):
        if overwrite:
            raise ValueError("the documents format appends only; write to a new path")
        self.path, self.inches, self.job = options["path"], float(options.get("inches", 4.0)), uuid.uuid4().hex

    def _place(self):
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(self.path)
        return files, base, f"{base}/_temporary-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, _, temporary = self._place()
        folder, current, now, many = f"part-{uuid.uuid4().hex}", None, None, 0
        try:
            for batch in iterator:
                names = batch.schema.names
                for i in range(batch.num_rows):
                    row = {c: batch.column(k)[i].as_py() for k, c in enumerate(names)}
                    if current is None or row["file"] != now:
                        if current is not None:
                            current.close()
                        else:
                            files.create_dir(f"{temporary}/{folder}", recursive=True)
                        now, many = row["file"], many + 1
                        out = files.open_output_stream(f"{temporary}/{folder}/{now}", compression=None)
                        current = (_TextFile if now.endswith(".txt") else _WordFile)(out, row, self.inches)
                    current.add(row)
        finally:
            if current is not None:
                current.close()
        return _Written(folder if many else None, many)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, base, temporary = self._place()
        files.create_dir(base, recursive=True)
        for m in messages:  # one for each task
            if m and m.folder:
                files.move(f"{temporary}/{m.folder}", f"{base}/{m.folder}")
        self._clear(files, temporary)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, _, temporary = self._place()
        self._clear(files, temporary)

    @staticmethod
    def _clear(files, temporary: str) -> None:
        from pyarrow import fs

        if files.get_file_info(temporary).type == fs.FileType.Directory:
            files.delete_dir(temporary)


class DocumentSink(DataSource):
    """Options: path (a folder, by URI), inches (width of pictures)."""

    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return ROWS

    def writer(self, schema: StructType, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DocumentSink)


def write_documents(rows: DataFrame, path: str, inches: float = 4.0, files: int | None = None) -> None:
    """Writes rows of ROWS; `files`: partitions to deal the documents to. Of equal rows each counts. A document's text goes
    through one task, as its file does; others are dealt to other tasks."""
    register(rows.sparkSession)
    dealt = rows.repartition(files, "file") if files else rows.repartition("file")
    order = ["file", "side", "page", "seq"]
    dealt.sortWithinPartitions(*order).write.format("documents").mode("append").option("inches", str(inches)).save(path)


# -- documents as rows ------------------------------------------------------------------------------------------------


def file_name(id_: Column, suffix: str) -> Column:
    """A name that no other id has, and that any file system takes: all but ASCII letters, digits, `-` and `_` in percent
    notation, `%` alone for null."""
    return F.concat(F.coalesce(F.replace(F.replace(F.replace(F.url_encode(id_.cast("string")), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("."), F.lit("%2E")), F.lit("%")), F.lit(suffix))


def id_of(name: str) -> str | None:
    """The id of a name that file_name() made."""
    stem = name.rpartition(".")[0]
    return None if stem == "%" else urllib.parse.unquote(stem)


def _rows(df: DataFrame, file: Column, page: Column, blocks: Column, pictures: Column | None, title: Column | None, author: Column | None) -> DataFrame:
    """ROWS of an array of blocks (kind, text) for each row of df, and of the picture that belongs to its blocks of kind
    image."""
    told = [file.alias("file"), page.cast("int").alias("page")]
    more = [(F.lit(None) if c is None else c).cast("string").alias(n) for c, n in ((title, "title"), (author, "author"))]
    body = df.select(*told, *more, F.posexplode(blocks).alias("seq", "_b")).select("file", F.lit(1).alias("side"), "page", "seq", "_b.kind", "_b.text", "title", "author", F.lit(None).cast("binary").alias("content"))
    if pictures is None:
        return body
    at = F.array_position(F.transform(blocks, lambda b: b["kind"]), F.lit("image")) - 1
    shown = df.filter(pictures.isNotNull()).select(*told, F.lit(0).alias("side"), at.cast("int").alias("seq"), F.lit("image").alias("kind"), F.lit(None).cast("string").alias("text"), *more, pictures.alias("content"))
    return body.unionByName(shown)


def _block(kind: str, text: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), (F.lit(None) if text is None else text).cast("string").alias("text"))


def _some(*parts: tuple[Column, Column]) -> Column:
    """The blocks whose condition holds."""
    return F.array_compact(F.array(*[F.when(test, block) for test, block in parts]))


def recognised_rows(pages: DataFrame, doc: str = "doc_id", page: str = "page_num", text: str = "page_text", image: str | None = None, error: str | None = None, suffix: str = ".docx") -> DataFrame:
    """Recognised and repaired pages as documents: for each page a heading, its picture and its text, or a line that says
    that there is none; for a page with an error a line with that; breaks between pages, and a summary at the end."""
    n, said, always = F.col(page), F.col(error) if error else F.lit(None).cast("string"), F.lit(True)
    fine, held = said.isNull(), ~is_blank(text)
    picture = F.when(fine, F.col(image)) if image else None
    blocks = _some(
        (n > 1, _block("break")), (~fine, _block("italic", F.format_string(PAGE_FAILED, n, said))), (fine, _block("heading", F.format_string(PAGE_HEADING, n))),
        (picture.isNotNull() if image else ~always, _block("image")), (fine & held, _block("text", F.col(text))), (fine & ~held, _block("italic", F.lit(NO_TEXT))),
    )
    file = file_name(F.col(doc), suffix)
    counts = pages.groupBy(file.alias("_file")).agg(F.count_if(fine & held).alias("_some"), F.count("*").alias("_all"))
    end = _rows(counts, F.col("_file"), F.lit(_LAST), F.array(_block("bold", F.format_string(SUMMARY, F.col("_some"), F.col("_all")))), None, None, None)
    return _rows(pages, file, n, blocks, picture, None, None).unionByName(end)


def simple_rows(pages: DataFrame, doc: str = "doc_id", page: str = "page_num", text: str = "page_text", suffix: str = ".docx") -> DataFrame:
    """Pages as documents of their nonblank paragraphs; a break before each page with text but the first."""
    parts = F.transform(paragraphs(F.col(text)), lambda p: F.struct(F.lit("text").alias("kind"), p.alias("text")))
    blocks = F.when((F.col(page) > 1) & (F.size(parts) > 0), F.concat(F.array(_block("break")), parts)).otherwise(parts)
    return _rows(pages, file_name(F.col(doc), suffix), F.col(page), blocks, None, None, None)


def image_rows(pages: DataFrame, doc: str = "doc_id", page: str = "page_num", image: str = "image", suffix: str = ".docx") -> DataFrame:
    """Pages as documents of their pictures, with breaks between pages. For pictures 6 inches wide."""
    return _rows(pages, file_name(F.col(doc), suffix), F.col(page), _some((F.col(page) > 1, _block("break")), (F.col(image).isNotNull(), _block("image"))), F.col(image), None, None)


def digital_rows(docs: DataFrame, doc: str = "doc_id", text: str = "text", kind: str = "kind", title: str | None = None, author: str | None = None, suffix: str = ".docx") -> DataFrame:
    """Finished texts of digital files (flows.digital with `kinds`) as documents of one paragraph, which is bold where there
    was no text and italic where the repair left none. `title` and `author` name columns."""
    one = F.array(F.struct(F.col(kind).alias("kind"), F.col(text).alias("text")))
    return _rows(docs, file_name(F.col(doc), suffix), F.lit(1), one, None, *(F.col(c) if c else None for c in (title, author)))


def text_rows(docs: DataFrame, doc: str = "doc_id", text: str = "text", suffix: str = ".txt") -> DataFrame:
    """Texts as files of their own."""
    return _rows(docs, file_name(F.col(doc), suffix), F.lit(1), F.array(_block("text", F.col(text))), None, None, None)
