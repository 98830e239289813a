"""Pages of document files as a PySpark data source, through a reader that the caller brings.

    spark.dataSource.register(page_source(make_reader))
    spark.read.format("document_pages").load(folder).filter("sampled AND needed")

A row is a page as one of three extractors sees it. Filters on path, page_index, sampled, extractor and needed go down to
the source: files are left out when the read is planned, and pages and extractors that aren't asked for are never
extracted. `sampled` marks the few pages from which a file is judged, `needed` whether the extractors before found too
little there, so the filter above reads a file as lazily as a loop over it would.

Spark keeps with a loaded table what was pushed down to it last, so load() it once for each query.

Partitions are planned from the files' lengths alone: small files go together, and a large one is dealt by ranges of its
pages, unless only sampled pages are asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import BinaryIO, Protocol

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.types import StructType

from ..functions.names import MOST_BYTES
from ..operators.quality import sample_indices

SCHEMA = "path string, total_pages int, encrypted boolean, creator string, producer string, fallback boolean, page_index int, sampled boolean, extractor int, needed boolean, page_text string, page_error string, error string"
EXTRACTORS = (1, 2, 3)
#: The second extractor is asked while there are fewer characters than this, the third likewise.
ENOUGH = {2: 100, 3: 50}
BATCH_BYTES = 4 << 20


class Document(Protocol):
    """An open file. `fallback` says that only the second-best library could open it, which knows no metadata."""

    total_pages: int
    encrypted: bool
    creator: str | None
    producer: str | None
    fallback: bool

    def text(self, extractor: int, page: int) -> str | None: ...


Reader = Callable[[BinaryIO], Document]


class _Pages:
    """What has been extracted from an open document. Of the sampled pages, those after a failed one have no text."""

    def __init__(self, document: Document):
        self.document, self.held, self.errors = document, {}, {}
        self.sample = sample_indices(1 if document.fallback else document.total_pages)

    def text(self, extractor: int, page: int) -> str | None:
        for i in [*(i for i in self.sample if i < page), page] if page in self.sample else [page]:
            if (extractor, i) not in self.held:
                failed = i in self.sample and any((extractor, j) in self.errors for j in self.sample if j < i)
                try:
                    self.held[extractor, i] = None if failed else self.document.text(extractor, i)
                except Exception as e:
                    self.held[extractor, i], self.errors[extractor, i] = None, f"{type(e).__name__}: {e}"
        return self.held[extractor, page]

    def sampled(self, extractor: int) -> str:
        texts = [self.text(extractor, i) or "" for i in self.sample]
        return "".join(t + "\n\n" for t in texts if t.strip())

    def needed(self, extractor: int) -> bool:
        found = 0
        for e in EXTRACTORS:
            wanted = e == 1 or found < ENOUGH[e]
            if e == extractor:
                return wanted
            if wanted and (text := self.sampled(e)):
                found += len(text) + (e > 1)  # with the line feed before it
        return False


@dataclass
class _Part(InputPartition):
    """Files, each with which share of its pages."""

    files: list[tuple[str, int, int]]


_PUSHED = {
    "path": (EqualTo, In, StringStartsWith, IsNotNull),
    "page_index": (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, IsNotNull),
    "sampled": (EqualTo, IsNotNull),
    "extractor": (EqualTo, In, IsNotNull),
    "needed": (EqualTo, IsNotNull),
}


def _holds(f: Filter, value: object) -> bool:
    match f:
        case EqualTo():
            return value == f.value
        case In():
            return value in f.value
        case StringStartsWith():
            return value.startswith(f.value)
        case GreaterThan():
            return value > f.value
        case GreaterThanOrEqual():
            return value >= f.value
        case LessThan():
            return value < f.value
        case LessThanOrEqual():
            return value <= f.value
    return True


class PageReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType, make_reader: Callable[[], Reader]):
        self.path, self.columns, self.make_reader = options["path"], schema, make_reader
        self.suffix, self.most = options.get("suffix", ".pdf").lower(), int(options.get("max_bytes", MOST_BYTES))
        self.together, self.range = int(options.get("partition_bytes", 64 << 20)), int(options.get("range_bytes", 16 << 20))
        self.texts = options.get("texts", "true").lower() == "true"
        self.filters: list[tuple[str, Filter]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if len(getattr(f, "attribute", ())) == 1 and isinstance(f, _PUSHED.get(f.attribute[0], ())):
                self.filters.append((f.attribute[0], f))
            else:
                yield f

    def _wanted(self, column: str, value: object) -> bool:
        return all(_holds(f, value) for c, f in self.filters if c == column)

    def _asked(self, column: str) -> bool:
        """Whether the filters ask for rows with a true value only."""
        return not self._wanted(column, False)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs as pafs

        fs, base = pafs.FileSystem.from_uri(self.path)
        infos = [fs.get_file_info(base)]
        if infos[0].type == pafs.FileType.Directory:
            infos = fs.get_file_info(pafs.FileSelector(base, recursive=True))
        files = sorted((i.path, i.size) for i in infos if i.is_file and i.path.lower().endswith(self.suffix) and i.size <= self.most and self._wanted("path", i.path))
        parts, held = [_Part([])], 0
        for path, size in files:
            shares = 1 if self._asked("sampled") else max(1, -(-size // self.range))
            for share in range(shares):
                if parts[-1].files and held + size // shares > self.together:
                    parts.append(_Part([]))
                    held = 0
                parts[-1].files.append((path, share, shares))
                held += size // shares
        return parts

    def _rows(self, path: str, file: BinaryIO, reader: Reader, share: int, shares: int) -> Iterator[tuple]:
        # what stands for a whole file is a row like its first page's
        first = all(self._wanted(*x) for x in (("page_index", 0), ("sampled", True), ("extractor", 1), ("needed", True)))
        try:
            document = reader(file)
            pages = _Pages(document)
        except Exception as e:  # a bad file is a row, not a failed job
            if share == 0 and first:
                yield (path, 1, None, None, None, None, 0, True, 1, True, None, None, f"{e}")
            return
        n = document.total_pages
        told = (path, n, document.encrypted, document.creator, document.producer, document.fallback)
        if not self.texts:
            if share == 0 and first:
                yield (*told, 0, True, 1, True, None, None, None)
            return
        for page in pages.sample if self._asked("sampled") else range(n * share // shares, n * (share + 1) // shares):
            sampled = page in pages.sample
            if not (self._wanted("page_index", page) and self._wanted("sampled", sampled)):
                continue
            for extractor in EXTRACTORS:
                if self._wanted("extractor", extractor) and self._wanted("needed", needed := pages.needed(extractor)):
                    text = pages.text(extractor, page)
                    yield (*told, page, sampled, extractor, needed, text, pages.errors.get((extractor, page)), None)

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, reader = to_arrow_schema(self.columns), self.make_reader()
        rows, held = [], 0
        for path, share, shares in partition.files:
            fs, _ = pafs.FileSystem.from_uri(self.path)
            with fs.open_input_file(path) as file:
                for row in self._rows(path, file, reader, share, shares):
                    rows.append(row)
                    held += 200 + len(row[10] or "")
                    if held >= BATCH_BYTES:
                        yield _batch(rows, schema)
                        rows, held = [], 0
        if rows:
            yield _batch(rows, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def page_source(make_reader: Callable[[], Reader], format_name: str = "document_pages") -> type[DataSource]:
    """The data source of this reader, to be registered under the name. The reader is made once for a task. Options: path
    (a file or folder, by URI), suffix, max_bytes (larger files are left out), partition_bytes, range_bytes, texts
    (false: nothing is extracted, each file is one row)."""

    class PageSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return format_name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema: StructType) -> DataSourceReader:
            return PageReader(self.options, schema, make_reader)

    return PageSource


def register(spark: SparkSession, make_reader: Callable[[], Reader], format_name: str = "document_pages") -> None:
    """Makes the format known to the session and lets filters go down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(page_source(make_reader, format_name))
