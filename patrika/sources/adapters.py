"""Pages out of document files, through engines that the caller brings.

No PDF, raster or recognition library belongs to this package. An engine is a function that a task calls: readers give
a file's pages, recognisers an image's text. Their failures become a row's `error`, never a failed task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import ANY_CHARACTER, CONFIGURATIONS, OTHER_LAYOUTS, OTHER_SECONDS, SCRIPT_ONLY

PAGES = "path string, page_num int, page_text string, image binary, error string"
Reader = Callable[[bytes], Sequence[tuple[str | None, bytes | None]]]
Recogniser = Callable[[bytes, float], str]
IMAGES = "path string, page_number int, width int, height int, source string, image binary, error string"
#: Of a page: its render, and the images in it, each as width, height and content; one that fails raises.
ImageReader = Callable[[bytes], Sequence[tuple[tuple[int, int, bytes], Sequence[Callable[[], tuple[int, int, bytes]]]]]]


def read_pages(files: DataFrame, make_reader: Callable[[], Reader]) -> DataFrame:
    """A row per page of `files` (path, content): number from 1, text and image as the reader gives them. A file that
    cannot be read is one row with page_num 0 and its error. The reader is made once for a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = make_reader()
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    rows += [(path, n, text, image, None) for n, (text, image) in enumerate(reader(bytes(content)), 1)]
                except Exception as e:  # a bad file is a row, not a failed job
                    rows.append((path, 0, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "page_num", "page_text", "image", "error"])

    return files.select("path", "content").mapInPandas(run, PAGES)


def first_text(image: bytes, engines: Sequence[tuple[Recogniser, float]]) -> tuple[str, str | None]:
    """The first nonblank text that engines, each with its time limit, give for an image, and the last error if none does."""
    error = None
    for recognise, limit in engines:
        try:
            if (text := recognise(image, limit) or "").strip():
                return text, None
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
    return "", error


def recognise_pages(pages: DataFrame, make_engines: Callable[[], Sequence[tuple[Recogniser, float]]], prepare: Callable[[bytes], bytes] | None = None) -> DataFrame:
    """Pages with the text of their images: engines in turn until one gives a nonblank text. `prepare` works on the image
    before; where it fails the image goes on as it is. Filter the pages first: every row given here is recognised."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engines = make_engines()
        for b in batches:
            texts, errors = [], []
            for image in b["image"]:
                if image is None:
                    texts.append("")
                    errors.append("no image")
                    continue
                raw = bytes(image)
                try:
                    ready = prepare(raw) if prepare else raw
                except Exception:
                    ready = raw
                text, error = first_text(ready, engines)
                texts.append(text)
                errors.append(error)
            b["page_text"], b["error"] = texts, errors
            yield b

    return pages.select("path", "page_num", "page_text", "image", "error").mapInPandas(run, PAGES)


#: An engine's run: image, language, options, seconds.
Run = Callable[[bytes, str, str, float], str]


def in_turn(run: Run, language: str = "kan", failure: type[Exception] = RuntimeError) -> Recogniser:
    """A recogniser that tries an engine's options in turn until a text is nonblank: the script's characters only; all, in
    half the time; then other page layouts, 15 seconds each. What the later ones raise is passed over. Of the first one, a
    `failure` that speaks of a timeout becomes a TimeoutError, which recognise_within_limit() acts on, and any other error
    an empty text."""

    def recognise(image: bytes, seconds: float) -> str:
        try:
            text = run(image, language, SCRIPT_ONLY, seconds)
        except Exception as e:
            if isinstance(e, failure) and "timeout" in str(e).lower():
                raise TimeoutError(f"Tesseract OCR timed out after {seconds:g} seconds") from e
            return ""
        for options, limit in ((ANY_CHARACTER, seconds // 2), *((o, OTHER_SECONDS) for o in OTHER_LAYOUTS)):
            if text.strip():
                break
            try:
                text = run(image, language, options, limit)
            except Exception:
                continue
        return text

    return recognise


def simple(run: Run, languages: Callable[[], Sequence[str]]) -> Recogniser:
    """A recogniser without fallbacks: the script's language with English where the engine has it, else English alone."""
    try:
        language = "kan+eng" if "kan" in languages() else "eng"
    except Exception:
        language = "eng"

    def recognise(image: bytes, seconds: float) -> str:
        return run(image, language, CONFIGURATIONS[0], seconds)

    return recognise


def _told(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"


def recognise_within_limit(
    pages: DataFrame, make_costly: Callable[[], Recogniser] | None, make_plain: Callable[[], Recogniser], limit: int | None = 20, seconds: float = 60.0, prepare: Callable[[bytes], bytes] | None = None
) -> DataFrame:
    """Pages with the text of their images: by the costly recogniser for the first `limit` pages of a file (None: all),
    by the plain one for the rest. Where the costly one fails, the plain one has half the time; a blank text is a text.
    Where the costly one can't be made, the plain one takes all pages. What the plain one raises is the row's error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plain, costly = make_plain(), None
        if make_costly is not None:
            try:
                costly = make_costly()
            except Exception:  # no access to it: the plain one is there
                costly = None

        def text_of(image: bytes, number: int) -> str:
            if costly is None or (limit is not None and number > limit):
                return plain(image, seconds)
            try:
                return costly(image, seconds)
            except Exception:
                return plain(image, seconds // 2)

        for b in batches:
            texts, errors = [], []
            for image, number in zip(b["image"], b["page_num"], strict=True):
                text, error = "", "no image" if image is None else None
                if image is not None:
                    raw = bytes(image)
                    try:
                        raw = prepare(raw) if prepare else raw
                    except Exception:
                        raw = bytes(image)
                    try:
                        text = text_of(raw, int(number)) or ""
                    except Exception as e:
                        error = _told(e)
                texts.append(text)
                errors.append(error)
            b["page_text"], b["error"] = texts, errors
            yield b

    return pages.select("path", "page_num", "page_text", "image", "error").mapInPandas(run, PAGES)


def configured_text(recognise: Callable[[bytes, str], str], image: bytes, options: str) -> str:
    """The text of an image under these options, or the error that came instead."""
    try:
        return recognise(bytes(image), options)
    except Exception as e:
        return f"Error: {e}"


def compare_configurations(pages: DataFrame, make_recogniser: Callable[[], Callable[[bytes, str], str]], configurations: Sequence[str] = tuple(CONFIGURATIONS)) -> DataFrame:
    """A row (path, page_num, config, text) for each page's image under each configuration, named config_0 and so on; an
    error is the text of its row. files.write_by_configuration writes them."""
    rows = pages.select("path", "page_num", "image", F.posexplode(F.array(*[F.lit(c) for c in configurations])).alias("_pos", "_options"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        recognise = make_recogniser()
        for b in batches:
            texts = []
            texts += [configured_text(recognise, image, options) for image, options in zip(b["image"], b["_options"], strict=True)]
            yield pd.DataFrame({"path": b["path"], "page_num": b["page_num"], "config": "config_" + b["_pos"].astype(str), "text": texts})

    return rows.mapInPandas(run, "path string, page_num int, config string, text string")


def image_rows(reader: Callable, path: str, content: bytes, pages: Sequence[int] | None = None) -> list[tuple]:
    """The rows of IMAGES of one file."""
    rows = []
    try:
        all_ = reader(content)
        for i in range(len(all_)) if pages is None else [i for i in pages if i < len(all_)]:
            render, inside = all_[i]
            rows.append((path, i + 1, *render[:2], "page_render", render[2], None))
            for k, one in enumerate(inside):
                try:
                    width, height, image = one()
                except Exception:
                    continue
                rows.append((path, i + 1, width, height, f"embedded_{k}", image, None))
    except Exception as e:
        rows = [(path, 0, None, None, None, None, _told(e))]
    return rows


def read_images(files: DataFrame, make_reader: Callable[[], ImageReader], pages: Sequence[int] | None = None) -> DataFrame:
    """Rows of the images of `files` (path, content): for each page (or those of the indices `pages`, from 0, that there
    are) its render with source 'page_render', then the images in it as 'embedded_0' and so on; one that fails is left
    out. A file that can't be read is a row with page_number 0 and its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = make_reader()
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                rows = image_rows(reader, path, bytes(content), pages)
                yield pd.DataFrame(rows, columns=["path", "page_number", "width", "height", "source", "image", "error"]).astype({"width": "Int32", "height": "Int32"})

    return files.select("path", "content").mapInPandas(run, IMAGES)


def first_done(first: DataFrame, second: DataFrame, id_col: str = "path") -> DataFrame:
    """Rows (id, content, error) of two ways to convert the same files: the second's where the first has no content, and
    an error only where neither has. Ids are unique in each and not null."""
    b = second.select(F.col(id_col).alias("_id"), F.col("content").alias("_content"), F.col("error").alias("_error"))
    done = F.coalesce("content", "_content")
    return first.join(b, F.col(id_col) == F.col("_id"), "left").select(id_col, done.alias("content"), F.when(done.isNull(), F.coalesce("_error", "error", F.lit("RuntimeError: PDF conversion failed"))).alias("error"))
