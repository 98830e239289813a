"""Files of documents as rows, and texts and documents as files."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator
from html import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import MOST_BYTES

CONTENT_TYPES = "[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Default Extension="png" ContentType="image/png"/><Default Extension="jpeg" ContentType="image/jpeg"/><Default Extension="gif" ContentType="image/gif"/><Default Extension="bmp" ContentType="image/bmp"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/><Override PartName="/docProps/core.xml" ContentType="application/vnd.openxmlformats-package.core-properties+xml"/></Types>'
DOCUMENT_RELATIONS = "_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/><Relationship Id="r2" Type="http://schemas.openxmlformats.org/package/2006/relationships/metadata/core-properties" Target="docProps/core.xml"/></Relationships>'


def read_files(spark: SparkSession, path: str, pattern: str = "*.pdf", most_bytes: int = MOST_BYTES) -> DataFrame:
    """path, modificationTime, length and content of the files that match; larger ones are left out by their length,
    before their content is read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).filter(F.col("length") <= most_bytes)


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores, twice as many tasks as there are, or as many as the files have parts. Most parts of a file
    with few row groups are empty, so it is dealt out whatever the number of its parts."""
    return df.repartition(max(2 * df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()))


def write_texts(docs: DataFrame, path: str, text: str = "text") -> None:
    """A text for each row, in files of many rows."""
    docs.select(F.coalesce(F.col(text), F.lit("")).alias("value")).write.text(path, lineSep="\u001e")


def write_by_configuration(rows: DataFrame, path: str, config: str = "config", text: str = "text") -> None:
    """Texts in a folder for each configuration."""
    rows.select(F.col(config).alias("config"), F.coalesce(F.col(text), F.lit("")).alias("value")).write.partitionBy("config").text(path, lineSep="\u001e")


def _clean(text: str | None) -> str:
    return escape("".join(c for c in text or "" if c >= " " or c in "\t\n"))


def picture_info(content: bytes) -> tuple[str, int, int]:
    """What kind of picture it is, by the name that its file ends with, its width and its height, from its header. What is
    none of the known ones counts as a png of two by three."""
    if content[:8] == b"\x89PNG\r\n\x1a\n" and len(content) >= 24:
        return "png", *struct.unpack(">II", content[16:24])
    if content[:6] in (b"GIF87a", b"GIF89a") and len(content) >= 10:
        return "gif", *struct.unpack("<HH", content[6:10])
    if content[:2] == b"BM" and len(content) >= 26:
        width, height = struct.unpack("<ii", content[18:26])
        return "bmp", width, abs(height)
    at = 2
    while content[:2] == b"\xff\xd8" and at + 9 <= len(content) and content[at] == 0xFF:
        marker, size = content[at + 1], int.from_bytes(content[at + 2 : at + 4], "big")
        if marker == 0xFF:  # fill
            at += 1
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):  # a frame
            height, width = struct.unpack(">HH", content[at + 5 : at + 9])
            return "jpeg", width, height
        else:
            at += 2 + size
    return "png", 2, 3


def picture_xml(number: int, relation: str, width: int, height: int, inches: float) -> str:
    """A picture `inches` wide, in its own proportions."""
    side = int(inches * 914_400)
    tall = side * max(1, height) // max(1, width)
    return (
        f'<w:p><w:r><w:drawing><wp:inline xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"><wp:extent cx="{side}" cy="{tall}"/><wp:docPr id="{number}" name="{relation}"/>'
        '<a:graphic xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><a:graphicData uri="http://schemas.openxmlformats.org/drawingml/2006/picture"><pic:pic xmlns:pic="http://schemas.openxmlformats.org/drawingml/2006/picture">'
        f'<pic:nvPicPr><pic:cNvPr id="{number}" name="{relation}"/><pic:cNvPicPr/></pic:nvPicPr><pic:blipFill><a:blip xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" r:embed="{relation}"/><a:stretch><a:fillRect/></a:stretch></pic:blipFill>'
        f'<pic:spPr><a:xfrm><a:off x="0" y="0"/><a:ext cx="{side}" cy="{tall}"/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></pic:spPr></pic:pic></a:graphicData></a:graphic></wp:inline></w:drawing></w:r></w:p>'
    )


def block_xml(kind: str, text: str | None, font: str = "Noto Sans Kannada", points: int = 12, language: str = "kn-IN") -> str:
    """A block without a picture: heading, text, italic, bold or break."""
    if kind == "break":
        return '<w:p><w:r><w:br w:type="page"/></w:r></w:p>'
    place = '<w:pPr><w:pStyle w:val="Heading2"/><w:jc w:val="center"/></w:pPr>' if kind == "heading" else ""
    weight = {"bold": "<w:b/>", "italic": "<w:i/>"}.get(kind, "")
    style = f'<w:rPr><w:rFonts w:ascii="{font}" w:hAnsi="{font}" w:cs="{font}" w:eastAsia="{font}"/>{weight}<w:sz w:val="{2 * points}"/><w:lang w:val="{language}" w:bidi="{language}"/></w:rPr>'
    return f'<w:p>{place}<w:r>{style}<w:t xml:space="preserve">{_clean(text)}</w:t></w:r></w:p>'


def core_xml(title: str | None, author: str | None, language: str = "kn-IN") -> str:
    core = "".join(f"<{tag}>{_clean(v)}</{tag}>" for tag, v in (("dc:title", title), ("dc:creator", author), ("dc:language", language)) if v)
    return f'<?xml version="1.0" encoding="UTF-8"?><cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/">{core}</cp:coreProperties>'


def relations_xml(pictures: dict[str, str]) -> str:
    """The document's relations to its pictures' files, by name."""
    link = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/image"
    return '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="{k}" Type="{link}" Target="media/{v}"/>' for k, v in pictures.items()) + "</Relationships>"


def document_bytes(blocks: list[tuple[str, str | None, bytes | None]], title: str | None = None, author: str | None = None, font: str = "Noto Sans Kannada", points: int = 12, language: str = "kn-IN", inches: float = 4.0) -> bytes:
    """A word-processor document of blocks (kind, text, image): heading, text, italic, bold, image or break."""
    body, images = [], {}
    for kind, text, image in blocks:
        if kind != "image":
            body.append(block_xml(kind, text, font, points, language))
        elif image is not None:
            ending, width, height = picture_info(bytes(image))
            name = f"image{len(images) + 1}"
            images[name] = (f"{name}.{ending}", bytes(image))
            body.append(picture_xml(len(images), name, width, height, inches))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in CONTENT_TYPES, DOCUMENT_RELATIONS, ("docProps/core.xml", core_xml(title, author, language)):
            z.writestr(name, text)
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{"".join(body)}</w:body></w:document>')
        z.writestr("word/_rels/document.xml.rels", relations_xml({k: v for k, (v, _) in images.items()}))
        for name, image in images.values():
            z.writestr(f"word/media/{name}", image)
    return out.getvalue()


def docx_bytes(paragraphs: list[str | None], **options: object) -> bytes:
    """A word-processor document: a paragraph for each text, a page break for each None."""
    return document_bytes([("break", None, None) if p is None else ("text", p, None) for p in paragraphs], **options)


def as_docx(docs: DataFrame, id_col: str = "doc_id", paragraphs: str = "paragraphs") -> DataFrame:
    """Rows of the id and `content`, a word-processor document of its array of paragraphs; a null one is a page break."""
    blocks = F.transform(paragraphs, lambda p: F.struct(F.when(p.isNull(), "break").otherwise("text").alias("kind"), p.alias("text"), F.lit(None).cast("binary").alias("image")))
    return as_documents(docs.select(id_col, blocks.alias("blocks")), id_col)


def as_documents(docs: DataFrame, id_col: str = "doc_id", blocks: str = "blocks", title: str | None = None, author: str | None = None, inches: float = 4.0) -> DataFrame:
    """Rows of the id and `content`, a word-processor document of its array of blocks (see operators.pages). `title` and
    `author` name columns."""
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, content binary"
    told = [F.col(c).cast("string").alias(n) if c else F.lit(None).cast("string").alias(n) for c, n in ((title, "_title"), (author, "_author"))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = zip(b.pop("_b"), b.pop("_title"), b.pop("_author"), strict=True)
            b["content"] = [document_bytes([(x["kind"], x["text"], x["image"]) for x in ([] if blocks_ is None else blocks_)], t, a, inches=inches) for blocks_, t, a in rows]
            yield b

    return docs.select(id_col, F.col(blocks).alias("_b"), *told).mapInPandas(run, schema)
