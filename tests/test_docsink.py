"""Documents streamed into files."""

import io
import re
import struct
import sys
import zipfile
from html import unescape
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from patrika.functions.constants import DIGITAL_PLACEHOLDER, EMPTIED
from patrika.operators import pages as pg
from patrika.plans import flows
from patrika.sources import docsink, files

PNG = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 300, 100) + b"rest"
GIF, BMP = b"GIF89a" + struct.pack("<HH", 40, 80) + b"x", b"BM" + bytes(16) + struct.pack("<ii", 7, -9) + b"x"
JPEG = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab" + b"\xff\xc2" + struct.pack(">HBHH", 11, 8, 50, 200) + b"x" * 9


def read(folder):
    """Name: kinds and texts of the blocks, and the names of the pictures, of each document."""
    out = {}
    for path in Path(folder).glob("part-*/*.docx"):
        assert path.name not in out
        z = zipfile.ZipFile(io.BytesIO(path.read_bytes()))
        assert z.testzip() is None
        xml, links = z.read("word/document.xml").decode(), z.read("word/_rels/document.xml.rels").decode()
        blocks = []
        for p in re.findall(r"<w:p>.*?</w:p>", xml, re.S):
            if "<w:drawing>" in p:
                name = re.search(f'Id="{re.search("r:embed=.(\\w+).", p)[1]}" [^>]*Target="media/([^"]+)"', links)[1]
                blocks.append(("image", (z.read(f"word/media/{name}"), name.rpartition(".")[2], *map(int, re.search(r'cx="(\d+)" cy="(\d+)"', p).groups()))))
            else:
                kind = "break" if "w:br " in p else "heading" if "Heading2" in p else "bold" if "<w:b/>" in p else "italic" if "<w:i/>" in p else "text"
                blocks.append((kind, unescape("".join(re.findall(r"preserve\">(.*?)</w:t>", p, re.S)))))
        out[path.name] = (blocks, z.read("docProps/core.xml").decode())
    return out


def pages_of(spark, n=7):
    rows = [(d, p, f"text {d} {p}" if (d + p) % 4 else " ", "torn" if p == 5 else None, [PNG, GIF, JPEG, None][(d + p) % 4]) for d in (1, 2, 30) for p in range(1, n + 1)]
    return spark.createDataFrame([*rows, (None, 1, "a < b", None, BMP)], "doc_id long, page_num int, page_text string, bad string, image binary").repartition(5)


@pytest.mark.parametrize(("content", "info"), [(PNG, ("png", 300, 100)), (GIF, ("gif", 40, 80)), (BMP, ("bmp", 7, 9)), (JPEG, ("jpeg", 200, 50)), (b"", ("png", 2, 3)), (b"\xff\xd8\xff", ("png", 2, 3)), (b"GIF89a", ("png", 2, 3)), (b"\xff\xd8" + b"\xff\xe0\x00\x00" * 4, ("png", 2, 3))])
def test_pictures(content, info):
    assert files.picture_info(content) == info
    xml = files.picture_xml(1, "image1", 300, 100, 4.0)
    assert xml.count('cx="3657600" cy="1219200"') == 2


def test_recognised_documents_are_those_of_blocks(spark, tmp_path):
    pages = pages_of(spark)
    docsink.write_documents(docsink.recognised_rows(pages, image="image", error="bad"), str(tmp_path / "out"), files=2)
    got, side = read(tmp_path / "out"), int(4.0 * 914_400)
    want = {}
    for r in pg.recognised_blocks(pages, image="image", error="bad").collect():
        shown = lambda b: (bytes(b["image"]), (i := files.picture_info(bytes(b["image"])))[0], side, side * i[2] // i[1])
        want[f"{'%' if r['doc_id'] is None else r['doc_id']}.docx"] = [(b["kind"], shown(b) if b["kind"] == "image" else (b["text"] or "")) for b in r["blocks"]]
    assert {name: blocks for name, (blocks, _) in got.items()} == want
    assert not list((tmp_path / "out").glob("_temporary*")) and {docsink.id_of(n) for n in got} == {"1", "2", "30", None}


def test_other_documents(spark, tmp_path):
    pages = pages_of(spark).withColumn("page_text", F.replace("page_text", F.lit(" "), F.lit("\n\n")))
    docsink.write_documents(docsink.simple_rows(pages), str(tmp_path / "simple"))
    want = {f"{'%' if r['doc_id'] is None else r['doc_id']}.docx": [(b["kind"], (b["text"] or "")) for b in r["blocks"]] for r in pg.simple_blocks(pages).collect()}
    assert {name: blocks for name, (blocks, _) in read(tmp_path / "simple").items()} == want
    docsink.write_documents(docsink.image_rows(pages.filter("doc_id = 1")), str(tmp_path / "images"), inches=6.0)
    blocks = read(tmp_path / "images")["1.docx"][0]
    assert [k for k, _ in blocks] == ["image", "break", "break", "image", "break", "image", "break", "image", "break", "break", "image"] and blocks[0][1][1:] == ("jpeg", 6 * 914_400, 6 * 914_400 // 4)


def test_digital_documents(spark, tmp_path):
    rows = spark.createDataFrame([("a/b", 1, " ", None), ("ಕ é.*", 1, "ªÁ Û ªÁ Û", None), ("c", 1, "text", "torn"), ("d", 1, "some words", None)], "doc_id string, page_num int, page_text string, bad string")
    docs = flows.digital(rows, error=F.col("bad"), kinds=True).withColumns({"t": F.lit("A & B"), "by": F.lit(None).cast("string")})
    docsink.write_documents(docsink.digital_rows(docs, title="t", author="by").unionByName(docsink.text_rows(docs)), str(tmp_path / "out"))
    got = {docsink.id_of(n): x for n, x in read(tmp_path / "out").items()}
    texts = {r["doc_id"]: (r["text"], r["kind"]) for r in docs.collect()}
    assert {k: [(kind, text) for text, kind in [v]] for k, v in texts.items()} == {k: blocks for k, (blocks, _) in got.items()}
    assert texts["a/b"] == (DIGITAL_PLACEHOLDER, "bold") and texts["c"][1] == "text" and texts["ಕ é.*"][1] == ("italic" if texts["ಕ é.*"][0] == EMPTIED else "text")
    assert all("<dc:title>A &amp; B</dc:title>" in core and "creator" not in core for _, core in got.values())
    assert {docsink.id_of(p.name): p.read_text() for p in (tmp_path / "out").glob("part-*/*.txt")} == {k: v for k, (v, _) in texts.items()}


def _batch(rows):
    names = ["file", "side", "page", "seq", "kind", "text", "title", "author", "content"]
    return pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows])


def test_only_committed_attempts_are_shown(tmp_path):
    writer = docsink.DocumentWriter({"path": str(tmp_path)}, False)
    one = [("a.docx", 1, p, 0, "text", f"page {p}", None, None, None) for p in range(3)]
    first, again = writer.write(iter([_batch(one[:2]), _batch(one[2:])])), writer.write(iter([_batch(one)]))
    other, empty = writer.write(iter([_batch([("b.txt", 1, 1, 0, "text", "b", None, None, None)])])), writer.write(iter([]))

    def failing():
        yield _batch(one)
        raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(failing())
    assert not list(tmp_path.glob("part-*")) and first.files == again.files == other.files == 1 and empty.folder is None
    writer.commit([again, None, other, empty])
    assert sorted(p.name for p in tmp_path.rglob("*") if p.is_file()) == ["a.docx", "b.txt"] and [b for b, _ in read(tmp_path).values()] == [[("text", f"page {p}") for p in range(3)]]
    late = docsink.DocumentWriter({"path": str(tmp_path)}, False)
    late.write(iter([_batch(one)]))
    late.abort([None])
    assert sorted(p.name for p in tmp_path.rglob("*") if p.is_file()) == ["a.docx", "b.txt"]


def test_a_long_document_is_streamed(tmp_path):
    """200 pages with pictures of a megabyte each, while the writer holds little more than one of them."""
    import resource

    writer = docsink.DocumentWriter({"path": str(tmp_path)}, False)

    def rows():
        for p in range(200):
            yield _batch([("a.docx", 0, p, 1, "image", None, None, None, PNG + bytes([p % 251]) * (1 << 20))])
        for p in range(200):
            yield _batch([("a.docx", 1, p, 0, "text", "x" * 1000, None, None, None), ("a.docx", 1, p, 1, "image", None, None, None, None)])

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    writer.commit([writer.write(rows())])
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000 or sys.platform != "linux"
    (path,) = tmp_path.glob("part-*/a.docx")
    assert path.stat().st_size > 200 << 20 and len([n for n in zipfile.ZipFile(path).namelist() if "media" in n]) == 200
