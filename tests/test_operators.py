import io
import zipfile

import pytest
from pyspark.sql import functions as F

from patrika.functions import names, registry, rewrite
from patrika.functions.constants import CONFIGURATIONS, DIGITAL_PLACEHOLDER, EMPTIED, FAILED, RECOGNISED_PLACEHOLDER
from patrika.functions.rewrite import is_nfc, normalize, repaired_digital
from patrika.functions.script import issues, profile
from patrika.operators import pages as pg
from patrika.operators import quality as ql
from patrika.plans import flows
from patrika.plans.analyze import analyze
from patrika.sources import adapters, files
from patrika.streaming.inbox import analyse_inbox


@pytest.mark.parametrize(("n", "picks"), [(0, []), (3, [0, 1, 2]), (6, [0, 2, 3, 4, 5]), (7, [0, 2, 3, 4, 6]), (8, [0, 2, 4, 7]), (10, [0, 3, 5, 6, 9]), (100, [0, 33, 50, 66, 99])])
def test_sample_pages(spark, n, picks):
    assert spark.range(1).select(ql.sample_pages(F.lit(n))).first()[0] == picks


def test_assembly(spark):
    pages = spark.createDataFrame([(1, 3, "b"), (1, 1, "a"), (1, 2, " "), (2, 1, None)], "doc_id long, page_num int, page_text string")
    rows = {r[0]: tuple(r)[1:] for r in pg.assemble(pages).collect()}
    assert rows == {1: ("a\n\nb\n\n", 3, 2), 2: ("", 1, 0)}
    done = {r["doc_id"]: r for r in flows.scanned(pages).collect()}
    assert done[1]["summary"] == "2/3" and done[2]["status"] == "success"  # the placeholder is in the script
    assert {r["doc_id"]: r["status"] for r in flows.digital(pages, F.lit(False)).collect()} == {1: "no_script", 2: "success"}


def test_cascade_and_fonts(spark):
    one = spark.range(1)
    got = one.select(pg.cascade(F.lit("ab"), F.lit("c" * 60), F.lit("d"), (F.lit(1), F.lit(2), F.lit(3))).alias("c")).select("c.*").first()
    assert (got["text"], got["has_text_layer"], got["pages_with_text"]) == ("ab\n" + "c" * 60, True, 2)
    assert got["notes"] == ["PyMuPDF extracted 2 chars from 1 pages", "pdfplumber extracted 60 chars"]
    assert one.select(pg.has_legacy_font(F.array(F.lit("X+NUDI01")))).first()[0] is True
    assert one.select(pg.has_legacy_font(F.lit(None).cast("array<string>"))).first()[0] is False
    assert one.select(pg.file_notes(F.lit(True), F.lit(None), F.lit("CamScanner"))).first()[0] == ["PDF is encrypted", "Scanner software detected: camscanner"]


def test_quality_and_types(spark):
    good = "ಕನ್ನಡ ಪದ " * 20
    rows = spark.createDataFrame([(1, good), (2, "plain English words " * 10), (3, " "), (4, None), (5, "§☃☃☃☃☃☃")], "doc_id long, text string")
    a = {r["doc_id"]: r["analysis"] for r in analyze(rows).collect()}
    assert (a[1]["pdf_type"], a[1]["confidence"], a[1]["needs_ocr"]) == ("digital", 1.0, False)
    assert (a[2]["pdf_type"], a[2]["confidence"], a[2]["text_quality_score"]) == ("hybrid", 0.6, 0.5)
    assert a[3]["pdf_type"] == a[4]["pdf_type"] == "scanned" and a[3]["analysis_notes"] == ["No text extracted"]
    assert a[5]["text_quality_score"] == 0.0 and a[5]["confidence"] == 0.7
    sparse = analyze(rows, total_pages=F.lit(10), pages_with_text=F.lit(1)).filter("doc_id = 5").first()["analysis"]
    assert (sparse["pdf_type"], sparse["confidence"]) == ("scanned", 0.8)
    assert analyze(rows, forced=F.lit(True)).filter("doc_id = 1").first()["analysis"]["pdf_type"] == "forced_ocr"
    assert ql.with_quality(rows, normalize("text")).columns == ["doc_id", "text", "quality"]


def test_names(spark):
    rows = spark.createDataFrame([("ಕ a/b.PDF",), ("x.doc",), ("",), (None,)], "n string")
    assert [r[0] for r in rows.select(names.upload_status(F.col("n"))).collect()] == ["Valid", "File must be a PDF", "No file selected", "No file selected"]
    assert rows.select(names.stamped_name(F.col("n"), F.lit("2024-01-02 03:04:05").cast("timestamp"))).first()[0] == "20240102030405_ಕab.PDF"


def test_adapters(spark):
    data = spark.createDataFrame([("a", bytearray(b"one|two")), ("b", bytearray(b"bad"))], "path string, content binary")

    def make_reader():
        def read(raw):
            if raw == b"bad":
                raise ValueError("no pages")
            return [(t.decode(), t) for t in raw.split(b"|")]

        return read

    pages = adapters.read_pages(data, make_reader)
    assert sorted((r["path"], r["page_num"], r["page_text"], r["error"]) for r in pages.collect() if r["path"] == "a") == [("a", 1, "one", None), ("a", 2, "two", None)]
    assert pages.filter("path = 'b'").first()["error"] == "ValueError: no pages"

    def make_engines():
        def fails(image, limit):
            raise TimeoutError(str(limit))

        return [(fails, 60.0), (lambda image, limit: " ", 30.0), (lambda image, limit: image.decode().upper(), 15.0)]

    texts = adapters.recognise_pages(pages.filter("path = 'a'"), make_engines, prepare=lambda raw: raw + b"!")
    assert sorted(r["page_text"] for r in texts.collect()) == ["ONE!", "TWO!"]
    assert adapters.recognise_pages(pages.filter("path = 'b'"), make_engines).first()["error"] == "no image"


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdf").write_bytes(b"123")
    (tmp_path / "in/b.pdf").write_bytes(b"12345")
    (tmp_path / "in/c.txt").write_bytes(b"1")
    assert [bytes(r["content"]) for r in files.read_files(spark, str(tmp_path / "in"), most_bytes=4).collect()] == [b"123"]
    docs = spark.createDataFrame([(1, ["a < b", None, "ಕ"]), (2, None)], "doc_id long, paragraphs array<string>")
    for r in files.as_docx(docs).collect():
        xml = zipfile.ZipFile(io.BytesIO(bytes(r["content"]))).read("word/document.xml").decode()
        assert ("a &lt; b" in xml and 'type="page"' in xml and "ಕ" in xml) == (r["doc_id"] == 1)
    files.write_texts(spark.createDataFrame([("x\ny",)], "text string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out"), lineSep="\u001e").first()[0] == "x\ny"


def test_stream(spark, tmp_path):
    inbox, table, ck = (str(tmp_path / x) for x in ("inbox", "table", "ck"))
    rows = lambda a, b: spark.range(a, b).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text")).coalesce(1)
    for a, b in ((0, 3), (3, 5)):
        rows(a, b).write.mode("append").parquet(inbox)
        analyse_inbox(spark, inbox, table, ck).awaitTermination()
    assert sorted(r[0] for r in spark.read.parquet(table).select("doc_id").collect()) == [0, 1, 2, 3, 4]


def test_recognised_pages_use_their_own_detection(spark):
    # the markers are gone once misread characters are replaced, so the page as it came has to tell
    rows = spark.createDataFrame([(1, 1, "µÀ º dÄ"), (1, 2, " "), (2, 1, None)], "doc_id long, page_num int, page_text string")
    done = {r["doc_id"]: r for r in flows.scanned(rows).collect()}
    assert done[1]["text"] == "ಮ ಳ ದೂ\n\n" and done[1]["summary"] == "1/2"
    assert done[2]["text"] == RECOGNISED_PLACEHOLDER and done[2]["summary"] == "0/1"
    assert flows.convert_scanned is flows.scanned


def test_digital_placeholders(spark):
    rows = spark.createDataFrame([(1, 1, " ", None), (2, 1, "ªÁ Û ªÁ Û", None), (3, 1, "text", "torn"), (None, 1, "some words", None)], "doc_id long, page_num int, page_text string, bad string")
    got = {r["doc_id"]: r["text"] for r in flows.digital(rows, F.lit(False), F.col("bad")).collect()}
    assert got[1] == DIGITAL_PLACEHOLDER and got[3] == FAILED + "torn" and got[None] == "some words"
    assert got[2] == (repaired_digital("ªÁ Û ªÁ Û\n\n") or EMPTIED)


def test_unknown_analysis(spark):
    rows = spark.createDataFrame([(1, "text", "no file"), (2, "text", None)], "doc_id long, text string, bad string")
    got = {r["doc_id"]: r["analysis"] for r in analyze(rows, total_pages=F.lit(7), error=F.col("bad")).collect()}
    assert (got[1]["pdf_type"], got[1]["confidence"], got[1]["needs_ocr"], got[1]["total_pages"]) == ("unknown", 0.5, True, 1)
    assert got[1]["analysis_notes"] == ["Analysis failed: no file", "Defaulting to OCR for safety"] and got[2]["total_pages"] == 7


def test_percentages_round_half_to_even(spark):
    rows = spark.createDataFrame([("ಕ" + "a" * 15,), ("ಕ" * 3 + "a" * 13,)], "x string")
    assert [r[0]["script_pct"] for r in rows.select(profile("x")).collect()] == [6.2, 18.8]


def test_documents(spark):
    pages = spark.createDataFrame([(1, 2, "two", None, b"png2"), (1, 1, "a < b", None, b"png1"), (1, 3, " ", None, None), (2, 1, None, "torn", None)], "doc_id long, page_num int, page_text string, bad string, image binary")
    blocks = pg.recognised_blocks(pages, image="image", error="bad")
    kinds = {r["doc_id"]: [b["kind"] for b in r["blocks"]] for r in blocks.collect()}
    assert kinds == {1: ["heading", "image", "text", "break", "heading", "image", "text", "break", "heading", "italic", "bold"], 2: ["italic", "bold"]}
    docs = files.as_documents(blocks.withColumns({"t": F.lit("A & B"), "by": F.lit(None)}), title="t", author="by")
    for r in docs.collect():
        z = zipfile.ZipFile(io.BytesIO(bytes(r["content"])))
        xml, core = z.read("word/document.xml").decode(), z.read("docProps/core.xml").decode()
        assert "<dc:title>A &amp; B</dc:title>" in core and "creator" not in core and "kn-IN" in core
        if r["doc_id"] == 1:
            assert "a &lt; b" in xml and "Heading2" in xml and "<w:b/>" in xml and z.read("word/media/image2.png") == b"png2" and "2/3" in xml
    simple = {r["doc_id"]: [(b["kind"], b["text"]) for b in r["blocks"]] for r in pg.simple_blocks(pages.withColumn("page_text", F.replace("page_text", F.lit(" < "), F.lit("\n\n")))).collect()}
    assert simple == {1: [("text", "a"), ("text", "b"), ("break", None), ("text", "two")], 2: []}
    assert [len(r["blocks"]) for r in pg.image_blocks(pages.filter("image is not null")).collect()] == [3]


def test_recognisers_in_turn(spark):
    pages = spark.createDataFrame([("a", n, None, bytearray(b"%d" % n), None) for n in (1, 2, 3)] + [("b", 1, None, None, None)], adapters.PAGES)

    def costly():
        def read(image, seconds):
            if image == b"2":
                raise TimeoutError("slow")
            return ""

        return read

    def plain():
        def read(image, seconds):
            if image == b"4":
                raise ValueError("bad")
            return f"{image.decode()} in {seconds:g}"

        return read

    def none():
        raise RuntimeError("no client")

    text = lambda df: [r["page_text"] for r in df.filter("path = 'a'").orderBy("page_num").collect()]
    assert text(adapters.recognise_within_limit(pages, costly, plain, limit=2, seconds=60.0)) == ["", "2 in 30", "3 in 60"]
    assert text(adapters.recognise_within_limit(pages, none, plain)) == ["1 in 60", "2 in 60", "3 in 60"]
    assert adapters.recognise_within_limit(pages, costly, plain).filter("path = 'b'").first()["error"] == "no image"
    more = pages.unionByName(spark.createDataFrame([("c", 1, None, bytearray(b"4"), None)], adapters.PAGES))
    assert adapters.recognise_within_limit(more, None, plain).filter("path = 'c'").first()["error"] == "ValueError: bad"


def test_configurations(spark, tmp_path):
    pages = spark.createDataFrame([("a", 1, None, bytearray(b"x"), None)], adapters.PAGES)

    def make():
        def read(image, options):
            if "psm 3" in options:
                raise ValueError("no")
            return options

        return read

    rows = adapters.compare_configurations(pages, make)
    assert {r["config"]: r["text"] for r in rows.collect()} == {"config_0": CONFIGURATIONS[0], "config_1": CONFIGURATIONS[1], "config_2": "Error: no", "config_3": CONFIGURATIONS[3]}
    files.write_by_configuration(rows, str(tmp_path / "out"))
    assert {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()} == {f"config=config_{i}" for i in range(4)}


def test_images_of_files(spark):
    data = spark.createDataFrame([("a", bytearray(b"xy")), ("b", bytearray(b"bad"))], "path string, content binary")

    def make():
        def broken():
            raise ValueError("image")

        def read(raw):
            if raw == b"bad":
                raise OSError("torn")
            return [((2, 3, bytes([c])), [lambda c=c: (1, 1, b"in"), broken]) for c in raw]

        return read

    rows = adapters.read_images(data, make)
    assert sorted((r["page_number"], r["source"], r["width"]) for r in rows.filter("path = 'a'").collect()) == [(1, "embedded_0", 1), (1, "page_render", 2), (2, "embedded_0", 1), (2, "page_render", 2)]
    assert [(r["page_number"], r["error"]) for r in rows.filter("path = 'b'").collect()] == [(0, "OSError: torn")]
    assert adapters.read_images(data, make, [1, 9]).filter("path = 'a'").count() == 2


def test_first_done(spark):
    one = spark.createDataFrame([("a", bytearray(b"1"), None), ("b", None, "X: y"), ("c", None, None)], "path string, content binary, error string")
    two = spark.createDataFrame([("a", bytearray(b"2"), None), ("b", bytearray(b"2"), None), ("c", None, None)], "path string, content binary, error string")
    got = {r["path"]: (r["content"] and bytes(r["content"]), r["error"]) for r in adapters.first_done(one, two).collect()}
    assert got == {"a": (b"1", None), "b": (b"2", None), "c": (None, "RuntimeError: PDF conversion failed")}


def test_names_for_sql(spark):
    # rewrite functions that have been used hold handles of the driver's; registering must not care, nor do it only once
    spark.createDataFrame([("A1",)], "t string").select(rewrite.normalize("t"), rewrite.fix_misread("t"), rewrite.repair("t")).collect()
    registry.register(spark)
    registry.register(spark)
    texts = ["ªÀ£ÀPÀAiÀÄ", "The é text", None, "ಕನ್ನಡ", "%%%%%ಕ", "abc...", "µÀ º dÄ"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").createOrReplaceTempView("sql_names")
    for name, (step, _) in registry.FUNCTIONS.items():
        got = [r[0] for r in spark.sql(f"SELECT {name}(t) FROM sql_names ORDER BY i").collect()]
        assert got == [step(t or "") for t in texts], name
    native = [r[0] for r in spark.table("sql_names").orderBy("i").select(issues("t", is_nfc("t"))).collect()]
    assert native == [r[0] for r in spark.sql("SELECT validate_kannada_output(t) FROM sql_names ORDER BY i").collect()]


def test_native_names_for_sql_start_no_python(spark):
    registry.register(spark)
    texts = ["ªÀ£ÀPÀAiÀÄ", "it's \\ a \"quoted\" ನಮಸ್ಕಾರ1", None, "", "ಕನ್ನಡ ಕನ್ನಡ ಕನ್ನಡ ಕನ್ನಡ ªÀ £À", "%%%%%ಕ", "µÀ º dÄ", "ಕ\tab , c"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    df.createOrReplaceTempView("sql_native")
    got = spark.sql("SELECT " + ", ".join(f"{name}(t) AS {name}" for name in registry.NATIVE) + " FROM sql_native")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert got.collect() == df.select(*[build(F.col("t")).alias(name) for name, build in registry.NATIVE.items()]).collect()
    plan = spark.sql("SELECT validate_kannada_output(t) FROM sql_native")._jdf.queryExecution().executedPlan().toString()
    assert "is_normal_form(" in plan and "kannada_issues(" not in plan and plan.count("ArrowEvalPython") == 1


def test_one_row_group_is_dealt_to_all_cores(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    spark.range(4000).withColumn("text", F.lit("x" * 100)).coalesce(1).write.parquet(str(tmp_path / "t"))
    whole = spark.read.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert whole.rdd.getNumPartitions() >= cores
        assert whole.select(F.spark_partition_id()).distinct().count() == 1
        assert files.spread(whole).select(F.spark_partition_id()).distinct().count() >= cores
        assert files.spread(whole).count() == 4000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
