"""Pages of files through a reader: what is pushed down, what is touched, and the record that comes of it."""

import json
import random
import sys
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from patrika.operators.quality import sample_indices, sample_pages
from patrika.plans.analyze import analyze_files, analyze_pages
from patrika.sources import pagesource

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # for the reader below, in tasks
KANNADA = "ಕನ್ನಡ ಅಕ್ಷರ ಪುಟ "


class Stub:
    """A file of JSON: pages of three texts each (null: extraction fails), and what is known of the file."""

    def __init__(self, file, log):
        told = json.loads(file.read())
        self.pages, self.log, self.name = told["pages"], log, told["name"]
        self.total_pages, self.fallback = len(self.pages), told.get("fallback", False)
        self.encrypted, self.creator, self.producer = told.get("encrypted", False), told.get("creator"), told.get("producer")

    def text(self, extractor, page):
        with open(f"{self.log}/{self.name}", "a") as f:
            f.write(f"{extractor} {page}\n")
        if (text := self.pages[page][extractor - 1]) is None:
            raise ValueError("bad page")
        return text


def touched(log, name):
    path = Path(log) / name
    lines = path.read_text().split("\n")[:-1] if path.exists() else []
    path.unlink(missing_ok=True)
    return sorted(tuple(map(int, x.split())) for x in lines)


@pytest.fixture
def folder(spark, tmp_path):
    files, log = tmp_path / "files", tmp_path / "log"
    files.mkdir(), log.mkdir()
    place = str(log)
    pagesource.register(spark, lambda: lambda file: Stub(file, place), "stub_pages")
    long, short = KANNADA * 20, "x y"
    told = {
        "long": {"pages": [[f"{long}{i}", "second", "third"] for i in range(40)], "creator": "Genius Scan 2", "encrypted": True},
        "short": {"pages": [["", KANNADA * 2 + str(i), "third"] for i in range(8)], "producer": "lib"},
        "poor": {"pages": [["", short, "third"]] * 3},
        "blank": {"pages": [[" ", "", "\n"]] * 6},
        "failing": {"pages": [[long, "b", "c"], [None, "b", "c"], [long, "b", "c"]]},
        "second_best": {"pages": [[f"{long}{i}", "b", "c"] for i in range(30)], "fallback": True, "encrypted": True},
        "none": {"pages": []},
    }
    for name, x in told.items():
        (files / f"{name}.pdf").write_text(json.dumps(x | {"name": name}))
    (files / "broken.PDF").write_text("{")
    (files / "other.txt").write_text("{}")
    (files / "huge.pdf").write_text(" " * 200_000)
    return str(files), str(log), told


def test_sample_indices_are_those_of_the_column(spark):
    rows = spark.range(300).select("id", sample_pages(F.col("id")).alias("p")).collect()
    assert all(sample_indices(r["id"]) == r["p"] for r in rows)


def test_only_what_is_asked_for_is_extracted(spark, folder):
    path, log, told = folder
    load = lambda: spark.read.format("stub_pages").option("max_bytes", "100000").load(path)
    names = F.regexp_extract("path", r"(\w+)\.pdf", 1)
    got = load().filter("sampled AND extractor = 1").select(names.alias("n"), "page_index").collect()
    assert sorted(r["page_index"] for r in got if r["n"] == "long") == [0, 13, 20, 26, 39]
    assert touched(log, "long") == [(1, p) for p in (0, 13, 20, 26, 39)] and touched(log, "blank") == [(1, p) for p in (0, 2, 3, 4, 5)]
    for name in told:
        touched(log, name)
    assert load().filter("page_index BETWEEN 3 AND 4 AND extractor IN (2, 3) AND path LIKE '%' ").filter(F.col("path").startswith(path.removeprefix("file:") + "/long")).count() == 4
    # whether an extractor is needed is told from the sampled pages of those before
    assert [x for x in touched(log, "long") if x[0] > 1] == [(2, 3), (2, 4), (3, 3), (3, 4)] and not any(touched(log, n) for n in told)
    plan = load().filter("sampled AND page_index > 2")._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.split("BatchScan")[0]
    assert load().filter("page_index = 39").select("path").distinct().count() == 1
    assert {r["n"] for r in load().select(names.alias("n")).distinct().collect()} == {*told, ""} - {"none"}


def test_large_files_are_dealt_by_ranges_of_pages(spark, folder):
    path, log, told = folder
    load = lambda: spark.read.format("stub_pages").options(max_bytes="100000", range_bytes="2000", partition_bytes="2000").load(path)
    assert load().rdd.getNumPartitions() > len(told) > load().filter("sampled").rdd.getNumPartitions() / 2
    rows = load().filter("extractor = 1").groupBy("path").agg(F.count("*").alias("n"), F.max("total_pages").alias("t"), F.count_distinct("page_index").alias("d")).collect()
    assert len(rows) == 7 and all(r["n"] == r["t"] == r["d"] for r in rows)


def test_lazy_analysis_of_files(spark, folder):
    path, log, told = folder
    got = {r["path"].rsplit("/", 1)[1].split(".")[0]: r["analysis"] for r in analyze_files(spark, path, "stub_pages", max_bytes="100000").collect()}
    touches = {name: touched(log, name) for name in told}
    assert set(got) == {*told, "broken"} - {"none"}
    assert touches["long"] == [(1, p) for p in (0, 13, 20, 26, 39)]  # the first extractor was enough
    assert touches["short"] == [(e, p) for e in (1, 2) for p in (0, 2, 4, 7)]
    assert touches["poor"] == [(e, p) for e in (1, 2, 3) for p in range(3)]
    assert touches["failing"] == [(1, 0), (1, 1)] and touches["second_best"] == [(1, 0)]
    assert got["long"]["pdf_type"] == "digital" and got["long"]["total_pages"] == 40 and got["long"]["pages_with_text"] == 5
    assert [n.split(" chars")[0].rstrip("0123456789") for n in got["long"]["analysis_notes"]][:3] == ["PDF is encrypted", "Scanner software detected: genius scan ", "PyMuPDF extracted "]
    assert got["long"]["analysis_notes"][3] == "Kannada text detected"
    assert got["blank"]["pdf_type"] == "scanned" and got["blank"]["analysis_notes"] == ["No text extracted"]
    assert got["failing"]["pages_with_text"] == 1 and got["failing"]["pdf_type"] == "digital"
    assert got["second_best"]["total_pages"] == 30 and got["second_best"]["analysis_notes"][:2] == ["Used PyPDF2 fallback", f"PyMuPDF extracted {len(KANNADA) * 20 + 3} chars from 1 pages"]
    assert got["broken"]["pdf_type"] == "unknown" and got["broken"]["analysis_notes"][0].startswith("Analysis failed: ") and got["broken"]["total_pages"] == 1
    # all rows of all pages and extractors give the same
    whole = analyze_pages(spark.read.format("stub_pages").option("max_bytes", "100000").load(path))
    assert {r["path"].rsplit("/", 1)[1].split(".")[0]: r["analysis"] for r in whole.collect()} == got
    for name in told:
        touched(log, name)
    forced = {r["path"].rsplit("/", 1)[1].split(".")[0]: r["analysis"] for r in analyze_files(spark, path, "stub_pages", forced=True, max_bytes="100000").collect()}
    assert not any(touched(log, name) for name in told)
    assert forced["long"]["pdf_type"] == forced["broken"]["pdf_type"] == "forced_ocr" and forced["long"]["total_pages"] == 40


def test_pages_with_nulls_and_ties(spark):
    rng = random.Random(3)
    rows = [(1, 2, 0, 1, None, None), (1, 2, 1, 1, "a" * 120, None), (1, 2, 1, 1, "b", None), (2, 1, 0, 1, None, None), (None, 1, 0, 1, "text", None), (3, 9, 1, 1, "not sampled", None), (3, 9, 0, 2, "x", None), (4, 1, 0, 1, None, "bad")]
    rng.shuffle(rows)
    pages = spark.createDataFrame(rows, "doc_id int, total_pages int, page_index int, extractor int, page_text string, error string")
    pages = pages.withColumns({"encrypted": F.lit(None).cast("boolean"), "fallback": F.lit(None).cast("boolean"), "creator": F.lit(None).cast("string"), "producer": F.lit(None).cast("string")})
    got = {r["doc_id"]: r["analysis"] for r in analyze_pages(pages, "doc_id").collect()}
    assert got[1]["pages_with_text"] == 2 and got[1]["sample_text"] == "a" * 120 + "\n\nb\n\n" and got[2]["pdf_type"] == "scanned"
    assert got[None]["sample_text"] == "text\n\n" and got[3]["sample_text"] == "\nx\n\n" and got[4]["pdf_type"] == "unknown"
    assert analyze_pages(pages.limit(0), "doc_id").count() == 0
