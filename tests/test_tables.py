"""Table functions give what the DataFrame forms give; recognisers try their options in the right order."""

import sys

import pytest
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from patrika.functions import tables
from patrika.functions.constants import ANY_CHARACTER, CONFIGURATIONS, OTHER_LAYOUTS, SCRIPT_ONLY
from patrika.sources import adapters

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_paragraphs_as_a_table_function(spark):
    data = [(d, p, None if p == 3 else f"one {d}\n\n \n\n  two {p}\n\n" if p % 2 else "") for d in (1, 2, 5) for p in range(1, 6)] + [(None, 1, "x"), (1, 9, "  last \n\n\n")]
    pages = spark.createDataFrame(data, "doc_id long, page_num int, page_text string").withColumn("number", F.lit("own")).repartition(4)
    tables.register(spark)
    pages.createOrReplaceTempView("udtf_pages")
    got = spark.sql("SELECT * FROM page_paragraphs(TABLE(udtf_pages) PARTITION BY doc_id ORDER BY page_num)")
    assert got.columns == ["doc_id", "page_num", "number", "paragraph"] and dict(got.dtypes)["doc_id"] == "bigint"
    assert rows(got) == rows(tables.page_paragraphs(pages)) and got.count() == 14
    with pytest.raises(AnalysisException, match="no column page_text"):
        spark.sql("SELECT * FROM page_paragraphs(TABLE(SELECT 1 AS doc_id, 1 AS page_num))").collect()


def test_configurations_and_images_as_table_functions(spark):
    def make_recogniser():
        def recognise(image, options):
            if "psm 3" in options:
                raise ValueError("no")
            return f"{image[0]} {options}"

        return recognise

    def make_reader():
        def read(content):
            if content == b"bad":
                raise OSError("torn")
            return [((2, 3, bytes([c])), [lambda: (1, 1, b"in")]) for c in content]

        return read

    tables.register(spark, make_recogniser, make_reader)
    images = spark.createDataFrame([("a", n, None, bytearray([n]), None) for n in (1, 2)], adapters.PAGES)
    images.createOrReplaceTempView("udtf_images")
    got = spark.sql("SELECT * FROM image_configurations(TABLE(udtf_images), " + ", ".join(f"'{c}'" for c in CONFIGURATIONS) + ")")
    assert rows(got) == rows(adapters.compare_configurations(images, make_recogniser)) and got.count() == 8
    with pytest.raises(AnalysisException, match="name one configuration"):
        spark.sql("SELECT * FROM image_configurations(TABLE(udtf_images))").collect()
    files = spark.createDataFrame([("a", bytearray(b"xy")), ("b", bytearray(b"bad"))], "path string, content binary")
    files.createOrReplaceTempView("udtf_files")
    assert rows(spark.sql("SELECT * FROM file_images(TABLE(udtf_files))")) == rows(adapters.read_images(files, make_reader))


def test_options_in_turn():
    said, calls = {}, []

    def run(image, language, options, seconds):
        calls.append((language, options, seconds))
        if isinstance(out := said.get(options, " "), Exception):
            raise out
        return out

    recognise = adapters.in_turn(run)
    assert recognise(b"", 61.0) == " "
    assert calls == [("kan", SCRIPT_ONLY, 61.0), ("kan", ANY_CHARACTER, 30.0), *(("kan", o, 15) for o in OTHER_LAYOUTS)] and [o[14] for o in OTHER_LAYOUTS] == list("348")
    said |= {ANY_CHARACTER: ValueError("x"), OTHER_LAYOUTS[0]: RuntimeError("timeout"), OTHER_LAYOUTS[1]: "found"}
    calls.clear()
    assert recognise(b"", 60.0) == "found" and len(calls) == 4
    said[SCRIPT_ONLY] = RuntimeError("Timeout reached")
    with pytest.raises(TimeoutError, match="after 60 seconds"):
        recognise(b"", 60.0)
    for error in (ValueError("timeout"), RuntimeError("other")):
        said[SCRIPT_ONLY] = error
        assert recognise(b"", 60.0) == ""

    def none():
        raise OSError("not there")

    for languages, want in ((lambda: ["eng", "kan"], "kan+eng"), (lambda: ["eng"], "eng"), (none, "eng")):
        calls.clear()
        adapters.simple(run, languages)(b"", 5.0)
        assert calls == [(want, CONFIGURATIONS[0], 5.0)]
