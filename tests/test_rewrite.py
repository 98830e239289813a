import random

import pytest
from pyspark.sql import functions as F

from patrika.functions import rewrite as rw
from patrika.functions import script as sc
from patrika.functions.constants import LEGACY, MISREAD


def column(spark, values, *cols):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [tuple(r) if len(cols) > 1 else r[0] for r in df.orderBy("i").select(*cols).collect()]


def test_dictionaries():
    assert len(LEGACY) == 174 and len(MISREAD) == 70
    assert dict(LEGACY)["®"] == "ಪ" and dict(LEGACY)["²"] == "ಯ" and dict(LEGACY)["­"] == "ಣ"
    assert rw.from_font("ªÀ£ÀPÀAiÀÄ") == "ಅನಡಆ"
    assert rw.replaced("A1", MISREAD) == "೧"
    assert rw.cleaned("ನಮಸ್ಕಾರ") == "ನಮಸ್ ಕಾರ"
    assert rw.normal("é") == "é" and rw.normal("q́") == "q"


def test_native_forms_agree_with_steps(spark):
    rng = random.Random(4)
    alphabet = ["ಕ", "ಾ", "ೆ", "A", "U", "Á", "1", "೧", " ", "\n", ".", "!", "x", "ª", "À", "ಆ", "Q", "é", "-", "%", "್"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(1500)] + [None, "", " "]
    got = column(spark, texts, rw.apply_rules("x"), rw.clean("x"), rw.substitute("x", LEGACY), rw.collapse("x"), sc.is_script("x"), sc.is_font_encoded("x"))
    for t, row in zip(texts, got, strict=True):
        t = t or ""
        want = (rw.by_rules(t), rw.cleaned(t), rw.replaced(t, LEGACY), rw.collapsed(t), rw.in_script(t), rw.font_encoded(t))
        assert row == want, repr(t)


def test_arrow_forms(spark):
    texts = ["ªÀ£ÀPÀAiÀÄ", "The é text of some length, is here", None, "ಕನ್ನಡ ಪಠ್ಯ ಇಲ್ಲಿ ಇದೆ ನೋಡಿ"]
    got = column(spark, texts, rw.normalize("x"), rw.convert_font("x"), rw.fix_misread("x"), rw.repair("x"), rw.repair_digital("x"), rw.is_nfc("x"))
    for t, row in zip(texts, got, strict=True):
        t = t or ""
        assert row[:5] == (rw.normal(t), rw.from_font(t), rw.replaced(t, MISREAD), rw.repaired(t), rw.repaired_digital(t))
    assert [r[5] for r in got] == [True, False, True, True]
    assert column(spark, [" ", "a1"], rw.repair_recognised("x"), rw.repair_recognised("x", debug=True)) == [("", ""), ("ಅ೧", "a1")]


@pytest.mark.parametrize(("text", "expected"), [("", False), ("   ", False), ("...", False), ("ಕab", True), ("ಕabcd", False), ("ಕ,,,,", True), (None, False)])
def test_is_script(spark, text, expected):
    assert column(spark, [text], sc.is_script("x")) == [expected]


def test_font_markers_and_issues(spark):
    assert column(spark, ["ªÀ £À", "ªÀ", "ಕನ್ನಡ ಪಠ್ಯ ಇಲ್ಲಿ ಇದೆ ªÀ £À"], sc.is_font_encoded("x")) == [True, False, False]
    found = column(spark, ["", "ಕನ್ನಡ", "abc...", "%%%%%ಕ"], sc.issues("x", rw.is_nfc("x")))
    assert found[0] == ["Empty or whitespace-only text"] and found[1] == []
    assert found[2] == ["Insufficient Kannada characters detected", "Excessive punctuation detected"]
    assert "Excessive non-Kannada artifacts detected" in found[3]


def test_profile_and_flags(spark):
    p = column(spark, ["ಕಕab", ""], sc.profile("x"))
    assert tuple(p[0]) == (4, 2, 50.0, 2, 50.0, "ಕಕab") and tuple(p[1]) == (0, 0, 0.0, 0, 0.0, "No text")
    assert column(spark, ["xರರರ", "a"], sc.looks_corrupt("x")) == [True, False]
    assert column(spark, ["abcdefghijk"], sc.is_over_cleaned("x", F.lit("a"))) == [True]


def test_texts_go_to_python_in_small_batches(spark):
    texts = spark.createDataFrame([("MAಜ|o1 zsಾ ಚzs ¼½",), ("e\u0301q\u0301",), ("plain",), (None,)], "x string")
    plan = lambda *c: texts.select(*c)._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan(rw.fix_misread("x"))
    made = [rw.normalize("x"), rw.is_nfc("x"), rw.convert_font("x"), rw.repair("x"), rw.repair_digital("x"), rw.repair_recognised("x")]
    assert "BatchEvalPython" in plan(*made) and "ArrowEvalPython" not in plan(*made)
    rows = texts.select("x", rw.fix_misread("x"), rw.normalize("x"), rw.is_nfc("x")).collect()
    for x, misread, normal, nfc in rows:
        assert (misread, normal, nfc) == (rw.replaced(x or "", MISREAD), rw.normal(x or ""), rw.is_normal(x or ""))


def test_counts_match_character_by_character(spark):
    """Counts by length agree with counts of each character, runs and negated classes included, and make no large negated class."""
    import re

    script = sc
    from patrika.functions.constants import ANY, DELETED, SCRIPT

    texts = ["", "plain", "ಕನ್ನಡ \u200c ಪದ ★★ x", "ÿ" * 30, "ÁÁß QX ZZ ★ é", "\x00\x7f\x85\u3000 ★ Жж", "ಕ" * 9 + "ÿ" * 40, "ÿÿ ಕಾ ÿÿÿÿ ÿÿÿÿÿÿÿÿÿÿÿÿÿÿÿÿÿÿÿÿÿ"]
    for t in texts:
        counted = re.sub(r"[\s.,!?;:()\-]", "", t)
        assert rw.in_script(t) == (bool(counted) and len(re.findall(f"[{SCRIPT}]", counted)) / len(counted) > 0.2)
        total = len("".join(t.split()))
        if total > 20 and not rw.in_script(t):
            assert rw.font_encoded(t) == (sum(c > "\x7f" for c in t) / total > 0.7 and len(re.findall(ANY, t)) / total < 0.2)
        assert not set(rw.cleaned(t)) & set(DELETED)
    col = script.count_of(F.col("text"), r"^\x00-\x7F")
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", col.alias("n")).collect()
    assert [r["n"] for r in rows] == [sum(c > "\x7f" for c in r["text"]) for r in rows]
    assert "[^" not in str(col)
