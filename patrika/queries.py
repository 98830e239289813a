"""Queries that apply the operators to the tables of a data folder, and DuckDB SQL that says the same."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import names, rewrite, script
from .functions.constants import ANY, CORRUPTION, DAMAGE, DELETED, DIGIT, FONTS, ISSUES, LEGACY, LETTER, MARKERS, MARKS, MISREAD, NO_FILE, NOT_PDF, RULES, SCANNERS, SCRIPT, SPACE, VALID, VOWEL_SIGN, WORD, DIGITAL_PLACEHOLDER, EMPTIED, EXTRACTED, FAILED, FAILURE_NOTES, FALLBACK, NO_COMPONENTS, NO_PERMISSION, NO_TEXT, NOT_VALID, PAGE_FAILED, PAGE_HEADING, PAGE_OF, RECOGNISED_PLACEHOLDER, SUMMARY, UNEXPECTED
from .operators import joins, runs, sketches
from .operators import pages as pg
from .operators import quality as ql
from .plans import flows
from .plans.analyze import analyze, analyze_pages
from .sources import docsink
from .sources.files import spread
from .streaming import windows

_JOIN = "␞"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text"))


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text twice: as it is, and with misread characters replaced, which fills it with script."""
    d = _docs(spark, sf_dir).withColumn("other", rewrite.fix_misread("text"))
    rows = F.array(F.struct(F.lit(0).alias("variant"), "text"), F.struct(F.lit(1).alias("variant"), F.col("other").alias("text")))
    return d.select("doc_id", "lang", F.inline(rows))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page_num"), F.when(F.col("turn") % 3 == 1, " ").otherwise(F.col("text")).alias("page_text"))


# -- the same in SQL --------------------------------------------------------------------------------------------------

SP = SPACE
PUNCT = r".,!?;:()\-"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _del(x: str, chars: str) -> str:
    return f"regexp_replace({x}, {q('[' + chars + ']')}, '', 'g')"


def _count(x: str, chars: str) -> str:
    return f"(length({x}) - length({_del(x, chars)}))"


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, {q('^[' + SP + ']+')}, ''), {q('[' + SP + ']+$')}, '')"


def _replaced(x: str, table) -> str:
    for k, v in table:
        x = f"replace({x}, {q(k)}, {q(v)})"
    return x


def _blank(x: str) -> str:
    return f"NOT regexp_matches({x}, {q('[^' + SP + ']')})"


def _script(x: str) -> str:
    counted = _del(x, SP + PUNCT)
    return f"coalesce({_count(counted, SCRIPT)}::DOUBLE / nullif(length({counted}), 0)::DOUBLE > 0.2, false)"


def _matches(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


def _any(x: str, parts) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(p)})" for p in parts) + ")"


def _number(x: str, parts) -> str:
    return "(" + " + ".join(f"contains({x}, {q(p)})::INT" for p in parts) + ")"


def _encoded(x: str) -> str:
    total = f"length({_del(x, SP)})::DOUBLE"
    return (
        f"CASE WHEN {x} = '' OR ({_script(x)} AND {_matches(x, ANY + '+')} > 3) THEN false WHEN {_number(x, MARKERS)} >= 2 THEN true "
        f"WHEN {_number(x, DAMAGE)} >= 3 AND NOT {_script(x)} THEN true "
        f"WHEN {total} > 20 THEN {_count(x, '^' + chr(0x5C) + 'x00-' + chr(0x5C) + 'x7F')} / {total} > 0.7 AND {_count(x, ANY[1:-1])} / {total} < 0.2 ELSE false END"
    )


def _rules(x: str) -> str:
    for pattern, stays in RULES:
        p, r = pattern, stays
        if p.startswith("<"):
            p, r = f"(^|[^{WORD}])" + p[1:], "1" + r.replace("1", "2")
        elif p.endswith(">"):
            p, r = p[:-1] + f"([^{WORD}]|$)", r + ("2" if r else "1")
        out = "".join("\\" + c if c in "12" else c for c in r)
        x = f"regexp_replace({x}, {q(p)}, {q(out)}, 'g')"
    return x


def _clean(x: str) -> str:
    x = f"regexp_replace({x}, {q('[' + SP + ']+')}, ' ', 'g')"
    x = f"regexp_replace({x}, ' [.,:;!?] ', ' ', 'g')"
    x = f"regexp_replace({x}, {q(f'({LETTER})({LETTER}{VOWEL_SIGN})')}, '\\1 \\2', 'g')"
    x = _del(_del(x, "".join(DELETED)), f"^{SCRIPT}{SP}{WORD}{PUNCT}")
    x = f"regexp_replace({x}, {q(f'({LETTER})({DIGIT})')}, '\\1 \\2', 'g')"
    return _strip(f"regexp_replace({x}, {q(f'({DIGIT})({LETTER})')}, '\\1 \\2', 'g')")


def _normal(x: str) -> str:
    return f"regexp_replace(nfc_normalize({x}), {q(MARKS)}, '', 'g')"


def _collapse(x: str) -> str:
    return _strip(f"regexp_replace({x}, {q('[' + SP + ']+')}, ' ', 'g')")


def _runs(x: str) -> str:
    """Runs of five or more equal word characters. RE2 has no back references, so this names the characters one by one:
    all that the tables and the script hold."""
    points = [*range(0x30, 0x250), *range(0x0C80, 0x0D00)]
    words = [chr(p) for p in points if unicodedata.category(chr(p))[0] in "LN" or p in (0x5F, 0x0CDD)]
    return _matches(x, "|".join(f"{c}{{5,}}" for c in words))


_BOTH = f"(SELECT doc_id, 0 AS variant, coalesce(text, '') AS text FROM documents UNION ALL SELECT doc_id, 1, {_replaced(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')', MISREAD)} FROM documents)"
_D = "(SELECT doc_id, lang, coalesce(text, '') AS text FROM documents)"
_P = "(SELECT conv_id AS doc_id, turn + 1 AS page_num, CASE WHEN turn % 3 = 1 THEN ' ' ELSE text END AS page_text FROM conversations)"


def _quality(source: str) -> str:
    """The quality of the texts of (doc_id, variant, text) as a table `quality`."""
    return f"""
n1 AS (SELECT doc_id, variant, {_normal('text')} AS t FROM {source}),
n2 AS (SELECT *, length({_strip('t')}) AS n, {_matches('t', ANY + '+')} AS words, {_script('t')} AS script,
  {_count('t', '^ಀ-೿ -~ -ÿ' + SP)} + {_runs('t')} + {_matches('t', f'^[^{WORD}{SP}]*$')} + {_matches('t', '[A-Za-z]{20,}')} AS artifacts FROM n1),
n3 AS (SELECT *, artifacts::DOUBLE / greatest(n, 1) AS ratio, {_blank('t')} AS blank FROM n2),
quality AS (SELECT doc_id, variant, t, script, blank, CASE WHEN blank THEN 0.0::DOUBLE ELSE
    least(((CASE WHEN script THEN 0.4::DOUBLE ELSE 0::DOUBLE END + CASE WHEN n > 100 THEN 0.2::DOUBLE ELSE 0::DOUBLE END) + CASE WHEN ratio < 0.1 THEN 0.3::DOUBLE ELSE 0::DOUBLE END) + CASE WHEN words > 10 THEN 0.1::DOUBLE ELSE 0::DOUBLE END, 1.0::DOUBLE) END AS score,
  CASE WHEN blank THEN 'No text extracted' ELSE array_to_string(list_filter([CASE WHEN script THEN 'Kannada text detected' ELSE 'No Kannada text detected' END,
    CASE WHEN n > 100 THEN format('Substantial text length: {{}} chars', n) END, CASE WHEN ratio < 0.1 THEN 'Low artifact ratio' ELSE printf('High artifact ratio: %.2f', ratio) END,
    CASE WHEN words > 10 THEN format('Found {{}} Kannada words', words) END], lambda x: x IS NOT NULL), '{_JOIN}') END AS notes FROM n3)"""


_QUALITY = _quality(_BOTH)

Made = tuple[Callable[[SparkSession, str], DataFrame], str]
_ALL: dict[str, Made] = {}


def _query(sql: str):
    def keep(f):
        _ALL[f.__name__] = (f, sql)
        return f

    return keep


@_query(f"WITH {_QUALITY} SELECT doc_id, variant, score, CASE WHEN blank OR NOT script THEN '' ELSE 'kannada' END AS languages, notes, CASE WHEN blank THEN '' ELSE substr(t, 1, 500) END AS sample FROM quality")
def q1_quality(spark, d):
    x = ql.with_quality(_both(spark, d), rewrite.normalize("text"), "q")
    return x.select("doc_id", "variant", "q.score", F.array_join("q.languages", ",").alias("languages"), F.array_join("q.notes", _JOIN).alias("notes"), "q.sample")


_KIND = "CASE WHEN blank THEN 'scanned' WHEN score >= 0.3 AND script THEN 'digital' WHEN score >= 0.3 THEN 'hybrid' ELSE 'hybrid' END"


@_query(
    f"WITH {_QUALITY} SELECT doc_id, variant, {_KIND} AS pdf_type, (blank OR NOT (score >= 0.3 AND script)) AS needs_ocr, "
    "CASE WHEN blank THEN 0.9::DOUBLE WHEN score >= 0.3 AND script THEN score WHEN score >= 0.3 THEN 0.6::DOUBLE ELSE 0.7::DOUBLE END AS confidence, (NOT blank)::INT AS pages_with_text, CASE WHEN blank THEN '' ELSE substr(t, 1, 200) END AS sample_text FROM quality"
)
def q4_analysis(spark, d):
    a = analyze(_both(spark, d))
    return a.select("doc_id", "variant", "analysis.pdf_type", "analysis.needs_ocr", "analysis.confidence", "analysis.pages_with_text", "analysis.sample_text")


@_query(f"WITH {_QUALITY}, k AS (SELECT variant, lang, {_KIND} AS pdf_type, score FROM quality JOIN documents USING (doc_id)) SELECT lang, variant, pdf_type, count(*) AS n, sum((score * 10)::INT)::BIGINT AS tenths FROM k GROUP BY ALL")
def q4_summary(spark, d):
    a = analyze(_both(spark, d))
    return a.groupBy("lang", "variant", F.col("analysis.pdf_type").alias("pdf_type")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("analysis.text_quality_score") * 10).cast("int")).alias("tenths"))


@_query("SELECT doc_id, 'forced_ocr' AS pdf_type, true AS needs_ocr, 1.0::DOUBLE AS confidence, 'Force OCR mode enabled by user' AS notes FROM documents")
def q5_forced(spark, d):
    a = analyze(_docs(spark, d), forced=F.lit(True))
    return a.select("doc_id", "analysis.pdf_type", "analysis.needs_ocr", "analysis.confidence", F.array_join("analysis.analysis_notes", _JOIN).alias("notes"))


@_query(
    "WITH s AS (SELECT doc_id, doc_id % 6 = 0 AS has_text_not, (doc_id % 11) / 10.0::DOUBLE AS score, doc_id % 3 = 0 AS script, doc_id % 7 AS found, doc_id % 19 AS total FROM documents) "
    "SELECT doc_id, CASE WHEN has_text_not THEN 'scanned' WHEN score >= 0.3 AND script THEN 'digital' WHEN score >= 0.3 THEN 'hybrid' WHEN found::DOUBLE / greatest(total, 1) < 0.3 THEN 'scanned' ELSE 'hybrid' END AS type, "
    "CASE WHEN has_text_not THEN 0.9::DOUBLE WHEN score >= 0.3 AND script THEN score WHEN score >= 0.3 THEN 0.6::DOUBLE WHEN found::DOUBLE / greatest(total, 1) < 0.3 THEN 0.8::DOUBLE ELSE 0.7::DOUBLE END AS confidence, "
    "(has_text_not OR NOT (score >= 0.3 AND script)) AS needs_ocr FROM s"
)
def q2_classify(spark, d):
    i = F.col("doc_id")
    k = ql.document_type(i % 6 != 0, (i % 11).cast("double") / 10.0, i % 3 == 0, i % 7, i % 19)
    return _docs(spark, d).withColumn("k", k).select("doc_id", "k.type", "k.confidence", "k.needs_ocr")


@_query(
    "WITH s AS (SELECT doc_id, doc_id % 120 AS n FROM documents) SELECT doc_id, n AS total_pages, array_to_string(CASE WHEN n <= 5 THEN range(0, n) ELSE list_sort(list_distinct([0, n - 1, n // 2, n // 3, 2 * (n // 3)])) END, ',') AS picks FROM s"
)
def q3_sample_pages(spark, d):
    n = F.col("doc_id") % 120
    return _docs(spark, d).select("doc_id", n.alias("total_pages"), F.array_join(ql.sample_pages(n), ",").alias("picks"))


@_query(f"SELECT doc_id, variant, {_script('text')} AS is_script FROM {_BOTH}")
def p1_script(spark, d):
    return _both(spark, d).select("doc_id", "variant", script.is_script("text").alias("is_script"))


_MARKED = f"(SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN text || {q(' '.join(MARKERS[:2]))} WHEN 2 THEN text || {q(' '.join(DAMAGE[:3]))} WHEN 3 THEN repeat('ÿ', 30) ELSE text || {q(MARKERS[3])} END AS text FROM {_BOTH})"


def _marked(spark, d):
    i, t = F.col("doc_id") % 5, F.col("text")
    x = F.when(i == 0, t).when(i == 1, F.concat(t, F.lit(" ".join(MARKERS[:2])))).when(i == 2, F.concat(t, F.lit(" ".join(DAMAGE[:3])))).when(i == 3, F.lit("ÿ" * 30)).otherwise(F.concat(t, F.lit(MARKERS[3])))
    return _both(spark, d).select("doc_id", "variant", x.alias("text"))


@_query(f"SELECT doc_id, {_encoded('text')} AS is_font_encoded FROM {_MARKED}")
def p2_font_encoding(spark, d):
    return _marked(spark, d).select("doc_id", script.is_font_encoded("text").alias("is_font_encoded"))


@_query(
    f"SELECT doc_id, variant, CASE WHEN {_blank('text')} THEN {q(ISSUES['blank'])} ELSE array_to_string(list_filter([CASE WHEN NOT {_script('text')} THEN {q(ISSUES['script'])} END, "
    f"CASE WHEN {_count('text', '^' + SCRIPT + SP + WORD + PUNCT)} > length(text) * 0.1::DOUBLE THEN {q(ISSUES['artifacts'])} END, CASE WHEN {_count('text', '.,!?;:')} / length(text)::DOUBLE > 0.3 THEN {q(ISSUES['punctuation'])} END, "
    f"CASE WHEN text <> nfc_normalize(text) THEN {q(ISSUES['form'])} END], lambda x: x IS NOT NULL), '{_JOIN}') END AS issues FROM {_BOTH}"
)
def p3_validation(spark, d):
    return _both(spark, d).select("doc_id", "variant", F.array_join(script.issues("text", rewrite.is_nfc("text")), _JOIN).alias("issues"))


_PC = lambda x: f"CASE WHEN length(text) > 0 THEN printf('%.1f', {x}::DOUBLE / length(text) * 100)::DOUBLE ELSE 0.0::DOUBLE END"
_ASC = _count("text", r"\x00-\x7F")


@_query(f"SELECT doc_id, variant, length(text) AS total, {_count('text', 'ಀ-೿')} AS script, {_PC(_count('text', 'ಀ-೿'))} AS script_pct, {_ASC} AS ascii, {_PC(_ASC)} AS ascii_pct, CASE WHEN length(text) > 0 THEN substr(text, 1, 100) ELSE 'No text' END AS sample FROM {_BOTH}")
def p4_profile(spark, d):
    return _both(spark, d).withColumn("p", script.profile("text")).select("doc_id", "variant", "p.*")


@_query(f"SELECT doc_id, variant, {_any('text', CORRUPTION)} AS corrupt, length(text) > 0 AND length({_clean('text')}) < length(text) * 0.1::DOUBLE AS over_cleaned, NOT ({_blank('text')}) AS nonblank FROM {_BOTH}")
def p6_flags(spark, d):
    return _both(spark, d).select("doc_id", "variant", script.looks_corrupt("text").alias("corrupt"), script.is_over_cleaned("text", rewrite.clean("text")).alias("over_cleaned"), (~script.is_blank("text")).alias("nonblank"))


@_query(f"SELECT doc_id, variant, {_normal('text')} AS text FROM {_BOTH}")
def t1_normalize(spark, d):
    return _both(spark, d).select("doc_id", "variant", rewrite.normalize("text").alias("text"))


@_query(f"SELECT doc_id, variant, {_rules(_replaced('text', LEGACY))} AS text FROM {_BOTH}")
def t2_font_dictionary(spark, d):
    return _both(spark, d).select("doc_id", "variant", rewrite.convert_font("text").alias("text"))


@_query(f"SELECT doc_id, {_replaced('text', MISREAD)} AS text FROM {_D}")
def t3_misread(spark, d):
    return _docs(spark, d).select("doc_id", rewrite.fix_misread("text").alias("text"))


@_query(f"SELECT doc_id, variant, {_rules('text')} AS text FROM {_BOTH}")
def t4_rules(spark, d):
    return _both(spark, d).select("doc_id", "variant", rewrite.apply_rules("text").alias("text"))


@_query(f"SELECT doc_id, variant, {_clean('text')} AS text FROM {_BOTH}")
def t5_clean(spark, d):
    return _both(spark, d).select("doc_id", "variant", rewrite.clean("text").alias("text"))


def _steps(source: str, forced: bool | None) -> str:
    """The repair as staged tables over (doc_id, t); forced None: where the column `forced` or the detection says so."""
    hit = "true" if forced else _encoded("t") if forced is False else f"(forced OR {_encoded('t')})"
    done = lambda x: _collapse(_normal(_clean(x)))
    return (
        f"r1 AS MATERIALIZED (SELECT * REPLACE ({_replaced('t', MISREAD)} AS t) FROM {source}), r2 AS MATERIALIZED (SELECT doc_id, CASE WHEN {hit} THEN {_rules(_rules(_replaced('t', LEGACY)))} ELSE t END AS t FROM r1), "
        f"r3 AS MATERIALIZED (SELECT doc_id, {done('t')} AS t FROM r2), r4 AS MATERIALIZED (SELECT doc_id, t, NOT {_script('t')} AND length(t) > 10 AS again, {_rules(_rules(_replaced('t', LEGACY)))} AS u FROM r3), "
        f"repaired AS MATERIALIZED (SELECT doc_id, CASE WHEN again THEN {done('u')} ELSE t END AS t FROM r4)"
    )


@_query(f"WITH src AS (SELECT doc_id, text AS t FROM {_D}), {_steps('src', False)} SELECT doc_id, t AS text FROM repaired")
def t6_repair(spark, d):
    return _docs(spark, d).select("doc_id", rewrite.repair("text").alias("text"))


@_query(
    f"WITH d AS MATERIALIZED (SELECT doc_id, text, {_blank('text')} AS blank, doc_id % 4 = 1 AS fonts, {_script('text')} AS script, {_encoded('text')} AS enc FROM {_D}), "
    f"light AS MATERIALIZED (SELECT doc_id, {_collapse(_normal('text'))} AS t FROM d), "
    f"heavy AS MATERIALIZED (SELECT d.doc_id, {_rules(_replaced('text', LEGACY))} AS t FROM d JOIN light USING (doc_id) WHERE NOT blank AND NOT (script AND NOT fonts) AND (fonts OR enc)), "
    f"again AS MATERIALIZED (SELECT doc_id, {_rules(_replaced('light.t', LEGACY))} AS t FROM d JOIN light USING (doc_id) WHERE NOT blank AND NOT script AND NOT fonts AND NOT enc AND NOT {_script('light.t')} AND length(light.t) > 20), "
    f"src AS (SELECT * FROM heavy UNION ALL SELECT * FROM again), {_steps('src', True)} "
    "SELECT d.doc_id, CASE WHEN d.blank THEN '' ELSE coalesce(r.t, light.t) END AS text FROM d JOIN light USING (doc_id) LEFT JOIN repaired r USING (doc_id)"
)
def t7_repair_digital(spark, d):
    return _docs(spark, d).select("doc_id", rewrite.repair_digital("text", F.col("doc_id") % 4 == 1).alias("text"))


@_query("SELECT page_id, CASE WHEN name IS NULL OR name = '' THEN " + q(NO_FILE) + " WHEN NOT ends_with(lower(name), '.pdf') THEN " + q(NOT_PDF) + " ELSE " + q(VALID) + " END AS status, regexp_replace(coalesce(name, ''), '[^\\p{L}\\p{N}._-]', '', 'g') AS safe FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN url || '.PDF' WHEN 2 THEN '' END AS name FROM pages)")
def s1_upload(spark, d):
    i = F.col("page_id") % 4
    name = F.when(i == 0, F.col("url")).when(i == 1, F.concat("url", F.lit(".PDF"))).when(i == 2, "")
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", names.upload_status(name).alias("status"), names.safe_name(name).alias("safe"))


_S9 = "(SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN source WHEN 2 THEN lang ELSE ' ' END AS t1, CASE doc_id % 5 WHEN 0 THEN lang WHEN 1 THEN text ELSE '' END AS t2, CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE text END AS t3, doc_id % 5 AS p1, doc_id % 7 AS p2, doc_id % 4 AS p3 FROM documents)"


@_query(
    f"WITH a AS (SELECT *, NOT ({_blank('t1')}) AS u1 FROM {_S9}), b AS (SELECT *, CASE WHEN u1 THEN t1 ELSE '' END AS x1, CASE WHEN u1 THEN p1 ELSE 0 END AS c1 FROM a), "
    f"c AS (SELECT *, length(x1) < 100 AND NOT ({_blank('t2')}) AS u2 FROM b), e AS (SELECT *, CASE WHEN u2 THEN x1 || chr(10) || t2 ELSE x1 END AS x2, CASE WHEN u2 THEN greatest(c1, p2) ELSE c1 END AS c2 FROM c), "
    f"f AS (SELECT *, length(x2) < 50 AND NOT ({_blank('t3')}) AS u3 FROM e) SELECT doc_id, CASE WHEN u3 THEN x2 || chr(10) || t3 ELSE x2 END AS text, (u1 OR u2 OR u3) AS has_text_layer, CASE WHEN u3 THEN greatest(c2, p3) ELSE c2 END AS pages_with_text, "
    f"array_to_string(list_filter([CASE WHEN u1 THEN format('PyMuPDF extracted {{}} chars from {{}} pages', length(t1), p1) END, CASE WHEN u2 THEN format('pdfplumber extracted {{}} chars', length(t2)) END, CASE WHEN u3 THEN format('PyPDF2 extracted {{}} chars', length(t3)) END], lambda x: x IS NOT NULL), '{_JOIN}') AS notes FROM f"
)
def s9_cascade(spark, d):
    i = F.col("doc_id")
    first = F.when(i % 4 == 0, F.col("text")).when(i % 4 == 1, F.col("source")).when(i % 4 == 2, F.col("lang")).otherwise(" ")
    second = F.when(i % 5 == 0, F.col("lang")).when(i % 5 == 1, F.col("text")).otherwise("")
    x = spread(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "source", "text")).select("doc_id", first.alias("t1"), second.alias("t2"), F.when(i % 3 == 0, " ").otherwise(F.col("text")).alias("t3"))
    x = x.withColumn("c", pg.cascade(F.col("t1"), F.col("t2"), F.col("t3"), (i % 5, i % 7, i % 4)))
    return x.select("doc_id", "c.text", "c.has_text_layer", "c.pages_with_text", F.array_join("c.notes", _JOIN).alias("notes"))


@_query(
    f"SELECT doc_id, {_any('lower(text)', [f.lower() for f in FONTS])} OR doc_id % 9 = 0 AS legacy_fonts, array_to_string(list_filter([CASE WHEN doc_id % 4 = 0 THEN 'PDF is encrypted' END, "
    f"CASE WHEN {_any('c', SCANNERS)} OR {_any('p', SCANNERS)} THEN 'Scanner software detected: ' || CASE WHEN c <> '' THEN c ELSE p END END], lambda x: x IS NOT NULL), '{_JOIN}') AS notes "
    "FROM (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN 'camscanner 5' WHEN 1 THEN '' ELSE 'writer' END AS c, CASE doc_id % 5 WHEN 0 THEN 'acrobat x' ELSE 'lib' END AS p FROM documents)"
)
def s10_file_notes(spark, d):
    i = F.col("doc_id")
    fonts = F.array(F.col("text"), F.when(i % 9 == 0, "ABC+BRH-Kannada").otherwise("Arial"))
    creator, producer = F.when(i % 3 == 0, "CamScanner 5").when(i % 3 == 1, None).otherwise("Writer"), F.when(i % 5 == 0, "Acrobat X").otherwise("Lib")
    return _docs(spark, d).select("doc_id", pg.has_legacy_font(fonts).alias("legacy_fonts"), F.array_join(pg.file_notes(i % 4 == 0, creator, producer), _JOIN).alias("notes"))


# pages of files as three extractors see them: a conversation is a file, its turns are the pages
_E = f"""
raw AS (SELECT conv_id AS doc_id, turn AS page_index, role, coalesce(text, '') AS text, count(*) OVER (PARTITION BY conv_id) AS total, conv_id % 11 = 0 AS fallback FROM conversations),
picked AS (SELECT *, list_contains(CASE WHEN fallback THEN [0] WHEN total <= 5 THEN range(0, total) ELSE [0, total - 1, total // 2, total // 3, 2 * (total // 3)] END, page_index) AS sampled FROM raw),
seen AS (SELECT doc_id, page_index, total, fallback, CASE doc_id % 4 WHEN 0 THEN ' ' WHEN 1 THEN role WHEN 2 THEN text ELSE {_replaced('text', MISREAD)} END AS t1,
  CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN role ELSE text END AS t2, CASE WHEN page_index % 2 = 0 THEN text ELSE ' ' END AS t3 FROM picked WHERE sampled),
files AS (SELECT doc_id, max(total)::INT AS total, bool_or(fallback) AS fallback, {', '.join(f"coalesce(string_agg(t{e} || chr(10) || chr(10), '' ORDER BY page_index) FILTER (WHERE NOT ({_blank(f't{e}')})), '') AS x{e}, count(*) FILTER (WHERE NOT ({_blank(f't{e}')}))::INT AS p{e}" for e in (1, 2, 3))},
  doc_id % 13 = 5 AS broken, doc_id % 17 = 3 AS forced, doc_id % 6 = 0 AS encrypted, CASE doc_id % 3 WHEN 0 THEN 'camscanner 5' WHEN 1 THEN '' ELSE 'writer' END AS c, CASE doc_id % 5 WHEN 0 THEN 'acrobat x' ELSE 'lib' END AS p FROM seen GROUP BY doc_id),
c2 AS (SELECT *, length(x1) < 100 AND x2 <> '' AS u2, CASE WHEN length(x1) < 100 AND x2 <> '' THEN x1 || chr(10) || x2 ELSE x1 END AS a2 FROM files),
c3 AS (SELECT *, length(a2) < 50 AND x3 <> '' AS u3, CASE WHEN length(a2) < 50 AND x3 <> '' THEN a2 || chr(10) || x3 ELSE a2 END AS a3 FROM c2),
whole AS (SELECT *, greatest(p1, CASE WHEN u2 THEN p2 ELSE 0 END, CASE WHEN u3 THEN p3 ELSE 0 END) AS found, list_concat(CASE WHEN fallback THEN [{q(FALLBACK)}] ELSE
    [CASE WHEN encrypted THEN 'PDF is encrypted' END, CASE WHEN {_any('c', SCANNERS)} OR {_any('p', SCANNERS)} THEN 'Scanner software detected: ' || CASE WHEN c <> '' THEN c ELSE p END END] END,
  [CASE WHEN x1 <> '' THEN format('PyMuPDF extracted {{}} chars from {{}} pages', length(x1), p1) END, CASE WHEN u2 THEN format('pdfplumber extracted {{}} chars', length(x2)) END, CASE WHEN u3 THEN format('PyPDF2 extracted {{}} chars', length(x3)) END]) AS own FROM c3),
{_quality('(SELECT doc_id, 0 AS variant, a3 AS text FROM whole)')},
judged AS (SELECT w.*, k.blank, k.script, k.score, k.t, k.notes, found::DOUBLE / greatest(total, 1) < 0.3 AS sparse, forced OR broken AS fixed FROM whole w JOIN quality k USING (doc_id))"""


@_query(
    f"WITH {_E} SELECT doc_id, CASE WHEN forced THEN 'forced_ocr' WHEN broken THEN 'unknown' WHEN blank THEN 'scanned' WHEN score >= 0.3 AND script THEN 'digital' WHEN score >= 0.3 THEN 'hybrid' WHEN sparse THEN 'scanned' ELSE 'hybrid' END AS pdf_type, "
    "NOT fixed AND NOT blank AS has_text_layer, CASE WHEN fixed THEN 0.0::DOUBLE ELSE score END AS score, CASE WHEN broken AND NOT forced THEN 1 ELSE total END AS total_pages, CASE WHEN fixed THEN 0 ELSE found END AS pages_with_text, "
    "CASE WHEN fixed OR blank THEN '' ELSE substr(t, 1, 200) END AS sample_text, CASE WHEN NOT fixed AND NOT blank AND script THEN 'kannada' ELSE '' END AS languages, fixed OR blank OR NOT (score >= 0.3 AND script) AS needs_ocr, "
    "CASE WHEN forced THEN 1.0::DOUBLE WHEN broken THEN 0.5::DOUBLE WHEN blank THEN 0.9::DOUBLE WHEN score >= 0.3 AND script THEN score WHEN score >= 0.3 THEN 0.6::DOUBLE WHEN sparse THEN 0.8::DOUBLE ELSE 0.7::DOUBLE END AS confidence, "
    f"CASE WHEN forced THEN 'Force OCR mode enabled by user' WHEN broken THEN 'Analysis failed: broken{_JOIN}Defaulting to OCR for safety' ELSE array_to_string(list_filter(own || [notes], lambda x: x IS NOT NULL), '{_JOIN}') END AS notes FROM judged"
)
def q4_files(spark, d):
    i, t = F.col("doc_id"), F.coalesce("text", F.lit(""))
    c = spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page_index"), "role", t.alias("text"))
    c = c.withColumn("total_pages", F.count("*").over(Window.partitionBy("doc_id")).cast("int")).withColumn("misread", rewrite.fix_misread("text"))
    first = F.when(i % 4 == 0, " ").when(i % 4 == 1, F.col("role")).when(i % 4 == 2, F.col("text")).otherwise(F.col("misread"))
    second = F.when(i % 3 == 0, "").when(i % 3 == 1, F.col("role")).otherwise(F.col("text"))
    third = F.when(F.col("page_index") % 2 == 0, F.col("text")).otherwise(" ")
    seen = F.inline(F.array(*[F.struct(F.lit(e).alias("extractor"), x.alias("page_text")) for e, x in enumerate((first, second, third), 1)]))
    told = {
        "encrypted": i % 6 == 0, "creator": F.when(i % 3 == 0, "CamScanner 5").when(i % 3 == 2, "Writer"), "producer": F.when(i % 5 == 0, "Acrobat X").otherwise("Lib"),
        "fallback": i % 11 == 0, "error": F.when(i % 13 == 5, "broken"),
    }
    pages = c.select("doc_id", "page_index", "total_pages", seen).withColumns(told)
    a = analyze_pages(pages, "doc_id", forced=i % 17 == 3)
    r = "analysis."
    return a.select(
        "doc_id", r + "pdf_type", r + "has_text_layer", F.col(r + "text_quality_score").alias("score"), r + "total_pages", r + "pages_with_text", r + "sample_text", F.array_join(r + "detected_languages", ",").alias("languages"),
        r + "needs_ocr", r + "confidence", F.array_join(r + "analysis_notes", _JOIN).alias("notes"),
    )


def _status(x: str) -> str:
    return f"CASE WHEN {_blank(x)} THEN 'blank' WHEN {_encoded(x)} THEN 'legacy' WHEN NOT {_script(x)} THEN 'no_script' ELSE 'success' END"


@_query(f"SELECT doc_id, {_status('text')} AS digital, CASE WHEN {_blank('text')} THEN 'blank' WHEN NOT {_script('text')} THEN 'no_script' ELSE 'success' END AS scanned FROM {_MARKED}")
def p10_status(spark, d):
    t = F.col("text")
    return _marked(spark, d).select("doc_id", pg.conversion_status(t, False).alias("digital"), pg.conversion_status(t, True).alias("scanned"))


@_query(
    f"SELECT doc_id, coalesce(string_agg(page_text || chr(10) || chr(10), '' ORDER BY page_num) FILTER (WHERE NOT ({_blank('page_text')})), '') AS text, count(*) AS total_pages, count(*) FILTER (WHERE NOT ({_blank('page_text')})) AS pages_with_text, "
    f"count(*) FILTER (WHERE NOT ({_blank('page_text')})) || '/' || count(*) AS summary FROM {_P} GROUP BY doc_id"
)
def a1_assembly(spark, d):
    return pg.assemble(_pages(spark, d)).withColumn("summary", pg.summary(F.col("pages_with_text"), F.col("total_pages")))


@_query(f"SELECT doc_id, CASE WHEN {_blank(_normal('t'))} THEN {q(DIGITAL_PLACEHOLDER)} ELSE {_normal('t')} END AS text FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN ' ' ELSE text END AS t FROM documents)")
def a8_final_text(spark, d):
    t = F.when(F.col("doc_id") % 10 == 0, " ").otherwise(F.col("text"))
    return _docs(spark, d).select("doc_id", pg.final_text(rewrite.normalize(t)).alias("text"))


@_query("SELECT conv_id AS doc_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS page_num, turn < max(turn) OVER (PARTITION BY conv_id) AS page_break, row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 3 AS within_limit FROM conversations")
def w1_page_numbers(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("doc_id"), "turn")
    return pg.numbered(c, pos="turn", vision_pages=3)


@_query(f"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda p: {_strip('p')}), lambda p: p <> ''), '{_JOIN}') AS paragraphs FROM {_D}")
def k4_paragraphs(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(pg.paragraphs(F.replace("text", F.lit("\n"), F.lit("\n\n"))), _JOIN).alias("paragraphs"))


# recognised pages: each text of _marked, blank for every seventh document; markers in the raw text force the font dictionary
_RAW = f"(SELECT doc_id, variant, CASE WHEN doc_id % 7 = 0 THEN ' ' ELSE text END AS t FROM (SELECT doc_id, variant, CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN text || {q(' '.join(MARKERS[-2:]))} WHEN 2 THEN text || {q(' '.join(DAMAGE[:3]))} WHEN 3 THEN repeat('ÿ', 30) ELSE text || {q(MARKERS[4])} END AS text FROM {_BOTH}))"
_KEYED = f"(SELECT 2 * doc_id + variant AS doc_id, t, {_encoded('t')} AS forced FROM {_RAW})"


def _raw(spark, d):
    i, t = F.col("doc_id") % 5, F.col("text")
    x = F.when(i == 0, t).when(i == 1, F.concat(t, F.lit(" ".join(MARKERS[-2:])))).when(i == 2, F.concat(t, F.lit(" ".join(DAMAGE[:3])))).when(i == 3, F.lit("ÿ" * 30)).otherwise(F.concat(t, F.lit(MARKERS[4])))
    return _both(spark, d).select((2 * F.col("doc_id") + F.col("variant")).alias("doc_id"), F.when(F.col("doc_id") % 7 == 0, " ").otherwise(x).alias("t"))


@_query(f"WITH src AS MATERIALIZED (SELECT * FROM {_KEYED}), {_steps('src', None)} SELECT s.doc_id, CASE WHEN {_blank('s.t')} THEN '' ELSE r.t END AS text FROM src s JOIN repaired r USING (doc_id)")
def t8_recognised(spark, d):
    return _raw(spark, d).select("doc_id", rewrite.repair_recognised("t").alias("text"))


@_query(f"SELECT doc_id, CASE WHEN {_blank('t')} THEN '' ELSE {_normal('t')} END AS text FROM (SELECT 2 * doc_id + variant AS doc_id, t FROM {_RAW})")
def t8_debug(spark, d):
    return _raw(spark, d).select("doc_id", rewrite.repair_recognised("t", debug=True).alias("text"))


# a file's pages: two rows of _raw
_FILED = "SELECT doc_id // 4 AS doc_id, (doc_id % 4 + 1)::INT AS page_num"
_ASSEMBLED = f"coalesce(string_agg(page_text || chr(10) || chr(10), '' ORDER BY page_num) FILTER (WHERE NOT ({_blank('page_text')})), '')"


def _filed(spark, d):
    i = F.col("doc_id")
    return _raw(spark, d).select(F.expr("doc_id div 4").alias("doc_id"), (i % 4 + 1).cast("int").alias("page_num"), F.col("t").alias("page_text"))


@_query(
    f"WITH src AS MATERIALIZED (SELECT * FROM {_KEYED}), {_steps('src', None)}, p AS ({_FILED}, CASE WHEN {_blank('s.t')} THEN '' ELSE r.t END AS page_text FROM src s JOIN repaired r USING (doc_id)), "
    f"a AS (SELECT doc_id, {_ASSEMBLED} AS t, count(*) AS total_pages, count(*) FILTER (WHERE NOT ({_blank('page_text')})) AS pages_with_text FROM p GROUP BY doc_id), b AS (SELECT *, {_normal('t')} AS n FROM a), c AS (SELECT *, CASE WHEN {_blank('n')} THEN {q(RECOGNISED_PLACEHOLDER)} ELSE n END AS text FROM b) "
    f"SELECT doc_id, text, total_pages, pages_with_text, pages_with_text || '/' || total_pages AS summary, CASE WHEN {_blank('text')} THEN 'blank' WHEN NOT {_script('text')} THEN 'no_script' ELSE 'success' END AS status FROM c"
)
def r6_scanned(spark, d):
    return flows.scanned(_filed(spark, d))


_DIGITAL = (
    f"WITH p AS ({_FILED}, t AS page_text FROM (SELECT 2 * doc_id + variant AS doc_id, t FROM {_RAW})), a AS (SELECT doc_id, {_ASSEMBLED} AS text, count(*) AS total_pages, count(*) FILTER (WHERE NOT ({_blank('page_text')})) AS pages_with_text, bool_or(page_num = 1 AND doc_id % 3 = 0) AS fonts, max(CASE WHEN page_num = 2 AND doc_id % 11 = 5 THEN 'bad page' END) AS error FROM p GROUP BY doc_id), "
    f"d AS MATERIALIZED (SELECT *, {_blank('text')} AS blank, {_script('text')} AS script, {_encoded('text')} AS enc FROM a), light AS MATERIALIZED (SELECT doc_id, {_collapse(_normal('text'))} AS t FROM d), "
    f"heavy AS MATERIALIZED (SELECT d.doc_id, {_rules(_replaced('text', LEGACY))} AS t FROM d WHERE NOT blank AND NOT (script AND NOT fonts) AND (fonts OR enc)), "
    f"again AS MATERIALIZED (SELECT doc_id, {_rules(_replaced('light.t', LEGACY))} AS t FROM d JOIN light USING (doc_id) WHERE NOT blank AND NOT script AND NOT fonts AND NOT enc AND NOT {_script('light.t')} AND length(light.t) > 20), "
    f"src AS (SELECT * FROM heavy UNION ALL SELECT * FROM again), {_steps('src', True)}, "
    f"o AS (SELECT d.doc_id, total_pages, pages_with_text, CASE WHEN error IS NOT NULL THEN {q(FAILED)} || error WHEN d.blank THEN {q(DIGITAL_PLACEHOLDER)} WHEN {_blank('coalesce(r.t, light.t)')} THEN {q(EMPTIED)} ELSE coalesce(r.t, light.t) END AS text, CASE WHEN error IS NOT NULL THEN 'text' WHEN d.blank THEN 'bold' WHEN {_blank('coalesce(r.t, light.t)')} THEN 'italic' ELSE 'text' END AS kind FROM d JOIN light USING (doc_id) LEFT JOIN repaired r USING (doc_id)) "
)


def _digital(spark, d, kinds=False):
    i, n = F.col("doc_id"), F.col("page_num")
    return flows.digital(_filed(spark, d), (n == 1) & (i % 3 == 0), F.when((n == 2) & (i % 11 == 5), "bad page"), kinds)


@_query(
    _DIGITAL + f"SELECT doc_id, text, total_pages, pages_with_text, {_status('text')} AS status FROM o"
)
def r6_digital(spark, d):
    return _digital(spark, d)


@_query(_DIGITAL + "SELECT doc_id || '.docx' AS file, 1 AS side, 0 AS seq, kind, text FROM o")
def k2_digital_document(spark, d):
    return docsink.digital_rows(_digital(spark, d, kinds=True)).select("file", "side", "seq", "kind", "text")


@_query("SELECT doc_id, page_num, CASE WHEN " + _blank("a") + " THEN b ELSE a END AS page_text FROM (SELECT conv_id AS doc_id, turn + 1 AS page_num, CASE WHEN turn % 3 = 1 THEN ' ' ELSE text END AS a, CASE WHEN turn % 2 = 1 THEN role ELSE '' END AS b FROM conversations)")
def s5_layout_retry(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    p = c.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page_num"), F.when(F.col("turn") % 3 == 1, " ").otherwise(F.col("text")).alias("a"), F.when(F.col("turn") % 2 == 1, F.col("role")).alias("b"))
    return flows.coalesced_pages(p, "a", "b").select("doc_id", "page_num", "page_text")


@_query(
    f"SELECT doc_id, 'unknown' AS pdf_type, false AS has_text_layer, 0.0::DOUBLE AS score, 1 AS total_pages, 0 AS pages_with_text, '' AS sample_text, '' AS languages, true AS needs_ocr, 0.5::DOUBLE AS confidence, {q(FAILURE_NOTES[0].replace('%s', ''))} || lang || {q(_JOIN + FAILURE_NOTES[1])} AS notes FROM documents WHERE doc_id % 2 = 0 "
    f"UNION ALL SELECT doc_id, 'forced_ocr', false, 0.0, 9, 0, '', '', true, 1.0, 'Force OCR mode enabled by user' FROM documents WHERE doc_id % 2 = 1"
)
def q4_unknown(spark, d):
    i = F.col("doc_id") % 2
    a = analyze(_docs(spark, d), total_pages=F.lit(9), forced=i == 1, error=F.col("lang"))
    return a.select("doc_id", "analysis.pdf_type", "analysis.has_text_layer", F.col("analysis.text_quality_score").alias("score"), "analysis.total_pages", "analysis.pages_with_text", "analysis.sample_text", F.array_join("analysis.detected_languages", ",").alias("languages"), "analysis.needs_ocr", "analysis.confidence", F.array_join("analysis.analysis_notes", _JOIN).alias("notes"))


def _shown(b):
    return F.array_join(F.transform("blocks", lambda x: F.concat(x["kind"], F.lit("|"), F.coalesce(x["text"], F.lit("")))), _JOIN).alias(b)


def _sql_format(pattern: str, *values: str) -> str:
    parts = pattern.replace("%s", "%d").split("%d")
    return " || ".join([q(parts[0]), *(f"{v} || {q(p)}" for v, p in zip(values, parts[1:], strict=True))])


_LINES = (
    f"CASE WHEN error IS NOT NULL THEN 'italic|' || {_sql_format(PAGE_FAILED, 'page_num', 'error')} ELSE 'heading|' || {_sql_format(PAGE_HEADING, 'page_num')} || '{_JOIN}' || CASE WHEN {_blank('page_text')} THEN {q('italic|' + NO_TEXT)} ELSE 'text|' || page_text END END"
    f" || CASE WHEN page_num < max(page_num) OVER (PARTITION BY doc_id) THEN '{_JOIN}break|' ELSE '' END"
)


_ROW = "FROM (SELECT doc_id || '.docx' AS file, page_num, (page_num > 1)::INT AS after, page_num = 3 AS bad, page_text, " + _blank("page_text") + f" AS empty FROM {_P})"


@_query(
    f"SELECT file, page_num AS page, 0 AS seq, 'break' AS kind, NULL AS text {_ROW} WHERE page_num > 1 UNION ALL SELECT file, page_num, after, 'italic', printf({q(PAGE_FAILED)}, page_num, 'x') {_ROW} WHERE bad "
    f"UNION ALL SELECT file, page_num, after, 'heading', printf({q(PAGE_HEADING)}, page_num) {_ROW} WHERE NOT bad UNION ALL SELECT file, page_num, after + 1, CASE WHEN empty THEN 'italic' ELSE 'text' END, CASE WHEN empty THEN {q(NO_TEXT)} ELSE page_text END {_ROW} WHERE NOT bad "
    f"UNION ALL SELECT file, 2147483647, 0, 'bold', printf({q(SUMMARY)}, count(*) FILTER (WHERE NOT bad AND NOT empty), count(*)) {_ROW} GROUP BY file"
)
def k3_streamed_document(spark, d):
    p = _pages(spark, d).withColumn("error", F.when(F.col("page_num") == 3, "x"))
    return docsink.recognised_rows(p, error="error").select("file", "page", "seq", "kind", "text")


@_query(
    f"WITH p AS (SELECT *, CASE WHEN page_num = 3 THEN 'x' END AS error FROM {_P}), l AS (SELECT doc_id, page_num, page_text, error, {_LINES} AS line FROM p) "
    f"SELECT doc_id, string_agg(line, '{_JOIN}' ORDER BY page_num) || '{_JOIN}bold|' || {_sql_format(SUMMARY, f'count(*) FILTER (WHERE error IS NULL AND NOT ({_blank(chr(112) + "age_text")}))', 'count(*)')} AS blocks FROM l GROUP BY doc_id"
)
def k3_recognised_document(spark, d):
    p = _pages(spark, d).withColumn("error", F.when(F.col("page_num") == 3, "x"))
    return pg.recognised_blocks(p, error="error").select("doc_id", _shown("blocks"))


@_query(
    f"WITH p AS (SELECT doc_id, page_num, page_text, unnest(list_filter(list_transform(string_split(page_text, '. '), lambda x: {_strip('x')}), lambda x: x <> '')) AS para FROM {_P}), "
    f"w AS (SELECT doc_id, page_num, (CASE WHEN page_num > 1 THEN 'break|{_JOIN}' ELSE '' END) || string_agg('text|' || para, '{_JOIN}') AS line FROM (SELECT *, row_number() OVER () AS r FROM p) GROUP BY doc_id, page_num), a AS (SELECT DISTINCT doc_id FROM {_P}) "
    f"SELECT a.doc_id, coalesce((SELECT string_agg(line, '{_JOIN}' ORDER BY page_num) FROM w WHERE w.doc_id = a.doc_id), '') AS blocks FROM a"
)
def k4_simple_document(spark, d):
    p = _pages(spark, d).withColumn("page_text", F.replace("page_text", F.lit(". "), F.lit("\n\n")))
    return pg.simple_blocks(p).select("doc_id", _shown("blocks"))


@_query(f"SELECT conv_id AS doc_id, turn, {_sql_format(PAGE_OF, 'turn + 1', 'max(turn + 1) OVER (PARTITION BY conv_id)')} AS header FROM conversations")
def k7_page_header(spark, d):
    c = pg.numbered(spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("doc_id"), "turn"), pos="turn")
    return c.select("doc_id", "turn", pg.page_header(F.col("turn") + 1, F.max(F.col("turn") + 1).over(Window.partitionBy("doc_id"))).alias("header"))


@_query(
    "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN " + q(NOT_VALID) + " WHEN 1 THEN source || ': ' || lang WHEN 2 THEN " + q(NO_COMPONENTS) + " WHEN 3 THEN " + q(NO_PERMISSION) + " WHEN 4 THEN " + q(UNEXPECTED.replace("%s", "")) + " || source || ': ' || lang END AS message FROM documents"
)
def k12_messages(spark, d):
    i = F.col("doc_id") % 6
    kind = F.when(i == 0, "PdfReadError").when(i == 1, "ValueError").when(i == 2, "FileNotFoundError").when(i == 3, "PermissionError").when(i == 4, "KeyError")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", names.error_message(F.concat(kind, F.lit(": "), "source", F.lit(": "), "lang")).alias("message"))


# -- extensions: joins by time, windows, sketches, runs ---------------------------------------------------------------

_EVENTS = "(SELECT event_id, epoch_us(ts) AS t, ts, user_id, event_type, value FROM events)"


def _events(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value").withColumn("t", F.unix_micros("ts"))


@_query(
    f"SELECT a.event_id, b.event_id AS signup_id, b.value AS signup_value FROM (SELECT * FROM {_EVENTS} WHERE event_type = 'purchase') a "
    f"ASOF LEFT JOIN (SELECT user_id, t, arg_max(event_id, (value, event_id)) AS event_id, max(value) AS value FROM {_EVENTS} WHERE event_type = 'signup' GROUP BY user_id, t) b ON a.user_id = b.user_id AND a.t >= b.t"
)
def x_asof_join(spark, d):
    e = _events(spark, d)
    right = e.filter("event_type = 'signup'").select("user_id", F.col("t").alias("at"), F.col("value").alias("signup_value"), F.col("event_id").alias("signup_id"))
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", "t")
    return joins.asof_join(left, right, ["user_id"], "t", "at", ["signup_value", "signup_id"]).select("event_id", "signup_id", "signup_value")


_SPANS = f"(SELECT event_id, user_id, event_type, t // 1000000 AS s, t // 1000000 + (value * value)::BIGINT + CASE WHEN event_id % 97 = 0 THEN 2000000 ELSE 0 END AS e FROM {_EVENTS})"


@_query(f"SELECT a.event_id, b.event_id AS other_id, least(a.e, b.e) - greatest(a.s, b.s) AS seconds FROM {_SPANS} a JOIN {_SPANS} b ON a.user_id = b.user_id AND a.s < b.e AND b.s < a.e WHERE a.event_type = 'error' AND b.event_type = 'view' AND a.s < a.e AND b.s < b.e")
def x_interval_join(spark, d):
    e = _events(spark, d).withColumn("s", F.floor(F.col("t") / 1_000_000).cast("long"))
    end = F.col("s") + F.round(F.col("value") * F.col("value")).cast("long") + F.when(F.col("event_id") % 97 == 0, 2_000_000).otherwise(0)
    e = e.withColumn("e", end)
    a = e.filter("event_type = 'error'").select(F.col("s").alias("start"), F.col("e").alias("end"), "user_id", "event_id")
    b = e.filter("event_type = 'view'").select(F.col("s").alias("r_start"), F.col("e").alias("r_end"), "user_id", F.col("event_id").alias("other_id"))
    return joins.interval_join(a, b, ["user_id"]).select("event_id", "other_id", (F.least("end", "r_end") - F.greatest("start", "r_start")).alias("seconds"))


_SUMS = "count(*) AS n, sum(round(value * 1000000)::BIGINT)::BIGINT AS total, max(value) AS largest"


@_query(f"SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01')) AS start, event_type, {_SUMS} FROM {_EVENTS} GROUP BY 1, 2")
def x_tumbling_windows(spark, d):
    return windows.summed(_events(spark, d), windows.tumbling("ts", "1 hour"), ["event_type"]).select(F.unix_micros("start").alias("start"), "event_type", "n", "total", "largest")


@_query(f"SELECT (t // 1800000000 - k) * 1800000000 AS start, event_type, {_SUMS} FROM {_EVENTS}, (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2")
def x_sliding_windows(spark, d):
    return windows.summed(_events(spark, d), windows.sliding("ts", "1 hour", "30 minutes"), ["event_type"]).select(F.unix_micros("start").alias("start"), "event_type", "n", "total", "largest")


@_query(
    f"WITH g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t, event_id) AS run FROM (SELECT *, (coalesce(t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id), 7200000000) >= 7200000000)::INT AS fresh FROM {_EVENTS})) "
    f"SELECT min(t) AS start, max(t) + 7200000000 AS end_, user_id, {_SUMS} FROM g GROUP BY user_id, run"
)
def x_session_windows(spark, d):
    return windows.summed(_events(spark, d), windows.session("ts", "2 hours"), ["user_id"]).select(F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end_"), "user_id", "n", "total", "largest")


@_query(f"SELECT day, event_type, grouping(day, event_type) AS g, count(*) AS n, sum(round(value * 1000000)::BIGINT)::BIGINT AS total FROM (SELECT *, strftime(ts, '%Y-%m-%d') AS day FROM {_EVENTS}) GROUP BY ROLLUP (day, event_type)")
def x_sketches(spark, d):
    e = _events(spark, d).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    daily = sketches.sketched(e, ["day", "event_type"])
    r = sketches.rolled_up(daily, ["day", "event_type"])
    return r.select("day", "event_type", F.expr("shiftleft(1, level) - 1").cast("long").alias("g"), "n", "total")


@_query(
    f"WITH p AS (SELECT doc_id, page_num, page_num % 3 <> 0 AND NOT (doc_id % 2 = 0) AS odd, page_text FROM {_P} WHERE (doc_id + page_num) % 5 <> 0), n AS (SELECT *, (page_num - coalesce(lag(page_num) OVER w, -9) > 1 OR odd IS DISTINCT FROM lag(odd) OVER w)::INT AS fresh FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY page_num)), "
    "r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY page_num)::BIGINT AS run FROM n) SELECT doc_id, run, min(page_num) AS first_page, max(page_num) AS last_page, bool_or(odd) AS odd, count(*) AS n FROM r GROUP BY doc_id, run"
)
def x_page_runs(spark, d):
    p = _pages(spark, d).filter((F.col("doc_id") + F.col("page_num")) % 5 != 0).withColumn("odd", (F.col("page_num") % 3 != 0) & (F.col("doc_id") % 2 != 0))
    r = runs.with_runs(p, F.col("odd"))
    return r.groupBy("doc_id", "run").agg(F.min("page_num").alias("first_page"), F.max("page_num").alias("last_page"), F.bool_or("odd").alias("odd"), F.count("*").alias("n"))



def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _ALL.items()}
