"""Line de-duplication: lines that many documents share stay in one document only.

Lines are exploded and normalised, their 128-bit hashes counted over distinct documents, lines over the threshold
dropped, and each text put together again by position. All of it is Spark SQL on the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, UPPER, defined_id, named, stored, with_group


def _line_keys(text: Column) -> Column:
    """For each \\n-split line, its normalised form: white space stripped at both ends, A-Z in lower case."""
    return F.transform(F.split(F.translate(text, UPPER, LOWER), "\n", -1), lambda x: F.trim(x, F.lit(SPACE)))


def _without(text: Column, drops: Column) -> Column:
    """The lines of the text without those at the positions `drops`. The lambda's argument holds the lines, which are
    split once; the positions are subtracted by hashing, so long texts take linear time."""
    lines = F.split(text, "\n", -1)
    held = F.array(F.struct(lines.alias("lines"), F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drops).alias("at")))
    return F.array_join(F.element_at(F.transform(held, lambda h: F.transform(h["at"], lambda i: F.get(h["lines"], i))), 1), "\n")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs with `text_col` cleaned, and the columns `n_lines` and `n_dropped` (long).

    A line goes if its key has at least `min_chars` code points and occurs in at least `min_docs` distinct ids,
    unless this document has the largest id of those. A null or empty text is one empty line and stays empty
    (null becomes ''). Rows with equal ids count as one document, each row being cleaned alike; a null id is one
    document with the smallest id. Very long texts are taken
    apart and joined in time linear in their lines. Other columns pass through; an input column named like an added one
    is replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # rows of one id with different texts have lines of their own
    place = [defined_id(id_col).alias("_line_dedup_id"), F.xxhash64(text).alias("_line_dedup_row")]
    # placed before lines are exploded, or each line would hash its whole text again
    lines = docs.select(*place, text.alias("_text")).select("_line_dedup_id", "_line_dedup_row", F.posexplode(_line_keys(F.col("_text"))).alias("_pos", "_key"))
    lines = lines.filter(F.length("_key") >= min_chars).select("_line_dedup_id", "_line_dedup_row", "_pos", F.xxhash64("_key").alias("h1"), F.xxhash64(F.lit(1), "_key").alias("h2"))
    lines = stored(lines, "lines")  # read twice, for the groups and for the lines in them
    shared = with_group(lines, ["h1", "h2"], [F.count_distinct("_line_dedup_id").alias("_n"), F.max("_line_dedup_id").alias("_last")], ["_line_dedup_id", "_line_dedup_row", "_pos"], having=F.col("_n") >= min_docs)
    drops = shared.filter(F.col("_line_dedup_id") != F.col("_last")).groupBy("_line_dedup_id", "_line_dedup_row").agg(F.collect_set("_pos").alias("_line_dedup_drops"))
    joined = docs.select("*", *place).join(drops, ["_line_dedup_id", "_line_dedup_row"], "left")
    n_lines = F.size(F.split(text, "\n", -1)).cast("long")
    kept = F.when(F.col("_line_dedup_drops").isNull(), text).otherwise(_without(text, F.col("_line_dedup_drops")))
    return joined.select(
        *[kept.alias(c) if c == text_col else named(c) for c in docs.columns if c not in ("n_lines", "n_dropped")],
        n_lines.alias("n_lines"),
        F.coalesce(F.size("_line_dedup_drops"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """The contract's row per document: doc_id, n_lines, n_dropped, kept_sha256."""
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


#: DuckDB SQL for digest().
SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS line, len(ls) AS n_lines
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), keyed AS (
  SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k FROM lines
), shared AS (
  SELECT k, max(doc_id) AS last_id FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
)
SELECT l.doc_id, max(n_lines)::BIGINT AS n_lines,
  count(*) FILTER (WHERE s.k IS NOT NULL AND l.doc_id <> s.last_id)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE s.k IS NULL OR l.doc_id = s.last_id), '')) AS kept_sha256
FROM keyed l LEFT JOIN shared s ON l.k = s.k
GROUP BY l.doc_id
"""
