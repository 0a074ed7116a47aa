"""The named queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumgrid.llm import leakage, neardup, packing, splitting, truncation
from vellumgrid.runtime import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    starts = splitting.section_starts(table(spark, d, "corpus_files"), "file_id", "content")
    return starts.where(F.col("level") >= 0).select(F.col("id").alias("file_id"), "line_no")


def p1_ranges(spark: SparkSession, d: str) -> DataFrame:
    """The rows of ``p1_found`` from ranges of 1 KiB."""
    starts = splitting.section_starts(table(spark, d, "corpus_files"), "file_id", "content", range_bytes=1 << 10)
    return starts.where(F.col("level") >= 0).select(F.col("id").alias("file_id"), "line_no")


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_texts(table(spark, d, "corpus_files"), "file_id", "content").withColumnRenamed("id", "file_id")


def _near(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return neardup.near_duplicates(table(spark, d, "corpus_files"), "file_id", "content", n=3, threshold=0.6, least_words=40)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.pairs_of(*_near(spark, d)).select(F.col("id_a").alias("file_id_a"), F.col("id_b").alias("file_id_b"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups_of(*_near(spark, d)).withColumnRenamed("id", "file_id")


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), "doc_id", packing.byte_tokens("text"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).where((F.col("n_pieces") > 1) & (F.col("piece") == 0)).select(F.col("id").alias("doc_id"))


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).withColumnRenamed("id", "doc_id")


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(_packed(spark, d))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Per leaked item the affected documents and the longest run of its words."""
    return _leaks(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max("n_words").alias("longest"), F.max("item_words").alias("item_words"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "documents"), least=1).where("cut").select("doc_id")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_report(truncation.truncated(table(spark, d, "documents"), least=1))


def p8_endings(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "documents"), least=1)


def p8_evidence(spark: SparkSession, d: str) -> DataFrame:
    """How many cut texts of each kind were found by each kind of evidence."""
    return truncation.truncated(table(spark, d, "documents"), least=1).where("cut").groupBy("kind", "evidence").agg(F.count(F.lit(1)).alias("n_cut"))


# lines; then where the frontmatter ends; then the headings after it with an even number of fence lines before them
SECTIONS_SQL = r"""
WITH big AS (SELECT file_id, string_split(content, chr(10)) AS ls FROM corpus_files WHERE length(content) > 4000),
lines AS (SELECT file_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no, len(ls) AS n FROM big),
front AS (SELECT file_id, coalesce(min(line_no) FILTER (rtrim(line, chr(13)) = '---' AND line_no > 1), 0) AS closes FROM lines
          GROUP BY file_id HAVING bool_or(line_no = 1 AND rtrim(line, chr(13)) = '---')),
fences AS (SELECT l.*, coalesce(closes, 0) AS closes,
             sum(CASE WHEN line_no > coalesce(closes, 0) AND regexp_matches(line, '^[\s\p{Z}\x{85}]*(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY line_no) AS before
           FROM lines l LEFT JOIN front USING (file_id))
SELECT file_id, 1::INT AS line_no FROM big
UNION ALL
SELECT file_id, line_no::INT FROM fences
WHERE line_no > greatest(closes, 1) AND before % 2 = 0
  AND (regexp_matches(line, '^#{1,6}[\s\p{Z}\x{85}]') OR (line_no < n AND regexp_matches(line, '^#{1,6}$')))
"""


LEAKS_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(item_text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE item_text IS NOT NULL),
di AS (SELECT doc_id, array_to_string(w[k : k + 11], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d)),
ii AS (SELECT item_id, array_to_string(w[k : k + 11], ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i))
SELECT DISTINCT doc_id, item_id FROM di JOIN ii USING (run)
"""
SIMILAR_SQL = r"""
WITH d AS (SELECT file_id, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS w FROM corpus_files WHERE content IS NOT NULL),
g AS (SELECT DISTINCT file_id, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] AS gram FROM (SELECT file_id, w, unnest(range(1, len(w) - 1)) AS k FROM d WHERE len(w) >= 40)),
n AS (SELECT file_id, count(*) AS n FROM g GROUP BY file_id),
both_ AS (SELECT a.file_id AS x, b.file_id AS y, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.file_id < b.file_id GROUP BY ALL)
SELECT x AS file_id_a, y AS file_id_b FROM both_ JOIN n p ON p.file_id = x JOIN n q ON q.file_id = y WHERE c >= 0.6 * (p.n + q.n - c) - 1e-9
"""

QUERIES = {
    "p1_found": p1_found,
    "p1_ranges": p1_ranges,
    "p1_pieces": p1_pieces,
    "p4_found": p4_found,
    "p4_groups": p4_groups,
    "p6_found": p6_found,
    "p6_packed": p6_packed,
    "p6_fill": p6_fill,
    "p7_found": p7_found,
    "p7_items": p7_items,
    "p8_found": p8_found,
    "p8_report": p8_report,
    "p8_endings": p8_endings,
    "p8_evidence": p8_evidence,
}
ORACLE = {
    "p4_found": SIMILAR_SQL,
    "p7_found": LEAKS_SQL,
    "p1_found": SECTIONS_SQL,
    "p1_ranges": SECTIONS_SQL,
    "p6_found": "SELECT doc_id FROM (SELECT doc_id, max(strlen(text)) + 1 AS tokens FROM documents GROUP BY doc_id) WHERE tokens > 4096",
}
