"""Queries over the dirty tables: orphan references, packed values, snapshot changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumgrid.operators import multivalue, references, snapshots
from vellumgrid.runtime import table


def _tables(spark: SparkSession, d: str) -> list[DataFrame]:
    return [table(spark, d, n) for n in ("links", "corpus_files", "headings", "graph_files")]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_references(*_tables(spark, d))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_report(*_tables(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    entries = table(spark, d, "entries").groupBy("entry_id").agg(F.max("tags").alias("field"))
    commands = table(spark, d, "help_commands").groupBy("command_id").agg(F.max("aliases").alias("field"))
    packed = entries.select(F.lit("entries").alias("src_table"), F.col("entry_id").alias("row_id"), "field").unionByName(
        commands.where(F.trim("field") != "none").select(F.lit("help_commands").alias("src_table"), F.col("command_id").alias("row_id"), "field")
    )
    return multivalue.split_values(packed, "field").select("src_table", "row_id", "item_pos", "item")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.snapshot_changes(table(spark, d, "inventory_snapshots"), key=snapshots.canonical_path("path"))


def p5_reported(spark: SparkSession, d: str) -> DataFrame:
    """Derived changes per project and status beside the distinct changes a tool reported."""
    found = p5_found(spark, d).groupBy("project", "status").agg(F.count(F.lit(1)).alias("n_found"))
    told = table(spark, d, "drift_changes")
    word = F.lower(F.trim("status"))
    told = told.select("change_id", "project", F.when(word.startswith("a"), "added").when(word.isin("d", "deleted") | word.startswith("r"), "removed").when(word.startswith("m") | word.startswith("c"), "modified").otherwise("unknown").alias("status")).distinct()
    told = told.groupBy("project", "status").agg(F.count(F.lit(1)).alias("n_reported"))
    return found.join(told, ["project", "status"], "full").select("project", "status", F.coalesce("n_found", F.lit(0)).alias("n_found"), F.coalesce("n_reported", F.lit(0)).alias("n_reported"))


QUERIES = {"p2_found": p2_found, "p2_report": p2_report, "p3_found": p3_found, "p5_found": p5_found, "p5_reported": p5_reported}

_ORPHANS = """
WITH l AS (SELECT DISTINCT link_id, bundle, target, anchor, seen_at FROM links WHERE target IS NOT NULL),
alive AS (
  SELECT l.link_id, l.anchor, l.seen_at, f.file_id FROM l JOIN corpus_files f
  ON f.bundle = l.bundle AND f.path = l.target AND f.created_at <= l.seen_at AND (f.deleted_at IS NULL OR f.deleted_at > l.seen_at)),
h AS (
  SELECT DISTINCT heading_id, file_id, ord, regexp_replace(replace(lower(heading_text), ' ', '-'), '[^\\p{L}\\p{N}_-]', '', 'g') AS slug
  FROM headings WHERE heading_text IS NOT NULL),
n AS (SELECT file_id, slug, row_number() OVER (PARTITION BY file_id, slug ORDER BY ord, heading_id) - 1 AS k FROM h),
slugs AS (SELECT DISTINCT file_id, CASE WHEN k = 0 THEN slug ELSE slug || '-' || k END AS slug FROM n),
bad_anchor AS (
  SELECT a.link_id, a.seen_at FROM alive a LEFT JOIN slugs s
  ON s.file_id = a.file_id AND s.slug = regexp_replace(replace(lower(a.anchor), ' ', '-'), '[^\\p{L}\\p{N}_-]', '', 'g')
  WHERE a.anchor IS NOT NULL AND NOT starts_with(a.anchor, '^')
  GROUP BY a.link_id, a.seen_at HAVING count(s.slug) = 0),
g AS (SELECT DISTINCT graph_id, bundle, build_no, built_at, links FROM graph_files),
e AS (SELECT graph_id, bundle, build_no, built_at, unnest(links) AS path, generate_subscripts(links, 1) AS pos FROM g),
orphans AS (
  SELECT 'links' AS ref_table, link_id AS ref_id, 0 AS item_pos, seen_at AS seen FROM l WHERE link_id NOT IN (SELECT link_id FROM alive)
  UNION ALL SELECT 'links', link_id, 0, seen_at FROM bad_anchor
  UNION ALL SELECT 'graph_files', graph_id, CAST(pos AS INTEGER), built_at FROM e
  WHERE NOT EXISTS (SELECT 1 FROM graph_files k WHERE k.bundle = e.bundle AND k.build_no = e.build_no AND k.path = e.path))
"""

_CHANGES = """
WITH r AS (
  SELECT project, snapshot_no, regexp_replace(replace(path, '\\', '/'), '^(\\./+)+', '') AS path, lower(sha256) AS sha, ingested_at FROM inventory_snapshots),
k AS (SELECT project, snapshot_no, path, sha FROM r QUALIFY row_number() OVER (PARTITION BY project, snapshot_no, path ORDER BY ingested_at DESC NULLS LAST, sha DESC) = 1),
s AS (SELECT project, snapshot_no, lag(snapshot_no) OVER (PARTITION BY project ORDER BY snapshot_no) AS before_no FROM (SELECT DISTINCT project, snapshot_no FROM r)),
changes AS (
  SELECT a.project, a.snapshot_no, a.path, CASE WHEN b.path IS NULL THEN 'added' ELSE 'modified' END AS status
  FROM k a JOIN s ON s.project = a.project AND s.snapshot_no = a.snapshot_no AND s.before_no IS NOT NULL
  LEFT JOIN k b ON b.project = a.project AND b.snapshot_no = s.before_no AND b.path = a.path
  WHERE b.path IS NULL OR b.sha IS DISTINCT FROM a.sha
  UNION ALL
  SELECT b.project, s.snapshot_no, b.path, 'removed' FROM k b JOIN s ON s.project = b.project AND s.before_no = b.snapshot_no
  WHERE NOT EXISTS (SELECT 1 FROM k a WHERE a.project = b.project AND a.snapshot_no = s.snapshot_no AND a.path = b.path))
"""

ORACLE = {
    "p2_found": _ORPHANS + "SELECT ref_table, ref_id, item_pos FROM orphans",
    "p2_report": _ORPHANS + "SELECT ref_table, date_trunc('month', seen)::TIMESTAMP AS period, count(*) AS n_orphans FROM orphans GROUP BY 1, 2",
    "p5_found": _CHANGES + "SELECT project, snapshot_no, path, status FROM changes",
    "p5_reported": _CHANGES
    + """, f AS (SELECT project, status, count(*) AS n FROM changes GROUP BY 1, 2),
t AS (SELECT project, status, count(*) AS n FROM (
  SELECT DISTINCT change_id, project, CASE
    WHEN lower(trim(status)) LIKE 'a%' THEN 'added' WHEN lower(trim(status)) IN ('d', 'deleted') OR lower(trim(status)) LIKE 'r%' THEN 'removed'
    WHEN lower(trim(status)) LIKE 'm%' OR lower(trim(status)) LIKE 'c%' THEN 'modified' ELSE 'unknown' END AS status FROM drift_changes) GROUP BY 1, 2)
SELECT coalesce(f.project, t.project) AS project, coalesce(f.status, t.status) AS status, coalesce(f.n, 0) AS n_found, coalesce(t.n, 0) AS n_reported
FROM f FULL JOIN t ON f.project = t.project AND f.status = t.status""",
}
