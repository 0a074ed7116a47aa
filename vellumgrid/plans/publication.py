"""Queries over publications, crawls and versions, with their SQL twins. Tables are adapted so that every rule has its cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumgrid.functions import text
from vellumgrid.operators import provenance
from vellumgrid.runtime import table
from vellumgrid.sources import files, pages

# Paths that graph rows are given by their number: good and bad ones of both kinds.
PATHS = ("/a/{n}.md", "/a/../{n}.md", "a/{n}.md", "/a//{n}.MD", "/a\\{n}.md", "/{n}.md#x", "img/{n}.png", "/img/{n}.png", ".hidden/{n}.png", "img/./{n}.png", "img/{n}%20.png", "graph.json", "{n}.md", "a/{n}.json")


def _declared(s: SparkSession, d: str) -> DataFrame:
    g = table(s, d, "graph_files").groupBy("graph_id", "bundle").agg(F.min("sha256").alias("sha256"))
    path = F.replace(F.element_at(F.array(*map(F.lit, PATHS)), (F.col("graph_id") % 14).cast("int") + 1), F.lit("{n}"), F.col("graph_id").cast("string"))
    return g.select("graph_id", "bundle", path.alias("path"), F.when(F.col("graph_id") % 14 < 6, "document").otherwise("artifact").alias("kind"), "sha256")


_DECLARED = (
    "WITH d AS (SELECT graph_id, bundle, sha256, replace(list_element(["
    + ", ".join(f"'{p}'" for p in PATHS)
    + "], (graph_id % 14 + 1)::INT), '{n}', graph_id::VARCHAR) AS path, CASE WHEN graph_id % 14 < 6 THEN 'document' ELSE 'artifact' END AS kind FROM (SELECT graph_id, bundle, min(sha256) AS sha256 FROM graph_files GROUP BY 1, 2))"
)


def publication_issues(s: SparkSession, d: str) -> DataFrame:
    """Every fifth declared file is missing, every seventh has other bytes, and some files are not declared."""
    declared = _declared(s, d)
    there = declared.where(F.col("graph_id") % 5 != 0).select("bundle", "path", F.when(F.col("graph_id") % 7 == 0, F.lit("0" * 64)).otherwise(F.col("sha256")).alias("sha256"))
    extra = declared.where(F.col("graph_id") % 11 == 0).select("bundle", F.concat("path", F.lit("~")).alias("path"), "sha256")
    unique = lambda x: x.groupBy("bundle", "path").agg(*(F.min(c).alias(c) for c in x.columns if c not in ("bundle", "path")))
    return provenance.publication_issues(unique(declared.drop("graph_id")), unique(there.unionByName(extra)), "bundle")


_PUBLICATION = (
    _DECLARED
    + """, u AS (SELECT bundle, path, min(kind) AS kind, min(sha256) AS sha256 FROM d GROUP BY 1, 2),
f AS (SELECT bundle, path, min(sha256) AS sha256 FROM (SELECT bundle, path, CASE WHEN graph_id % 7 = 0 THEN repeat('0', 64) ELSE sha256 END AS sha256 FROM d WHERE graph_id % 5 <> 0 UNION ALL SELECT bundle, path || '~', sha256 FROM d WHERE graph_id % 11 = 0) GROUP BY 1, 2),
c AS (SELECT *, len(list_filter(string_split(ltrim(path, '/'), '/'), lambda x: x IN ('', '.', '..'))) > 0 OR starts_with(path, '//') AS dirty FROM u)
SELECT bundle, path, CASE
  WHEN kind = 'document' AND NOT (starts_with(path, '/') AND NOT regexp_matches(path, '[\\\\#?]') AND NOT dirty AND lower(path) LIKE '%.md') THEN 'bad path'
  WHEN kind = 'artifact' AND (starts_with(path, '/') OR regexp_matches(path, '[\\\\#?%]') OR dirty OR regexp_matches('/' || path, '/\\.') OR lower(path) IN ('graph.json', 'llms.txt') OR lower(path) LIKE '%.md') THEN 'bad path'
  WHEN NOT regexp_matches(coalesce(sha256, ''), '^[0-9a-f]{64}$') THEN 'bad hash' END AS problem FROM c WHERE problem IS NOT NULL
UNION ALL
SELECT bundle, path, CASE WHEN f.path IS NULL THEN 'missing' WHEN u.path IS NULL THEN 'undeclared' ELSE 'mismatch' END FROM u FULL JOIN f USING (bundle, path) WHERE f.path IS NULL OR u.path IS NULL OR u.sha256 IS DISTINCT FROM f.sha256"""
)


def _references(s: SparkSession, d: str) -> DataFrame:
    """An external reference for each link row, in the order of the ids, with faults by the id."""
    x = table(s, d, "links").groupBy("link_id").agg(F.min(F.struct("bundle", "from_path", "line_no")).alias("l")).select("link_id", "l.*")
    n = F.col("link_id")
    host = F.when(n % 6 == 0, "H.example").otherwise("h.example")
    url = F.concat(F.lit("https://"), host, F.lit("/"), F.when(n % 10 == 0, "a/../").otherwise(""), (n % 997).cast("string"), F.when(n % 8 == 0, "/graph.json?x").otherwise("/graph.json"))
    bad = F.when(n % 9 == 0, "../up").when(n % 9 == 1, "").otherwise(F.col("from_path"))
    return x.select("bundle", n.alias("pos"), bad.alias("from"), F.when(n % 12 == 0, 0).otherwise(F.col("line_no")).alias("line"), url.alias("url"), F.when(n % 15 == 0, "net").otherwise("source").alias("origin"), F.when(n % 20 == 0, "/x.md").otherwise("/index.md").alias("root"), F.sha2(n.cast("string"), 256).alias("sha256"))


def reference_issues(s: SparkSession, d: str) -> DataFrame:
    refs = _references(s, d).withColumn("sha256", F.when(F.col("pos") % 14 == 0, F.upper("sha256")).otherwise(F.col("sha256")))
    return provenance.reference_issues(refs, "bundle")


_REFERENCES = """
WITH l AS (SELECT link_id AS pos, min((bundle, from_path, line_no)) AS l FROM links GROUP BY 1),
r AS (SELECT pos, l[1] AS bundle, CASE pos % 9 WHEN 0 THEN '../up' WHEN 1 THEN '' ELSE l[2] END AS src, CASE WHEN pos % 12 = 0 THEN 0 ELSE l[3] END AS line,
  'https://' || CASE WHEN pos % 6 = 0 THEN 'H.example' ELSE 'h.example' END || '/' || CASE WHEN pos % 10 = 0 THEN 'a/../' ELSE '' END || pos % 997 || CASE WHEN pos % 8 = 0 THEN '/graph.json?x' ELSE '/graph.json' END AS url,
  CASE WHEN pos % 15 = 0 THEN 'net' ELSE 'source' END AS origin FROM l),
w AS (SELECT *, lag((src, line, url, origin)) OVER (PARTITION BY bundle ORDER BY pos) > (src, line, url, origin) AS late, row_number() OVER (PARTITION BY bundle, url ORDER BY pos) AS n FROM r)
SELECT bundle, pos, unnest(list_filter([
  CASE WHEN pos % 6 = 0 OR pos % 8 = 0 OR pos % 10 = 0 OR pos % 20 = 0 THEN 'address' END, CASE WHEN n > 1 THEN 'repeated address' END, CASE WHEN pos % 14 = 0 THEN 'hash' END,
  CASE WHEN src = '' OR contains(src, '..') OR contains(src, '\\') THEN 'declaring file' END, CASE WHEN origin = 'net' THEN 'origin' END, CASE WHEN line < 1 THEN 'line' END, CASE WHEN late THEN 'order' END], lambda x: x IS NOT NULL)) AS rule FROM w
"""


def crawl_turns(s: SparkSession, d: str) -> DataFrame:
    """Sixty-four fetches (the crawl's budget) shared between the bundles in turn."""
    queue = table(s, d, "links").groupBy("link_id").agg(F.min("bundle").alias("seed"))
    return pages.round_robin(queue.withColumnRenamed("link_id", "pos"))


def label_changes(s: SparkSession, d: str) -> DataFrame:
    f = table(s, d, "corpus_files").select("file_id", "entry_type")
    derived = f.where(F.col("entry_type").isNotNull()).select("file_id", F.concat(F.lit("kind:"), F.lower("entry_type")).alias("label"))
    now = f.select("file_id", F.explode(F.array(F.when(F.col("file_id") % 3 == 0, "kind:note").otherwise("kind:old"), F.lit("queue:open"))).alias("label"))
    return provenance.label_changes(derived, now, "file_id", prefix="kind:")


def version_order(s: SparkSession, d: str) -> DataFrame:
    """The versions, some of them as pre-releases, in order."""
    v = F.col("cli_version")
    made = F.when(F.col("command_id") % 4 == 0, F.concat(v, F.lit("-rc.2"))).when(F.col("command_id") % 4 == 1, F.concat(v, F.lit("-rc.10"))).when(F.col("command_id") % 4 == 2, F.concat(v, F.lit("-rc.x+b1"))).otherwise(v)
    each = table(s, d, "help_commands").select(made.alias("version")).distinct().withColumn("k", text.version_key("version"))
    before = each.select(F.col("k").alias("o"), F.col("version").alias("other"))
    # a few versions: each with how many come before it
    return each.join(F.broadcast(before), F.col("o") < F.col("k"), "left").groupBy("version").agg(F.count("other").alias("n_before"))


_VERSIONS = """
WITH v AS (SELECT DISTINCT cli_version AS base, (command_id % 4)::INT AS k FROM help_commands),
w AS (SELECT base || CASE k WHEN 0 THEN '-rc.2' WHEN 1 THEN '-rc.10' WHEN 2 THEN '-rc.x+b1' ELSE '' END AS version, string_split(base, '.')::INT[] AS p, k FROM v)
SELECT a.version, count(b.version) AS n_before FROM w a LEFT JOIN w b ON (b.p, b.k) < (a.p, a.k) GROUP BY 1
"""


def literal_urls(s: SparkSession, d: str) -> DataFrame:
    made = table(s, d, "documents").where(F.col("text").isNotNull()).groupBy("doc_id").agg(F.max("text").alias("text"))
    tail = F.concat(F.lit("\n“https://h.example/"), F.col("doc_id").cast("string"), F.lit("”, (http://x.example/a?b=1).\nhttps://"))
    return files.literal_urls(made.select(F.col("doc_id").cast("string").alias("path"), F.concat("text", tail).alias("content")))


_URLS = r"""
WITH t AS (SELECT doc_id, max(text) || chr(10) || '“https://h.example/' || doc_id || '”, (http://x.example/a?b=1).' || chr(10) || 'https://' AS text FROM documents WHERE text IS NOT NULL GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM t),
u AS (SELECT doc_id, line_no, regexp_replace(unnest(regexp_extract_all(line, 'https?://[^\s"''<>`“”‘’]+')), '[.,;:!?)\]}]+$', '') AS url FROM l)
SELECT doc_id::VARCHAR AS path, line_no::INT AS line_no, url FROM u WHERE regexp_matches(url, '^https?://.')
"""


def page_links(s: SparkSession, d: str) -> DataFrame:
    """Pages made from the documents' numbers with a link of every kind, and with links that are none."""
    n = F.col("doc_id").cast("string")
    body = F.concat(
        F.lit("<script>https://no.example/"), n, F.lit("</script><a class=x href='a"), n, F.lit(".md#f'>1</a> <A HREF=\"https://O.example?q="), n, F.lit("&amp;r=2\">2</A> see https://b.example/"), n,
        F.lit(". [t](../c.md) http://plain.example/ <a href=#top>3</a>\n[d]: <https://d.example/"), n, F.lit("> x\n<a href='a"), n, F.lit(".md'>again</a><style>a{b:url(https://s.example/)}</style>"),
    )
    made = table(s, d, "documents").select("doc_id").distinct().select(F.concat(F.lit("https://H.example/p/"), n, F.lit("/")).alias("url"), body.alias("body"))
    return pages.extract_links(made)


_PAGES = """
WITH n AS (SELECT DISTINCT doc_id FROM documents),
p AS (SELECT 'https://H.example/p/' || doc_id || '/' AS url, ['https://h.example/p/' || doc_id || '/a' || doc_id || '.md', 'https://o.example/?q=' || doc_id || '&r=2', 'https://b.example/' || doc_id, 'https://h.example/p/c.md', 'https://d.example/' || doc_id] AS links FROM n)
SELECT url, unnest(range(1, 6))::INT AS pos, unnest(links) AS link FROM p
"""

QUERIES = {
    "publication_issues": publication_issues,
    "reference_issues": reference_issues,
    "crawl_turns": crawl_turns,
    "label_changes": label_changes,
    "version_order": version_order,
    "literal_urls": literal_urls,
    "page_links": page_links,
}
ORACLE = {
    "publication_issues": _PUBLICATION,
    "reference_issues": _REFERENCES,
    "crawl_turns": "SELECT seed, link_id AS pos, (row_number() OVER (ORDER BY n, seed))::INT AS turn FROM (SELECT link_id, min(bundle) AS seed, row_number() OVER (PARTITION BY min(bundle) ORDER BY link_id) AS n FROM links GROUP BY link_id) QUALIFY turn <= 64",
    "label_changes": "WITH d AS (SELECT DISTINCT file_id, 'kind:' || lower(entry_type) AS label FROM corpus_files WHERE entry_type IS NOT NULL), c AS (SELECT DISTINCT file_id, CASE WHEN file_id % 3 = 0 THEN 'kind:note' ELSE 'kind:old' END AS label FROM corpus_files) SELECT file_id, label, CASE WHEN c.label IS NULL THEN 'add' ELSE 'remove' END AS change FROM (SELECT *, label AS x FROM d) d FULL JOIN (SELECT *, label AS x FROM c) c USING (file_id, label) WHERE d.x IS NULL OR c.x IS NULL".replace("CASE WHEN c.label IS NULL", "CASE WHEN c.x IS NULL"),
    "version_order": _VERSIONS,
    "literal_urls": _URLS,
    "page_links": _PAGES,
}
