"""Queries over whole corpora, links, inventories and manifests, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumgrid.functions import markdown as md
from vellumgrid.functions import paths, text, urls
from vellumgrid.operators import checks, graph, multivalue, parse, provenance, references, rewrite, search, snapshots
from vellumgrid.runtime import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- relations ---------------------------------------------------------------------------------------------------


def files(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "corpus_files")


def live(s: SparkSession, d: str) -> DataFrame:
    return files(s, d).where(F.col("deleted_at").isNull())


def parsed(s: SparkSession, d: str) -> DataFrame:
    return parse.entries(files(s, d).where(F.col("content").isNotNull()), "content", "file_id", "bundle", "path")


def links(s: SparkSession, d: str) -> DataFrame:
    return graph.edges(table(s, d, "links"))


def raw_links(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "links").groupBy("link_id").agg(F.min(F.struct("bundle", "from_path", "raw", "link_text")).alias("l")).select("link_id", "l.*")


def snapshot(s: SparkSession, d: str, which: str) -> DataFrame:
    """The first or last snapshot of every project: ``(project, path, sha256)``, one row per path."""
    t = table(s, d, "inventory_snapshots")
    pick = t.groupBy("project").agg((F.min if which == "first" else F.max)("snapshot_no").alias("snapshot_no"))
    rows = t.join(pick, ["project", "snapshot_no"], "left_semi").select("project", snapshots.canonical_path("path").alias("path"), F.lower("sha256").alias("sha256"), "ingested_at", F.lower("entry_type").alias("type"), "bytes")
    return rows.groupBy("project", "path").agg(F.max_by("sha256", F.struct("ingested_at", "sha256")).alias("sha256"))


def build(s: SparkSession, d: str, which: str) -> DataFrame:
    """The first or last build of every bundle: ``(bundle, path, sha256)``."""
    t = table(s, d, "graph_files")
    pick = t.groupBy("bundle").agg((F.min if which == "first" else F.max)("build_no").alias("build_no"))
    return t.join(pick, ["bundle", "build_no"], "left_semi").groupBy("bundle", "path").agg(F.max(F.lower("sha256")).alias("sha256"))


_LINKS = "l AS (SELECT DISTINCT link_id, bundle, from_path, ord, link_text, target, anchor, line_no FROM links WHERE target IS NOT NULL), docs AS (SELECT * FROM corpus_files WHERE deleted_at IS NULL)"
_SNAP = """SELECT project, path, sha256 FROM (
  SELECT i.project, regexp_replace(replace(path, '\\', '/'), '^(\\./+)+', '') AS path, lower(sha256) AS sha256, ingested_at FROM inventory_snapshots i
  JOIN (SELECT project, {f}(snapshot_no) AS n FROM inventory_snapshots GROUP BY 1) p ON p.project = i.project AND p.n = i.snapshot_no)
  QUALIFY row_number() OVER (PARTITION BY project, path ORDER BY ingested_at DESC, sha256 DESC) = 1"""
_BUILD = """SELECT g.bundle, path, max(lower(sha256)) AS sha256 FROM graph_files g JOIN (SELECT bundle, {f}(build_no) AS n FROM graph_files GROUP BY 1) p
  ON p.bundle = g.bundle AND p.n = g.build_no GROUP BY 1, 2"""
_FM = """fm AS (SELECT file_id, bundle, path, content, CASE WHEN starts_with(content, '---' || chr(13) || chr(10)) THEN substr(content, 6) WHEN starts_with(content, '---' || chr(10)) THEN substr(content, 5) END AS rest FROM corpus_files WHERE content IS NOT NULL),
b AS (SELECT *, strpos(rest, chr(10) || '---') AS cut FROM fm),
c AS (SELECT *, substr(rest, cut + 4) AS after FROM b),
blocks AS (SELECT file_id, bundle, path, content, CASE WHEN cut > 0 AND (after = '' OR starts_with(after, chr(10)) OR starts_with(after, chr(13) || chr(10))) THEN replace(substr(rest, 1, cut - 1), chr(13), '') END AS block FROM c)"""
_LINES = """raw AS (SELECT file_id, content, string_split(content, chr(10)) AS ls FROM corpus_files WHERE content IS NOT NULL),
numbered AS (SELECT file_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM raw),
ends AS (SELECT file_id, min(line_no) AS fm_end FROM numbered WHERE line_no > 2 AND starts_with(line, '---') GROUP BY 1),
fms AS (SELECT e.file_id, e.fm_end FROM ends e JOIN numbered a ON a.file_id = e.file_id AND a.line_no = 1 AND rtrim(a.line, chr(13)) = '---'
        JOIN numbered z ON z.file_id = e.file_id AND z.line_no = e.fm_end AND rtrim(z.line, chr(13)) = '---'),
body AS (SELECT n.file_id, n.line_no, n.line, regexp_matches(n.line, '^[^\\S\\n]*(```|~~~)') AS fence FROM numbered n LEFT JOIN fms f ON f.file_id = n.file_id WHERE f.fm_end IS NULL OR n.line_no > f.fm_end),
masked AS (SELECT *, coalesce(sum(fence::INT) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 AS inside FROM body),
prose AS (SELECT file_id, line_no, line FROM masked WHERE inside = 0 AND NOT fence)"""


def _fold_sql(parts: str) -> str:
    """A path folded from its parts, from the root; it begins with ``!`` if it climbs above it."""
    return f"list_reduce(list_prepend('', list_filter({parts}, lambda p: p <> '' AND p <> '.')), lambda acc, p: CASE WHEN p <> '..' THEN acc || '/' || p WHEN acc IN ('', '!') THEN '!' ELSE regexp_replace(acc, '/[^/]*$', '') END)"


def _dir_sql(path: str) -> str:
    return f"regexp_replace({path}, '/[^/]*$', '')"


def _seen_from_sql(source: str, target: str) -> str:
    """The relative spelling of ``target`` in the document ``source``."""
    a, b = f"list_filter(string_split({_dir_sql(source)}, '/'), lambda p: p <> '')", f"list_filter(string_split({target}, '/'), lambda p: p <> '')"
    shared = f"len(list_filter(range(1, least(len({a}), len({b}) - 1) + 1), lambda i: ({a})[1:i] = ({b})[1:i]))"
    return f"(CASE WHEN len({a}) > {shared} THEN repeat('../', len({a}) - {shared}) ELSE './' END || array_to_string(({b})[{shared} + 1 :], '/'))"


_NORMAL = (
    "SELECT *, CASE WHEN contains(raw, '#') THEN regexp_replace(raw, '^[^#]*#', '') END AS anchor, regexp_replace(raw, '#(.|\\n)*$', '') AS bare FROM ({rows})",
    "SELECT *, "
    + _fold_sql(f"string_split(CASE WHEN starts_with(bare, '/') THEN bare WHEN bare = '' THEN from_path ELSE {_dir_sql('from_path')} || '/' || bare END, '/')")
    + " AS folded FROM ({rows})",
)


def _normal_sql(rows: str) -> str:
    """``path``, ``anchor`` and ``escapes`` of rows with ``from_path`` and ``raw``."""
    inner = _NORMAL[1].replace("{rows}", _NORMAL[0].replace("{rows}", rows))
    return f"SELECT *, starts_with(folded, '!') AS escapes, CASE WHEN ltrim(folded, '!') = '' THEN '/' ELSE ltrim(folded, '!') END AS path FROM ({inner})"


# --- search and lists ----------------------------------------------------------------------------------------------


def _search(mode: str, phrase: str, sql: str) -> None:
    def f(s: SparkSession, d: str) -> DataFrame:
        return search.search(files(s, d), "content", phrase, "file_id", "bundle", "path", "entry_type", mode=mode)

    f.__name__ = f"search_{mode}"
    query(f"SELECT file_id, bundle, path, entry_type, count(*) AS matches FROM (SELECT *, unnest(string_split(lower(content), chr(10))) AS line FROM corpus_files) WHERE {sql} GROUP BY ALL")(f)


_search("all", "the renderer", "contains(line, 'the') AND contains(line, 'renderer')")
_search("any", "renderer kiosk", "contains(line, 'renderer') OR contains(line, 'kiosk')")
_search("exact", "the renderer", "contains(line, 'the renderer')")


@query("SELECT file_id, n AS line_no, line FROM (SELECT file_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1)::INT AS n FROM corpus_files) WHERE contains(lower(line), 'vault') AND contains(lower(line), 'the')")
def search_lines(s, d):
    return search.search_lines(files(s, d), "content", "the vault", "file_id")


@query("SELECT doc_id, source, count(*) AS matches FROM (SELECT doc_id, source, ingested_at, unnest(string_split(lower(text), chr(10))) AS line FROM documents) WHERE contains(line, 'the') AND contains(line, 'crawler') GROUP BY doc_id, source, ingested_at")
def search_documents(s, d):
    return search.search(table(s, d, "documents"), "text", "the crawler", "doc_id", "source")


@query("SELECT file_id, bundle, path FROM corpus_files WHERE content IS NOT NULL AND starts_with(ltrim(path, '/'), 'guides/')")
def list_prefix(s, d):
    return search.list_entries(parsed(s, d), prefix="/guides/").select("file_id", "bundle", "path")


_VALUE = "regexp_extract(chr(10) || block, '\\n{k}:[ ]*\"?([^\\n\"]*)\"?', 1)"


@query(f"WITH {_FM} SELECT file_id, path FROM blocks WHERE {_VALUE.format(k='type')} = 'note'")
def where_eq(s, d):
    return search.list_entries(parsed(s, d), where=["type=note"]).select("file_id", "path")


@query(f"WITH {_FM} SELECT file_id, path FROM blocks WHERE block IS NULL OR {_VALUE.format(k='status')} <> 'stable'")
def where_ne(s, d):
    return search.list_entries(parsed(s, d), where=["status!=stable"]).select("file_id", "path")


@query(f"WITH {_FM} SELECT file_id, path FROM blocks WHERE block IS NULL OR {_VALUE.format(k='owner')} = ''")
def where_empty(s, d):
    return search.list_entries(parsed(s, d), where=["owner="]).select("file_id", "path")


@query(f"WITH {_FM} SELECT file_id, path FROM blocks WHERE block IS NOT NULL AND {_VALUE.format(k='owner')} <> ''")
def where_present(s, d):
    return search.list_entries(parsed(s, d), where=["owner!="]).select("file_id", "path")


@query("SELECT file_id, bundle, path, row_number() OVER (ORDER BY created_at DESC, path, file_id) AS place FROM corpus_files")
def list_sorted(s, d):
    """Newest first. The place comes from per-range counts, not from one global window."""
    rows = files(s, d).select("file_id", "bundle", "path", "created_at").orderBy(F.desc("created_at"), "path", "file_id")
    return _numbered(rows, "place").select("file_id", "bundle", "path", "place")


def _numbered(ordered: DataFrame, name: str) -> DataFrame:
    """``ordered`` with its row numbers: per-partition counts are summed, one number per partition."""
    from pyspark.sql import Window

    from vellumgrid.runtime import materialise

    marked = materialise(ordered.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()), "ordered")
    counts = marked.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return marked.join(F.broadcast(before.select("_p", "_first", "_before")), "_p").withColumn(name, F.col("_before") + F.col("_i") - F.col("_first") + 1).drop("_p", "_i", "_first", "_before")


@query(f"WITH {_FM} SELECT file_id, CASE WHEN block IS NULL THEN content ELSE regexp_replace(substr(content, strpos(substr(content, 4), chr(10) || '---') + 7), '^\\r?\\n', '') END AS body FROM blocks")
def read_bodies(s, d):
    return parsed(s, d).select("file_id", "body")


@query("SELECT count(*) AS files, count(content) AS readable, count(DISTINCT bundle) AS bundles, sum(length(content))::BIGINT AS chars, (SELECT count(DISTINCT link_id) FROM links) AS links FROM corpus_files")
def status(s, d):
    f = files(s, d).agg(F.count(F.lit(1)).alias("files"), F.count("content").alias("readable"), F.count_distinct("bundle").alias("bundles"), F.sum(F.length("content").cast("long")).alias("chars"))
    return f.crossJoin(F.broadcast(table(s, d, "links").agg(F.count_distinct("link_id").alias("links"))))  # one row each


# --- vocabulary ------------------------------------------------------------------------------------------------------


@query(f"WITH {_FM}, k AS (SELECT file_id, unnest(regexp_extract_all(chr(10) || block, '\\n([A-Za-z_][A-Za-z0-9_-]*):', 1)) AS name FROM blocks WHERE block IS NOT NULL) SELECT name, count(DISTINCT file_id) AS count FROM k GROUP BY 1")
def property_keys(s, d):
    return search.value_counts(parse.fm_keys(parsed(s, d), "file_id"), None, "file_id", column="key")


@query(f"WITH {_FM}, k AS (SELECT file_id, {_VALUE.format(k='type')} AS name FROM blocks WHERE block IS NOT NULL) SELECT name, count(DISTINCT file_id) AS count FROM k WHERE name <> '' GROUP BY 1")
def property_values(s, d):
    return search.value_counts(parse.fm_values(parsed(s, d), "file_id"), "type", "file_id")


@query()
def tags(s, d):
    rows = table(s, d, "entries").groupBy("entry_id").agg(F.max("tags").alias("tags"))
    items = multivalue.split_values(rows, "tags").select("entry_id", F.lit("tags").alias("key"), F.col("item").alias("value"))
    return search.value_counts(items, "tags", "entry_id")


@query(f"WITH {_FM} SELECT file_id, length(block) AS size, length(block) - length(replace(block, chr(10), '')) + 3 AS fm_lines FROM blocks WHERE block IS NOT NULL")
def frontmatter_blocks(s, d):
    rows = files(s, d).select("file_id", md.frontmatter("content").alias("f")).where(F.col("f.block").isNotNull())
    return rows.select("file_id", F.length(F.replace("f.block", F.lit("\r"), F.lit(""))).alias("size"), (md.newlines(F.col("f.block")) + 3).alias("fm_lines"))


@query(f"WITH {_FM}, r AS (SELECT file_id, unnest(regexp_extract_all(block, 'resource:[ ]*([^\\n]+)', 1)) AS resource FROM blocks) SELECT DISTINCT file_id, resource FROM r")
def source_resources(s, d):
    return parsed(s, d).select("file_id", F.explode("resources").alias("resource")).distinct()


# --- line parsers ------------------------------------------------------------------------------------------------------

_HEADINGS = _LINES + ", heads AS (SELECT file_id, line_no, length(regexp_extract(line, '^(#{1,6})\\s+', 1)) AS level, trim(regexp_extract(line, '^#{1,6}[\\t\\n\\f\\r ]+(.*)$', 1), ' ' || chr(9) || chr(13)) AS text FROM prose WHERE regexp_matches(line, '^#{1,6}[\\t\\n\\f\\r ]+')), sl AS (SELECT *, regexp_replace(replace(lower(text), ' ', '-'), '[^\\p{L}\\p{N}_-]', '', 'g') AS slug FROM heads)"


def _headings(s, d):
    return parse.headings(files(s, d).where(F.col("content").isNotNull()), "content", "file_id")


@query(f"WITH {_HEADINGS} SELECT file_id, (row_number() OVER (PARTITION BY file_id ORDER BY line_no))::INT AS ord, level::INT AS level, text, line_no::INT AS line_no FROM sl")
def outline(s, d):
    return _headings(s, d).select("file_id", "ord", "level", "text", "line_no")


@query(f"WITH {_HEADINGS} SELECT file_id, line_no::INT AS line_no, CASE WHEN k = 0 THEN slug ELSE slug || '-' || k END AS final_slug FROM (SELECT *, row_number() OVER (PARTITION BY file_id, slug ORDER BY line_no) - 1 AS k FROM sl)")
def heading_slugs(s, d):
    return _headings(s, d).select("file_id", "line_no", "final_slug")


@query(f"WITH {_LINES} SELECT file_id, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars FROM prose GROUP BY 1")
def prose_size(s, d):
    rows = md.prose_lines(files(s, d).where(F.col("content").isNotNull()), "content", "file_id")
    # every fence line is left as a blank line
    fences = files(s, d).where(F.col("content").isNotNull()).select("file_id", (F.regexp_count(md.frontmatter("content")["body"], F.lit(md.FENCE_LINE))).alias("f"))
    sums = rows.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("line").cast("long")).alias("n_chars"))
    return sums.join(fences, "file_id").select("file_id", (F.col("n") - F.col("f")).alias("n_lines"), "n_chars").where(F.col("n_lines") > 0)


@query(f"WITH {_LINES} SELECT file_id, line_no::INT AS line_no, regexp_extract(line, '\\[([ xX])\\]', 1) <> ' ' AS done, trim(regexp_extract(line, '^\\s*[-*+] \\[[ xX]\\]\\s+(.*)$', 1), ' ' || chr(9) || chr(13)) AS text FROM prose WHERE regexp_matches(line, '^\\s*[-*+] \\[[ xX]\\]\\s+')")
def checkboxes(s, d):
    return parse.checkboxes(files(s, d).where(F.col("content").isNotNull()), "content", "file_id")


@query(
    f"""WITH {_LINES}, m AS (SELECT file_id, line_no, line, contains(line, '|') AS bar, regexp_matches(line, '^[\\t ]*\\|?[\\t ]*:?-+:?[\\t ]*(\\|[\\t ]*:?-+:?[\\t ]*)*\\|?[\\t\\r ]*$') AS ruled FROM prose),
h AS (SELECT *, lead(ruled) OVER w AND lead(line_no) OVER w = line_no + 1 AS head, lag(bar) OVER w AND lag(line_no) OVER w = line_no - 1 AS after_bar FROM m WINDOW w AS (PARTITION BY file_id ORDER BY line_no)),
t AS (SELECT *, sum((bar AND head AND NOT ruled)::INT) OVER (PARTITION BY file_id ORDER BY line_no) AS table_n, bar AND head AND NOT ruled AS is_head FROM h),
run AS (SELECT *, sum((NOT bar)::INT) OVER (PARTITION BY file_id, table_n ORDER BY line_no) AS breaks, line_no - min(line_no) OVER (PARTITION BY file_id, table_n) - 1 AS row_n FROM t WHERE table_n > 0)
SELECT file_id, table_n::INT AS table_n, count(*) AS n_rows FROM run WHERE breaks = 0 AND row_n > 0 GROUP BY 1, 2"""
)
def tables(s, d):
    cells = parse.table_cells(files(s, d).where(F.col("content").isNotNull()), "content", "file_id")
    return cells.groupBy("file_id", "table_n").agg(F.count_distinct("row_n").alias("n_rows"))


_CELLS = "list_transform(string_split(regexp_replace(regexp_replace(replace(trim({x}, ' ' || chr(9) || chr(13)), '\\|', chr(1)), '^\\|', ''), '\\|$', ''), '|'), lambda c: replace(trim(c, ' ' || chr(9) || chr(13)), chr(1), '|'))"


@query(
    ORACLE["tables"].split("SELECT file_id, table_n::INT")[0]
    + f""", hd AS (SELECT file_id, table_n, {_CELLS.replace("{x}", "line")} AS names FROM t WHERE is_head),
g AS (SELECT r.file_id, r.table_n, r.row_n, h.names, {_CELLS.replace("{x}", "r.line")} AS cells FROM run r JOIN hd h ON h.file_id = r.file_id AND h.table_n = r.table_n WHERE r.breaks = 0 AND r.row_n > 0)
SELECT file_id, table_n::INT AS table_n, row_n::INT AS row_n, i::INT AS col_n, names[i] AS header, coalesce(cells[i], '') AS cell FROM (SELECT *, unnest(range(1, len(names) + 1)) AS i FROM g)"""
)
def table_cells(s, d):
    return parse.table_cells(files(s, d).where(F.col("content").isNotNull()), "content", "file_id")


@query("SELECT doc_id, link_text, raw, CASE WHEN starts_with(raw, '#') THEN 'self' WHEN regexp_matches(raw, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN 'external' WHEN starts_with(raw, '/') THEN 'absolute' ELSE 'relative' END AS kind FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\[([^\\]]*)\\]\\(([^)]+)\\)', 1)) AS link_text, unnest(regexp_extract_all(text, '\\[([^\\]]*)\\]\\(([^)]+)\\)', 2)) AS raw FROM documents)")
def document_links(s, d):
    rows = table(s, d, "documents").where(F.col("text").isNotNull())
    return parse.inline_links(rows, "text", "doc_id").select("doc_id", F.col("text").alias("link_text"), "raw", "kind")


@query("SELECT link_id, regexp_extract(raw, '^\\[\\[([^\\]|#]*)', 1) AS target, regexp_extract(raw, '#([^\\]|]*)', 1) AS anchor FROM (SELECT DISTINCT link_id, raw FROM links WHERE starts_with(raw, '[['))")
def wikilinks(s, d):
    return parse.wikilinks(raw_links(s, d).where(F.col("raw").startswith("[[")), "raw", "link_id").select("link_id", "target", "anchor")


# --- paths and URLs ---------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT link_id, rtrim(regexp_extract(raw, '^([^#]*)', 1), '/') AS path, CASE WHEN contains(raw, '#') THEN regexp_extract(raw, '#(.*)$', 1) END AS anchor, false AS escapes FROM links WHERE starts_with(raw, '/')")
def link_paths(s, d):
    rows = raw_links(s, d).where(F.col("raw").startswith("/"))
    return rows.select("link_id", paths.normalise_link("from_path", "raw").alias("n")).select("link_id", "n.path", "n.anchor", "n.escapes")


@query(
    "SELECT link_id, path, anchor, escapes FROM ("
    + _normal_sql("SELECT DISTINCT link_id, from_path, regexp_replace(raw, '^<([^>]*)>', '\\1') AS raw FROM links WHERE raw IS NOT NULL AND NOT starts_with(raw, '[[') AND NOT regexp_matches(raw, '^[A-Za-z][A-Za-z0-9+.-]*:') AND NOT starts_with(raw, '//')")
    + ")"
)
def link_paths_all(s, d):
    """Every spelling that names a path, relative and self links too; wiki links and external ones name none."""
    rows = raw_links(s, d).where((urls.link_class("raw") != "external") & ~F.col("raw").startswith("[["))
    target = F.regexp_replace("raw", r"\A<([^>]*)>", "$1")
    return rows.select("link_id", paths.normalise_link("from_path", target).alias("n")).select("link_id", "n.path", "n.anchor", "n.escapes")


@query("SELECT DISTINCT link_id, rtrim(target, '/') AS path FROM links WHERE target IS NOT NULL AND NOT starts_with(raw, '[[') AND NOT starts_with(raw, '<')")
def links_resolved(s, d):
    """Raw spellings, relative ones too, resolved to the paths the crawler noted."""
    rows = table(s, d, "links").where(F.col("target").isNotNull() & ~F.col("raw").startswith("[[") & ~F.col("raw").startswith("<")).select("link_id", "from_path", "raw").distinct()
    return rows.select("link_id", paths.normalise_link("from_path", "raw")["path"].alias("path"))


@query("SELECT DISTINCT link_id, rtrim(target, '/') AS path FROM links WHERE target IS NOT NULL AND from_path IS NOT NULL")
def relative_round_trip(s, d):
    """A target spelled relative to its document and resolved again is the target."""
    rows = table(s, d, "links").where(F.col("target").isNotNull() & F.col("from_path").isNotNull()).select("link_id", "from_path", "target").distinct()
    return rows.select("link_id", paths.normalise_link("from_path", paths.relative_link("from_path", "target"))["path"].alias("path"))


@query("SELECT file_id, regexp_matches(path, '^/[^/]*/[^/]*-[0-9]*[05]\\.md$') AS starred, regexp_matches(path, '^/guides(/.*)?$') AS deep, (length(path) - length(replace(path, '/', '')) - 1)::INT AS depth, regexp_extract(path, '([^/]*)$', 1) AS base FROM corpus_files")
def glob_match(s, d):
    star = paths.matches_glob("path", "/*/*-*[05].md")
    return files(s, d).select("file_id", star.alias("starred"), paths.matches_glob("path", "/guides/**").alias("deep"), paths.depth("path").alias("depth"), paths.basename("path").alias("base"))


ORACLE["glob_match"] = ORACLE["glob_match"].replace("[^/]*-[0-9]*[05]", "[^/]*-[^/]*[05]")


@query("SELECT link_id, CASE WHEN starts_with(raw, '#') THEN 'self' WHEN regexp_matches(raw, '^[A-Za-z][A-Za-z0-9+.-]*:') OR starts_with(raw, '//') THEN 'external' WHEN starts_with(raw, '/') THEN 'absolute' ELSE 'relative' END AS kind FROM (SELECT DISTINCT link_id, raw FROM links WHERE raw IS NOT NULL)")
def link_classes(s, d):
    return raw_links(s, d).where(F.col("raw").isNotNull()).select("link_id", urls.link_class("raw").alias("kind"))


@query("SELECT link_id, lower(regexp_extract(raw, '^(https?://[^/?#]+)', 1)) || CASE WHEN regexp_extract(raw, '^https?://[^/?#]+([^#]*)', 1) LIKE '/%' THEN '' ELSE '/' END || regexp_extract(raw, '^https?://[^/?#]+([^#]*)', 1) AS url, starts_with(lower(raw), 'https://') AND NOT contains(raw, '#') AS valid FROM (SELECT DISTINCT link_id, raw FROM links WHERE regexp_matches(raw, '^https?://'))")
def url_canonical(s, d):
    rows = raw_links(s, d).where(F.col("raw").rlike(r"\Ahttps?://"))
    return rows.select("link_id", urls.canonical_url("raw").alias("url"), urls.valid_url("raw").alias("valid"))


_SIX = {0: ("2001:db8::{n}", False), 1: ("fc00::{n}", False), 2: ("fe80::{n}", False), 3: ("64:ff9b::{n}", False), 4: ("2606:4700::{n}", True), 5: ("ff02::{n}", False), 6: ("not:an:address:{n}", False), 7: ("::ffff:8.8.8.8", True), 8: ("::ffff:10.0.0.1", False), 9: ("::1", False)}


@query(
    "SELECT user_id, ip, public FROM (SELECT DISTINCT user_id, (user_id % 223 + 1)::VARCHAR || '.' || (user_id % 256)::VARCHAR || '.1.7' AS ip, NOT ((user_id % 223 + 1) IN (10, 127) OR ((user_id % 223 + 1) = 172 AND user_id % 256 BETWEEN 16 AND 31) OR ((user_id % 223 + 1) = 192 AND user_id % 256 = 168) OR ((user_id % 223 + 1) = 169 AND user_id % 256 = 254) OR ((user_id % 223 + 1) = 100 AND user_id % 256 BETWEEN 64 AND 127) OR ((user_id % 223 + 1) = 198 AND user_id % 256 IN (18, 19))) AS public FROM events) UNION ALL SELECT DISTINCT user_id, CASE user_id % 10 "
    + " ".join(f"WHEN {k} THEN replace('{ip}', '{{n}}', (user_id % 1000)::VARCHAR)" for k, (ip, _) in _SIX.items())
    + " END, user_id % 10 IN (4, 7) FROM events"
)
def public_ips(s, d):
    """Addresses made from the users' numbers: IPv4, IPv6, mapped ones, and what is none."""
    users = table(s, d, "events").select("user_id").distinct()
    four = F.concat_ws(".", (F.col("user_id") % 223 + 1).cast("string"), (F.col("user_id") % 256).cast("string"), F.lit("1"), F.lit("7"))
    six = F.coalesce(*(F.when(F.col("user_id") % 10 == k, F.replace(F.lit(ip), F.lit("{n}"), (F.col("user_id") % 1000).cast("string"))) for k, (ip, _) in _SIX.items()))
    return users.select("user_id", F.explode(F.array(four, six)).alias("ip")).withColumn("public", urls.is_public_ip("ip"))


# --- graph --------------------------------------------------------------------------------------------------------------


@query(f"WITH {_LINKS} SELECT bundle, from_path, target, line_no FROM l WHERE NOT EXISTS (SELECT 1 FROM docs WHERE docs.bundle = l.bundle AND docs.path = l.target)")
def links_broken(s, d):
    return graph.broken(links(s, d), live(s, d))


@query(f"WITH {_LINKS} SELECT bundle, path, entry_type FROM docs WHERE NOT regexp_matches(path, '(^|/)(index|log)\\.md$') AND NOT regexp_matches(path, '^/Archive(/.*)?$') AND NOT EXISTS (SELECT 1 FROM l WHERE docs.bundle = l.bundle AND docs.path = l.target)")
def orphans(s, d):
    return graph.orphans(live(s, d), links(s, d), ["/Archive/**"]).select("bundle", "path", "entry_type")


@query(f"WITH {_LINKS} SELECT bundle, target, count(*) AS n_links, count(DISTINCT from_path) AS n_sources FROM l GROUP BY 1, 2")
def backlinks(s, d):
    return graph.backlink_counts(links(s, d))


@query(f"WITH {_LINKS} SELECT bundle, target, from_path, link_text, line_no FROM l WHERE target = '/index.md'")
def backlinks_of(s, d):
    return graph.backlinks(links(s, d), "/index.md")


@query(f"WITH {_LINKS} SELECT bundle, from_path, target, link_text, line_no, ord FROM l QUALIFY row_number() OVER (PARTITION BY bundle, from_path, target ORDER BY ord, link_id) = 1")
def links_outgoing(s, d):
    return graph.outgoing(links(s, d))


_REACH = f"RECURSIVE {_LINKS}, r(bundle, path) AS (SELECT bundle, path FROM docs WHERE path = '/index.md' UNION SELECT l.bundle, l.target FROM r JOIN l ON l.bundle = r.bundle AND l.from_path = r.path JOIN docs k ON k.bundle = l.bundle AND k.path = l.target)"


@query(f"WITH {_REACH} SELECT bundle, path FROM r")
def reachable(s, d):
    return graph.reachable(live(s, d), links(s, d)).select("bundle", "path")


@query(f"WITH {_REACH} SELECT DISTINCT bundle, path FROM docs WHERE NOT regexp_matches(path, '(^|/)(index|log)\\.md$') AND bundle IN (SELECT bundle FROM docs WHERE path = '/index.md') AND (bundle, path) NOT IN (SELECT (bundle, path) FROM r)")
def unreachable(s, d):
    return graph.unreachable(live(s, d), links(s, d))


_ORDER = f"{_LINKS}, f AS (SELECT l.bundle, l.target AS path, min(l.ord) AS o FROM l JOIN docs k ON k.bundle = l.bundle AND k.path = l.target WHERE l.from_path = '/index.md' AND l.target <> '/index.md' GROUP BY 1, 2), seq AS (SELECT bundle, path, (row_number() OVER (PARTITION BY bundle ORDER BY o, path))::INT AS seq FROM f)"


@query(f"WITH {_ORDER} SELECT * FROM seq")
def reading_order(s, d):
    return graph.reading_order(live(s, d), links(s, d))


@query(f"WITH {_ORDER}, b AS (SELECT bundle, target, count(DISTINCT from_path) AS n FROM l WHERE from_path <> target GROUP BY 1, 2) SELECT q.bundle, q.path, lag(q.path) OVER w AS prev, lead(q.path) OVER w AS next, coalesce(b.n, 0) AS n_backlinks FROM seq q LEFT JOIN b ON b.bundle = q.bundle AND b.target = q.path WINDOW w AS (PARTITION BY q.bundle ORDER BY q.seq)")
def navigation(s, d):
    return graph.navigation(live(s, d), links(s, d))


_WIKI = """WITH w AS (SELECT DISTINCT link_id, bundle, from_path, regexp_extract(raw, '^\\[\\[([^\\]|#]*)', 1) AS name FROM links WHERE starts_with(raw, '[[')),
docs AS (SELECT DISTINCT bundle, path FROM corpus_files WHERE deleted_at IS NULL),
f AS (SELECT *, CASE WHEN name LIKE '%.md' THEN name ELSE name || '.md' END AS file FROM w),
e AS (SELECT f.link_id, k.path FROM f JOIN docs k ON k.bundle = f.bundle AND contains(f.name, '/') AND k.path = '/' || ltrim(f.file, '/')),
n AS (SELECT f.link_id, k.path FROM f JOIN docs k ON k.bundle = f.bundle AND NOT contains(f.name, '/') AND regexp_extract(k.path, '([^/]*)$', 1) = f.file
  QUALIFY row_number() OVER (PARTITION BY f.link_id ORDER BY length(k.path) - length(replace(k.path, '/', '')), regexp_replace(k.path, '/[^/]*$', '') <> regexp_replace(f.from_path, '/[^/]*$', ''), k.path) = 1)
SELECT f.link_id AS wiki_id, coalesce(e.path, n.path) AS path FROM f LEFT JOIN e USING (link_id) LEFT JOIN n USING (link_id)"""


def _wiki(s, d):
    rows = raw_links(s, d).where(F.col("raw").startswith("[["))
    return parse.wikilinks(rows, "raw", "link_id", "bundle", "from_path").select("bundle", "from_path", F.col("link_id").alias("wiki_id"), F.col("target").alias("name"), "raw", "anchor", "display")


@query(_WIKI)
def wikilinks_resolved(s, d):
    return graph.resolve_wikilinks(_wiki(s, d), live(s, d)).select("wiki_id", "path")


@query(f"WITH {_LINKS}, t AS (SELECT l.bundle, l.from_path AS path, list_sort(list(DISTINCT l.target)) AS ts FROM l JOIN docs k ON k.bundle = l.bundle AND k.path = l.target GROUP BY 1, 2) SELECT docs.bundle, docs.path, strlen(content)::BIGINT AS bytes, sha256(content) AS sha256, entry_type, coalesce(array_to_string(ts, ' '), '') AS links FROM docs LEFT JOIN t ON t.bundle = docs.bundle AND t.path = docs.path")
def graph_manifest(s, d):
    return graph.graph_rows(live(s, d), links(s, d)).select("bundle", "path", "bytes", "sha256", "entry_type", F.array_join("links", " ").alias("links"))


# --- provenance ---------------------------------------------------------------------------------------------------------


@query("SELECT coalesce(map {'go': 'go', 'py': 'python', 'ts': 'typescript', 'sql': 'sql', 'md': 'markdown', 'json': 'json', 'toml': 'toml'}[regexp_extract(path, '\\.([^.]+)$', 1)], 'other') AS type, count(*) AS n FROM inventory_snapshots GROUP BY 1")
def source_types(s, d):
    return table(s, d, "inventory_snapshots").groupBy(provenance.source_type(snapshots.canonical_path("path")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


#: What the paths and contents of documents are made into, by their number, and what becomes of them.
_SOURCES = {0: ("src/{n}.go", "", "go"), 1: ("lib/node_modules/{n}.js", "", None), 2: ("build/{n}.py", "", None), 3: ("src/build/{n}.PY", "", "python"), 4: ("etc/{n}/.env", "", "environment_credentials"), 5: ("{n}/id_rsa", "", "private_key_filename"), 6: ("{n}.env/.env.example", "", "other"), 7: ("{n}.txt", "-----BEGIN PRIVATE KEY-----\nx\n-----END PRIVATE KEY-----", "private_key_block"), 8: ("{n}.p12", "", "private_key_container"), 9: ("{n}/Makefile", "", "make")}


@query(
    "SELECT file_id, verdict, strlen(content || tail)::BIGINT AS bytes, sha256(content || tail) AS sha256 FROM (SELECT file_id, content, CASE WHEN file_id % 10 = 7 THEN '-----BEGIN PRIVATE KEY-----' || chr(10) || 'x' || chr(10) || '-----END PRIVATE KEY-----' ELSE '' END AS tail, CASE file_id % 10 "
    + " ".join(f"WHEN {k} THEN '{v}'" for k, (_, _, v) in _SOURCES.items() if v)
    + " END AS verdict FROM corpus_files WHERE content IS NOT NULL) WHERE verdict IS NOT NULL"
)
def inventory(s, d):
    """Kept files with their type, quarantined ones with the reason; pruned ones are in neither."""
    which, n = F.col("file_id") % 10, F.col("file_id").cast("string")
    path = F.replace(F.element_at(F.array(*(F.lit(p) for p, _, _ in _SOURCES.values())), which.cast("int") + 1), F.lit("{n}"), n)
    tail = F.element_at(F.array(*(F.lit(t) for _, t, _ in _SOURCES.values())), which.cast("int") + 1)
    made = files(s, d).where(F.col("content").isNotNull()).select("file_id", path.alias("path"), F.concat("content", tail).alias("content"))
    kept, out = provenance.inventory(made)
    number = F.regexp_extract("path", r"(\d+)", 1).cast("long")
    sizes = made.select("file_id", F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    away = out.select(number.alias("file_id"), F.col("reason").alias("verdict")).join(sizes, "file_id")
    return kept.select(number.alias("file_id"), F.col("type").alias("verdict"), "bytes", "sha256").unionByName(away)


def _drift_sql(key: str, a: str, b: str) -> str:
    return f"WITH b AS ({a}), n AS ({b}) SELECT coalesce(b.{key}, n.{key}) AS {key}, coalesce(b.path, n.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'modified' END AS status FROM b FULL JOIN n ON b.{key} = n.{key} AND b.path = n.path WHERE b.path IS NULL OR n.path IS NULL OR b.sha256 IS DISTINCT FROM n.sha256"


@query(_drift_sql("project", _SNAP.format(f="min"), _SNAP.format(f="max")))
def drift(s, d):
    return provenance.drift(snapshot(s, d, "first"), snapshot(s, d, "last"), "project", "path")


@query(_drift_sql("bundle", _BUILD.format(f="min"), _BUILD.format(f="max")))
def trust_diff(s, d):
    return provenance.drift(build(s, d, "first"), build(s, d, "last"), "bundle", "path")


@query("SELECT file_id, CASE WHEN content IS NULL THEN 'missing' ELSE 'mismatch' END AS problem FROM corpus_files WHERE sha256 IS NOT NULL AND (content IS NULL OR lower(sha256) <> sha256(content)) UNION ALL SELECT file_id, 'undeclared' FROM corpus_files WHERE sha256 IS NULL AND content IS NOT NULL")
def manifest_verify(s, d):
    f = files(s, d)
    return provenance.verify_manifest(f.where(F.col("sha256").isNotNull()), f.where(F.col("content").isNotNull()), "file_id")


@query(
    f"WITH b AS ({_BUILD.format(f='min')}), n AS ({_BUILD.format(f='max')}), c AS (SELECT bundle, path, max(sha256(content)) AS sha256 FROM corpus_files WHERE deleted_at IS NULL AND content IS NOT NULL GROUP BY 1, 2), "
    "k AS (SELECT bundle, path FROM b UNION SELECT bundle, path FROM n UNION SELECT bundle, path FROM c), r AS (SELECT k.bundle, k.path, b.sha256 AS b, n.sha256 AS d, c.sha256 AS c FROM k LEFT JOIN b USING (bundle, path) LEFT JOIN n USING (bundle, path) LEFT JOIN c USING (bundle, path)) "
    "SELECT bundle, path, CASE WHEN d IS DISTINCT FROM b AND c IS DISTINCT FROM b AND d IS NOT DISTINCT FROM c THEN 'converged' WHEN d IS DISTINCT FROM b AND c IS DISTINCT FROM b THEN 'conflict' WHEN d IS DISTINCT FROM b THEN 'apply' ELSE 'workspace' END AS change FROM r WHERE d IS DISTINCT FROM b OR c IS DISTINCT FROM b"
)
def checkin_plan(s, d):
    now = live(s, d).where(F.col("content").isNotNull()).groupBy("bundle", "path").agg(F.max(F.sha2("content", 256)).alias("sha256"))
    none = now.limit(0)
    return provenance.merge_plan(build(s, d, "first"), build(s, d, "last"), now, none, "bundle", "path")


@query(ORACLE["checkin_plan"].replace("SELECT bundle, path, CASE", "SELECT bundle, path, CASE WHEN d IS DISTINCT FROM b AND EXISTS (SELECT 1 FROM n WHERE n.bundle = r.bundle AND n.path = r.path) THEN 'conflict'"))
def checkin_generated(s, d):
    """The same plan where the files of the last build are generated, so that a draft may not change them."""
    now = live(s, d).where(F.col("content").isNotNull()).groupBy("bundle", "path").agg(F.max(F.sha2("content", 256)).alias("sha256"))
    draft = build(s, d, "last")
    return provenance.merge_plan(build(s, d, "first"), draft, now, draft, "bundle", "path")


@query(
    f"WITH o AS ({_BUILD.format(f='min')}), n AS ({_BUILD.format(f='max')}), e AS (SELECT bundle, path, max(sha256(content)) AS sha256 FROM corpus_files WHERE deleted_at IS NULL AND content IS NOT NULL GROUP BY 1, 2), "
    "k AS (SELECT bundle, path FROM o UNION SELECT bundle, path FROM n), r AS (SELECT k.bundle, k.path, o.sha256 AS o, n.sha256 AS n, e.sha256 AS e FROM k LEFT JOIN o USING (bundle, path) LEFT JOIN n USING (bundle, path) LEFT JOIN e USING (bundle, path)) "
    "SELECT bundle, path, CASE WHEN o IS NOT NULL AND e IS NOT NULL AND o <> e THEN 'edited' WHEN n IS NULL THEN 'delete' WHEN o IS NULL AND e IS NOT NULL AND n <> e THEN 'overwrite' ELSE 'write' END AS action FROM r WHERE (o IS NOT NULL AND e IS NOT NULL AND o <> e) OR (n IS NULL AND e IS NOT NULL) OR (n IS NOT NULL AND n IS DISTINCT FROM e)"
)
def ledger_plan(s, d):
    now = live(s, d).where(F.col("content").isNotNull()).groupBy("bundle", "path").agg(F.max(F.sha2("content", 256)).alias("sha256"))
    return provenance.ledger_plan(build(s, d, "first"), build(s, d, "last"), now, "bundle", "path")


def _resources(s, d):
    p = parsed(s, d)
    rows = p.select("file_id", "bundle", "path", F.explode("resources").alias("r"))
    return rows.select("file_id", "bundle", "path", paths.canonical_resource("path", "r").alias("resource"))


_RES = (
    f"{_FM}, rr AS (SELECT file_id, bundle, path, trim(unnest(regexp_extract_all(block, 'resource:[ ]*([^\\n]+)', 1)), ' ' || chr(34) || chr(39)) AS r FROM blocks), "
    + "rf AS (SELECT *, "
    + _fold_sql(f"string_split(CASE WHEN starts_with(r, './') OR starts_with(r, '../') THEN {_dir_sql('path')} || '/' || r ELSE r END, '/')")
    + " AS folded FROM rr), res AS (SELECT DISTINCT file_id, bundle, path, CASE WHEN starts_with(folded, '!') OR folded = '' THEN NULL ELSE ltrim(folded, '/') END AS resource FROM rf)"
)


@query(f"WITH {_RES} SELECT DISTINCT file_id, resource FROM res WHERE resource IS NOT NULL")
def resources_resolved(s, d):
    return _resources(s, d).where(F.col("resource").isNotNull()).select("file_id", "resource").distinct()


@query(
    f"WITH {_REACH}, {_RES}, dk AS (SELECT DISTINCT bundle, path FROM docs), bs AS ({_SNAP.format(f='min')}), ns AS ({_SNAP.format(f='max')}), "
    "of AS (SELECT DISTINCT x.bundle, x.path, x.resource FROM res x JOIN dk USING (bundle, path)), known AS (SELECT * FROM of WHERE resource IS NOT NULL), "
    "j AS (SELECT k.bundle, k.path, k.resource, ns.path IS NULL AS gone, bs.path IS NULL AS fresh, ns.sha256 IS DISTINCT FROM bs.sha256 AS other FROM known k LEFT JOIN ns ON ns.project = k.bundle AND ns.path = k.resource LEFT JOIN bs ON bs.project = k.bundle AND bs.path = k.resource), "
    "lone AS (SELECT bundle, path FROM docs WHERE NOT regexp_matches(path, '(^|/)(index|log)\\.md$') AND NOT EXISTS (SELECT 1 FROM l WHERE docs.bundle = l.bundle AND docs.path = l.target)), "
    "far AS (SELECT DISTINCT bundle, path FROM docs WHERE NOT regexp_matches(path, '(^|/)(index|log)\\.md$') AND bundle IN (SELECT bundle FROM docs WHERE path = '/index.md') AND (bundle, path) NOT IN (SELECT (bundle, path) FROM r) AND (bundle, path) NOT IN (SELECT (bundle, path) FROM lone)), "
    "sig AS (SELECT CASE WHEN gone THEN 'source_missing' WHEN fresh THEN 'source_not_in_baseline' WHEN other THEN 'source_changed' END AS signal FROM j "
    "UNION ALL SELECT 'missing_sources' FROM dk WHERE path <> '/index.md' AND (bundle, path) NOT IN (SELECT (bundle, path) FROM of) UNION ALL SELECT 'orphan' FROM lone UNION ALL SELECT 'unreachable' FROM far) "
    "SELECT signal, count(*) AS n FROM sig WHERE signal IS NOT NULL GROUP BY 1"
)
def health_signals(s, d):
    """All signals; a bundle's sources are the inventories of the project of its name, the first snapshot being the baseline."""
    docs, e = live(s, d).select("bundle", "path").distinct(), links(s, d)
    res = _resources(s, d).join(docs, ["bundle", "path"], "left_semi").select("bundle", "path", "resource")
    base, now = (snapshot(s, d, which).withColumnRenamed("project", "bundle") for which in ("first", "last"))
    found = provenance.health(docs, res, base, now, graph.orphans(docs, e), graph.unreachable(docs, e), "bundle")
    return provenance.health_summary(found)


@query("SELECT bundle, count(*) AS n_docs, sum(strlen(content))::BIGINT AS n_bytes, max(strlen(content))::BIGINT AS largest FROM corpus_files WHERE content IS NOT NULL GROUP BY 1")
def budgets(s, d):
    return provenance.budgets(files(s, d).where(F.col("content").isNotNull()), "bundle").select("bundle", "n_docs", "n_bytes", "largest")


@query(
    "WITH p AS (SELECT bundle, path FROM corpus_files UNION ALL SELECT bundle, upper(path) FROM corpus_files WHERE file_id % 10 = 0 UNION ALL SELECT bundle, path || 'é' FROM corpus_files WHERE file_id % 10 = 1 UNION ALL SELECT bundle, path || 'e' || chr(769) FROM corpus_files WHERE file_id % 10 = 1) "
    "SELECT bundle, replace(lower(path), 'e' || chr(769), 'é') AS key, count(DISTINCT path) AS n FROM p GROUP BY 1, 2 HAVING count(DISTINCT path) > 1"
)
def collisions(s, d):
    """The documents beside some of them in capitals, and with an accent of one or two characters."""
    f = files(s, d).select("file_id", "bundle", "path")
    upper = f.where(F.col("file_id") % 10 == 0).withColumn("path", F.upper("path"))
    marked = f.where(F.col("file_id") % 10 == 1).select("file_id", "bundle", F.explode(F.array(F.concat("path", F.lit("é")), F.concat("path", F.lit("e\u0301")))).alias("path"))
    return provenance.collisions(f.unionByName(upper).unionByName(marked), paths.canonical_key("path"), "bundle")


@query("SELECT event_type AS file, sum(n)::BIGINT AS statements, sum(CASE WHEN hit > 0 THEN n ELSE 0 END)::BIGINT AS covered FROM (SELECT event_type, user_id, max(event_id % 3) AS hit, max(user_id % 7 + 1) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def coverage_merge(s, d):
    e = table(s, d, "events").select(F.col("event_type").alias("file"), F.col("user_id").cast("string").alias("span"), (F.col("user_id") % 7 + 1).alias("statements"), (F.col("event_id") % 3).alias("hits"))
    return provenance.merged_coverage(e)


# --- checks -----------------------------------------------------------------------------------------------------------------


@query(
    f"WITH {_FM}, v AS (SELECT file_id, path, block, {_VALUE.format(k='type')} AS type, {_VALUE.format(k='status')} AS status, regexp_matches(path, '(^|/)(index|log)\\.md$') AS reserved, contains(chr(10) || block, chr(10) || 'status:') AS has_status FROM blocks) "
    "SELECT file_id, rule FROM (SELECT file_id, 'type is missing' AS rule FROM v WHERE NOT reserved AND (block IS NULL OR type = '') UNION ALL SELECT file_id, 'status is not in the vocabulary' FROM v WHERE NOT reserved AND has_status AND status NOT IN ('draft', 'stable', 'deprecated') "
    "UNION ALL SELECT file_id, 'path is too deep' FROM v WHERE length(path) - length(replace(path, '/', '')) - 1 > 2 UNION ALL SELECT file_id, 'path holds a space' FROM v WHERE contains(path, ' ') "
    "UNION ALL SELECT file_id, 'index.md declares properties' FROM v WHERE regexp_matches(path, '(^|/)index\\.md$') AND regexp_matches(chr(10) || block, '\\n[A-Za-z_]+:') AND NOT regexp_matches(chr(10) || block, '^\\nokf_version:[^\\n]*$'))"
)
def check_issues(s, d):
    return checks.document_issues(parsed(s, d), "file_id", max_depth=2).select("file_id", "rule")


#: Put behind the documents, by their number: every construct a publication refuses, bare and in code.
_REFUSED = ("[a][b]", "[a]: x.md", "<A class=x HREF='y'>", "![[e]]", "`[[x]]` `<a href=y>`", "[a](javascript:x)", "[a](/root.md)", "[a](../../../../../../u.md)", "[a](%zz.md)", "[a](x\\y.md)", "~~~\n[[x]] [a](file:x)\n~~~", "closed ]]", "[a](https://h.org/x) [b](ok.md#y)")


@query(
    "WITH adapted AS (SELECT file_id, path, content || chr(10) || chr(10) || CASE file_id % 13 "
    + " ".join(f"WHEN {k} THEN '{x.replace(chr(39), chr(39) * 2)}'" for k, x in enumerate(_REFUSED))
    + " END AS content FROM corpus_files WHERE content IS NOT NULL), "
    + _LINES.replace("corpus_files", "adapted")
    + """, bare AS (SELECT file_id, line_no, regexp_replace(line, '`[^`]*`', '', 'g') AS line FROM prose),
forms AS (SELECT file_id, line_no, '' AS detail, CASE WHEN regexp_matches(line, '^[\\t ]{0,3}\\[[^\\]\\n]+\\]:[\\t ]*\\S') OR regexp_matches(line, '\\[[^\\]\\n]+\\]\\[[^\\]\\n]*\\]([^(]|$)') THEN 'reference link' WHEN regexp_matches(line, '(?i)<a\\s[^>]*href') THEN 'HTML link' WHEN contains(line, '[[') OR contains(line, ']]') THEN 'wikilink' END AS rule FROM bare),
dests AS (SELECT file_id, line_no, trim(unnest(regexp_extract_all(line, '\\[([^\\]]*)\\]\\(([^)]+)\\)', 2)), ' ' || chr(9) || chr(13)) AS dest FROM bare),
raws AS (SELECT d.file_id, d.line_no, a.path AS from_path, CASE WHEN starts_with(dest, '<') THEN regexp_extract(dest, '^<([^>]*)', 1) ELSE regexp_extract(dest, '^([^ \\t]*)', 1) END AS raw FROM dests d JOIN adapted a USING (file_id)),
kinds AS (SELECT *, CASE WHEN starts_with(raw, '#') THEN 'self' WHEN regexp_matches(raw, '^[A-Za-z][A-Za-z0-9+.-]*:') OR starts_with(raw, '//') THEN 'external' ELSE 'inner' END AS kind, regexp_replace(raw, '#.*$', '') AS part FROM raws),
folds AS (SELECT *, """
    + _fold_sql(f"string_split(CASE WHEN kind <> 'inner' THEN '' WHEN starts_with(part, '/') THEN part ELSE {_dir_sql('from_path')} || '/' || url_decode(CASE WHEN regexp_matches(part, '%([^0-9A-Fa-f]|.[^0-9A-Fa-f]|.?$)') THEN '' ELSE part END) END, '/')")
    + """ AS folded FROM kinds),
targets AS (SELECT file_id, line_no, raw AS detail, CASE WHEN kind = 'external' AND lower(regexp_extract(raw, '^([^:]*):', 1)) IN ('javascript', 'data', 'file', 'vbscript', 'about', 'blob') THEN 'forbidden scheme'
  WHEN kind = 'inner' AND contains(part, '\\') THEN 'unsafe target' WHEN kind = 'inner' AND regexp_matches(part, '%([^0-9A-Fa-f]|.[^0-9A-Fa-f]|.?$)') THEN 'invalid escape' WHEN kind = 'inner' AND starts_with(part, '/') THEN 'root-absolute link' WHEN kind = 'inner' AND starts_with(folded, '!') THEN 'link leaves the corpus' END AS rule FROM folds)
SELECT file_id, line_no::INT AS line_no, rule, detail FROM (SELECT * FROM forms UNION ALL BY NAME SELECT * FROM targets) WHERE rule IS NOT NULL"""
)
def gate_issues(s, d):
    tail = F.coalesce(*(F.when(F.col("file_id") % 13 == k, F.lit(x)) for k, x in enumerate(_REFUSED)))
    made = files(s, d).where(F.col("content").isNotNull()).select("file_id", "path", F.concat("content", F.lit("\n\n"), tail).alias("content"))
    return checks.gate_issues(made, "content", "file_id")


@query("SELECT heading_id, regexp_matches(heading_text, '^\\d{4}-\\d{2}-\\d{2}$') AS dated FROM (SELECT DISTINCT heading_id, heading_text FROM headings WHERE heading_text IS NOT NULL)")
def dated_headings(s, d):
    rows = table(s, d, "headings").where(F.col("heading_text").isNotNull()).select("heading_id", "heading_text").distinct()
    return rows.select("heading_id", (checks.valid_timestamp("heading_text") & ~checks.odd_date("heading_text")).alias("dated"))


@query(f"WITH {_LINKS}, s AS (SELECT DISTINCT k.bundle, k.path, n.slug FROM docs k JOIN (SELECT file_id, CASE WHEN i = 0 THEN slug ELSE slug || '-' || i END AS slug FROM (SELECT file_id, slug, row_number() OVER (PARTITION BY file_id, slug ORDER BY ord, heading_id) - 1 AS i FROM (SELECT DISTINCT heading_id, file_id, ord, regexp_replace(replace(lower(heading_text), ' ', '-'), '[^\\p{{L}}\\p{{N}}_-]', '', 'g') AS slug FROM headings))) n USING (file_id)), c AS (SELECT *, regexp_replace(replace(lower(anchor), ' ', '-'), '[^\\p{{L}}\\p{{N}}_-]', '', 'g') AS want, EXISTS (SELECT 1 FROM docs WHERE docs.bundle = l.bundle AND docs.path = l.target) AS there FROM l) SELECT bundle, from_path AS path, 'warning' AS level, 'broken link' AS rule, target AS detail FROM c WHERE NOT there UNION ALL SELECT bundle, from_path, 'warning', 'anchor not found', target || '#' || anchor FROM c WHERE there AND anchor <> '' AND NOT starts_with(anchor, '^') AND NOT EXISTS (SELECT 1 FROM s WHERE s.bundle = c.bundle AND s.path = c.target AND s.slug = c.want)")
def check_links(s, d):
    at = references.heading_anchors(table(s, d, "headings")).join(live(s, d).select("file_id", "bundle", "path"), "file_id").select("bundle", "path", "slug")
    return checks.graph_issues(links(s, d), live(s, d), at)


# --- rewrites ---------------------------------------------------------------------------------------------------------------


@query(
    "WITH a AS (" + _normal_sql("SELECT DISTINCT link_id, bundle, from_path, raw FROM links WHERE starts_with(raw, '/') AND NOT starts_with(raw, '//') AND NOT contains(raw, ' ')") + "), "
    f"t AS (SELECT link_id, bundle, from_path, raw AS old, {_seen_from_sql('from_path', 'path')} || coalesce('#' || anchor, '') AS new FROM a WHERE NOT escapes) SELECT * FROM t WHERE old <> new"
)
def tidy_links(s, d):
    return rewrite.tidy_links_plan(raw_links(s, d), "link_id", "bundle")


@query("WITH r AS (SELECT bundle, path, array_to_string(list_transform(string_split(path, '/'), lambda x: array_to_string(list_filter(regexp_split_to_array(x, '\\s+'), lambda y: y <> ''), '-')), '/') AS new_path FROM corpus_files WHERE deleted_at IS NULL AND regexp_matches(path, '\\s')), n AS (SELECT bundle, new_path, count(*) AS k FROM r GROUP BY 1, 2) SELECT r.bundle, r.path, r.new_path, n.k > 1 OR EXISTS (SELECT 1 FROM corpus_files c WHERE c.deleted_at IS NULL AND c.bundle = r.bundle AND c.path = r.new_path) AS collides FROM r JOIN n USING (bundle, new_path)")
def tidy_slugs(s, d):
    return rewrite.slug_plan(live(s, d), "bundle")


@query(
    ORACLE["tidy_slugs"].replace("SELECT r.bundle, r.path, r.new_path", ", mv AS (SELECT r.bundle, r.path AS old, r.new_path AS nw", 1).replace("AS collides FROM r JOIN n USING (bundle, new_path)", "AS collides FROM r JOIN n USING (bundle, new_path))")
    + ", lk AS (SELECT DISTINCT bundle, from_path, target FROM links WHERE target IS NOT NULL), "
    "x AS (SELECT lk.*, f.nw AS nf, t.nw AS nt FROM lk LEFT JOIN mv f ON f.bundle = lk.bundle AND f.old = lk.from_path AND NOT f.collides LEFT JOIN mv t ON t.bundle = lk.bundle AND t.old = lk.target AND NOT t.collides), "
    "y AS (SELECT bundle, from_path, target AS old_target, coalesce(nf, from_path) AS new_from, coalesce(nt, target) AS goal FROM x WHERE nf IS NOT NULL OR nt IS NOT NULL) "
    f"SELECT bundle, from_path, old_target, new_from, {_seen_from_sql('new_from', 'goal')} AS new_target FROM y"
)
def move_plan(s, d):
    """Respelling when every path with a blank gets its slug."""
    moves = rewrite.slug_plan(live(s, d), "bundle").where(~F.col("collides")).select("bundle", F.col("path").alias("old"), F.col("new_path").alias("new"))
    return rewrite.move_plan(links(s, d), moves, "bundle")


@query(
    _WIKI.replace("SELECT f.link_id AS wiki_id, coalesce(e.path, n.path) AS path FROM f", ", z AS (SELECT f.link_id, f.bundle, f.from_path, coalesce(e.path, n.path) AS path FROM f").replace("LEFT JOIN n USING (link_id)", "LEFT JOIN n USING (link_id))")
    + f", q AS (SELECT z.*, k.inside, regexp_extract(k.inside, '#([^|]*)', 1) AS anchor, trim(regexp_extract(k.inside, '\\|(.*)$', 1)) AS display FROM z JOIN (SELECT DISTINCT link_id, regexp_extract(raw, '^\\[\\[(.*?)\\]\\]', 1) AS inside FROM links WHERE starts_with(raw, '[[')) k USING (link_id)) "
    f"SELECT bundle, from_path, '[[' || inside || ']]' AS old, '[' || CASE WHEN display <> '' THEN display ELSE regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.md$', '') END || '](' || {_seen_from_sql('from_path', 'path')} || CASE WHEN anchor <> '' THEN '#' || anchor ELSE '' END || ')' AS new, CASE WHEN path IS NULL THEN 'no such document' END AS skip FROM q"
)
def tidy_wikilinks(s, d):
    w = _wiki(s, d)
    found = graph.resolve_wikilinks(w.select("bundle", "from_path", "wiki_id", "name"), live(s, d)).select("wiki_id", "path")
    return rewrite.wikilink_plan(w.join(found, "wiki_id"))


@query("SELECT file_id, lower(regexp_replace(replace(lower(title), ' ', '-'), '[^\\p{L}\\p{N}_-]', '', 'g')) AS slug FROM (SELECT DISTINCT file_id, title FROM entries WHERE title IS NOT NULL)")
def title_slugs(s, d):
    return table(s, d, "entries").where(F.col("title").isNotNull()).select("file_id", "title").distinct().select("file_id", text.heading_slug("title").alias("slug"))


# --- further functions ------------------------------------------------------------------------------------------------------

_VERSION = "(string_split(cli_version, '.')[1]::INT * 1000000 + string_split(cli_version, '.')[2]::INT * 1000 + string_split(cli_version, '.')[3]::INT)"


@query(f"SELECT command_name, arg_max(cli_version, {_VERSION}) AS last_version, count(DISTINCT cli_version) AS n_versions FROM help_commands GROUP BY 1")
def command_versions(s, d):
    return table(s, d, "help_commands").groupBy("command_name").agg(F.max_by("cli_version", text.version_key("cli_version")).alias("last_version"), F.count_distinct("cli_version").alias("n_versions"))


@query("SELECT file_id, CASE WHEN slug = '' THEN 'corpus' ELSE slug END AS slug FROM (SELECT DISTINCT file_id, trim(regexp_replace(lower(title), '[^\\p{L}\\p{Nd}]+', '-', 'g'), '-') AS slug FROM entries WHERE title IS NOT NULL)")
def landing_slugs(s, d):
    return table(s, d, "entries").where(F.col("title").isNotNull()).select("file_id", text.landing_slug("title").alias("slug")).distinct()


@query("SELECT bundle, count(*) FILTER (regexp_matches(sha256, '^[0-9a-f]{64}$')) AS n_valid, count(*) AS n_rows FROM graph_files GROUP BY 1")
def hash_syntax(s, d):
    return table(s, d, "graph_files").groupBy("bundle").agg(F.count_if(provenance.valid_hash("sha256")).alias("n_valid"), F.count(F.lit(1)).alias("n_rows"))


@query("SELECT file_id, (length(t) + length(regexp_replace(t, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')))::BIGINT AS units FROM (SELECT file_id, content || repeat('😀é', (file_id % 4)::INT) AS t FROM corpus_files WHERE content IS NOT NULL)")
def utf16_lengths(s, d):
    """The documents with some characters beyond the basic plane put behind them."""
    made = F.concat("content", F.repeat(F.lit("😀é"), (F.col("file_id") % 4).cast("int")))
    return files(s, d).where(F.col("content").isNotNull()).select("file_id", provenance.utf16_length(made).cast("long").alias("units"))


@query(f"WITH n AS ({_BUILD.format(f='max')}), c AS (SELECT DISTINCT bundle, path FROM corpus_files WHERE deleted_at IS NULL) SELECT c.bundle, c.path, 'left' AS side FROM c WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.bundle = c.bundle AND n.path = c.path) UNION ALL SELECT n.bundle, n.path, 'right' FROM n WHERE NOT EXISTS (SELECT 1 FROM c WHERE n.bundle = c.bundle AND n.path = c.path)")
def index_equality(s, d):
    return graph.set_difference(live(s, d), build(s, d, "last"), "bundle", "path")


@query("SELECT file_id, 'guide' AS label FROM corpus_files WHERE regexp_matches(path, '^/guides(/.*)?$') UNION ALL SELECT file_id, 'entry' FROM corpus_files WHERE regexp_matches(path, '(^|/)(index|log)\\.md$') UNION ALL SELECT file_id, 'numbered' FROM corpus_files WHERE regexp_matches(path, '[0-9]\\.md$')")
def path_labels(s, d):
    rules = {"guide": ["guides/**"], "entry": ["**/index.md", "**/log.md"], "numbered": ["**/*[0-9].md"]}
    return graph.path_labels(files(s, d), rules, "file_id")
