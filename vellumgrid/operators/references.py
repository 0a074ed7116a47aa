"""References to records that do not exist.

References are summed per key and period before anything else moves, so a key
that holds a third of them is a few rows. These sums are held against the
records; what a period's sum cannot decide, because a record came or went within
it, is summed again per instant. Counts come from the sums; single references are
listed by a semi-join with the keys found wanting.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumgrid.functions.text import heading_slug
from vellumgrid.runtime import BROADCAST_BYTES, broadcast_if_small, materialise, measured_bytes

#: A key with more references than this is never sent to one task.
ROWS_PER_TASK = 1_000_000

LINK_KEY = ["bundle", "path", "slug", "period"]
GRAPH_KEY = ["bundle", "build_no", "path", "period"]


def reference_counts(refs: DataFrame, key: list[str], at: str) -> DataFrame:
    """``(key..., n, lo, hi)``: references per key (period included), and their first and last time."""
    return refs.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("lo"), F.max(at).alias("hi"))


def _same(key: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key])


def pick(refs: DataFrame, keys: DataFrame, key: list[str], counts: DataFrame, rows_per_task: int = ROWS_PER_TASK, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The references whose key is among ``keys(key..., status)``, NULLs alike, with the status; ``mixed`` keys are passed over.

    Where the keys are small they are broadcast and no reference moves. Beyond,
    the heavy keys (by ``counts``, at most one for ``rows_per_task`` references)
    are looked up by broadcast; the other references are joined by shuffle.
    """
    wanted = keys.select(*[F.col(c).alias(f"_{c}") for c in key], "status")
    plain = [*refs.columns, "status"]
    if measured_bytes(keys) <= broadcast_bytes:
        return refs.join(F.broadcast(wanted.where(F.col("status") != "mixed")), _same(key)).select(*plain)
    wanted = wanted.where(F.col("status") != "mixed")
    heavy = materialise(counts.where(F.col("n") > rows_per_task).select(*[F.col(c).alias(f"_{c}") for c in key]), "heavy")
    marked = refs.join(broadcast_if_small(heavy.withColumn("_heavy", F.lit(True))), _same(key), "left")
    hot = marked.where(F.col("_heavy")).select(*refs.columns)
    cold = marked.where(F.col("_heavy").isNull()).select(*refs.columns)
    one = reduce(lambda a, b: a & b, [wanted[f"_{c}"].eqNullSafe(heavy[f"_{c}"]) for c in key])
    return hot.join(broadcast_if_small(wanted.join(heavy, one, "left_semi")), _same(key)).select(*plain).unionByName(cold.join(wanted, _same(key)).select(*plain))


def slug_counts(headings: DataFrame) -> DataFrame:
    """``(file_id, slug, n)``: how many headings of a file give the same anchor.

    Duplicate deliveries (same ``heading_id``) count once; a NULL text has no anchor.
    """
    once = headings.where(F.col("heading_text").isNotNull()).select("file_id", heading_slug("heading_text").alias("slug"), "heading_id").distinct()
    return once.groupBy("file_id", "slug").agg(F.count(F.lit(1)).alias("n"))


def heading_anchors(headings: DataFrame) -> DataFrame:
    """``(file_id, slug)``: the anchors of every file; ``n`` headings of one slug have the anchors ``slug``, ``slug-1`` … ``slug-(n-1)``."""
    each = slug_counts(headings).select("file_id", "slug", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    return each.select("file_id", F.when(F.col("k") == 0, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), F.col("k").cast("string"))).alias("slug")).distinct()


def judge(sums: DataFrame, lives: DataFrame, slugs: DataFrame) -> DataFrame:
    """``(key..., n, status)`` of sums ``(key..., n, lo, hi)`` of links: ``target`` if no record of the path was
    there at any of their times, ``anchor`` if all records were there all the time but none has the anchor, ``mixed``
    if records came or went between; NULL if nothing is missing.
    """
    created, deleted = F.col("created_at"), F.col("deleted_at")
    life = lives.where(F.col("path").isNotNull()).select(F.col("bundle").alias("_bundle"), F.col("path").alias("_path"), "file_id", "created_at", "deleted_at")
    touches = (created <= F.col("hi")) & (deleted.isNull() | (deleted > F.col("lo")))
    covers = (created <= F.col("lo")) & (deleted.isNull() | (deleted > F.col("hi")))
    # an inner join, so that adaptive execution may split either side of a path with many records
    met = sums.join(life, (F.col("bundle") == F.col("_bundle")) & (F.col("path") == F.col("_path")) & touches)
    # heading number k of a slug is slug-k
    slug = F.col("slug")
    number = F.regexp_extract(slug, r"-([1-9]\d{0,8})\z", 1)
    as_is = F.struct(slug.alias("base"), F.lit(0).cast("long").alias("k"))
    numbered = F.struct(F.regexp_replace(slug, r"-[1-9]\d{0,8}\z", "").alias("base"), number.try_cast("long").alias("k"))
    asked = met.select(*LINK_KEY, covers.alias("covers"), "file_id", F.explode(F.when(number != "", F.array(as_is, numbered)).otherwise(F.array(as_is))).alias("a"))
    have = slugs.select(F.col("file_id").alias("_file_id"), F.col("slug").alias("_slug"), F.col("n").alias("_n"))
    found = asked.join(have, (F.col("file_id") == F.col("_file_id")) & (F.col("a.base") == F.col("_slug")), "left")
    answers = found.select(*LINK_KEY, F.lit(None).cast("long").alias("n"), "covers", (slug.isNull() | F.coalesce(F.col("_n") > F.col("a.k"), F.lit(False))).alias("there"))
    nothing = F.lit(None).cast("boolean")
    all_ = sums.select(*LINK_KEY, "n", nothing.alias("covers"), nothing.alias("there")).unionByName(answers)
    status = F.when(F.count("covers") == 0, "target").when(~F.bool_and("covers"), "mixed").when(~F.bool_or("there"), "anchor")
    return all_.groupBy(*LINK_KEY).agg(F.max("n").alias("n"), status.alias("status"))


def _month(c: str) -> Column:
    return F.date_trunc("month", c).cast("timestamp")


class _Links:
    """Orphan sums of links per month, and per instant where months don't decide."""

    def __init__(self, links: DataFrame, files: DataFrame, headings: DataFrame, once: bool):
        anchor = F.col("anchor")
        slug = F.when(anchor.isNotNull() & ~anchor.startswith("^"), heading_slug(anchor))
        self.refs = links.where(F.col("target").isNotNull()).select("link_id", "bundle", F.col("target").alias("path"), slug.alias("slug"), "seen_at")
        if once:  # counts need every delivery once; a list is made distinct in the end
            self.refs = self.refs.distinct()
        slugs = slug_counts(headings)
        self.by_month = self.refs.withColumn("period", _month("seen_at"))
        self.month_sums = reference_counts(self.by_month, LINK_KEY, "seen_at")
        judged = materialise(judge(self.month_sums, files, slugs).where(F.col("status").isNotNull()), "months", measure=True)
        self.months, mixed = judged, judged.where(F.col("status") == "mixed")
        self.instants = None
        if not mixed.isEmpty():
            again = mixed.withColumn("status", F.lit("again"))
            rest = pick(self.by_month, again, LINK_KEY, self.month_sums).drop("status")
            self.instant_sums = reference_counts(rest.withColumn("period", F.col("seen_at")), LINK_KEY, "seen_at")
            self.instants = materialise(judge(self.instant_sums, files, slugs).where(F.col("status").isNotNull()), "instants", measure=True)

    def orphans(self) -> DataFrame:
        found = pick(self.by_month, self.months, LINK_KEY, self.month_sums)
        if self.instants is not None:
            by_instant = self.refs.withColumn("period", F.col("seen_at"))
            found = found.unionByName(pick(by_instant, self.instants, LINK_KEY, self.instant_sums))
        return found.groupBy("link_id").agg(F.min(F.struct("bundle", "seen_at", "status")).alias("o")).select("link_id", "o.bundle", "o.seen_at", F.col("o.status").alias("reason"))

    def counts(self) -> DataFrame:
        sums = self.months.where(F.col("status") != "mixed").select("period", "n")
        if self.instants is not None:
            sums = sums.unionByName(self.instants.select(_month("period").alias("period"), "n"))
        return sums.groupBy("period").agg(F.sum("n").alias("n_orphans"))


class _Graph:
    """Orphan sums of manifest links per month."""

    def __init__(self, graph_files: DataFrame, once: bool):
        rows = graph_files.select("graph_id", "bundle", "build_no", "links", "built_at")
        if once:
            rows = rows.groupBy("graph_id").agg(F.min(F.struct("bundle", "build_no", "links", "built_at")).alias("g")).select("graph_id", "g.*")
        self.refs = rows.select("graph_id", "bundle", "build_no", "built_at", _month("built_at").alias("period"), F.posexplode("links").alias("_p", "path")).withColumn("item_pos", (F.col("_p") + 1).cast("int"))
        self.sums = reference_counts(self.refs, GRAPH_KEY, "built_at")
        known = graph_files.where(F.col("path").isNotNull()).select("bundle", "build_no", "path").distinct()
        self.bad = materialise(self.sums.join(known, ["bundle", "build_no", "path"], "left_anti").select(*GRAPH_KEY, "n", F.lit("target").alias("status")), "graph", measure=True)

    def orphans(self) -> DataFrame:
        found = pick(self.refs, self.bad, GRAPH_KEY, self.sums)
        return found.groupBy("graph_id", "item_pos").agg(F.min(F.struct("bundle", "built_at")).alias("o")).select("graph_id", "item_pos", "o.*")

    def counts(self) -> DataFrame:
        return self.bad.groupBy("period").agg(F.sum("n").alias("n_orphans"))


def orphan_links(links: DataFrame, files: DataFrame, headings: DataFrame) -> DataFrame:
    """Links whose target file did not exist at ``seen_at``, or exists without the anchor.

    Result ``(link_id, bundle, seen_at, reason)`` with reason ``target`` or
    ``anchor``; one row per link id however often it was delivered (a link
    delivered with different contents is an orphan if one of them is). External
    links (target NULL) are no references. A NULL bundle or seen_at matches no
    record, so such a link is an orphan. Anchors that are NULL or begin with
    ``^`` are not looked up; an anchor of blanks or symbols only is looked up as
    an empty slug. If several records of a path are alive, an anchor in any of
    them counts. Other columns are ignored; empty tables give an empty result.
    """
    return _Links(links, files, headings, once=False).orphans()


def orphan_graph_links(graph_files: DataFrame) -> DataFrame:
    """Elements of ``links`` that are no path of the same bundle and build.

    Result ``(graph_id, item_pos, bundle, built_at)``. A row delivered twice
    counts once; NULL or empty ``links`` give nothing; a NULL element names no
    document and is an orphan, as are all elements of a row without bundle or build.
    """
    return _Graph(graph_files, once=False).orphans()


def _both(links: DataFrame, files: DataFrame, headings: DataFrame, graph_files: DataFrame, once: bool) -> tuple[_Links, _Graph]:
    with ThreadPoolExecutor(2) as both:  # their written tables don't depend on each other
        of_links, of_graph = both.submit(_Links, links, files, headings, once), both.submit(_Graph, graph_files, once)
        return of_links.result(), of_graph.result()


def orphan_references(links: DataFrame, files: DataFrame, headings: DataFrame, graph_files: DataFrame) -> DataFrame:
    """All orphan references: ``(ref_table, ref_id, item_pos)``."""
    of_links, of_graph = _both(links, files, headings, graph_files, once=False)
    a = of_links.orphans().select(F.lit("links").alias("ref_table"), F.col("link_id").alias("ref_id"), F.lit(0).alias("item_pos"))
    return a.unionByName(of_graph.orphans().select(F.lit("graph_files").alias("ref_table"), F.col("graph_id").alias("ref_id"), "item_pos"))


def orphan_report(links: DataFrame, files: DataFrame, headings: DataFrame, graph_files: DataFrame) -> DataFrame:
    """``(ref_table, period, n_orphans)``: orphans per table and month of seen_at or built_at, from the sums alone.

    Rows delivered twice count once; rows without a time have the period NULL.
    """
    of_links, of_graph = _both(links, files, headings, graph_files, once=True)
    return of_links.counts().withColumn("ref_table", F.lit("links")).unionByName(of_graph.counts().withColumn("ref_table", F.lit("graph_files"))).select("ref_table", "period", "n_orphans")
