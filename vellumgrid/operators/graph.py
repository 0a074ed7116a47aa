"""The link graph: broken links, orphans, backlinks, reachability, navigation.

Documents are ``(bundle, path)``; edges are ``(bundle, from_path, ord, target)``.
Any further grouping column works like ``bundle``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumgrid.functions.paths import basename, depth, dirname, matches_glob
from vellumgrid.runtime import broadcast_if_small, materialise, written_rows


def edges(links: DataFrame) -> DataFrame:
    """One row per link that names an internal target, however often it was delivered."""
    kept = links.where(F.col("target").isNotNull())
    return kept.groupBy("link_id").agg(F.min(F.struct("bundle", "from_path", "ord", "link_text", "target", "anchor", "line_no", "wikilink")).alias("l")).select("link_id", "l.*")


def broken(links: DataFrame, docs: DataFrame) -> DataFrame:
    """``(bundle, from_path, target, line_no)`` of links to documents that are not there."""
    known = docs.select("bundle", F.col("path").alias("target"))
    return links.join(known, ["bundle", "target"], "left_anti").select("bundle", "from_path", "target", "line_no")


def exempt(path: Column | str, globs: Sequence[str] = ()) -> Column:
    """Index and log files, and what the globs name, need no incoming link."""
    own = basename(path).isin("index.md", "log.md")
    return reduce(lambda a, b: a | b, [matches_glob(path, g) for g in globs], own)


def orphans(docs: DataFrame, links: DataFrame, globs: Sequence[str] = ()) -> DataFrame:
    """Documents no link leads to (a link to itself counts), without the exempt ones."""
    linked = links.select("bundle", F.col("target").alias("path"))
    return docs.where(~exempt("path", globs)).join(linked, ["bundle", "path"], "left_anti")


def backlinks(links: DataFrame, target: str | None = None) -> DataFrame:
    """``(bundle, target, from_path, link_text, line_no)``: every link to a document, or to all of them in one pass."""
    rows = links.where(F.col("target") == target) if target is not None else links
    return rows.select("bundle", "target", "from_path", "link_text", "line_no")


def backlink_counts(links: DataFrame) -> DataFrame:
    return links.groupBy("bundle", "target").agg(F.count(F.lit(1)).alias("n_links"), F.count_distinct("from_path").alias("n_sources"))


def outgoing(links: DataFrame) -> DataFrame:
    """The links of each document, the first of each target kept."""
    turn = F.row_number().over(Window.partitionBy("bundle", "from_path", "target").orderBy("ord", "link_id"))
    return links.withColumn("_n", turn).where(F.col("_n") == 1).select("bundle", "from_path", "target", "link_text", "line_no", "ord")


#: Hops computed in one plan before the new documents are written.
HOPS_PER_ROUND = 2


def reachable(docs: DataFrame, links: DataFrame, root: str = "/index.md", hops_per_round: int = HOPS_PER_ROUND) -> DataFrame:
    """``(bundle, path, hops)`` of the documents a chain of links leads to from the root.

    Breadth first over all bundles at once, a few hops to a plan; each round is a
    written table, so a lost executor costs no earlier round. Edges are prepared once.
    """
    known = docs.select("bundle", "path").distinct()
    steps = links.select("bundle", F.col("from_path").alias("path"), F.col("target").alias("next")).distinct().join(known.withColumnRenamed("path", "next"), ["bundle", "next"], "left_semi")
    steps = materialise(steps.where(F.col("path") != F.col("next")), "edges")
    seen = frontier = docs.where(F.col("path") == root).select("bundle", "path").distinct().withColumn("hops", F.lit(0))
    hops = 0
    while True:
        found, last = None, frontier
        for _ in range(hops_per_round):
            hops += 1
            before = seen if found is None else seen.unionByName(found)
            step = last.select("bundle", "path").join(steps, ["bundle", "path"]).select("bundle", F.col("next").alias("path")).distinct()
            last = step.join(before, ["bundle", "path"], "left_anti").withColumn("hops", F.lit(hops))
            found = last if found is None else found.unionByName(last)
        found = materialise(found, "reached", measure=True)
        if not written_rows(found):
            return seen
        seen = seen.unionByName(found)
        frontier = found.where(F.col("hops") == hops)


def unreachable(docs: DataFrame, links: DataFrame, root: str = "/index.md", globs: Sequence[str] = ()) -> DataFrame:
    """Documents of bundles with a root that no chain of links leads to, without the exempt ones."""
    rooted = broadcast_if_small(docs.where(F.col("path") == root).select("bundle").distinct())
    far = docs.select("bundle", "path").distinct().where(~exempt("path", globs)).join(rooted, "bundle", "left_semi")
    return far.join(reachable(docs, links, root), ["bundle", "path"], "left_anti")


def reading_order(docs: DataFrame, links: DataFrame, root: str = "/index.md") -> DataFrame:
    """``(bundle, path, seq)``: the targets of the root's links in order of first occurrence."""
    known = docs.select("bundle", F.col("path").alias("target")).distinct()
    first = links.where((F.col("from_path") == root) & (F.col("target") != root)).groupBy("bundle", "target").agg(F.min("ord").alias("ord"))
    there = first.join(known, ["bundle", "target"], "left_semi")
    return there.select("bundle", F.col("target").alias("path"), F.row_number().over(Window.partitionBy("bundle").orderBy("ord", "target")).alias("seq"))


def navigation(docs: DataFrame, links: DataFrame, root: str = "/index.md") -> DataFrame:
    """``(bundle, path, prev, next, n_backlinks)`` along the reading order; links to oneself are no backlinks."""
    order = reading_order(docs, links, root)
    w = Window.partitionBy("bundle").orderBy("seq")
    back = links.where(F.col("from_path") != F.col("target")).groupBy("bundle", F.col("target").alias("path")).agg(F.count_distinct("from_path").alias("n_backlinks"))
    return order.select("bundle", "path", F.lag("path").over(w).alias("prev"), F.lead("path").over(w).alias("next")).join(back, ["bundle", "path"], "left").withColumn("n_backlinks", F.coalesce("n_backlinks", F.lit(0)))


def alias_map(values: DataFrame) -> DataFrame:
    """``(bundle, alias, path)`` from properties named ``aliases``; of several claimants the least path."""
    rows = values.where((F.col("key") == "aliases") & (F.trim("value") != ""))
    return rows.groupBy("bundle", F.trim("value").alias("alias")).agg(F.min("path").alias("path"))


def resolve_wikilinks(wiki: DataFrame, docs: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """``wiki(bundle, from_path, wiki_id, name)`` with the path each name means, or NULL.

    A name with a slash is a path, ``.md`` optional. Else an alias wins, then the
    documents of that base name: the shallowest, of these one in the same folder,
    of these the alphabetically first.
    """
    file_name = F.when(F.col("name").endswith(".md"), F.col("name")).otherwise(F.concat("name", F.lit(".md")))
    bare = ~F.col("name").contains("/")
    # the path a name means by itself, or in the folder of its document
    full = F.when(bare, F.concat(dirname("from_path"), F.lit("/"), file_name)).otherwise(F.concat(F.lit("/"), F.regexp_replace(file_name, r"\A/+", "")))
    w = wiki.select("bundle", "from_path", "wiki_id", "name").distinct().withColumn("_full", full).withColumn("_base", F.when(bare, file_name))
    known = docs.select("bundle", F.col("path").alias("_full"), F.col("path").alias("_exact")).distinct()
    # of all documents with a base name only the best one is joined
    best = docs.groupBy("bundle", basename("path").alias("_base")).agg(F.min(F.struct(depth("path").alias("d"), F.col("path").alias("p"))).alias("_best"))
    found = w.join(known, ["bundle", "_full"], "left").join(best, ["bundle", "_base"], "left")
    if aliases is not None:
        found = found.join(aliases.select("bundle", F.col("alias").alias("name"), F.col("path").alias("_alias")), ["bundle", "name"], "left")
    else:
        found = found.withColumn("_alias", F.lit(None).cast("string"))
    by_name = F.when(F.col("_exact").isNotNull() & (depth("_exact") == F.col("_best.d")), F.col("_exact")).otherwise(F.col("_best.p"))
    return found.select("bundle", "from_path", "wiki_id", "name", F.when(F.col("name").contains("/"), F.col("_exact")).otherwise(F.coalesce("_alias", by_name)).alias("path"))


def graph_rows(docs: DataFrame, links: DataFrame, title: Column | None = None) -> DataFrame:
    """The manifest row of every document: title, bytes, digest, sorted distinct targets."""
    out = links.join(docs.select("bundle", F.col("path").alias("target")), ["bundle", "target"], "left_semi").groupBy("bundle", F.col("from_path").alias("path")).agg(F.array_sort(F.collect_set("target")).alias("links"))
    rows = docs.select("bundle", "path", (title if title is not None else F.lit(None).cast("string")).alias("title"), F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"), "entry_type")
    return rows.join(out, ["bundle", "path"], "left").withColumn("links", F.coalesce("links", F.array().cast("array<string>")))


def set_difference(left: DataFrame, right: DataFrame, *key: str) -> DataFrame:
    """``(key..., side)``: what only one of two sets of keys has; empty if they are equal."""
    a, b = left.select(*key).distinct(), right.select(*key).distinct()
    return a.join(b, list(key), "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, list(key), "left_anti").withColumn("side", F.lit("right")))


def path_labels(docs: DataFrame, rules: dict[str, Sequence[str]], *keep: str) -> DataFrame:
    """``(keep..., label)`` of the labels one of whose globs matches the path; the patterns are literals, so nothing is joined."""
    labels = [F.when(reduce(lambda a, b: a | b, [matches_glob("path", g) for g in globs]), F.lit(label)) for label, globs in rules.items()]
    return docs.select(*keep, F.explode(F.filter(F.array(*labels), lambda x: x.isNotNull())).alias("label"))
