"""Validation: every rule is a projection of the documents, the report their union."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumgrid.functions.markdown import prose_lines
from vellumgrid.functions.paths import basename, depth, normalise_link
from vellumgrid.functions.text import heading_slug
from vellumgrid.functions.urls import link_class
from vellumgrid.operators.parse import inline_links

# The states a document may declare.
STATES = ("draft", "stable", "deprecated")
_RFC3339 = r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})\z"
_DATE = r"\A\d{4}-\d{2}-\d{2}\z"
# Layouts of dates that are no ISO dates.
DATE_LAYOUTS = ("yyyy/MM/dd", "MM/dd/yyyy", "yyyy-M-d", "MMMM d, yyyy", "MMM d, yyyy", "d MMM yyyy")


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def valid_timestamp(value: Column | str) -> Column:
    """RFC 3339, or a date alone."""
    v = _c(value)
    return F.coalesce((v.rlike(_RFC3339) | v.rlike(_DATE)) & F.try_to_timestamp(v).isNotNull(), F.lit(False))


def offset_timestamp(value: Column | str) -> Column:
    """RFC 3339 with its offset."""
    v = _c(value)
    return F.coalesce(v.rlike(_RFC3339) & F.try_to_timestamp(v).isNotNull(), F.lit(False))


def odd_date(heading: Column | str) -> Column:
    """A heading that is a date in another layout than ISO's."""
    h = _c(heading)
    hits = [F.try_to_timestamp(h, F.lit(f)) for f in DATE_LAYOUTS]
    return F.coalesce(*hits).isNotNull() & ~h.rlike(_DATE)


def property(name: str) -> Column:  # noqa: A001
    """The values of a property, NULL if the key is missing."""
    return F.get(F.transform(F.filter("properties", lambda p: p["key"] == name), lambda p: p["values"]), 0)


def document_issues(parsed: DataFrame, *keep: str, types: Sequence[str] | None = None, max_depth: int = 3) -> DataFrame:
    """``(keep..., level, rule)`` of parsed documents ``(keep..., path, fm, fm_error, properties)``.

    Reserved names: ``index.md`` may declare only ``okf_version``, ``log.md`` nothing.
    """
    base = basename("path")
    reserved = base.isin("index.md", "log.md")
    has = lambda name: F.exists("properties", lambda p: p["key"] == name)
    first = lambda name: F.get(property(name), 0)
    issue = lambda cond, level, rule: F.when(cond, F.struct(F.lit(level).alias("level"), F.lit(rule).alias("rule")))
    kind = first("type")
    rules = [
        issue(F.col("fm_error").isNotNull(), "error", "frontmatter cannot be read"),
        issue(~reserved & F.col("fm_error").isNull() & (kind.isNull() | (F.trim(kind) == "")), "error", "type is missing"),
        issue(~reserved & has("status") & ~F.coalesce(first("status").isin(*STATES), F.lit(False)), "error", "status is not in the vocabulary"),
        issue(~reserved & has("sources") & ~F.coalesce("sources_ok", F.lit(False)), "error", "sources is no list of mappings with a resource"),
        issue(~reserved & has("generated") & ~F.coalesce("generated_ok", F.lit(False)), "error", "generated is no event"),
        issue(~reserved & has("verified") & ~F.coalesce("verified_ok", F.lit(False)), "error", "verified is no event"),
        issue(~reserved & has("timestamp") & ~F.coalesce(valid_timestamp(first("timestamp")), F.lit(False)), "error", "timestamp is not valid"),
        issue((base == "index.md") & F.exists("properties", lambda p: p["key"] != "okf_version"), "error", "index.md declares properties"),
        issue((base == "index.md") & has("okf_version") & (F.trim(F.coalesce(first("okf_version"), F.lit(""))) == ""), "error", "okf_version is empty"),
        issue((base == "log.md") & (F.size("properties") > 0), "error", "log.md has frontmatter"),
        issue(depth("path") > max_depth, "warning", "path is too deep"),
        issue(F.col("path").contains(" "), "warning", "path holds a space"),
    ]
    if types is not None:
        rules.append(issue(~reserved & kind.isNotNull() & ~kind.isin(*types), "error", "type is not in the vocabulary"))
    return parsed.select(*keep, F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("i")).select(*keep, "i.level", "i.rule")


def link_gate(content: Column | str) -> Column:
    """The first construct a publication refuses in code-free text, or NULL: reference links, HTML links, wikilinks."""
    c = _c(content)
    return (
        F.when(c.rlike(r"(?md)^[\t ]{0,3}\[[^\]\n]+\]:[\t ]*\S") | c.rlike(r"\[[^\]\n]+\]\[[^\]\n]*\](?!\()"), "reference link")
        .when(c.rlike(r"(?i)<a\s[^>]*href"), "HTML link")
        .when(c.contains("[[") | c.contains("]]"), "wikilink")
    )


#: Schemes no published link may have.
FORBIDDEN_SCHEMES = ("javascript", "data", "file", "vbscript", "about", "blob")


def target_gate(source: Column | str, raw: Column | str) -> Column:
    """Why a publication refuses a link's raw destination, or NULL."""
    r = _c(raw)
    kind = link_class(r)
    scheme = F.lower(F.regexp_extract(r, r"\A([^:]*):", 1))
    path = F.regexp_replace(r, r"#[\s\S]*\z", "")
    plain = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    inner = kind.isin("relative", "absolute")
    return (
        F.when((kind == "external") & scheme.isin(*FORBIDDEN_SCHEMES), "forbidden scheme")
        .when(inner & (path.contains("\\") | path.contains("\x00")), "unsafe target")
        .when(inner & plain.isNull(), "invalid escape")
        .when((kind == "absolute") | inner & plain.startswith("/"), "root-absolute link")
        .when(inner & normalise_link(source, plain)["escapes"], "link leaves the corpus")
        .when(F.regexp_extract(r, r"#([\s\S]*)\z", 1).rlike(r"[\r\n]"), "invalid fragment")
    )


def gate_issues(docs: DataFrame, content: str, *keep: str) -> DataFrame:
    """``(keep..., line_no, rule, detail)``: what a publication refuses in documents ``(keep..., path, content)``, code aside."""
    cols = list(dict.fromkeys([*keep, "path"]))
    lines = prose_lines(docs, content, *cols, code_free=True)
    forms = lines.select(*keep, "line_no", link_gate("line").alias("rule"), F.lit("").alias("detail"))
    targets = inline_links(docs, content, *cols).select(*keep, "line_no", target_gate("path", "raw").alias("rule"), F.col("raw").alias("detail"))
    return forms.unionByName(targets).where(F.col("rule").isNotNull())


def graph_issues(links: DataFrame, docs: DataFrame, anchors: DataFrame) -> DataFrame:
    """``(bundle, path, level, rule, detail)`` of edges: targets that are missing, anchors that are no heading.

    ``anchors(bundle, path, slug)``. Block references (``^``) are no headings; an
    anchor is looked up only where its document is there.
    """
    known = docs.select("bundle", F.col("path").alias("target")).distinct()
    lost = links.join(known, ["bundle", "target"], "left_anti").select("bundle", F.col("from_path").alias("path"), F.lit("warning").alias("level"), F.lit("broken link").alias("rule"), F.col("target").alias("detail"))
    asked = links.where(F.col("anchor").isNotNull() & (F.col("anchor") != "") & ~F.col("anchor").startswith("^")).join(known, ["bundle", "target"], "left_semi")
    there = anchors.select("bundle", F.col("path").alias("target"), F.col("slug").alias("_slug")).distinct()
    bad = asked.withColumn("_slug", heading_slug("anchor")).join(there, ["bundle", "target", "_slug"], "left_anti")
    return lost.unionByName(bad.select("bundle", F.col("from_path").alias("path"), F.lit("warning").alias("level"), F.lit("anchor not found").alias("rule"), F.concat("target", F.lit("#"), F.col("anchor")).alias("detail")))


def version_issues(roots: DataFrame, want: str) -> DataFrame:
    """``(keep..., rule)`` for root documents whose declared ``okf_version`` is absent or another than ``want``."""
    got = F.get(property("okf_version"), 0)
    rule = F.when(~F.exists("properties", lambda p: p["key"] == "okf_version"), "okf_version is missing").when(got.isNotNull() & (got != want), "okf_version is out of sync")
    return roots.withColumn("rule", rule).where(F.col("rule").isNotNull())
