"""Table-valued parsers: one document becomes rows of headings, checkboxes, links, tables, properties."""

from __future__ import annotations

import json
import re
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumgrid.functions import markdown as md
from vellumgrid.functions.text import heading_slug, strip
from vellumgrid.functions.urls import link_class


def headings(df: DataFrame, content: str, *keep: str) -> DataFrame:
    """``(keep..., ord, level, text, line_no, slug, final_slug)``; repeated slugs get ``-1``, ``-2`` …

    ``keep`` must identify the document.
    """
    found = md.prose_lines(df, content, *keep).select(*keep, "line_no", F.regexp_extract("line", r"\A(#{1,6})[\t\n\f\r ]+([^\n]*)", 1).alias("marks"), F.regexp_extract("line", r"\A#{1,6}[\t\n\f\r ]+([^\n]*)", 1).alias("text"))
    found = found.where(F.col("marks") != "").select(*keep, "line_no", F.length("marks").alias("level"), strip("text").alias("text"))
    found = found.withColumn("slug", heading_slug("text"))
    order = Window.partitionBy(*keep).orderBy("line_no")
    turn = F.row_number().over(Window.partitionBy(*keep, "slug").orderBy("line_no")) - 1
    final = F.when(turn == 0, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), turn.cast("string")))
    return found.withColumn("ord", F.row_number().over(order)).withColumn("final_slug", final).select(*keep, "ord", "level", "text", "line_no", "slug", "final_slug")


def checkboxes(df: DataFrame, content: str, *keep: str) -> DataFrame:
    """``(keep..., line_no, done, text)``."""
    pattern = r"\A[\t\n\f\r ]*[-*+] \[([ xX])\][\t\n\f\r ]+([^\n]*)"
    rows = md.prose_lines(df, content, *keep).where(F.col("line").rlike(pattern))
    return rows.select(*keep, "line_no", (F.regexp_extract("line", pattern, 1) != " ").alias("done"), strip(F.regexp_extract("line", pattern, 2)).alias("text"))


LINK = r"\[([^\]]*)\]\(([^)]+)\)"


def inline_links(df: DataFrame, content: str, *keep: str) -> DataFrame:
    """``(keep..., line_no, pos, text, raw, kind)``: Markdown links outside code, images too.

    ``raw`` is the destination without angle brackets and title.
    """
    rows = md.prose_lines(df, content, *keep, code_free=True).where(F.col("line").contains("]("))
    both = F.arrays_zip(F.regexp_extract_all("line", F.lit(LINK), F.lit(1)).alias("text"), F.regexp_extract_all("line", F.lit(LINK), F.lit(2)).alias("dest"))
    rows = rows.select(*keep, "line_no", F.posexplode(both).alias("pos", "l"))
    dest = strip("l.dest")
    raw = F.when(dest.startswith("<"), F.regexp_extract(dest, r"\A<([^>]*)", 1)).otherwise(F.regexp_extract(dest, r"\A([^ \t]*)", 1))
    return rows.select(*keep, "line_no", (F.col("pos") + 1).alias("pos"), F.col("l.text").alias("text"), raw.alias("raw")).withColumn("kind", link_class("raw"))


WIKILINK = r"`[^`]*`|(!?)\[\[(.*?)\]\]"


def wikilinks(df: DataFrame, content: str, *keep: str) -> DataFrame:
    """``(keep..., line_no, pos, embed, raw, target, anchor, display)`` outside backtick fences and code spans."""
    base = df.select(*keep, md.frontmatter(content).alias("_f"))
    # only backtick fences hide wikilinks
    parts = F.split(F.col("_f.body"), r"(?md)^[^\S\n]*```[^\n]*$", -1)
    numbered = F.transform(parts, lambda p, i: F.struct((F.aggregate(F.slice(F.transform(parts, md.newlines), 1, i), F.lit(0), lambda a, x: a + x) + 1).alias("first"), p.alias("text"), (i % 2).alias("odd")))
    rows = base.select(*keep, "_f.lines", F.explode(F.filter(numbered, lambda s: s["odd"] == 0)).alias("s")).select(*keep, "lines", "s.first", F.posexplode(F.split(F.col("s.text"), "\n", -1)).alias("_p", "line"))
    rows = rows.where(F.col("line").contains("[["))
    both = F.arrays_zip(F.regexp_extract_all("line", F.lit(WIKILINK), F.lit(1)).alias("bang"), F.regexp_extract_all("line", F.lit(WIKILINK), F.lit(2)).alias("raw"))
    rows = rows.select(*keep, (F.col("lines") + F.col("first") + F.col("_p")).cast("int").alias("line_no"), F.posexplode(F.filter(both, lambda x: strip(x["raw"]) != "")).alias("pos", "w"))
    rows = rows.select(*keep, "line_no", (F.col("pos") + 1).alias("pos"), (F.col("w.bang") == "!").alias("embed"), F.col("w.raw").alias("raw"))
    return rows.select("*", *split_wikilink("raw"))


def split_wikilink(raw: Column | str) -> list[Column]:
    """``target``, ``anchor`` and ``display`` of the text between the brackets; ``\\|`` counts as ``|``."""
    r = F.col(raw) if isinstance(raw, str) else raw
    at = F.instr(r, "|")
    head = F.when(at > 0, F.regexp_replace(F.substr(r, F.lit(1), at - 1), r"\\\z", "")).otherwise(r)
    display = F.when(at > 0, strip(F.substr(r, at + 1))).otherwise(F.lit(""))
    hash_at = F.instr(head, "#")
    target = F.when(hash_at > 0, F.substr(head, F.lit(1), hash_at - 1)).otherwise(head)
    anchor = F.when(hash_at > 0, F.substr(head, hash_at + 1)).otherwise(F.lit(""))
    return [strip(target).alias("target"), strip(anchor).alias("anchor"), display.alias("display")]


TABLE = r"(?md)^([^\n]*\|[^\n]*)\n[\t ]*\|?[\t ]*:?-+:?[\t ]*(?:\|[\t ]*:?-+:?[\t ]*)*\|?[\t\r ]*(?=\n|\z)((?:\n[^\n]*\|[^\n]*)*)"


def _cells(line: Column) -> Column:
    """The cells of a table line: outer bars dropped, ``\\|`` a literal bar."""
    inner = F.regexp_replace(strip(line), r"\A\||(?<!\\)\|\z", "")
    return F.transform(F.split(inner, r"(?<!\\)\|", -1), lambda c: F.replace(strip(c), F.lit("\\|"), F.lit("|")))


def table_cells(df: DataFrame, content: str, *keep: str) -> DataFrame:
    """``(keep..., table_n, row_n, col_n, header, cell)`` of GFM tables outside code; rows are padded or cut to the header."""
    segs = df.select(*keep, md.frontmatter(content).alias("_f")).select(*keep, F.explode(md.outside_segments(F.col("_f.body"))).alias("s"))
    heads, bodies = (F.regexp_extract_all(F.col("s.text"), F.lit(TABLE), F.lit(g)) for g in (1, 2))
    found = segs.where(F.col("s.text").contains("|")).select(*keep, F.col("s.first_line").alias("first_line"), F.posexplode(F.arrays_zip(heads.alias("head"), bodies.alias("body"))).alias("_p", "t"))
    found = found.withColumn("table_n", F.row_number().over(Window.partitionBy(*keep).orderBy("first_line", "_p")))
    header = _cells(F.col("t.head"))
    rows = F.filter(F.split(F.col("t.body"), "\n", -1), lambda x: x != "")
    found = found.select(*keep, "table_n", header.alias("names"), F.posexplode(rows).alias("_r", "line")).withColumn("cells", _cells(F.col("line")))
    grid = F.transform("names", lambda h, i: F.struct(h.alias("header"), F.coalesce(F.get("cells", i), F.lit("")).alias("cell")))
    return found.select(*keep, "table_n", (F.col("_r") + 1).alias("row_n"), F.posexplode(grid).alias("_c", "g")).select(*keep, "table_n", "row_n", (F.col("_c") + 1).alias("col_n"), F.col("g.header").alias("header"), F.col("g.cell").alias("cell"))


# --- frontmatter -----------------------------------------------------------------------------------------------

NODES, ALIASES, DEPTH = 16_384, 1_024, 128


class _Budget(Exception):
    pass


def decode_yaml(block: str | None) -> tuple[str | None, str | None]:
    """``(json, error)``: the block as a JSON object in which every scalar is a string; duplicates keep the last."""
    import yaml

    if block is None:
        return None, None
    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
    try:
        root = yaml.compose(block, Loader=loader)
        if root is None:
            return "{}", None
        if not isinstance(root, yaml.MappingNode):
            return None, "frontmatter is not a mapping"
        left, again, met = [NODES], [ALIASES], set()

        def value(node, depth: int, above: frozenset):
            left[0] -= 1
            again[0] -= id(node) in met  # an anchored node is met again by its alias
            met.add(id(node))
            if again[0] < 0:
                raise _Budget("too many aliases")
            if left[0] < 0 or depth > DEPTH:
                raise _Budget("frontmatter is too large")
            if id(node) in above:
                raise _Budget("alias cycle")
            inner = above | {id(node)}
            if isinstance(node, yaml.ScalarNode):
                return node.value.removesuffix("\n") if node.style in ("|", ">") else node.value.strip() if node.style is None else node.value
            if isinstance(node, yaml.SequenceNode):
                return [value(x, depth + 1, inner) for x in node.value]
            return {k.value: value(v, depth + 1, inner) for k, v in node.value if isinstance(k, yaml.ScalarNode)}

        return json.dumps(value(root, 0, frozenset()), ensure_ascii=False), None
    except _Budget as e:
        return None, str(e)
    except (yaml.YAMLError, ValueError, RecursionError) as e:
        return None, f"invalid frontmatter: {type(e).__name__}"


def _strings(v) -> list[str]:
    if isinstance(v, str):
        return [v] if v else []
    return [x for x in v if isinstance(x, str)] if isinstance(v, list) else []


def _resources(v) -> list[str]:
    if isinstance(v, dict):
        v = [v]
    if not isinstance(v, list):
        return []
    return [x if isinstance(x, str) else x["resource"] for x in v if isinstance(x, str) and x or isinstance(x, dict) and isinstance(x.get("resource"), str) and x["resource"]]


_OFFSET_TIME = re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:\d\d)\Z")


def _text(v) -> str:
    return v.strip() if isinstance(v, str) else ""


def _event(v) -> bool:
    """Who and when: ``by`` is not empty, ``at`` a timestamp with an offset."""
    if not isinstance(v, dict) or not _text(v.get("by")) or not _OFFSET_TIME.match(_text(v.get("at"))):
        return False
    try:
        datetime.fromisoformat(_text(v["at"]))
        return True
    except ValueError:
        return False


_S = T.StringType()
_DECODED = T.StructType(
    [
        T.StructField("json", _S),
        T.StructField("error", _S),
        T.StructField("properties", T.ArrayType(T.StructType([T.StructField("key", _S), T.StructField("values", T.ArrayType(_S))]))),
        T.StructField("resources", T.ArrayType(_S)),
        T.StructField("sources_ok", T.BooleanType()),
        T.StructField("generated_ok", T.BooleanType()),
        T.StructField("verified_ok", T.BooleanType()),
    ]
)


@F.pandas_udf(_DECODED)
def _decoded(blocks: pd.Series) -> pd.DataFrame:
    out = []
    for b in blocks:
        text, error = decode_yaml(b)
        data = json.loads(text) if text else {}
        properties = [{"key": k, "values": _strings(v)} for k, v in data.items()]
        sources, verified = data.get("sources"), data.get("verified")
        # a list without mappings, the empty one too, is a list of strings
        sources_ok = isinstance(sources, list) and bool(sources) and all(isinstance(x, dict) and _text(x.get("resource")) for x in sources)
        verified_ok = all(map(_event, verified)) if isinstance(verified, list) and verified else _event(verified)
        out.append((text, error, properties, _resources(sources), sources_ok, _event(data.get("generated")), verified_ok))
    return pd.DataFrame(out, columns=[f.name for f in _DECODED])


def entries(df: DataFrame, content: str, *keep: str) -> DataFrame:
    """``(keep..., fm, fm_error, properties, resources, …_ok, body, fm_lines)``: the parsed documents.

    Only documents with a frontmatter block go through Python.
    """
    base = df.select(*keep, md.frontmatter(content).alias("_f"))
    none = F.lit(None)
    empty = F.struct(none.cast("string"), none.cast("string"), F.array(), F.array(), *[none.cast("boolean")] * 3).cast(_DECODED)
    plain = base.where(F.col("_f.block").isNull()).select("*", empty.alias("d"))
    rich = base.where(F.col("_f.block").isNotNull()).select("*", _decoded(F.col("_f.block")).alias("d"))
    both = plain.unionByName(rich.withColumn("d", F.col("d").cast(_DECODED)))
    return both.select(*keep, F.col("d.json").alias("fm"), F.col("d.error").alias("fm_error"), F.coalesce("d.properties", F.array().cast("array<struct<key:string,values:array<string>>>")).alias("properties"), F.coalesce("d.resources", F.array().cast("array<string>")).alias("resources"), "d.sources_ok", "d.generated_ok", "d.verified_ok", F.col("_f.body").alias("body"), F.col("_f.lines").alias("fm_lines"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _typed_sources(blocks: pd.Series) -> pd.Series:
    import yaml

    def read(block: str | None) -> list[str]:
        try:
            data = yaml.safe_load(block) if block else None
        except (yaml.YAMLError, ValueError, RecursionError):
            return []
        items = data.get("sources") if isinstance(data, dict) else None
        items = [items] if isinstance(items, dict) else items if isinstance(items, list) else []
        return [json.dumps(x, ensure_ascii=False, sort_keys=True, default=str) for x in items if isinstance(x, dict)]

    return blocks.map(read)


def typed_sources(df: DataFrame, content: str, *keep: str) -> DataFrame:
    """``(keep..., pos, source)``: the declared sources as JSON objects with YAML's types (numbers, booleans, NULL, dates as text).

    A byte order mark before the frontmatter is passed over; blocks that cannot be read give nothing.
    """
    block = md.frontmatter(F.regexp_replace(content, r"\A\ufeff", ""))["block"]
    rows = df.select(*keep, block.alias("_b")).where(F.col("_b").contains("sources"))
    return rows.select(*keep, F.posexplode(_typed_sources("_b")).alias("_p", "source")).select(*keep, (F.col("_p") + 1).alias("pos"), "source")


def fm_values(parsed: DataFrame, *keep: str) -> DataFrame:
    """``(keep..., key, pos, value)``; keys without string values have no rows."""
    p = parsed.select(*keep, F.explode("properties").alias("p"))
    return p.select(*keep, F.col("p.key").alias("key"), F.posexplode("p.values").alias("_i", "value")).select(*keep, "key", (F.col("_i") + 1).alias("pos"), "value")


def fm_keys(parsed: DataFrame, *keep: str) -> DataFrame:
    """``(keep..., key)``: every property key, even if its value is empty."""
    return parsed.select(*keep, F.explode("properties").alias("p")).select(*keep, F.col("p.key").alias("key"))
