"""Search, property filters and vocabulary counts."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumgrid.functions import markdown as md
from vellumgrid.functions.paths import has_prefix


def _matches(line: Column, query: str, mode: str) -> Column:
    low = F.lower(line)
    if mode == "exact":
        return low.contains(query.lower())
    words = [low.contains(w) for w in query.lower().split()]
    if not words:
        return F.lit(mode == "all")
    return reduce(lambda a, b: a & b if mode == "all" else a | b, words)


def search_lines(df: DataFrame, text: str, query: str, *keep: str, mode: str = "all") -> DataFrame:
    """``(keep..., line_no, line)`` of the raw text's lines that hold all words, any word, or the exact query."""
    if mode not in ("all", "any", "exact"):
        raise ValueError(f"unknown search mode: {mode}")
    if not query.strip():
        raise ValueError("the query is blank")
    whole = _matches(F.col(text), query, mode)  # a cheap necessary condition before lines are made
    return md.lines(df.where(whole), text, *keep).where(_matches(F.col("line"), query, mode))


def search(df: DataFrame, text: str, query: str, *keep: str, mode: str = "all") -> DataFrame:
    """``(keep..., matches)``: matching lines per document, counted without exploding or shuffling."""
    if mode not in ("all", "any", "exact"):
        raise ValueError(f"unknown search mode: {mode}")
    if not query.strip():
        raise ValueError("the query is blank")
    hits = df.where(_matches(F.col(text), query, mode)).select(*keep, F.size(F.filter(F.split(F.lower(text), "\n", -1), lambda x: _matches(x, query, mode))).cast("long").alias("matches"))
    return hits.where(F.col("matches") > 0)


@dataclass(frozen=True)
class Where:
    key: str
    value: str
    negate: bool = False

    @classmethod
    def parse(cls, text: str) -> Where:
        """``key=value`` or ``key!=value``; a quoted value is unquoted."""
        negate = "!=" in text and text.index("!=") < (text.index("=") if "=" in text else len(text))
        key, sep, value = text.partition("!=" if negate else "=")
        if not sep or not key.strip():
            raise ValueError(f"not a filter: {text}")
        value = value.strip()
        if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        return cls(key.strip(), value, negate)

    def column(self, properties: Column) -> Column:
        """A list contains the value, a scalar equals it; an empty value asks for emptiness; a missing key is empty."""
        values = F.flatten(F.transform(F.filter(properties, lambda p: p["key"] == self.key), lambda p: p["values"]))
        hit = F.coalesce(F.size(values) == 0 if self.value == "" else F.array_contains(values, self.value), F.lit(False))
        return ~hit if self.negate else hit


def list_entries(parsed: DataFrame, path: str = "path", prefix: str | None = None, where: list[str] | None = None) -> DataFrame:
    """The entries below a prefix that pass all filters."""
    conditions = [has_prefix(path, prefix)] if prefix else []
    conditions += [Where.parse(w).column(F.col("properties")) for w in where or []]
    return parsed.where(reduce(lambda a, b: a & b, conditions)) if conditions else parsed


def value_counts(values: DataFrame, key: str | None, *doc: str, column: str = "value") -> DataFrame:
    """``(name, count)``: documents per distinct value, each counted once per document."""
    rows = values.where(F.col("key") == key) if key is not None else values
    return rows.select(*doc, F.col(column).alias("name")).distinct().groupBy("name").agg(F.count(F.lit(1)).alias("count"))


def ordered_counts(counts: DataFrame, by: str = "name") -> DataFrame:
    return counts.orderBy("name") if by == "name" else counts.orderBy(F.desc("count"), "name")


def resolve(df: DataFrame, name: str, path: str = "path") -> DataFrame:
    """The document a name means: an exact path, else a unique base name; the count tells missing (0) and ambiguous (2+)."""
    exact = "/" + name.lstrip("/")
    base = F.element_at(F.split(F.col(path), "/"), -1)
    rank = F.when(F.col(path) == exact, 0).otherwise(1)
    hits = df.where((F.col(path) == exact) | base.isin(name, name + ".md")).withColumn("_rank", rank)
    best = hits.agg(F.min("_rank").alias("_best"))
    return hits.join(F.broadcast(best), F.col("_rank") == F.col("_best")).drop("_rank", "_best")  # one row
