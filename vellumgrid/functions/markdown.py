"""Markdown as column expressions: frontmatter, fences, lines. One text is one row, so nothing here shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A line that opens or closes code: its trimmed text starts with three backticks or tildes (kinds are not paired).
FENCE_LINE = r"(?md)^[^\S\n]*(?:```|~~~)[^\n]*$"
#: Blanks as regular expressions of the RE2 family know them.
BLANK = r"[\t\n\f\r ]"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def frontmatter(content: Column | str) -> Column:
    """Struct ``(block, body, lines)``: the block between the fences or NULL, what follows, and the lines it took.

    The block opens with ``---`` in the first line and closes at the first line
    that begins with ``---``; if that line goes on, there is no frontmatter. An
    empty block is none either.
    """
    c = _c(content)
    skip = F.when(c.startswith("---\n"), 4).when(c.startswith("---\r\n"), 5)
    rest = F.substr(c, skip + 1)
    at = F.instr(rest, "\n---")
    after = F.substr(rest, at + F.lit(4))
    eol = F.when(after == "", 0).when(after.startswith("\n"), 1).when(after.startswith("\r\n"), 2)
    ok = skip.isNotNull() & (at > 0) & eol.isNotNull()
    body = F.when(ok, F.substr(after, eol + 1)).otherwise(c)
    block = F.when(ok, F.regexp_replace(F.substr(rest, F.lit(1), at - 1), r"\r\z", ""))
    lines = F.when(ok, newlines(F.substr(rest, F.lit(1), at + 3)) + 1 + F.when(eol > 0, 1).otherwise(0)).otherwise(0)
    return F.struct(block.alias("block"), body.alias("body"), lines.cast("int").alias("lines"))


def outside_segments(body: Column | str) -> Column:
    """The stretches outside fenced code: array of ``(first_line, text)``, lines counted from 1.

    The body is split at its fence lines; every second part is code. A part after
    a fence begins with the (blanked) fence line itself.
    """
    parts = F.split(_c(body), FENCE_LINE, -1)
    counts = F.transform(parts, newlines)
    numbered = F.transform(parts, lambda p, i: F.struct((F.aggregate(F.slice(counts, 1, i), F.lit(0), lambda a, x: a + x) + 1).alias("first_line"), p.alias("text"), (i % 2).alias("_odd")))
    return F.transform(F.filter(numbered, lambda s: s["_odd"] == 0), lambda s: F.struct(s["first_line"].cast("int").alias("first_line"), s["text"].alias("text")))


def lines(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """``(keep..., line_no, line)``: every line of the raw text."""
    return df.select(*keep, F.posexplode(F.split(F.col(text), "\n", -1)).alias("_p", "line")).select(*keep, (F.col("_p") + 1).alias("line_no"), "line")


def prose_lines(df: DataFrame, content: str, *keep: str, code_free: bool = False) -> DataFrame:
    """``(keep..., line_no, line)`` of the body outside fences; ``line_no`` counts in the file.

    ``code_free`` also removes inline code spans.
    """
    base = df.select(*keep, frontmatter(content).alias("_f"))
    segs = base.select(*keep, "_f.lines", F.explode(outside_segments(F.col("_f.body"))).alias("_s"))
    rows = segs.select(*keep, "lines", "_s.first_line", F.posexplode(F.split(F.col("_s.text"), "\n", -1)).alias("_p", "line"))
    line = F.regexp_replace("line", "`[^`]*`", "") if code_free else F.col("line")
    return rows.select(*keep, (F.col("lines") + F.col("first_line") + F.col("_p")).cast("int").alias("line_no"), line.alias("line"))
