"""Rewrites as plans: tables of (path, line, old, new) that can be read before they are applied."""

from __future__ import annotations

import json
import os
import re
import tempfile
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumgrid.functions.paths import normalise_link, relative_link, slug_name
from vellumgrid.functions.urls import link_class


def tidy_links_plan(links: DataFrame, *keep: str) -> DataFrame:
    """Absolute links as relative ones: ``(keep..., from_path, old, new)`` of ``(keep..., from_path, raw)``."""
    n = normalise_link("from_path", "raw")
    rows = links.where((link_class("raw") == "absolute") & ~F.col("raw").contains(" ")).select(*keep, "from_path", F.col("raw").alias("old"), n.alias("n")).where(~F.col("n.escapes"))
    new = F.concat(relative_link("from_path", "n.path"), F.coalesce(F.concat(F.lit("#"), F.col("n.anchor")), F.lit("")))
    return rows.select(*keep, "from_path", "old", new.alias("new")).where(F.col("old") != F.col("new"))


def slug_plan(docs: DataFrame, *group: str) -> DataFrame:
    """Paths with blanks and the names they would get: ``(group..., path, new_path, collides)``."""
    rows = docs.where(F.col("path").rlike(r"\s")).select(*group, "path", F.array_join(F.transform(F.split("path", "/"), lambda s: slug_name(s)), "/").alias("new_path"))
    taken = docs.select(*group, F.col("path").alias("new_path")).distinct().withColumn("_t", F.lit(True))
    same = rows.groupBy(*group, "new_path").agg(F.count(F.lit(1)).alias("_n"))
    return rows.join(taken, [*group, "new_path"], "left").join(same, [*group, "new_path"]).select(*group, "path", "new_path", (F.col("_t").isNotNull() | (F.col("_n") > 1)).alias("collides"))


def move_plan(links: DataFrame, moves: DataFrame, *group: str) -> DataFrame:
    """What changes when documents move: ``(group..., from_path, old_target, new_from, new_target)`` per link.

    ``moves(group..., old, new)``; both the links to a moved document and the
    links of one are respelled, seen from where it then stands.
    """
    g = list(group)
    here = moves.select(*g, F.col("old").alias("from_path"), F.col("new").alias("_nf"))
    there = moves.select(*g, F.col("old").alias("target"), F.col("new").alias("_nt"))
    rows = links.select(*g, "from_path", "target").distinct().join(here, g + ["from_path"], "left").join(there, g + ["target"], "left").where(F.col("_nf").isNotNull() | F.col("_nt").isNotNull())
    rows = rows.withColumn("new_from", F.coalesce("_nf", "from_path")).withColumn("_to", F.coalesce("_nt", "target"))
    return rows.select(*g, "from_path", F.col("target").alias("old_target"), "new_from", relative_link("new_from", "_to").alias("new_target"))


def wikilink_plan(resolved: DataFrame) -> DataFrame:
    """``(bundle, from_path, old, new, skip)``: Markdown for wikilinks ``(bundle, from_path, raw, anchor, display, embed, path)``.

    An unresolved one has no ``new`` and the reason in ``skip``. What is embedded becomes an image link.
    """
    text = F.when(F.col("display") != "", F.col("display")).otherwise(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md\z", ""))
    anchor = F.when(F.col("anchor") != "", F.concat(F.lit("#"), F.col("anchor"))).otherwise("")
    bang = F.when(F.col("embed"), "!").otherwise("") if "embed" in resolved.columns else F.lit("")
    new = F.concat(bang, F.lit("["), text, F.lit("]("), relative_link("from_path", "path"), anchor, F.lit(")"))
    return resolved.select("bundle", "from_path", F.concat(bang, F.lit("[["), F.col("raw"), F.lit("]]")).alias("old"), new.alias("new"), F.when(F.col("path").isNull(), "no such document").alias("skip"))


# --- one document at a time: pure functions, usable in a pandas UDF ---------------------------------------------

# Words and characters that YAML reads as something else.
_WORDS = {"true", "false", "null", "yes", "no", "on", "off", "~"}
_RISKY = set(":#[]{},&*!|>'\"%@`\n\r\t")


def needs_quotes(value: str) -> bool:
    """Whether the bare value might be read as anything but this string."""
    if not value or value != value.strip() or value[0] in "-?" or value.lower() in _WORDS or not _RISKY.isdisjoint(value):
        return True
    try:
        float(value)
    except ValueError:
        return False
    return True


def _spell(value: str, like: str = "") -> str:
    if needs_quotes(value):
        return json.dumps(value, ensure_ascii=False)
    quoted = re.fullmatch(r"\s*(['\"]).*\1\s*", like)
    return f"{quoted[1]}{value}{quoted[1]}" if quoted else value


def _block(lines: list[str]) -> int | None:
    """The line that closes the frontmatter, or NULL if there is none."""
    if lines[0].rstrip("\r") != "---":
        return None
    return next((i for i in range(1, len(lines)) if lines[i].rstrip("\r") == "---"), None)


def _check_key(key: str) -> None:
    if not key.strip() or key.startswith("_") or any(c in key for c in ":\r\n"):
        raise ValueError(f"not a property name: {key!r}")


def set_field(content: str, key: str, value: str | list[str] | None) -> str:
    """``content`` with the frontmatter key set (NULL: removed), all other lines as they are.

    A value keeps the quotes its line had; a list stays in lines of its own if it
    had them and is written in brackets otherwise. Keys that are empty, begin with
    an underscore or hold a colon or line end are refused.
    """
    _check_key(key)
    cr = "\r" if content.startswith("---\r\n") else ""
    lines = content.split("\n")
    close = _block(lines)
    if close is None and value is None:
        return content
    block, rest = (lines[1:close], lines[close:]) if close is not None else ([], ["---" + cr, *lines])
    at = next((i for i, x in enumerate(block) if re.match(rf"{re.escape(key)}\s*:", x)), len(block))
    stop = at + 1
    while stop < len(block) and (block[stop][:1] in (" ", "\t") or block[stop].startswith("- ") or not block[stop].strip()):
        stop += 1
    old = block[at].partition(":")[2] if at < len(block) else ""
    if value is None:
        new = []
    elif isinstance(value, str):
        new = [f"{key}: {_spell(value, old)}"]
    elif value and stop > at + 1:
        new = [f"{key}:", *(f"  - {_spell(v)}" for v in value)]
    else:
        new = [f"{key}: [{', '.join(map(_spell, value))}]"]
    block[at:stop] = [x + cr for x in new]
    return "\n".join(["---" + cr, *block, *rest])


def set_fields(content: str, fields: dict[str, str | list[str] | None], reserved: bool = False) -> str:
    """Several keys in one pass, in sorted order: all are checked before any is set.

    A reserved document (an index or a log) without frontmatter gets none.
    """
    if not fields:
        raise ValueError("no fields to set")
    for key, value in fields.items():
        _check_key(key)
        if not (value is None or isinstance(value, str) or isinstance(value, list) and all(isinstance(x, str) for x in value)):
            raise ValueError(f"{key}: the value must be a string or a list of strings")
    if reserved and _block(content.split("\n")) is None:
        raise ValueError("a reserved document has no frontmatter")
    for key in sorted(fields):
        content = set_field(content, key, fields[key])
    return content


def respell_values(content: str, steps: dict[str, dict[str, str]]) -> str:
    """``content`` with whole frontmatter values replaced: ``steps`` maps keys to ``{old: new}``; lines of a list or mapping belong to their key."""
    lines = content.split("\n")
    close, owner = _block(lines), ""
    for i in range(1, close or 0):
        if lines[i][:1] not in (" ", "\t", "-", "#", "\r", "") and ":" in lines[i]:
            owner = lines[i].partition(":")[0].strip()
        if table := steps.get(owner):
            values = "|".join(re.escape(v) for v in sorted(table, key=len, reverse=True))
            lines[i] = re.sub(rf"(?<=[:\[,\s\"'])(?:{values})(?=[\]}},\s\"']|\Z)", lambda m, t=table: t[m[0]], lines[i])
    return "\n".join(lines)


def set_checkbox(content: str, line_no: int, done: bool) -> str:
    """``content`` with the checkbox in a line (from 1) ticked or cleared."""
    lines = content.split("\n")
    if not 1 <= line_no <= len(lines) or not (m := re.match(r"(\s*[-*+] \[)([ xX])(\]\s+.*)", lines[line_no - 1], re.S)):
        raise ValueError(f"no checkbox in line {line_no}")
    lines[line_no - 1] = m[1] + ("x" if done else " ") + m[3]
    return "\n".join(lines)


_DESTINATION = re.compile(r"(\]\(\s*)(?:<([^>\n]*)>|([^\s<>)]+))")
_WIKILINK = re.compile(r"!?\[\[[^\]\n]*\]\]")


def outside_code(content: str, change: Callable[[str], str]) -> str:
    """``content`` with ``change`` applied to every stretch of its body outside fences and code spans."""
    lines = content.split("\n")
    fenced = False
    for i in range((_block(lines) or -1) + 1, len(lines)):
        if lines[i].lstrip().startswith(("```", "~~~")):
            fenced = not fenced
        elif not fenced:
            lines[i] = "".join(part if k % 2 else change(part) for k, part in enumerate(re.split(r"(`[^`]*`)", lines[i])))
    return "\n".join(lines)


def apply_plan(content: str, steps: Iterable[tuple[str, str]]) -> str:
    """``content`` with link destinations and wikilinks replaced as the steps ``(old, new)`` say; code stays as it is."""
    table = dict(steps)

    def destination(m: re.Match) -> str:
        if m[2] is not None:
            return f"{m[1]}<{table.get(m[2], m[2])}>"
        return m[1] + table.get(m[3], m[3])

    return outside_code(content, lambda part: _WIKILINK.sub(lambda m: table.get(m[0], m[0]), _DESTINATION.sub(destination, part)))


def write_file(path: str, content: str) -> None:
    """Replace a file in one step; a link is followed and the mode kept."""
    path = os.path.realpath(path)
    mode = os.stat(path).st_mode if os.path.exists(path) else None
    fd, temp = tempfile.mkstemp(dir=os.path.dirname(path))
    with os.fdopen(fd, "w", encoding="utf-8", newline="") as f:
        f.write(content)
    if mode is not None:
        os.chmod(temp, mode)
    os.replace(temp, path)
