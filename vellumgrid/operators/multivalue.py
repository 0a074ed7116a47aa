"""Several values packed in one field: split them into rows, positions kept.

A field's *skeleton* is what remains when every run of ordinary characters is
masked: ``a b, "c, d"`` and ``x y, "p, q"`` share ``w w,_"w,_w"``. How a field
splits depends on its skeleton alone, so the rule is resolved once per distinct
skeleton (in Python) and applied to all fields by position (in the JVM).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumgrid.runtime import broadcast_if_small, materialise

# Characters with a meaning for splitting.
SEPARATORS = ",;|·\t\n\r，；、"
BLANKS = "  　  "
QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’"}

_SPECIAL = SEPARATORS + BLANKS + "\"'“”‘’\\[]"
_CLASS = _SPECIAL.replace("\\", "\\\\").replace("[", "\\[").replace("]", "\\]")
#: One token: a run of ordinary characters, a run of blanks, or one special character. An apostrophe inside a
#: word and a hyphen that no blank follows are ordinary.
TOKEN = rf"(?:[^{_CLASS}-]|-(?![{BLANKS}])|(?<=[\p{{L}}\p{{N}}])['’](?=[\p{{L}}\p{{N}}]))+|[{BLANKS}]+|[\s\S]"
#: What an ordinary run and a run of blanks look like in a skeleton.
WORD, GAP = "w", "_"

RULE_TYPE = "array<array<int>>"


def tokens(field: Column | str) -> Column:
    """The field as an array of tokens whose concatenation is the field."""
    return F.regexp_extract_all(F.col(field) if isinstance(field, str) else field, F.lit(f"({TOKEN})"), F.lit(1))


def skeleton(toks: Column) -> Column:
    """One character per token: ``w`` ordinary, ``_`` blanks, else the special character itself."""
    return F.array_join(
        F.transform(
            toks,
            lambda t: F.when(F.length(t) > 1, F.when(t.rlike(rf"\A[{BLANKS}]"), F.lit(GAP)).otherwise(F.lit(WORD)))
            .when(t.rlike(rf"\A[{BLANKS}]\z"), F.lit(GAP))
            .when(t.rlike(rf"\A[{_CLASS}-]\z"), t)
            .otherwise(F.lit(WORD)),
        ),
        "",
    )


def _closing(s: str, i: int, ends: str) -> int:
    """Index of the quote that closes the one at ``i``, or -1. ``ends``: what may follow besides blanks and the end."""
    close, j = QUOTES[s[i]], i + 1
    while j < len(s):
        if s[j] == "\\" and j + 1 < len(s) and s[j + 1] == close:
            j += 2
        elif s[j] == close and close == s[i] and j + 1 < len(s) and s[j + 1] == close:
            j += 2
        elif s[j] == close:
            k = j + 1
            if k < len(s) and s[k] == GAP:
                return j if GAP in ends or k + 1 == len(s) or s[k + 1] in ends else -1
            return j if k == len(s) or s[k] in ends else -1
        else:
            j += 1
    return -1


def _quoted(s: str, i: int, j: int) -> list[int]:
    """Token positions of the value between the quotes at ``i`` and ``j``, escapes resolved."""
    out, k, close = [], i + 1, s[j]
    while k < j:
        if k + 1 < j and s[k + 1] == close and (s[k] == "\\" or (s[k] == close and close == s[i])):
            k += 1
        out.append(k)
        k += 1
    while out and s[out[0]] == GAP:
        out.pop(0)
    while out and s[out[-1]] == GAP:
        out.pop()
    return out


def _scan(s: str, lo: int, hi: int, seps: str) -> tuple[list[list[int]], bool]:
    """Values between ``lo`` and ``hi`` when ``seps`` separate; and whether a separator other than a blank stood outside quotes."""
    part, strong = s[:hi], False
    items, cur, i, fresh = [], [], lo, True
    while i < hi:
        c = part[i]
        if fresh and c in QUOTES and (j := _closing(part, i, seps)) >= 0:
            items.append(_quoted(part, i, j))
            i, cur, fresh = j + 1, [], False
            while i < hi and part[i] not in seps:  # blanks up to the separator
                i += 1
            continue
        if c in seps:
            strong |= c != GAP
            if cur:
                items.append(cur)
            cur, fresh = [], True
        elif c == GAP and not cur:
            pass
        else:
            cur.append(i)
            fresh = False
        i += 1
    if cur:
        items.append(cur)
    for x in items:
        while x and s[x[-1]] == GAP:
            x.pop()
    return [x for x in items if x], strong


def resolve(s: str) -> list[list[int]]:
    """The splitting rule of a skeleton: per value the positions of its tokens, in order."""
    lo, hi = 0, len(s)
    blank = GAP + "\t\n\r"
    while lo < hi and s[lo] in blank:
        lo += 1
    while lo < hi and s[hi - 1] in blank:
        hi -= 1
    if hi - lo >= 2 and s[lo] == "[" and s[hi - 1] == "]":
        lo, hi = lo + 1, hi - 1
    if lo < hi and s[lo] == "-" and lo + 1 < hi and s[lo + 1] == GAP:  # a list with a dash per line
        items = []
        for a, b in _lines(s, lo, hi):
            while a < b and s[a] in blank:
                a += 1
            if a < b and s[a] == "-" and (a + 1 == b or s[a + 1] == GAP):
                a += 1
                while a < b and s[a] in blank:
                    a += 1
            while a < b and s[b - 1] in blank:
                b -= 1
            if a < b and s[a] in QUOTES and _closing(s[:b], a, "") == b - 1:
                items.append(_quoted(s, a, b - 1))
            elif a < b:
                items.append(list(range(a, b)))
        return [x for x in items if x]
    # A blank separates only if nothing else does outside quotes; quotes may then open after a blank.
    values, strong = _scan(s, lo, hi, SEPARATORS + GAP)
    return _scan(s, lo, hi, SEPARATORS)[0] if strong else values


def _lines(s: str, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    a = lo
    for i in range(lo, hi):
        if s[i] == "\n":
            yield a, i
            a = i + 1
    yield a, hi


def _rules(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"_skeleton": b["_skeleton"], "_rule": [resolve(s) for s in b["_skeleton"]]})


def split_values(df: DataFrame, field: str, none: str | None = None) -> DataFrame:
    """One row per value: all columns of ``df`` plus ``item_pos`` (from 1, in order) and ``item``.

    Values keep their case and repeats; they are trimmed and stand without list
    brackets, list dashes and enclosing quotes. NULL, empty and blank fields, and
    fields equal to ``none``, give no rows; empty values are passed over. A quote
    without a partner is an ordinary character. Columns of ``df`` named
    ``item_pos`` or ``item`` are replaced.
    """
    df = df.drop("item_pos", "item")
    rows = df.where(F.col(field).isNotNull() & (F.length(field) > 0))
    if none is not None:
        rows = rows.where(F.trim(F.col(field)) != none)
    rows = rows.withColumn("_tokens", tokens(field)).withColumn("_skeleton", skeleton(F.col("_tokens")))
    rules = materialise(rows.select("_skeleton").distinct().mapInPandas(_rules, f"_skeleton string, _rule {RULE_TYPE}"), "rules", measure=True)
    ruled = rows.join(broadcast_if_small(rules), "_skeleton")
    # element_at counts from 1
    items = F.transform("_rule", lambda v: F.array_join(F.transform(v, lambda p: F.element_at("_tokens", p + 1)), ""))
    return ruled.select(*[F.col(c) for c in df.columns], F.posexplode(items).alias("_p", "item")).select(
        *df.columns, (F.col("_p") + 1).cast("int").alias("item_pos"), "item"
    )
