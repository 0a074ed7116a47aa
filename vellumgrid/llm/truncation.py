"""Texts cut off by a field limit or a broken transfer.

Evidence is that a text's end is a strict prefix of something longer elsewhere:

* the whole value is a strict prefix of a longer value (hashes of the prefixes of
  1, 2, 4 … characters bring the two together, a hash at the exact length
  decides); it is cut if the longer one goes on inside its last token or sentence;
* its last words are a strict prefix of longer stretches: the last token begins
  longer words and is none itself, or the last two words, or the last one, stand
  inside other texts and go on there.

The form of the ending (an open code block, a row with cells missing, a sentence
without its end) only filters: a finished form is no case unless a longer value
goes on. Where the form leaves it open (a list item, a sentence before an
ellipsis), how often the same words end units, and how often they go on,
decides by naive Bayes over counts of the whole corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumgrid.llm.words import U, beginnings, chunks, mix
from vellumgrid.runtime import BROADCAST_BYTES, broadcast_if_small, materialise, measured_bytes

#: Up to three words, or an ellipsis, in brackets of their own at the very end: a mark of the sender's, or an aside.
_STANDIN = re.compile(r"[\[(<]\s*(?:\w+(?:[ \t]+\w+){0,2}|\.{3}|…)\s*[\])>]")
_CLOSERS = "\"”’')]*_`»"
_TERMINALS = ".!?。！？"
_LIST = re.compile(r"[ \t>]*(?:[-*+]|\d+[.)])[ \t]+(?:\[[ xX]\][ \t]+)?(?=\S)")
_BARE_MARKER = re.compile(r"[ \t>]*(?:[-*+]|[-*+] \[[ xX]?\]?|#{1,6}|-{2}|[`~]{1,2})[ \t]*\Z")
_BARE_NUMBER = re.compile(r"[ \t>]*\d+[.)][ \t]*\Z")
_AFTER_ITEM = re.compile(r"[ \t>]*(?:[-*+]|\d+[.)])[ \t]|[ \t]*\Z")
_WORD = re.compile(r"[^\W_]+")
_ITEMS = re.compile(r"^[ \t>]*(?:[-*+]|\d+[.)])[ \t]+(?:\[[ xX]\][ \t]+)?(\S[^\n]*)$", re.M)
_DATED = re.compile(r"[^:\n]{1,30}: *\d{4}-\d\d-\d\d\Z")
_LINK = re.compile(r"!?\[[^\]\n]*\]\([^)\n]*\)\Z")
_GAP = re.compile(r"\s*")
_WIDE = re.compile(r"[。！？][\"”’')\]*_`»]*\Z")
_MARKS = re.compile(r"[.!?…。！？\"”’')\]*_`»]")
_OPENERS = set("|([{<,;:-–—=+/\\\"'“‘«`*_#&@$%~^")

FINISHED, CUT, ASK = 0, 1, 2
ITEM, SENTENCE, SIGN = "item", "sentence", "sign-off"
#: Values of fewer characters are looked up as prefixes only on demand (``least``).
PREFIX = 64
#: Prefix lengths are powers of two; so many of them are below PREFIX.
_SHORT = PREFIX.bit_length() - 1
#: A length is a limit of its source when so many different texts of it, and such a share, have it.
LIMIT_TEXTS, LIMIT_SHARE = 5, 0.01
#: Distinct endings that are sent to the counting pass, 8 bytes each; beyond, it counts all words and the join sorts them out.
KEY_BOUND = 1 << 20


def ending(text: str) -> tuple[int, str, str, int]:
    """Verdict, kind of the ending, the last unit where it has to be asked for, and the length without stand-ins."""
    body = _without_marks(text.rstrip())
    bare = _without_dots(body)
    dots, body = len(bare) < len(body), bare
    if not body:
        return FINISHED, "blank", "", 0
    n = len(body)
    last = body[body.rfind("\n") + 1 :]
    visible = last.strip()
    if "```" in body or "~~~" in body:
        fences = sum(x.lstrip().startswith(("```", "~~~")) for x in body.split("\n"))
        if fences % 2:
            return CUT, "code", body, n
        if visible.startswith(("```", "~~~")):
            return FINISHED, "code", "", n
    if visible.startswith("|"):
        at = body.rfind("\n\n") + 2 if "\n\n" in body else 0
        head = next((x for x in body[at:].split("\n") if x.lstrip().startswith("|")), visible)
        whole = visible.endswith("|") and len(visible) > 1 and visible.count("|") >= head.count("|")
        return (FINISHED if whole else CUT), "table", body, n
    # a number alone in a line is an item's unless it wraps a sentence
    if _BARE_MARKER.match(last) or _BARE_NUMBER.match(last) and _AFTER_ITEM.match(_line_before(body)):
        return CUT, "marker", body, n
    if ends_sentence(body):
        paragraph = body[body.rfind("\n\n") + 2 :] if "\n\n" in body else body
        return (CUT if paragraph.count("`") % 2 else FINISHED), SENTENCE, body, n
    if _DATED.match(visible) or _LINK.match(visible):
        return FINISHED, "closing line", "", n
    if not body[-1].isalnum() and body[-1] not in _OPENERS and not body[-1].isspace() and body[-1] not in ")]}>":
        return FINISHED, "symbol", "", n
    if visible.startswith("-- "):
        return ASK, SIGN, visible, n
    if m := _LIST.match(last):
        return ASK, ITEM, last[m.end() :], n
    if dots:
        return ASK, SENTENCE, body, n
    return CUT, SENTENCE, body, n


def _without_marks(body: str) -> str:
    while body.endswith(("]", ")", ">")):
        at = max(map(body.rfind, "[(<"))
        if at < 0 or body[at - 1 : at] == "]" or not _STANDIN.fullmatch(body, at):
            break
        body = body[:at].rstrip()
    return body


def _without_dots(body: str) -> str:
    if body.endswith("…"):
        return body[:-1].rstrip()
    return body.rstrip(".").rstrip() if body.endswith("...") else body


def ends_sentence(body: str) -> bool:
    """Whether a mark that ends sentences comes last, closing marks aside."""
    return body.rstrip(_CLOSERS)[-1:] in tuple(_TERMINALS)


def _line_before(body: str) -> str:
    """The line before the last one, empty if there is none."""
    at = body.rfind("\n")
    return body[body.rfind("\n", 0, at) + 1 : at] if at >= 0 else ""


def tail(unit: str, least: int = 2) -> str:
    """The end of a unit from its ``least`` last words on, however long they are."""
    size = 64
    while size < len(unit):
        words = list(_WORD.finditer(unit, len(unit) - size))
        if len(words) > least:  # the first one may be cut in two
            return unit[words[-least].start() :]
        size *= 4
    return unit


_TAILS = (
    ("chars", "long"), ("bytes", "long"), ("whole", "long"), ("verdict", "int"), ("kind", "string"), ("word", "long"), ("pair", "long"), ("n_words", "int"), ("dots", "boolean"),
    ("body", "long"), ("top", "int"), ("sign", "string"), ("body_hash", "long"), ("levels", "array<long>"),
)
_TAILS_DDL = ", ".join(map(" ".join, _TAILS))
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}


def _h(data: bytes | memoryview) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(data)).astype(np.int64))


def _folded(c) -> np.ndarray:
    """Word hashes with all numbers alike."""
    first = c.points[c.start] if len(c.start) else np.zeros(0, np.uint32)
    return np.where((first >= 0x30) & (first <= 0x39), U(7), c.hashes)


def _pairs(h: np.ndarray) -> np.ndarray:
    """Each word together with the one before it."""
    return mix(np.concatenate((h[:0], np.concatenate(([U(3)], h[:-1])) if len(h) else h)) * U(0x9E3779B97F4A7C15) + h)


def _tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, units = [], []
        for text in b.column(2).to_pylist():
            verdict, kind, unit, n = ending(text)
            data = text.encode("utf-8", "replace")
            begin = (lambda k, d=memoryview(data): d[:k]) if len(data) == len(text) else (lambda k, t=text: t[:k].encode("utf-8", "replace"))
            levels, at = [], 1
            while at <= len(text):
                levels.append(_h(begin(at)))
                at *= 2
            top = n.bit_length() - 1
            sign = unit.encode("utf-8", "replace").decode() if kind == SIGN else None
            rows.append([len(text), len(data), _h(data), verdict, kind, None, None, 0, text.rstrip().endswith(("…", "...")), n, top, sign, _h(begin(n)), levels])
            units.append("" if verdict == FINISHED else unit if kind == ITEM else tail(unit))
        for c in chunks(units, keep=True):
            h = _folded(c)
            pairs = _pairs(h)
            for k in np.flatnonzero(np.diff(c.bounds)):
                end = int(c.bounds[k + 1]) - 1
                r = rows[c.lo + int(k)]
                r[5], r[6], r[7] = int(h[end].astype(np.int64)), int(pairs[end].astype(np.int64)), int(c.bounds[k + 1] - c.bounds[k])
        if rows:
            cols = [pa.array(x, _ARROW[kind]) for x, (_, kind) in zip(zip(*rows), _TAILS)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=["doc_id", "source", *(name for name, _ in _TAILS)])


_STATS = pa.schema([("what", pa.int32()), ("key", pa.int64()), ("ends", pa.int64()), ("goes_on", pa.int64())])
#: What is counted: word pairs and words in sentences, words in unpunctuated list items, words that begin longer words; lengths of
#: unpunctuated and of all items by number of words; and how many words in all end sentences or items, and go on.
PAIRS, WORDS, ITEMS, PARTS, LENGTHS, ALL_LENGTHS, ALL_WORDS, ALL_ITEMS = range(8)
_END = np.array([ord(x) for x in ".!?…。！？"], np.uint32)
_CLOSE = np.array([ord(x) for x in "\"”’')]*_`»"], np.uint32)
#: The last words of a text may themselves be cut and are not counted.
_OWN = 4


def _isin(x: np.ndarray, few: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), bool)
    for v in few:
        out |= x == v
    return out


def _counter(keys):
    """Counts of how the asked endings (or all) occur inside texts: ending a sentence or item, or going on."""

    def add(total: dict, what: int, h: np.ndarray, end: np.ndarray) -> None:
        asked = keys.value[what] if keys is not None else None
        if asked is not None:
            if not len(asked):
                return
            at = np.minimum(np.searchsorted(asked, h), len(asked) - 1)
            hit = asked[at] == h
            h, end = h[hit], end[hit]
        u, back = np.unique(h, return_inverse=True)
        n, e = np.bincount(back, minlength=len(u)), np.bincount(back, weights=end, minlength=len(u)).astype(np.int64)
        for k, x, y in zip(u.tolist(), e.tolist(), (n - e).tolist()):
            plus(total, what, k, x, y)

    def plus(total: dict, what: int, k: int, ends: int, goes_on: int) -> None:
        was = total.get((what, k), (0, 0))
        total[(what, k)] = (was[0] + ends, was[1] + goes_on)

    def rows(total: dict) -> pa.RecordBatch:
        key = np.array([k for _, k in total], U).astype(np.int64)
        cols = [[w for w, _ in total], key, [v[0] for v in total.values()], [v[1] for v in total.values()]]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, _STATS)], schema=_STATS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], tuple[int, int]] = {}
        for b in batches:
            texts = b.column(0).to_pylist()
            for c in chunks(texts, keep=True):
                h = _folded(c)
                if not len(h):
                    continue
                cps = np.append(c.points, np.uint32(10))
                t0, t1 = cps[c.stop], cps[np.minimum(c.stop + 1, len(cps) - 1)]
                starts = np.zeros(len(cps) + 1, bool)
                starts[c.start] = True
                end = (_isin(t0, _END) & ~starts[np.minimum(c.stop + 1, len(cps))]) | (_isin(t0, _CLOSE) & _isin(t1, _END)) | ((t0 == 10) & (t1 == 10))
                room = np.repeat(c.bounds[1:], np.diff(c.bounds)) - np.arange(len(h))
                inside = room > _OWN
                add(total, PAIRS, _pairs(h)[inside], end[inside])
                add(total, WORDS, h[inside], end[inside])
                plus(total, ALL_WORDS, 0, int(end[inside].sum()), int((~end[inside]).sum()))
                spelled, at = np.unique(c.hashes[inside], return_index=True)
                at = np.flatnonzero(inside)[at]
                at = at[h[at] == c.hashes[at]]  # no numbers
                part = beginnings(c.points, c.start[at], c.stop[at])
                add(total, PARTS, part, np.ones(len(part), bool))
            items, closed = [], []
            for t in texts:
                stop = t.rstrip().rfind("\n")
                if stop > 0:
                    for x in _ITEMS.findall(t, 0, stop):
                        (closed if ends_sentence(x.rstrip()) else items).append(x)
            for c in chunks(closed):
                lengths = np.bincount(np.diff(c.bounds))
                for k in np.flatnonzero(lengths).tolist():
                    plus(total, ALL_LENGTHS, k, int(lengths[k]), 0)
            for c in chunks(items, keep=True):
                h, size = _folded(c), np.diff(c.bounds)
                if not len(h):
                    continue
                last = np.zeros(len(h), bool)
                last[c.bounds[1:][size > 0] - 1] = True
                add(total, ITEMS, h, last)
                plus(total, ALL_ITEMS, 0, int(last.sum()), int((~last).sum()))
                lengths = np.bincount(size)
                for k in np.flatnonzero(lengths).tolist():
                    plus(total, LENGTHS, k, int(lengths[k]), 0)
                    plus(total, ALL_LENGTHS, k, int(lengths[k]), 0)
            if len(total) > 500_000:
                yield rows(total)
                total.clear()
        if total:
            yield rows(total)

    return run


def longer_copies(tails: DataFrame, texts: DataFrame, least: int = PREFIX) -> DataFrame:
    """``(body, body_hash, inside, line)`` of the values that are a strict prefix of a longer value (stand-ins and ellipses aside).

    ``inside``: some longer value goes on inside the last token or sentence;
    ``line``: in the same line. Values under ``least`` characters don't ask. A value
    asks at its greatest level only, so values that merely begin alike don't meet;
    several values with the same text ask once.
    """
    asks = tails.where((F.col("body") >= max(least, 1)) & (F.col("top") >= 0)).select("top", F.element_at("levels", F.col("top") + 1).alias("h"), "body", "body_hash")
    # the lengths asked for under a prefix: at most as many as its level has, however many values ask
    lengths = asks.groupBy("top", "h").agg(F.collect_set("body").alias("asked"))
    offers = tails.select(F.col("doc_id").alias("other"), F.col("body").alias("longer"), "whole", F.posexplode("levels").alias("top", "h"))
    wanted = lambda rows, by: rows.join(by, ["top", "h"]).select("other", F.filter("asked", lambda n: n < F.col("longer")).alias("asked")).where(F.size("asked") > 0)
    copies = offers.where(F.col("top") >= _SHORT).groupBy("top", "h", "longer", "whole").agg(F.min("other").alias("other"))  # copies offer once
    met = wanted(copies, lengths.where(F.col("top") >= _SHORT))
    if least < PREFIX:  # few prefixes are asked for, but many texts may begin with one: the texts' side stays where it is
        short = materialise(lengths.where(F.col("top") < _SHORT), "short", measure=True)
        met = met.unionByName(wanted(offers.where(F.col("top") < _SHORT), broadcast_if_small(short)))
    met = met.select("other", F.explode("asked").alias("n")).groupBy("other").agg(F.collect_set("n").alias("asked"))
    met = materialise(met, "met", measure=True)
    long = texts.join(broadcast_if_small(met), F.col("doc_id") == F.col("other")).select("text", "asked")
    starts = long.mapInArrow(_starts, "body long, body_hash long, inside boolean, line boolean").groupBy("body", "body_hash").agg(F.max("inside").alias("inside"), F.max("line").alias("line"))
    return starts.join(asks.select("body", "body_hash").distinct(), ["body", "body_hash"], "left_semi")


def goes_on(text: str, n: int) -> tuple[bool, bool]:
    """Whether ``text`` goes on after ``n`` characters inside the token or sentence that ends there, and in the same line."""
    after = _GAP.match(text, n)
    gap, c = after[0], text[after.end() : after.end() + 1]
    line = bool(c) and "\n" not in gap
    if gap:
        return c.islower() and gap.count("\n") < 2, line
    # scripts without blanks: a full stop of theirs ends the sentence unless more marks follow
    return bool(c) and (not _WIDE.search(text, max(0, n - 20), n) or bool(_MARKS.match(c))), line


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of each text's beginnings of the asked lengths, and how it goes on there."""
    for b in batches:
        n, h, inside, line = [], [], [], []
        for text, asked in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            at, state = 0, xxhash.xxh3_64()
            for k in sorted(asked):  # each character is hashed once
                state.update(text[at:k].encode("utf-8", "replace"))
                on = goes_on(text, k)
                at = k
                n.append(k)
                h.append(int(np.uint64(state.intdigest()).astype(np.int64)))
                inside.append(on[0])
                line.append(on[1])
        yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(h, pa.int64()), pa.array(inside, pa.bool_()), pa.array(line, pa.bool_())], names=["body", "body_hash", "inside", "line"])


def truncated(df: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", least: int = PREFIX, key_bound: int = KEY_BOUND) -> DataFrame:
    """``(doc_id, source, kind, cut, evidence, at_limit, longer_copy)``: one row per text, ``cut`` if it stops before its end.

    ``kind`` names the last element. ``evidence`` tells what goes on elsewhere:
    ``value`` (the whole text), ``part of a word``, ``words`` (the last two),
    ``word``, ``sign-off``; or ``length`` where only the limit of its source speaks.
    ``at_limit``: an unusual number of the source's texts have just this length;
    ``longer_copy``: another text begins with this one and goes on, looked up for
    values of ``least`` characters or more (1: all). A finished-looking ending is
    cut if the longer text goes on inside its last token or sentence. NULL and
    blank texts are not cut and have no row; rows with a NULL id are left out; a
    NULL source is a source; of a row delivered twice the least verdict counts.
    Ids may have any type. Other columns are ignored.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\S"))
    tails = materialise(rows.mapInArrow(_tails, f"doc_id {df.schema[id].dataType.simpleString()}, source string, {_TAILS_DDL}"), "tails")

    asked = tails.where((F.col("verdict") != FINISHED) & F.col("word").isNotNull())
    questions = F.array(*(F.struct(F.lit(w).alias("what"), F.col(c).alias("key")) for w, c in ((PAIRS, "pair"), (WORDS, "word"), (ITEMS, "word"), (PARTS, "word"))))
    keys = asked.select(F.explode(questions).alias("q")).select("q.*").distinct()
    got = keys.limit(key_bound + 1).toPandas()
    shared = None
    if len(got) <= key_bound:
        shared = spark.sparkContext.broadcast({w: np.sort(got["key"][got["what"] == w].to_numpy(np.int64).astype(U)) for w in (PAIRS, WORDS, ITEMS, PARTS)})
    counted = rows.select("text").mapInArrow(_counter(shared), "what int, key long, ends long, goes_on long").groupBy("what", "key").agg(F.sum("ends").alias("ends"), F.sum("goes_on").alias("goes_on"))
    if shared is None:
        counted = counted.join(keys.unionByName(counted.where(F.col("what") > PARTS).select("what", "key")), ["what", "key"], "left_semi")
    stats = materialise(counted, "stats", measure=True)
    few = F.broadcast if measured_bytes(stats) <= BROADCAST_BYTES else lambda df: df
    # a row per kind of count; an item of n words could have been cut behind n - 1 of them
    base = {r["what"]: r for r in stats.where(F.col("what") >= LENGTHS).groupBy("what").agg(F.sum("ends").alias("ends"), F.sum("goes_on").alias("goes_on"), F.sum(F.col("ends") * (F.col("key") - 1)).alias("inner")).collect()}

    # how many items have just so many words, and how many of all have more
    lengths = stats.where(F.col("what").isin(LENGTHS, ALL_LENGTHS)).groupBy(F.col("key").alias("n_words")).agg(F.sum(F.when(F.col("what") == LENGTHS, F.col("ends"))).alias("_just"), F.sum(F.when(F.col("what") == ALL_LENGTHS, F.col("ends"))).alias("_all"))
    more_words = Window.orderBy(F.col("n_words").desc()).rowsBetween(Window.unboundedPreceding, -1)  # a row per distinct length
    lengths = lengths.select("n_words", F.coalesce("_just", F.lit(0)).alias("_just"), F.coalesce(F.sum("_all").over(more_words), F.lit(0)).alias("_more"))

    sizes = tails.select("source", "whole", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("size")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("size")))).alias("s")).distinct()
    sizes = sizes.groupBy("source", "s.unit", "s.size").agg(F.count(F.lit(1)).alias("n"))
    spikes = sizes.withColumn("all", F.sum("n").over(Window.partitionBy("source", "unit"))).where((F.col("n") >= LIMIT_TEXTS) & (F.col("n") >= LIMIT_SHARE * F.col("all")))
    # at most one spike per hundredth of a source's texts and unit
    limits = spikes.groupBy(F.col("source").alias("_s")).agg(F.collect_set(F.when(F.col("unit") == "chars", F.col("size"))).alias("_chars"), F.collect_set(F.when(F.col("unit") == "bytes", F.col("size"))).alias("_bytes"))
    t = tails.join(broadcast_if_small(materialise(limits, "limits", measure=True)), F.col("source").eqNullSafe(F.col("_s")), "left")
    t = t.withColumn("at_limit", F.coalesce(F.array_contains("_chars", F.col("chars")) | F.array_contains("_bytes", F.col("bytes")), F.lit(False)))

    copies = broadcast_if_small(materialise(longer_copies(tails, rows, least).withColumn("longer_copy", F.lit(True)), "copies", measure=True))
    t = t.join(copies, ["body", "body_hash"], "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("longer_copy", "inside", "line")})
    # an ellipsis hides that the sentence has no end; what is a line of its own goes on in that line only
    more = (
        F.when((F.col("verdict") == ASK) & (F.col("kind") == SENTENCE), F.col("longer_copy"))
        .when(F.col("verdict") == ASK, F.col("inside") | F.col("line"))
        .when(F.col("kind").isin(SENTENCE, "symbol"), F.col("inside"))
        .otherwise(F.col("line"))
    )
    t = t.withColumn("more", more).drop("levels", "_s", "_chars", "_bytes")

    # by binary order, a sign-off that others go on from is followed by one of them
    signs = t.where(F.col("kind") == SIGN).groupBy("sign").agg(F.count_distinct("whole").alias("_same"), F.first("word").alias("_word"), F.count_if(~F.col("at_limit")).alias("_off"))
    follower = F.lead("sign").over(Window.partitionBy(F.substring("sign", 1, 4)).orderBy("sign"))
    ends = signs.groupBy("_word").agg(F.sum("_same").alias("_ends"), F.sum("_off").alias("_free"))
    signs = signs.withColumn("_goes_on", F.coalesce(follower.startswith(F.col("sign")), F.lit(False))).join(ends, "_word", "left").select("sign", "_goes_on", "_ends", "_free")

    open_ = t.where(F.col("verdict") != FINISHED)
    for what, key in ((PAIRS, "pair"), (WORDS, "word"), (ITEMS, "word"), (PARTS, "word")):
        part = stats.where(F.col("what") == what).select(F.col("key").alias(key), F.col("ends").alias(f"e{what}"), F.col("goes_on").alias(f"g{what}"))
        open_ = open_.join(few(part), key, "left")
    open_ = open_.join(few(lengths), "n_words", "left").join(signs, "sign", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    seen = lambda w: zero(f"e{w}") + zero(f"g{w}") > 0
    tail_evidence = F.when(~seen(WORDS) & seen(PARTS), "part of a word").when(seen(PAIRS), "words").when(seen(WORDS), "word")

    def total(what: int, column: str) -> int:
        return int(base[what][column] or 0) if what in base else 0

    def rather_cut(what: int, all_: int) -> Column:
        """Whether words that are so often followed, and so often the end, are likelier where a text is cut than where a unit ends."""
        end, on = total(all_, "ends"), total(all_, "goes_on")
        return (zero(f"g{what}") + 1) * (end + 1) > (zero(f"e{what}") + 1) * (on + 1)

    in_part = ~seen(WORDS) & seen(PARTS)
    sentence = F.when(F.col("at_limit"), True).when(seen(PAIRS), rather_cut(PAIRS, ALL_WORDS)).when(seen(WORDS), rather_cut(WORDS, ALL_WORDS)).otherwise(in_part)
    end, on = total(ALL_ITEMS, "ends"), total(ALL_ITEMS, "goes_on")
    just, longer = total(LENGTHS, "ends") + 1, total(ALL_LENGTHS, "inner") + 1
    likelier = (zero(f"g{ITEMS}") + 1.0) * (end + 1) * (zero("_more") + 1) * just > (zero(f"e{ITEMS}") + 1.0) * (on + 1) * (zero("_just") + 1) * longer
    item = F.when(F.col("dots") & F.col("at_limit"), True).when(seen(WORDS) | seen(ITEMS), likelier).otherwise(in_part)
    # a limit counts where no text off the limit ends so; else the last word is in doubt unless another sign-off ends so
    sign = (F.col("at_limit") & (zero("_free") == 0)) | F.coalesce("_goes_on", F.lit(False)) | ((zero("_ends") < 2) & in_part)
    by_form = F.when(F.col("verdict") == CUT, tail_evidence.isNotNull()).when(F.col("kind") == ITEM, item).when(F.col("kind") == SIGN, sign).otherwise(sentence)
    evidence = F.when(F.col("more"), "value").when(F.col("kind") == SIGN, F.when(F.coalesce("_goes_on", F.lit(False)), "sign-off").when(in_part, "part of a word")).otherwise(tail_evidence)
    open_ = open_.withColumn("cut", by_form | F.col("more")).withColumn("evidence", F.when(F.col("cut"), F.coalesce(evidence, F.lit("length"))))
    told = t.where(F.col("verdict") == FINISHED).withColumn("cut", F.col("more")).withColumn("evidence", F.when(F.col("more"), "value"))
    keep = ["doc_id", "source", "kind", "cut", "evidence", "at_limit", "longer_copy"]
    both = open_.select(*keep).unionByName(told.select(*keep)).groupBy("doc_id")
    return both.agg(F.min(F.struct("cut", "kind", "source", "evidence", "at_limit")).alias("v"), F.max("longer_copy").alias("longer_copy")).select("doc_id", "v.source", "v.kind", "v.cut", "v.evidence", "v.at_limit", "longer_copy")


def truncation_report(found: DataFrame) -> DataFrame:
    """Texts, cut texts and their share per source."""
    return found.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_texts"), F.sum(F.col("cut").cast("long")).alias("n_cut"), F.avg(F.col("cut").cast("double")).alias("cut_share"), F.sum(F.col("longer_copy").cast("long")).alias("n_longer_copy")
    )
