"""Splitting oversized Markdown texts at headings, or at smaller natural breaks inside long sections.

Texts of every size are read in byte ranges. A range owns the lines that start in
it; its halo is one byte back and ``HALO`` bytes ahead, enough to tell a heading,
a fence or a rule that begins at its very end. Workers report each range's line
starts, characters, fences and headings. These boundary tables are stitched per
text: prefix sums, first within blocks of ranges and then over blocks, turn local
counts into offsets and fence parities, so that no text's table is one task.
Where blanks alone lead from a line's start into later ranges, the fence that may
follow is told by the state the earlier ranges end in. Sections, or parts of a
section longer than ``SOFT_BYTES``, are then cut out by offset, one row each, and
emitted as pieces; a whole text is never handed to Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumgrid.runtime import BROADCAST_BYTES, broadcast_if_small, materialise, measured_bytes

LIMIT = 4000
OVERLAP = 200
#: Bytes of a range, read and looked at on its own.
RANGE_BYTES = 16 << 10
#: A section without a heading for so many bytes is emitted in parts.
SOFT_BYTES = 1 << 20
#: Bytes read beyond a range: six ``#`` and a blank of up to three bytes, three marks of a fence, a rule with its line end.
HALO = 12
#: Ranges summed together before the blocks are.
BLOCK = 1024

# White space, and that beyond ASCII in UTF-8.
_WIDE = rb"\x1c|\x1d|\x1e|\x1f|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
_INDENT = rb"(?:[ \t\r\f\v]|" + _WIDE + rb")*"
_LINE = re.compile(rb"^(?:(#{1,6})(?=\s|" + _WIDE + rb")|" + _INDENT + rb"(`{3}|~{3})|(---)\r?$)", re.M)
#: The rest of a character begun before, and the blanks up to the first visible character of a line.
_HEAD = re.compile(rb"[\x80-\xbf]{0,3}" + _INDENT)
_BLANKS = re.compile(_INDENT)
_SENTENCE = re.compile(r"[.!?…][\"”’')\]*_]*\s+")
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n")
_BLANK = re.compile(r"\s+")

#: How a range ends: inside a line that shows nothing yet, or in any other way; NULL if it is blank from end to end.
PENDING, PLAIN = 1, 0
_MARK = "struct<line:long,pos:long,byte:long,level:int,fences:long>"
_RULE = "struct<line:long,fences:long>"
_MARK_FIELDS = ("line", "pos", "byte", "level", "fences")
_FOUND = (
    ("n_lines", pa.int64(), "long"),
    ("n_chars", pa.int64(), "long"),
    ("n_fences", pa.int64(), "long"),
    ("head", pa.int32(), "int"),
    ("tail", pa.int32(), "int"),
    ("opens", pa.bool_(), "boolean"),
    ("rule", pa.struct([("line", pa.int64()), ("fences", pa.int64())]), _RULE),
    ("marks", pa.list_(pa.struct([(f, pa.int32() if f == "level" else pa.int64()) for f in _MARK_FIELDS])), f"array<{_MARK}>"),
)
_FOUND_DDL = ", ".join(f"{name} {ddl}" for name, _, ddl in _FOUND)


def boundaries(data: bytes, lo: int, hi: int, base: int, soft: int | None = None) -> dict:
    """What bytes ``lo:hi`` of a text hold: ``data`` has the text's bytes from ``base`` on, halo included.

    Lines and characters belong where their first byte is. ``marks`` are headings
    as (line, character, byte, level, fences before it), counted from ``lo``;
    ``rule`` is the first ``---`` line but the text's first, which ``opens``.
    ``head`` is 1 if a line begun in an earlier range shows a fence first here.
    With ``soft``, each multiple of it adds a mark at the first line start after
    it (level -1), or the first blank (-2), or the first character (-3).
    """
    at, end = lo - base, hi - base
    own = np.frombuffer(data, np.uint8)[at:end]
    lead = (own & 0xC0) != 0x80
    chars = np.concatenate(([0], np.cumsum(lead)))
    newlines = np.flatnonzero(own == 0x0A)
    fresh = lo == 0 or data[at - 1] == 0x0A
    starts = np.concatenate(([0] if fresh else [], newlines[newlines < len(own) - 1] + 1)).astype(np.int64)

    head = 0
    first = _HEAD.match(data, at).end() if not fresh else at
    if not fresh and first < end:
        head = int(data[first : first + 3] in (b"```", b"~~~"))
    # the last line's part in this range
    if len(starts):
        last = at + int(starts[-1])
        tail = PENDING if data[end - 1] != 0x0A and _BLANKS.match(data, last).end() >= end else PLAIN
    else:
        tail = None if first >= end else PLAIN

    marks, rule, opens, fences = [], None, False, 0
    for m in _LINE.finditer(data, at):
        where = m.start() - at
        if where >= hi - lo:
            break
        line = int(np.searchsorted(starts, where))
        if line == len(starts) or starts[line] != where:
            continue
        if m.group(2):
            fences += m.start(2) < end  # else it belongs to a later range
        elif m.group(3):
            if lo + where == 0:
                opens = True
            elif rule is None:
                rule = {"line": line, "fences": fences}
        else:
            marks.append((line, int(chars[where]), lo + where, len(m.group(1)), fences))
    if soft:
        ahead = np.frombuffer(data, np.uint8)[at - 1 : end - 1] if lo else np.concatenate((np.zeros(1, np.uint8), own[:-1]))  # the byte before each
        for k in range(max(1, lo // soft), (hi - 1) // soft + 1):
            a, z = max(lo, k * soft) - lo, min(hi, (k + 1) * soft) - lo
            lines_here = starts[(starts >= a) & (starts < z)]
            blanks = np.flatnonzero((ahead[a:z] == 0x20) | (ahead[a:z] == 0x09)) + a
            any_here = np.flatnonzero(lead[a:z]) + a
            for level, found in ((-1, lines_here), (-2, blanks), (-3, any_here)):
                if len(found):
                    x = int(found[0])
                    marks.append((int(np.searchsorted(starts, x, "right")) - 1, int(chars[x]), lo + x, level, fences))
                    break
    return {
        "n_lines": len(starts), "n_chars": int(chars[-1]), "n_fences": fences, "head": head, "tail": tail, "opens": opens, "rule": rule, "marks": [dict(zip(_MARK_FIELDS, m)) for m in marks],
    }


def _report(ids: pa.Array, range_no: pa.Array, found: list[dict]) -> pa.RecordBatch:
    cols = [pa.array([f[name] for f in found], kind) for name, kind, _ in _FOUND]
    return pa.RecordBatch.from_arrays([ids, range_no, *cols], names=["id", "range_no", *(name for name, _, _ in _FOUND)])


def _detect(size: int, soft: int | None):
    """Boundaries of ranges ``(id, range_no, whole, data)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for k, whole, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                lo = k * size
                found.append(boundaries(data.as_py(), lo, min(whole, lo + size), max(0, lo - 1), soft))
            yield _report(b.column(0), b.column(1), found)

    return run


def _detect_files(size: int, soft: int | None):
    """Boundaries of ranges ``(id, range_no, whole, path)`` of files: only the range and its halo are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for k, whole, path in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                lo = k * size
                hi, base = min(whole, lo + size), max(0, lo - 1)
                found.append(boundaries(_read(path, base, hi + HALO - base), lo, hi, base, soft))
            yield _report(b.column(0), b.column(1), found)

    return run


def _read(path: str, at: int, n: int) -> bytes:
    system, inner = fs.FileSystem.from_uri(path)
    with system.open_input_file(inner) as f:
        return f.read_at(n, at)


def ranges_of(df: DataFrame, size: int) -> DataFrame:
    """``(id, range_no, whole, data)`` of texts ``(id, data)``: their byte ranges with halos, cut in the JVM."""
    whole = F.octet_length("data")

    def cut(k: Column) -> Column:
        base = F.greatest(k * size - 1, F.lit(0))
        return F.struct(k.cast("int").alias("range_no"), F.substr("data", (base + 1).cast("int"), F.least((k + 1) * size + HALO - base, whole.cast("long")).cast("int")).alias("data"))

    each = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((whole - 1) / size).cast("long")), cut)
    return df.select("id", whole.cast("long").alias("whole"), F.explode(each).alias("r")).select("id", "r.range_no", "whole", "r.data")


def stitch(ranges: DataFrame, soft: int | None = None) -> DataFrame:
    """``(id, line_no, pos, byte, level, copies)``: where sections start, from the ranges' boundary tables.

    Level 0 is the start of the text and 1 to 6 a heading; negative levels divide
    sections that run through a whole multiple of ``soft``. A range delivered twice counts once;
    ``copies`` tells how often its text was. Ranges are summed within blocks, then
    the blocks: a text of any size is spread over its blocks.
    """
    ranges = materialise(ranges, "ranges")  # the boundary tables: read more than once, the texts only once
    r = ranges.withColumn("block", F.floor(F.col("range_no") / BLOCK).cast("int")).repartition("id", "block")
    order = Window.partitionBy("id", "block").orderBy("range_no")
    before, all_of_it = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    r = r.withColumn("copies", F.sum((F.col("range_no") == 0).cast("int")).over(all_of_it)).withColumn("again", F.lag("range_no").over(order))
    r = r.where(~F.col("again").eqNullSafe(F.col("range_no")))

    r = r.withColumn("state", F.last("tail", True).over(before))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    r = r.withColumn("live", F.when((F.col("head") == 1) & (F.col("state") == PENDING), 1).otherwise(0))
    r = r.withColumn("waits", F.when((F.col("head") == 1) & F.col("state").isNull(), 1).otherwise(0))  # on the block before
    r = r.withColumns({"lines1": zero(F.sum("n_lines").over(before)), "chars1": zero(F.sum("n_chars").over(before)), "fences1": zero(F.sum(F.col("n_fences") + F.col("live")).over(before)) + F.col("live"), "waits1": zero(F.sum("waits").over(before)) + F.col("waits")})
    rule = F.when(F.col("rule").isNotNull(), F.struct((F.col("lines1") + F.col("rule.line")).alias("line"), (F.col("fences1") + F.col("rule.fences")).alias("fences"), F.col("waits1").alias("waits")))
    blocks = r.groupBy("id", "block").agg(
        F.sum("n_lines").alias("lines"), F.sum("n_chars").alias("chars"), F.sum(F.col("n_fences") + F.col("live")).alias("fences"), F.max("waits").alias("waits"),
        F.max_by("tail", F.when(F.col("tail").isNotNull(), F.col("range_no"))).alias("tail"), F.max("opens").alias("opens"), F.min(rule).alias("rule"), F.max("copies").alias("copies"),
    )
    by_block = Window.partitionBy("id").orderBy("block")
    before, whole = by_block.rowsBetween(Window.unboundedPreceding, -1), by_block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    b = blocks.withColumn("lead", F.when((F.col("waits") == 1) & (F.last("tail", True).over(before) == PENDING), 1).otherwise(0))
    b = b.withColumns({"line0": zero(F.sum("lines").over(before)), "char0": zero(F.sum("chars").over(before)), "fence0": zero(F.sum(F.col("fences") + F.col("lead")).over(before))})
    first_rule = F.when(F.col("rule").isNotNull(), F.struct((F.col("line0") + F.col("rule.line")).alias("line"), (F.col("fence0") + F.col("rule.fences") + F.col("lead") * F.col("rule.waits")).alias("fences")))
    b = b.withColumn("fm", F.when(F.max("opens").over(whole), F.min(first_rule).over(whole))).withColumn("n", F.max("copies").over(whole))
    b = b.select("id", "block", "line0", "char0", "fence0", "lead", F.coalesce("fm.line", F.lit(-1).cast("long")).alias("fm_line"), zero(F.col("fm.fences")).alias("fm_fences"), F.col("n").cast("int").alias("n"))

    r = r.select("id", "block", "range_no", "lines1", "chars1", "fences1", "waits1", "marks").join(b, ["id", "block"])
    start = r.where(F.col("range_no") == 0).select("id", *(F.lit(0).cast("long").alias(c) for c in ("line", "pos", "byte")), F.lit(0).alias("level"), "n")
    line = lambda m: m["line"] + F.col("line0") + F.col("lines1")
    parity = lambda m: (F.col("fence0") + F.col("fences1") + F.col("lead") * F.col("waits1") + m["fences"] - F.col("fm_fences")) % 2
    kept = F.filter("marks", lambda m: (m["level"] < 0) | (line(m) > F.greatest("fm_line", F.lit(0).cast("long"))) & (parity(m) == 0))
    marks = r.select("id", "n", (F.col("line0") + F.col("lines1")).alias("l0"), (F.col("char0") + F.col("chars1")).alias("c0"), F.explode(kept).alias("m"))
    marks = marks.select("id", (F.col("l0") + F.col("m.line")).alias("line"), (F.col("c0") + F.col("m.pos")).alias("pos"), F.col("m.byte").alias("byte"), F.col("m.level").alias("level"), "n")
    heads = start.unionByName(marks.where(F.col("level") > 0))
    if soft:
        segment = F.floor(F.col("byte") / soft)
        first = marks.where(F.col("level") < 0).groupBy("id", segment.alias("segment")).agg(F.min(F.struct((-F.col("level")).alias("rank"), "byte", "line", "pos", "n")).alias("s"))
        # a segment in which a heading starts is divided there
        first = first.join(heads.select("id", segment.alias("segment")).distinct(), ["id", "segment"], "left_anti")
        heads = heads.unionByName(first.select("id", "s.line", "s.pos", "s.byte", F.lit(-1).alias("level"), "s.n"))
    return heads.select("id", (F.col("line") + 1).cast("int").alias("line_no"), "pos", "byte", "level", F.col("n").alias("copies"))


def _long(df: DataFrame, id: str, text: str, limit: int) -> DataFrame:
    rows = df.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    rows = rows.where(F.col("id").isNotNull() & (F.octet_length("text") > limit)).where(F.char_length("text") > limit)
    return rows.select("id", F.encode("text", "UTF-8").alias("data"))


def section_starts(df: DataFrame, id: str, text: str, limit: int = LIMIT, range_bytes: int = RANGE_BYTES, soft_bytes: int | None = None) -> DataFrame:
    """``(id, line_no, pos, byte, level, copies)`` of the sections of every text longer than ``limit`` characters.

    NULL and shorter texts have none; rows with a NULL id are left out. Ids of any
    type must be unique among the long texts (a repeated identical row is counted
    once, ``copies`` says how often it came). The result is the same for every ``range_bytes``.
    """
    ranges = ranges_of(_long(df, id, text, limit), range_bytes).mapInArrow(_detect(range_bytes, soft_bytes), f"id {df.schema[id].dataType.simpleString()}, range_no int, {_FOUND_DDL}")
    return stitch(ranges, soft_bytes)


def cut_section(text: str, room: int, first_room: int) -> list[int]:
    """Where to cut a section so that each part has at most ``room`` characters (the first ``first_room``).

    The last paragraph break in the later three quarters of the room is taken,
    else the last line end, else the last sentence end, else the last blank
    anywhere, else the room's end.
    """
    cuts, at, most = [], 0, first_room
    while len(text) - at > most:
        lo, hi = at + most // 4, at + most
        cut = 0
        for pattern in (_PARAGRAPH, "\n", _SENTENCE):
            if pattern == "\n":
                cut = text.rfind("\n", lo, hi) + 1
            else:
                for m in pattern.finditer(text, lo, hi):
                    cut = m.end()
            if cut > lo:
                break
            cut = 0
        if not cut:
            for m in _BLANK.finditer(text, at + 1, hi):
                cut = m.end()
        cut = cut if at < cut <= hi else hi
        cuts.append(cut)
        at, most = cut, room
    return cuts


_PIECES = (("part", pa.int32()), ("start", pa.int64()), ("overlap", pa.int32()), ("line_no", pa.int32()), ("level", pa.int32()), ("piece", pa.string()))
_PIECES_DDL = "part int, start long, overlap int, line_no int, level int, piece string"


def emit(text: str, before: str, start: int, line_no: int, level: int, limit: int, overlap: int) -> Iterator[tuple]:
    """The pieces of one section; ``before``: the characters in front of it."""
    room = limit - overlap
    at = 0
    for part, end in enumerate([*cut_section(text, room, limit - min(overlap, len(before))), len(text)]):
        head = (before + text[:at])[-overlap:] if at < overlap else text[at - overlap : at]
        head = head if overlap else ""
        yield part, start + at, len(head), line_no, level, head + text[at:end]
        at = end


def _emitter(limit: int, overlap: int):
    """Pieces of sections ``(id, pos, line_no, level, back, data or path, byte, end)``; ``data`` begins ``back`` bytes before the section."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, out, held = [], [], 0
            pos, line_no, level, back = (b.column(c).to_pylist() for c in (1, 2, 3, 4))
            where = [b.column(c).to_pylist() for c in (6, 7)] if b.num_columns > 6 else None
            for i, data in enumerate(b.column(5)):
                data = data.as_py()
                if where:
                    data = _read(data, where[0][i] - back[i], where[1][i] - where[0][i] + back[i])
                head = 0
                while head < back[i] and data[head] & 0xC0 == 0x80:
                    head += 1
                before = data[head : back[i]].decode("utf-8", "replace")[-overlap:] if overlap else ""
                pieces = list(emit(data[back[i] :].decode("utf-8", "replace"), before, pos[i], line_no[i], level[i], limit, overlap))
                out += pieces
                of += [i] * len(pieces)
                held += len(data)
                if held > 4 << 20:
                    yield _pieces(b.column(0).take(pa.array(of)), out)
                    of, out, held = [], [], 0
            if out:
                yield _pieces(b.column(0).take(pa.array(of)), out)

    return run


def _pieces(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, *(pa.array(x, kind) for x, (_, kind) in zip(zip(*rows), _PIECES))], names=["id", *(name for name, _ in _PIECES)])


def split_texts(df: DataFrame, id: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = RANGE_BYTES, soft_bytes: int = SOFT_BYTES) -> DataFrame:
    """``(id, part, start, overlap, line_no, level, piece)`` for every text longer than ``limit`` characters.

    Every heading begins a piece (``part`` 0); sections beyond the limit are cut by
    :func:`cut_section`, those beyond ``soft_bytes`` first near its multiples
    (level -1). A piece begins with the last ``overlap`` characters of the text
    before it (fewer at the very start) and has at most ``limit`` in all; without
    their overlaps the pieces of a text, by ``start``, are the text.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    starts = section_starts(df, id, text, limit, range_bytes, soft_bytes)
    # as many starts as a text in a row has lines at most
    plans = starts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("byte", "pos", "line_no", "level"))).alias("sections"), F.max("copies").alias("copies"))
    plans = materialise(plans, "sections", measure=True)
    texts = _long(df, id, text, limit)
    once = plans.where(F.col("copies") == 1)
    rows = texts.join(F.broadcast(once) if measured_bytes(plans) <= BROADCAST_BYTES else once, "id")
    twice = plans.where(F.col("copies") > 1)
    if not twice.isEmpty():
        rows = rows.unionByName(texts.join(broadcast_if_small(twice), "id").dropDuplicates(["id"]))
    back = lambda s: F.least(F.lit(4 * overlap), s["byte"])
    end = lambda i: F.coalesce(F.get("sections", i + 1)["byte"], F.octet_length("data").cast("long"))
    cut = lambda s, i: F.struct(s["pos"].alias("pos"), s["line_no"].alias("line_no"), s["level"].alias("level"), back(s).cast("int").alias("back"), F.substr("data", (s["byte"] - back(s) + 1).cast("int"), (end(i) - s["byte"] + back(s)).cast("int")).alias("data"))
    parts = rows.select("id", F.explode(F.transform("sections", cut)).alias("s")).select("id", "s.pos", "s.line_no", "s.level", "s.back", "s.data")
    return parts.mapInArrow(_emitter(limit, overlap), f"id {df.schema[id].dataType.simpleString()}, {_PIECES_DDL}")


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes = []
        for path in b.column(1).to_pylist():
            system, inner = fs.FileSystem.from_uri(path)
            sizes.append(system.get_file_info(inner).size or 0)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sizes, pa.int64())], names=["id", "path", "whole"])


def split_files(spark: SparkSession, paths: DataFrame | list[str], limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = RANGE_BYTES, soft_bytes: int = SOFT_BYTES) -> DataFrame:
    """:func:`split_texts` for UTF-8 files, short ones too: ``paths(id, path)``, or a list whose positions are the ids.

    Paths are absolute ones or addresses of any file system Arrow reads. Workers
    ask the sizes, read byte ranges, then the sections or their parts, at most twice ``soft_bytes`` each.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    if not isinstance(paths, DataFrame):
        paths = spark.createDataFrame(list(enumerate(paths)), "id long, path string")
    kind = paths.schema["id"].dataType.simpleString()
    files = materialise(paths.select("id", "path").mapInArrow(_sizes, f"id {kind}, path string, whole long").where(F.col("whole") > 0), "files", measure=True)
    each = F.explode(F.sequence(F.lit(0), F.floor((F.col("whole") - 1) / range_bytes).cast("int")))
    plan = files.select("id", each.alias("range_no"), "whole", "path").repartition("id", "range_no")
    starts = stitch(plan.mapInArrow(_detect_files(range_bytes, soft_bytes), f"id {kind}, range_no int, {_FOUND_DDL}"), soft_bytes)
    # a section ends where the next one starts: in its segment, or first in the next, which always has a start
    starts = materialise(starts.withColumn("segment", F.floor(F.col("byte") / soft_bytes)), "starts")
    follows = starts.groupBy("id", (F.col("segment") - 1).alias("segment")).agg(F.min("byte").alias("follows"))
    ends = starts.withColumn("next", F.lead("byte").over(Window.partitionBy("id", "segment").orderBy("byte")))
    jobs = ends.join(follows, ["id", "segment"], "left").join(broadcast_if_small(files), "id")
    jobs = jobs.select("id", "pos", "line_no", "level", F.least(F.lit(4 * overlap), "byte").cast("int").alias("back"), "path", "byte", F.coalesce("next", "follows", "whole").alias("end"))
    return jobs.repartition("id", "byte").mapInArrow(_emitter(limit, overlap), f"id {kind}, {_PIECES_DDL}")
