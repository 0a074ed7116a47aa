"""Splitting against a line-by-line reading, with ranges down to a few bytes."""

import random
import re

import pytest

from vellumgrid.llm import splitting as S


def brute(text):
    lines = text.split("\n")
    first, out, fence = 0, [1], False
    if lines[0].removesuffix("\r") == "---":
        first = next((j + 1 for j in range(1, len(lines)) if lines[j].removesuffix("\r") == "---"), 0)
    for j in range(first, len(lines)):
        x = lines[j] + ("\n" if j < len(lines) - 1 else "")
        if x.strip().startswith(("```", "~~~")):
            fence = not fence
        elif not fence and j and re.match(r"#{1,6}\s", x):
            out.append(j + 1)
    return out


def document(rnd):
    parts = ["# A\n", "## Bé b\n", "####### no\n", "#no\n", "```sh\n", "  ~~~\n", "text é. More text! And more\n", "\n", "---\n", "--- \n", "---x\n", "line\r\n", "# C\r\n", "\t```\n", "中文。" * 5 + "\n", "word " * 30, "  \n", "#", "# ", "`" * 2, "#\u00a0wide\n", "\u3000\u00a0\u2003```\n", "\u2028", " " * 40 + "\u3000" * 9 + "```x\n", "\t" * 90 + "~~\n", "---\r\n"]
    head = rnd.choice(["", "---\n", "---\r\n", "# T\n", "---\na: 1\n# c\n---\n"])
    return head + "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40)))


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_random_documents(spark, size):
    rnd = random.Random(size)
    texts = {i: document(rnd) for i in range(120)}
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    got = {}
    for r in S.section_starts(df, "id", "text", limit=20, range_bytes=size).collect():
        if r.level >= 0:
            got.setdefault(r.id, []).append(r.line_no)
        assert texts[r.id].encode()[: r.byte].decode() == texts[r.id][: r.pos]
        assert r.line_no == texts[r.id].count("\n", 0, r.pos) + 1
    assert {k: sorted(v) for k, v in got.items()} == {k: brute(t) for k, t in texts.items() if len(t) > 20}


def rebuilt(rows):
    by = {}
    for r in rows:
        by.setdefault(r.id, []).append(r)
    return {k: sorted(v, key=lambda r: r.start) for k, v in by.items()}


@pytest.mark.parametrize("limit,overlap", [(60, 20), (40, 0)])
def test_pieces(spark, limit, overlap):
    rnd = random.Random(5)
    texts = {i: document(rnd) for i in range(60)} | {100: "x" * 500, 101: "y" * limit, 102: None, 103: ""}
    df = spark.createDataFrame(list(texts.items()), "id long, text string").selectExpr("*", "1 AS section", "'c' AS piece")
    by = rebuilt(S.split_texts(df, "id", "text", limit, overlap).collect())
    assert set(by) == {k for k, t in texts.items() if t and len(t) > limit}
    for k, pieces in by.items():
        assert "".join(p.piece[p.overlap :] for p in pieces) == texts[k]
        for p in pieces:
            assert len(p.piece) <= limit and p.overlap == min(overlap, p.start)
            assert p.piece == texts[k][p.start - p.overlap : p.start - p.overlap + len(p.piece)]
        assert {p.line_no for p in pieces if p.part == 0} == set(brute(texts[k]))


def test_natural_cuts():
    text = "One two. Three four.\n\nFive six seven. " + "eight " * 10
    first = S.cut_section(text, 40, 40)[0]
    assert text[:first].endswith("\n\n")
    assert S.cut_section("a" * 100, 40, 30) == [30, 70]
    assert text[: S.cut_section(text[22:], 30, 30)[0] + 22].endswith(". ")


def test_files(spark, tmp_path):
    rnd = random.Random(9)
    texts = [document(rnd) * 3 for _ in range(6)] + ["", "no heading at all " * 60 + "\n" + "é" * 300]
    paths = []
    for i, t in enumerate(texts):
        p = tmp_path / f"{i}.md"
        p.write_bytes(t.encode())
        paths.append(str(p))
    by = rebuilt(S.split_files(spark, paths, 80, 10, range_bytes=100, soft_bytes=250).collect())
    for i, t in enumerate(texts):
        pieces = by.get(i, [])
        assert "".join(p.piece[p.overlap :] for p in pieces) == t
        assert all(len(p.piece) <= 80 for p in pieces)
        if t:
            assert {p.line_no for p in pieces if p.part == 0 and p.level >= 0} == set(brute(t))
    assert S.split_files(spark, []).count() == 0


def test_giant_sections(spark):
    """Parts of a section beyond ``soft_bytes`` are emitted on their own, whatever the ranges."""
    texts = {"é": "# A\n" + "word " * 400 + "\n# B\n" + "x" * 900 + "中" * 300, "b": "line\n" * 500, "twice": "z" * 700}
    df = spark.createDataFrame([*texts.items(), ("twice", texts["twice"])], "id string, text string")
    seen = []
    for size in (37, 5000):
        got = S.split_texts(df, "id", "text", 90, 20, range_bytes=size, soft_bytes=256).collect()
        seen.append(sorted(map(tuple, got)))
        for k, pieces in rebuilt(got).items():
            assert "".join(p.piece[p.overlap :] for p in pieces) == texts[k]
            assert all(len(p.piece) <= 90 for p in pieces) and any(p.level == -1 for p in pieces)
    assert seen[0] == seen[1]


def test_blocks(spark):
    """More ranges than one block sums, fences behind blanks that cross blocks included."""
    text = "---\na\n```\n---\n# one\n" + " " * 1100 + "```\n# no\n" + "x" * 300 + "\n" + " " * 900 + "```\n# two\n"
    df = spark.createDataFrame([(1, text)], "id int, text string")
    got = sorted(r.line_no for r in S.section_starts(df, "id", "text", 20, range_bytes=1).collect())
    assert got == brute(text) == [1, 5, 10]


def test_repeated_rows_and_bad_arguments(spark):
    df = spark.createDataFrame([(1, "# a\n" + "b " * 40)] * 3 + [(None, "c " * 90)], "id long, text string")
    assert S.section_starts(df, "id", "text", 50).count() == 1
    with pytest.raises(ValueError):
        S.split_texts(df, "id", "text", 10, 10)
