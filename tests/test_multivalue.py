"""Packed values: golden cases, and a character-wise splitter on random fields."""

import random

import pytest

from vellumgrid.operators import multivalue as mv

CASES = [
    ("a, b, c", ["a", "b", "c"]),
    ("a b c", ["a", "b", "c"]),
    ("month end; rent", ["month end", "rent"]),
    ("  a , b ", ["a", "b"]),
    ("a;;b;", ["a", "b"]),
    ("a|b;c,d", ["a", "b", "c", "d"]),
    ("to_do|receipts; month end; x,y", ["to_do", "receipts", "month end", "x", "y"]),
    ('"a, b"; c', ["a, b", "c"]),
    ("'a; b' c", ["a; b", "c"]),
    ("“a, b”, c", ["a, b", "c"]),
    ("schemas mirrors 'refunds, late' EU 'one, two, three'", ["schemas", "mirrors", "refunds, late", "EU", "one, two, three"]),
    ('"the ""big"" list", x', ['the "big" list', "x"]),
    ('["the \\"big\\" list", "y"]', ['the "big" list', "y"]),
    ("[a, 'b, c', d e]", ["a", "b, c", "d e"]),
    ("[a]", ["a"]),
    ("\n- a b\n- “c, d”\n- e", ["a b", "c, d", "e"]),
    ("- a\n- b", ["a", "b"]),
    ("auditor's copy, x", ["auditor's copy", "x"]),
    ("auditor's copy's", ["auditor's", "copy's"]),
    ("eu/fr c++ p&l tax@source q1.2026 area:ledger on-the-road", ["eu/fr", "c++", "p&l", "tax@source", "q1.2026", "area:ledger", "on-the-road"]),
    ("--archive, -x", ["--archive", "-x"]),
    ("a\tb\t\tc d", ["a", "b", "c d"]),
    ("a、b，c；d·e", ["a", "b", "c", "d", "e"]),
    ('"unclosed, x', ['"unclosed', "x"]),
    ('say "a, b", c', ['say "a', 'b"', "c"]),
    ("a, a, A", ["a", "a", "A"]),
    ("   ", []),
    (" , ; ", []),
]


@pytest.mark.parametrize("field,want", CASES)
def test_rule(spark, field, want):
    toks, shape = _shape(field)
    assert ["".join(toks[p] for p in item) for item in mv.resolve(shape)] == want


def _shape(field):
    import regex

    toks = regex.findall(mv.TOKEN, field)
    shape = "".join("_" if t[0] in mv.BLANKS else "w" if len(t) > 1 or t not in mv._SPECIAL + "-" else t for t in toks)
    return toks, shape


def test_split_values(spark, rows):
    data = [(i, f) for i, (f, _) in enumerate(CASES)] + [(100, None), (101, ""), (102, "none"), (102, "none")]
    df = spark.createDataFrame(data, "id long, field string").selectExpr("id", "field", "'x' AS item", "7 AS item_pos")
    got = mv.split_values(df, "field", none="none")
    assert got.columns == ["id", "field", "item_pos", "item"]
    want = [(i, p, v) for i, (_, items) in enumerate(CASES) for p, v in enumerate(items, 1)]
    assert rows(got, "id", "item_pos", "item") == sorted(want, key=repr)


def test_empty_table(spark):
    assert mv.split_values(spark.createDataFrame([], "id long, field string"), "field").count() == 0


def test_very_long_field(spark, rows):
    n = 20_000
    df = spark.createDataFrame([(1, ", ".join(f"v{i}" for i in range(n)))], "id long, field string")
    got = mv.split_values(df, "field")
    assert got.count() == n and rows(got.where(f"item_pos = {n}"), "item") == [(f"v{n - 1}",)]


def test_tokens_rebuild_the_field(spark):
    rnd = random.Random(4)
    fields = ["".join(rnd.choice("ab é'\"“”,;|\t\n -[]\\、·") for _ in range(rnd.randint(1, 30))) for _ in range(300)]
    df = spark.createDataFrame([(f,) for f in fields], "field string")
    out = df.select("field", mv.tokens("field").alias("t"), mv.skeleton(mv.tokens("field")).alias("s")).collect()
    for r in out:
        assert "".join(r.t) == r.field
        assert len(r.s) == len(r.t)
        toks, shape = _shape(r.field)
        assert toks == r.t and shape == r.s
        flat = [p for item in mv.resolve(r.s) for p in item]
        assert flat == sorted(set(flat)) and all(0 <= p < len(r.t) for p in flat)
