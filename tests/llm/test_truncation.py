"""Endings, whole-value prefixes, and odd rows."""

import pytest

from vellumgrid.llm import truncation as T

TOLD = [
    ("All is well.", T.FINISHED),
    ("He said “all is well.”", T.FINISHED),
    ("**Is it?**", T.FINISHED),
    ("Done.…", T.FINISHED),
    ("The end. ✓", T.FINISHED),
    ("x.\n\nUpdated: 2026-01-02", T.FINISHED),
    ("x.\n\n[see](/a/b.md)", T.FINISHED),
    ("```sh\nls\n```", T.FINISHED),
    ("| a | b |\n|---|---|\n| 1 | 2 |", T.FINISHED),
    ("The pump grew by\n152.", T.FINISHED),
    ("All is well.\n[page break]", T.FINISHED),
    ("Both the recor", T.CUT),
    ("Both the recor [more]", T.CUT),
    ("```sh\nls", T.CUT),
    ("~~~\nls\n~~~\n~~~\nx.", T.CUT),
    ("| a | b |\n|---|---|\n| 1 | 2", T.CUT),
    ("| a | b |\n|---|---|\n| 1 |", T.CUT),
    ("Use `origins.", T.CUT),
    ("- a\n- ", T.CUT),
    ("x.\n\n##", T.CUT),
    ("Mid sentence, and", T.CUT),
    ("- one\n- two thr", T.ASK),
    ("It goes on…", T.ASK),
    ("It goes on...", T.ASK),
    ("x.\n\n-- Some desk", T.ASK),
    ("   ", T.FINISHED),
]


@pytest.mark.parametrize("text,want", TOLD)
def test_form(text, want):
    assert T.ending(text)[0] == want


def corpus():
    whole = [
        "The footer was moved because the pump left early.\n\n- red apples\n- green pears\n- cold tea\n\nWe saw the boat again. The apples were cold. Nobody sold the pears.",
        "Nobody sold the boat. We saw green pears.\n\n- cold apples\n- red boat\n\nThe tea was red. The pump left early.",
    ]
    rows = [(i, "s", w) for i, w in enumerate(whole * 3)]
    rows += [
        (20, "s", "We saw red apples.\n\n- cold tea\n- green pe"),
        (21, "s", "We saw red apples.\n\n- cold tea\n- green pears"),
        (22, "s", "We saw red apples.\n\n- cold tea\n- red"),
        (23, "s", "We saw tea. The pump left early…"),
        (24, "s", "We saw tea. The pump le…"),
        (25, None, "We saw tea. The pump"),
        (26, "s", None),
        (27, "s", " \n"),
        (None, "s", "The pump"),
        (28, "s", whole[0][:80]),
        (29, "s", whole[0][:129]),
    ]
    return rows


def test_cut(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, source string, text string").selectExpr("*", "'x' AS kind", "true AS cut")
    got = {r.doc_id: r for r in T.truncated(df).collect()}
    assert {k for k, r in got.items() if r.cut} == {20, 22, 24, 25, 28, 29}
    assert set(got) == {*range(6), *range(20, 26), 28, 29}
    assert {k for k, r in got.items() if r.longer_copy} == {28, 29}


def test_repeated_rows_report_and_empty(spark):
    rows = corpus()
    df = spark.createDataFrame(rows + rows, "doc_id long, source string, text string")
    found = T.truncated(df)
    report = {r.source: r for r in T.truncation_report(found).collect()}
    assert (report["s"].n_texts, report["s"].n_cut, report[None].n_cut) == (13, 5, 1)
    assert T.truncated(df.limit(0)).count() == 0


def test_limit_of_a_source(spark):
    full = [(i, "a", f"Line {i} is here. " * 3 + "The end.") for i in range(20)]
    cut = [(100 + i, "a", (f"Number {i} tells of many things that went on and on and " * 4)[:60] + "…") for i in range(8)]
    got = {r.doc_id: r for r in T.truncated(spark.createDataFrame(full + cut, "doc_id long, source string, text string")).collect()}
    assert all(got[100 + i].at_limit and got[100 + i].cut for i in range(8))
    assert not any(got[i].cut for i in range(20))


def test_finished_looking_and_short_values_with_longer_copies(spark):
    page = "To move the origins file, open the folder of the project and set it in vellum.toml before the next run. Then call it. Nothing else is needed.\n\n- one\n- two"
    short = "Set it in vellum.toml now. Then go. Bye, all.\n\n[see](/a.md) or not"
    wide = "先打开项目的文件夹。然后保存。" * 6
    at = lambda text, end: text[: text.index(end) + len(end)]
    texts = [page, at(page, "vellum."), at(page, "run."), at(page, "- one"), short, at(short, "vellum."), at(short, "now."), at(short, "(/a.md)"), wide, wide[:75], "Set", "- on", "- one"]
    df = spark.createDataFrame([(i, "s", x) for i, x in enumerate(texts)], "doc_id long, source string, text string")
    got = {r.doc_id: r for r in T.truncated(df, least=1).collect()}
    assert {k for k, r in got.items() if r.longer_copy} == {1, 2, 3, 5, 6, 7, 9, 10, 11}
    assert [k for k in (1, 2, 5, 6, 7, 9, 10, 11) if got[k].cut] == [1, 5, 7, 10, 11]
    long = {r.doc_id for r in T.truncated(df).collect() if r.longer_copy}
    assert long == {1, 2, 3, 9}
    report = T.truncation_report(T.truncated(df, least=1)).first()
    assert (report.n_texts, report.n_longer_copy) == (13, 9)


@pytest.mark.parametrize("text,n,want", [("a.b", 2, True), ("A. b", 2, True), ("A. B", 2, False), ("A.\nb", 2, True), ("A.\n\nb", 2, False), ("好。再", 2, False), ("“好。”再", 3, True), ("A. 5", 2, False)])
def test_goes_on(text, n, want):
    assert T.goes_on(text, n)[0] is want


def test_sign_offs(spark):
    texts = [f"We saw {x}.\n\n-- Ostervale desk" for x in ("a boat", "two boats")] + [f"We saw {x}.\n\n-- Ostervale" for x in ("tea", "pears", "apples", "jam")] + ["We saw ham.\n\n-- Ostervale de"]
    full = [f"Line {i} is here. " * 3 + "The end." for i in range(20)]
    cut = [f"Page {i:03} is long.\n\n-- Mill office" for i in range(6)] + ["Page 006 is long.\n\n-- Ostervale desk"[-33:]]
    rows = [(i, "s", x) for i, x in enumerate(texts)] + [(100 + i, "b", x) for i, x in enumerate(full)] + [(200 + i, "b", x) for i, x in enumerate(cut)]
    got = {r.doc_id: r.cut for r in T.truncated(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert {k for k, cut in got.items() if cut} == {2, 3, 4, 5, 6, *range(200, 206)}


def test_counting_every_word_gives_the_same(spark):
    df = spark.createDataFrame([(f"d{i}", s, x) for i, s, x in corpus() if i is not None], "doc_id string, source string, text string")
    few, all_ = ({tuple(r) for r in T.truncated(df, least=1, key_bound=b).collect()} for b in (1 << 20, 0))
    assert few == all_ and {r[0] for r in few if r[3]} == {"d20", "d22", "d24", "d25", "d28", "d29"}
    evidence = {r[0]: r[4] for r in few}
    assert evidence["d20"] == evidence["d24"] == evidence["d28"] == "value" and evidence["d22"] == "word" and evidence["d0"] is None


def test_without_anything_longer_elsewhere_nothing_is_cut(spark):
    df = spark.createDataFrame([(1, "s", "Qwx zrr"), (2, "s", "All is well.")], "doc_id long, source string, text string")
    assert not any(r.cut for r in T.truncated(df, least=1).collect())


@pytest.mark.parametrize("unit,want", [("one two three", "one two three"), ("a" * 500 + " b" * 200, "b b"), ("x " * 100 + "y" * 300 + " z", "y" * 300 + " z"), ("", "")])
def test_tail(unit, want):
    assert T.tail(unit).endswith(want) and unit.endswith(T.tail(unit))


def test_marks_in_brackets():
    assert [T.ending(f"The boat left. {x}")[0] for x in ("[continued]", "(see below)", "<cut here>", "[...]")] == [T.FINISHED] * 4
    assert T.ending("The boat le [to be continued]")[::3] == (T.CUT, 11)
    assert T.ending("x.\n\n[see](intro)")[0] == T.FINISHED
