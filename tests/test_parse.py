"""Parsers, search and filters on small documents."""

import pytest

from vellumgrid.functions import markdown as md
from vellumgrid.operators import checks, parse, search

DOC = """---
type: note
tags: [eu, "b c"]
status: 'draft'
sources:
  - resource: ./x.go
  - resource: src/y.go
empty:
n: 0.10
---
# Title
text `# not [a](b)` [One](./one.md#x "t") ![i](<a b.png>)
```sh
# no heading
- [ ] no box
~~~
## Title
- [ ] open *it*
  * [x]  done
#nospace
# Title

| a | b |
|---|:-:|
| 1 | x \\| y |
| 2 |
| 3 | 4 | 5 |

[[b|the B]] `[[no]]` ![[sub/c#h]] [[]]
"""


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, content string")


FRONT = [
    ("---\na: 1\n---\nbody", "a: 1", "body", 3),
    ("---\r\na: 1\r\n---\r\nbody", "a: 1", "body", 3),
    ("---\na: 1\n---", "a: 1", "", 2),
    ("no\n---\na\n---\n", None, "no\n---\na\n---\n", 0),
    ("---\na: 1\n---x\n---\nb", None, "---\na: 1\n---x\n---\nb", 0),
    ("---\n---\nb", None, "---\n---\nb", 0),
    ("---\na: 1\n", None, "---\na: 1\n", 0),
    ("", None, "", 0),
    (None, None, None, 0),
]


def test_frontmatter(spark):
    got = docs(spark, *[f[0] for f in FRONT]).orderBy("id").select(md.frontmatter("content").alias("f")).collect()
    for r, (text, block, body, lines) in zip(got, FRONT):
        assert (r.f.block, r.f.body, r.f.lines) == (block, body, lines), text


def test_headings(spark, rows):
    got = rows(parse.headings(docs(spark, DOC, None, ""), "content", "id"))
    assert got == [(0, 1, 1, "Title", 11, "title", "title"), (0, 2, 2, "Title", 17, "title", "title-1"), (0, 3, 1, "Title", 21, "title", "title-2")]


def test_checkboxes(spark, rows):
    assert rows(parse.checkboxes(docs(spark, DOC), "content", "id")) == [(0, 18, False, "open *it*"), (0, 19, True, "done")]


def test_links(spark, rows):
    assert rows(parse.inline_links(docs(spark, DOC), "content", "id")) == [(0, 12, 1, "One", "./one.md#x", "relative"), (0, 12, 2, "i", "a b.png", "relative")]


def test_tables(spark, rows):
    got = rows(parse.table_cells(docs(spark, DOC, "|a|\n", "```\n|a|\n|-|\n|b|\n```"), "content", "id"), "row_n", "col_n", "header", "cell")
    assert got == [(1, 1, "a", "1"), (1, 2, "b", "x | y"), (2, 1, "a", "2"), (2, 2, "b", ""), (3, 1, "a", "3"), (3, 2, "b", "4")]


def test_wikilinks(spark, rows):
    got = rows(parse.wikilinks(docs(spark, DOC.replace("```sh", "").replace("~~~", "")), "content", "id"), "embed", "target", "anchor", "display")
    assert got == [(False, "b", "", "the B"), (True, "sub/c", "h", "")]


def test_properties(spark, rows):
    p = parse.entries(docs(spark, DOC, "plain", "---\n- a\n---\n", "---\na: [\n---\n", None), "content", "id")
    assert rows(parse.fm_values(p, "id")) == [(0, "n", 1, "0.10"), (0, "status", 1, "draft"), (0, "tags", 1, "eu"), (0, "tags", 2, "b c"), (0, "type", 1, "note")]
    assert {r.key for r in parse.fm_keys(p, "id").collect()} == {"type", "tags", "status", "sources", "empty", "n"}
    by = {r.id: r for r in p.collect()}
    assert by[0].resources == ["./x.go", "src/y.go"] and by[0].sources_ok and by[0].fm_lines == 10
    assert by[2].fm_error and by[3].fm_error and by[1].fm_error is None


def test_yaml_budgets():
    assert parse.decode_yaml("a: &x\n  b: *x")[1]
    assert parse.decode_yaml("a: " + "[" * 200 + "]" * 200)[1]
    assert parse.decode_yaml("a: 1\na: 2\nd: 2024-01-01\nn: null\ne:") == ('{"a": "2", "d": "2024-01-01", "n": "null", "e": ""}', None)


WHERE = [("type=note", [0]), ("tags=eu", [0]), ("tags=b c", [0]), ("nope!=x", [0, 1]), ("nope=", [0, 1]), ("empty=", [0, 1]), ("status!=", [0]), ("type!=note", [1]), ('status="draft"', [0])]


@pytest.mark.parametrize("expr,want", WHERE)
def test_where(spark, expr, want):
    p = parse.entries(docs(spark, DOC, "plain"), "content", "id")
    assert sorted(r.id for r in search.list_entries(p, where=[expr]).collect()) == want


def test_where_parse():
    assert search.Where.parse("a!=b=c") == search.Where("a", "b=c", True)
    assert search.Where.parse("a=b!=c") == search.Where("a", "b!=c", False)
    with pytest.raises(ValueError):
        search.Where.parse("nothing")


def test_search(spark, rows):
    d = docs(spark, "Link graph\ngraph oranges\nLINKS and graph\n", "apples", None)
    assert rows(search.search(d, "content", "link graph", "id")) == [(0, 2)]
    assert rows(search.search(d, "content", "link graph", "id", mode="any")) == [(0, 3)]
    assert rows(search.search(d, "content", "link graph", "id", mode="exact")) == [(0, 1)]
    assert rows(search.search_lines(d, "content", "oranges", "id")) == [(0, 2, "graph oranges")]
    with pytest.raises(ValueError):
        search.search(d, "content", " ", "id")


def test_checks(spark, rows):
    texts = {"/a.md": DOC, "/b c.md": "x", "/index.md": "---\ntype: x\n---\n", "/log.md": "---\na: 1\n---\n", "/e/f/g/h/i.md": "---\ntype: t\nstatus: odd\nsources: []\ntimestamp: 2026-1-2\nverified:\n  by: me\n  at: 2026-01-02T03:04:05Z\ngenerated: {by: me}\n---\n"}
    df = spark.createDataFrame(list(texts.items()), "path string, content string")
    got = rows(checks.document_issues(parse.entries(df, "content", "path"), "path", types=["note"]), "path", "rule")
    assert got == sorted(
        [
            ("/b c.md", "path holds a space"),
            ("/b c.md", "type is missing"),
            ("/index.md", "index.md declares properties"),
            ("/log.md", "log.md has frontmatter"),
            ("/e/f/g/h/i.md", "status is not in the vocabulary"),
            ("/e/f/g/h/i.md", "sources is no list of mappings with a resource"),
            ("/e/f/g/h/i.md", "timestamp is not valid"),
            ("/e/f/g/h/i.md", "generated is no event"),
            ("/e/f/g/h/i.md", "type is not in the vocabulary"),
            ("/e/f/g/h/i.md", "path is too deep"),
        ],
        key=repr,
    )


def test_dates(spark):
    df = spark.createDataFrame([("2026-01-02", True, False), ("2026-1-2", False, True), ("2026-02-30", False, False), ("2026-01-02T03:04:05Z", True, False), ("2026-01-02 03:04", False, False), ("January 2, 2026", False, True), ("2 Jan 2026", False, True), ("2026/01/02", False, True)], "t string, ok boolean, odd boolean")
    for r in df.select("*", checks.valid_timestamp("t").alias("v"), checks.odd_date("t").alias("o")).collect():
        assert (r.v, r.o) == (r.ok, r.odd), r


def test_link_gate(spark):
    df = spark.createDataFrame([("[a]: b",), ('x <A class="y" href="z">',), ("[[w]]",), ("[a](b)",)], "t string")
    assert [r[0] for r in df.select(checks.link_gate("t")).collect()] == ["reference link", "HTML link", "wikilink", None]
