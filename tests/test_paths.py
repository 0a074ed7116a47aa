"""Path algebra: golden tables and round trips."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellumgrid.functions import paths as P
from vellumgrid.functions import text, urls

NORMAL = [
    ("/a/b.md", "/x/y.md", "/x/y.md", False),
    ("/a/b.md", "c.md", "/a/c.md", False),
    ("/a/b.md", "./c.md", "/a/c.md", False),
    ("/a/b.md", "../c.md", "/c.md", False),
    ("/a/b.md", "../../c.md", "/c.md", True),
    ("/b.md", "../c.md", "/c.md", True),
    ("/a/b.md", "c/../d.md", "/a/d.md", False),
    ("/a/b.md", "/x/./y//z.md", "/x/y/z.md", False),
    ("/a/b.md", "../a/../../c.md", "/c.md", True),
]


def test_normalise(spark):
    df = spark.createDataFrame(NORMAL, "f string, t string, want string, esc boolean")
    for r in df.select("*", P.normalise_link("f", "t").alias("n")).collect():
        assert (r.n.path, r.n.escapes) == (r.want, r.esc), r


def test_anchor(spark):
    r = spark.createDataFrame([("/a.md", "b.md#x#y")], "f string, t string").select(P.normalise_link("f", "t").alias("n")).first().n
    assert (r.path, r.anchor) == ("/b.md", "x#y")


def test_relative_round_trip(spark):
    names = ["/a.md", "/d/a.md", "/d/e/a.md", "/d/f/b.md", "/g/e/a.md", "/d.md"]
    df = spark.createDataFrame([(a, b) for a in names for b in names], "f string, t string")
    out = df.select("f", "t", P.relative_link("f", "t").alias("r")).select("*", P.normalise_link("f", "r").alias("n")).collect()
    for r in out:
        assert r.n.path == r.t and not r.n.escapes and re.match(r"\./|\.\./", r.r), r
    assert {(r.f, r.t): r.r for r in out}[("/d/e/a.md", "/d/f/b.md")] == "../f/b.md"


GLOBS = [
    ("*.md", "/a.md", True),
    ("*.md", "/x/a.md", False),
    ("x/*.md", "/x/a.md", True),
    ("x/**", "/x", True),
    ("x/**", "/x/y/z", True),
    ("x/**", "/xy", False),
    ("**/a.md", "/a.md", True),
    ("**/a.md", "/x/y/a.md", True),
    ("x/**/a.md", "/x/a.md", True),
    ("x/?.md", "/x/a.md", True),
    ("x/?.md", "/x/ab.md", False),
    ("x/[ab].md", "/x/b.md", True),
    ("x/[^ab].md", "/x/b.md", False),
    ("x/[a-c].md", "/x/b.md", True),
    ("x/[", "/x/[", False),
    ("a.b", "/aXb", False),
]


@pytest.mark.parametrize("pattern,path,want", GLOBS)
def test_glob(pattern, path, want):
    assert bool(re.match(P.glob_regex(pattern).replace(r"\z", r"\Z"), path)) == want


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="abé.+()|/", min_size=1, max_size=12))
def test_literal_glob_matches_itself(name):
    path = "/" + "/".join(x for x in name.split("/") if x)
    if path != "/":
        assert re.match(P.glob_regex(path).replace(r"\z", r"\Z"), path)


def test_slugs(spark):
    df = spark.createDataFrame([("Hello, World!",), ("Über uns 2",), ("a_b-c",), ("  ",), (None,)], "t string")
    assert [r[0] for r in df.select(text.heading_slug("t")).collect()] == ["hello-world", "über-uns-2", "a_b-c", "--", None]


def test_canonical_key(spark):
    df = spark.createDataFrame([("/Café.md",), ("/Ña",), ("/x́",)], "p string")
    assert [r[0] for r in df.select(P.canonical_key("p")).collect()] == ["/café.md", "/ña", "/x́"]


def test_resources(spark):
    df = spark.createDataFrame([("/d/a.md", "./x.go"), ("/d/a.md", "../x.go"), ("/a.md", "../x.go"), ("/d/a.md", "src/x.go"), ("/d/a.md", "/src/x.go")], "d string, r string")
    assert [r[0] for r in df.select(P.canonical_resource("d", "r")).collect()] == ["d/x.go", "x.go", None, "src/x.go", "src/x.go"]


URLS = [
    ("https://Example.org", "https://example.org/", True),
    ("https://example.org/a?b#c", "https://example.org/a?b", False),
    ("http://example.org/a", "http://example.org/a", False),
    ("https://u@example.org/", "https://u@example.org/", False),
    ("https://example.org:99999/", "https://example.org:99999/", False),
    ("nonsense", None, False),
]


def test_urls(spark):
    df = spark.createDataFrame(URLS, "u string, want string, ok boolean")
    for r in df.select("*", urls.canonical_url("u").alias("c"), urls.valid_url("u").alias("v")).collect():
        assert (r.c, r.v) == (r.want, r.ok), r


def test_addresses():
    public = {"8.8.8.8": True, "10.0.0.1": False, "::ffff:10.0.0.1": False, "192.0.2.9": False, "2606:4700::1": True, "fe80::1": False, "224.0.0.1": False, "x": False}
    assert {k: urls.public_address(k) for k in public} == public


def test_link_labels(spark):
    df = spark.createDataFrame([("a [b] \\ c", "/x y(1).md")], "t string, p string")
    r = df.select(urls.link_label("t"), urls.link_target("p")).first()
    assert tuple(r) == ("a \\[b\\] \\\\ c", "/x%20y%281%29.md")
