"""Publications: path rules, ledgers, references, turns, labels, versions, measured tables."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from vellumgrid.functions.text import version_key
from vellumgrid.operators import parse, rewrite
from vellumgrid.operators import provenance as V
from vellumgrid.runtime import broadcast_if_small, materialise, measured_bytes, written_rows
from vellumgrid.sources import files, pages

H = "0" * 64


def test_paths(spark):
    df = spark.createDataFrame([("/a/b.md",), ("/a/../b.md",), ("a.md",), ("/a?.md",), ("img/x.png",), (".x/y.png",), ("a//b.png",), ("graph.json",), ("a\x07b",), (None,)], "p string")
    got = [tuple(r) for r in df.select(V.document_path("p"), V.artifact_path("p")).collect()]
    assert got == [(True, False), (False, False), (False, False), (False, False), (False, True), (False, False), (False, False), (False, False), (False, False), (False, False)]


def test_graph_addresses(spark):
    good = ["https://h.org/graph.json", "https://h.org:8/a/Graph.JSON"]
    bad = ["http://h.org/graph.json", "https://H.org/graph.json", "https://h.org/a/../graph.json", "https://h.org/graph.json#x", "https://u@h.org/graph.json", "https://h.org/xgraph.json", None]
    df = spark.createDataFrame([(x,) for x in good + bad], "u string")
    assert [r[0] for r in df.select(V.graph_address("u")).collect()] == [True] * 2 + [False] * 7


def test_reference_issues(spark, rows):
    ref = lambda i, f, line, u: ("b", i, f, line, u, "corpus", "/index.md", H)
    data = [ref(1, "/a", 2, "https://h.org/graph.json"), ref(2, "/a", 1, "https://h.org/x/graph.json"), ref(3, "/b", 0, "https://h.org/graph.json")]
    df = spark.createDataFrame(data, "bundle string, pos long, from string, line int, url string, origin string, root string, sha256 string")
    assert rows(V.reference_issues(df, "bundle")) == [("b", 2, "order"), ("b", 3, "line"), ("b", 3, "repeated address")]
    assert V.reference_issues(df.limit(0), "bundle").count() == 0


def test_publication_issues(spark, rows):
    declared = spark.createDataFrame([("/a.md", "document", H), ("x.png", "artifact", H), ("y.md", "artifact", H), ("/z.md", "document", "Z")], "path string, kind string, sha256 string")
    there = spark.createDataFrame([("/a.md", H), ("x.png", "1" * 64), ("/z.md", "Z"), ("more", H)], "path string, sha256 string")
    assert rows(V.publication_issues(declared, there)) == [("/z.md", "bad hash"), ("more", "undeclared"), ("x.png", "mismatch"), ("y.md", "bad path"), ("y.md", "missing")]


def test_turns_and_labels(spark, rows):
    q = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 9), ("c", 1), ("c", 2)], "seed string, pos int")
    got = [(r.seed, r.pos) for r in pages.round_robin(q, fetches=6).orderBy("turn").collect()]
    assert got == [("a", 0), ("b", 9), ("c", 1), ("a", 1), ("c", 2), ("a", 2)]
    d, c = (spark.createDataFrame([(1, x) for x in xs], "id int, label string") for xs in (["k:a", "k:b"], ["k:b", "k:c", "other"]))
    assert rows(V.label_changes(d, c, "id", prefix="k:")) == [(1, "k:a", "add"), (1, "k:c", "remove")]
    assert rows(V.label_changes(d, c, "id", prefix="k:", complete=False)) == [(1, "k:a", "add")]


def test_versions(spark):
    order = ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "v1.0.1+x", "1.10.0"]
    df = spark.createDataFrame([(x,) for x in reversed(order)], "v string")
    assert [r.v for r in df.orderBy(version_key("v")).collect()] == order
    assert spark.createDataFrame([("1.0",), ("1.0.0-",), (None,)], "v string").where(version_key("v").isNotNull()).count() == 0


def test_ledgers_data_and_revisions(spark, tmp_path, rows):
    path = tmp_path / "ledger.json"
    assert files.read_ledger(spark, str(path)).count() == 0
    path.write_text(json.dumps({"version": "0", "files": {"a.md": H}}))
    assert rows(files.read_ledger(spark, str(path))) == [("a.md", H)]
    for bad in ({"version": "1", "files": {}}, {"version": "0", "files": {"../a": H}}, {"version": "0", "files": {"a": "x"}}):
        path.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            files.read_ledger(spark, str(path))
    path.write_text("[1]")
    with pytest.raises(ValueError):
        files.read_data(str(path))
    assert files.head_revision(str(tmp_path)) == ""
    git = tmp_path / ".git"
    (git / "refs/heads").mkdir(parents=True)
    (git / "HEAD").write_text("ref: refs/heads/x\n")
    (git / "packed-refs").write_text(f"# pack\n{'a' * 40} refs/heads/x\n")
    assert files.head_revision(str(tmp_path)) == "a" * 40
    (git / "refs/heads/x").write_text("b" * 40 + "\n")
    assert files.head_revision(str(tmp_path)) == "b" * 40


def test_published_files(spark, tmp_path, rows):
    (tmp_path / "a.md").write_bytes(b"abc")
    assert rows(files.publication(spark, str(tmp_path)), "path", "bytes", "sha256") == [("/a.md", 3, hashlib.sha256(b"abc").hexdigest())]
    with pytest.raises(Exception, match="too large"):
        files.publication(spark, str(tmp_path), limit=2).collect()


def test_typed_sources(spark, rows):
    df = spark.createDataFrame([(1, "\ufeff---\nsources:\n- resource: a\n  n: 1.5\n  ok: yes\n- text\n---\n"), (2, "---\nsources: {resource: b}\n---\n"), (3, "---\nsources: [\n---\n"), (4, None)], "id int, t string")
    assert rows(parse.typed_sources(df, "t", "id")) == [(1, 1, '{"n": 1.5, "ok": true, "resource": "a"}'), (2, 1, '{"resource": "b"}')]


def test_fields_and_values():
    doc = "---\r\ntype: a\r\ntags:\r\n  - x\r\n---\r\nbody"
    assert rewrite.set_fields(doc, {"type": None, "tags": ["y"], "a": "1"}) == "---\r\ntags:\r\n  - y\r\na: \"1\"\r\n---\r\nbody"
    for bad in ({}, {"_x": "1"}, {"a:b": "1"}, {"a": 1}):
        with pytest.raises(ValueError):
            rewrite.set_fields(doc, bad)
    with pytest.raises(ValueError):
        rewrite.set_fields("no block", {"a": "b"}, reserved=True)
    text = "---\nsee: [a.md, xa.md]\nsources:\n  - resource: a.md\nnote: a.md\n---\na.md"
    assert rewrite.respell_values(text, {"see": {"a.md": "b.md"}, "sources": {"a.md": "c.md"}}) == "---\nsee: [b.md, xa.md]\nsources:\n  - resource: c.md\nnote: a.md\n---\na.md"
    assert rewrite.apply_plan("[a](x) `[a](x)`\n~~~\n[a](x)\n~~~\n[[w]] ![[w]]", [("x", "y"), ("[[w]]", "[w](w.md)")]) == "[a](y) `[a](x)`\n~~~\n[a](x)\n~~~\n[w](w.md) ![[w]]"


def test_measured_tables(spark):
    df = spark.createDataFrame([(i, "x" * i, ["y"]) for i in range(50)], "a int, b string, c array<string>")
    known = materialise(df, "t", measure=True)
    assert written_rows(known) == 50 and measured_bytes(known) == measured_bytes(df) and known.where("a > 1").count() == 48
    empty = materialise(df.where(F.lit(False)), "t", measure=True)
    assert (written_rows(empty), measured_bytes(empty)) == (0, 0)
    assert "BroadcastHashJoin" in df.join(broadcast_if_small(known.select("a")), "a")._jdf.queryExecution().toString()
