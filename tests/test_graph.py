"""Link graph and provenance on small bundles."""

from vellumgrid.operators import graph as G
from vellumgrid.operators import provenance as V
from vellumgrid.operators import rewrite as W

DOCS = ["/index.md", "/a.md", "/b.md", "/sub/c.md", "/cycle/x.md", "/cycle/y.md", "/lone.md", "/parked/z.md", "/log.md"]
EDGES = [("/index.md", "/b.md"), ("/index.md", "/a.md"), ("/index.md", "/b.md"), ("/a.md", "/sub/c.md"), ("/b.md", "/b.md"), ("/cycle/x.md", "/cycle/y.md"), ("/cycle/y.md", "/cycle/x.md"), ("/a.md", "/gone.md"), ("/sub/c.md", "/index.md")]


def world(spark):
    docs = spark.createDataFrame([("w", p) for p in DOCS] + [("rootless", "/q.md")], "bundle string, path string")
    links = spark.createDataFrame([(i, "w", f, i, f"t{i}", t, None, i, False) for i, (f, t) in enumerate(EDGES)], "link_id long, bundle string, from_path string, ord int, link_text string, target string, anchor string, line_no int, wikilink boolean")
    return docs, G.edges(links.unionByName(links))


def test_graph(spark, rows):
    docs, links = world(spark)
    assert rows(G.broken(links, docs), "from_path", "target") == [("/a.md", "/gone.md")]
    assert rows(G.orphans(docs, links, ["/parked/**"]), "path") == [("/lone.md",), ("/q.md",)]
    assert rows(G.reachable(docs, links), "path", "hops") == [("/a.md", 1), ("/b.md", 1), ("/index.md", 0), ("/sub/c.md", 2)]
    assert rows(G.unreachable(docs, links, globs=["/parked/**"]), "path") == [("/cycle/x.md",), ("/cycle/y.md",), ("/lone.md",)]
    assert rows(G.reading_order(docs, links), "path", "seq") == [("/a.md", 2), ("/b.md", 1)]
    assert rows(G.navigation(docs, links), "path", "prev", "next", "n_backlinks") == [("/a.md", "/b.md", None, 1), ("/b.md", None, "/a.md", 1)]
    assert rows(G.backlinks(links, "/index.md"), "from_path") == [("/sub/c.md",)]
    assert len(rows(G.outgoing(links))) == len(set(EDGES))


def test_graph_of_nothing(spark):
    docs, links = world(spark)
    for d, e in ((docs.limit(0), links.limit(0)), (docs, links.limit(0)), (docs.limit(0), links)):
        assert G.reachable(d, e).count() == G.reachable(d, e).where("hops = 0").count()
        G.unreachable(d, e).count()


def test_wikilinks(spark, rows):
    docs = spark.createDataFrame([("w", p) for p in ["/n.md", "/x/n.md", "/x/y/n.md", "/x/m.md", "/y/m.md", "/z/z.md"]], "bundle string, path string")
    wiki = spark.createDataFrame([("w", "/x/s.md", 1, "n"), ("w", "/x/s.md", 2, "m"), ("w", "/s.md", 3, "m"), ("w", "/s.md", 4, "x/y/n"), ("w", "/s.md", 5, "y/n"), ("w", "/s.md", 6, "Zed"), ("w", "/s.md", 7, "none"), ("w", "/s.md", 8, "z.md")], "bundle string, from_path string, wiki_id long, name string")
    aliases = G.alias_map(spark.createDataFrame([("w", "/z/z.md", "aliases", " Zed "), ("w", "/zz.md", "aliases", "Zed"), ("w", "/x/m.md", "title", "n")], "bundle string, path string, key string, value string"))
    got = rows(G.resolve_wikilinks(wiki, docs, aliases), "wiki_id", "path")
    assert got == [(1, "/n.md"), (2, "/x/m.md"), (3, "/x/m.md"), (4, "/x/y/n.md"), (5, None), (6, "/z/z.md"), (7, None), (8, "/z/z.md")]


def inv(spark, **files):
    return spark.createDataFrame([(k.replace("_", "/"), v) for k, v in files.items()], "path string, sha256 string")


def test_drift_is_symmetric(spark, rows):
    a, b = inv(spark, x="1", y="2", z="3"), inv(spark, x="1", y="9", w="3")
    assert rows(V.drift(a, b, "path")) == [("w", "added"), ("y", "modified"), ("z", "removed")]
    assert rows(V.drift(b, a, "path")) == [("w", "removed"), ("y", "modified"), ("z", "added")]


def test_merge_plan(spark, rows):
    base = inv(spark, same="1", mine="1", theirs="1", both="1", equal="1", gen="1", gone="1")
    draft = inv(spark, same="1", mine="2", theirs="1", both="2", equal="5", gen="2", new="1")
    now = inv(spark, same="1", mine="1", theirs="3", both="3", equal="5", gen="1", gone="1")
    got = rows(V.merge_plan(base, draft, now, inv(spark, gen="1"), "path"))
    assert got == [("both", "conflict"), ("equal", "converged"), ("gen", "conflict"), ("gone", "apply"), ("mine", "apply"), ("new", "apply"), ("theirs", "workspace")]


def test_ledger_plan(spark, rows):
    got = rows(V.ledger_plan(inv(spark, edited="1", stale="1", same="1", absent="1"), inv(spark, edited="2", same="1", fresh="1", taken="1", absent="1"), inv(spark, edited="9", stale="1", same="1", taken="5"), "path"))
    assert got == [("absent", "write"), ("edited", "edited"), ("fresh", "write"), ("stale", "delete"), ("taken", "overwrite")]


def test_health(spark, rows):
    docs = spark.createDataFrame([(p,) for p in ["/index.md", "/grounded.md", "/missing.md", "/no.md", "/new.md", "/far.md", "/out.md"]], "path string")
    res = spark.createDataFrame([("/index.md", "s/c"), ("/grounded.md", "s/c"), ("/missing.md", "s/r"), ("/new.md", "s/n"), ("/far.md", "s/k"), ("/out.md", None)], "path string, resource string")
    base, now = inv(spark, s_c="1", s_r="1", s_k="1"), inv(spark, s_c="2", s_n="1", s_k="1")
    lone = docs.where("path IN ('/no.md', '/new.md')")
    got = rows(V.health(docs, res, base, now, lone, docs.where("path IN ('/no.md', '/far.md')")))
    assert got == sorted([("/grounded.md", "source_changed", "s/c"), ("/index.md", "source_changed", "s/c"), ("/missing.md", "source_missing", "s/r"), ("/no.md", "missing_sources", ""), ("/no.md", "orphan", ""), ("/new.md", "source_not_in_baseline", "s/n"), ("/new.md", "orphan", ""), ("/far.md", "unreachable", "")])


SECRETS = [(".env", "environment_credentials"), (".env.local", "environment_credentials"), (".env.local.example", None), (".env.sample", None), ("Credentials.JSON", "credential_filename"), ("id_rsa", "private_key_filename"), ("a.KEY", "private_key_container"), ("a.pem", None), ("secret.md", None)]


def test_inventory(spark, rows):
    assert [r[0] for r in spark.createDataFrame([("/d/" + n,) for n, _ in SECRETS], "p string").select(V.secret_name("p")).collect()] == [w for _, w in SECRETS]
    key = "-----BEGIN RSA PRIVATE KEY-----\nx\n-----END RSA PRIVATE KEY-----"
    files = [("a.go", b"x"), ("d/.env", b"x"), ("node_modules/b.js", b"x"), ("build/c.py", b"x"), ("d/build/c.py", b"x"), ("k.txt", key.encode()), ("n.bin", b"a\0b"), ("half.txt", key[:30].encode()), ("Makefile", b""), ("big", b"x" * 100)]
    kept, out = V.inventory(spark.createDataFrame(files, "path string, content binary"), max_bytes=99)
    assert rows(kept, "path", "type") == [("Makefile", "make"), ("a.go", "go"), ("d/build/c.py", "python"), ("half.txt", "other")]
    assert rows(out) == [("big", "too_large"), ("d/.env", "environment_credentials"), ("k.txt", "private_key_block"), ("n.bin", "binary")]


def test_manifest_and_coverage(spark, rows):
    import hashlib

    sha = hashlib.sha256(b"x").hexdigest()
    declared = inv(spark, ok=sha.upper(), bad="00", lost=sha)
    real = spark.createDataFrame([("ok", "x"), ("bad", "x"), ("more", "x")], "path string, content string")
    assert rows(V.verify_manifest(declared, real, "path")) == [("bad", "mismatch"), ("lost", "missing"), ("more", "undeclared")]
    blocks = spark.createDataFrame([("f", "1", 3, 0), ("f", "1", 3, 2), ("f", "2", 4, 0)], "file string, span string, statements int, hits int")
    assert rows(V.merged_coverage(blocks)) == [("f", 7, 3)]


def test_plans(spark, rows):
    links = spark.createDataFrame([("/d/a.md", "/d/b.md#x"), ("/d/a.md", "./c.md"), ("/d/a.md", "/e f.md"), ("/a.md", "/d/b.md")], "from_path string, raw string")
    assert rows(W.tidy_links_plan(links)) == [("/a.md", "/d/b.md", "./d/b.md"), ("/d/a.md", "/d/b.md#x", "./b.md#x")]
    docs = spark.createDataFrame([("/a b.md",), ("/a-b.md",), ("/c  d/e.md",), ("/x.md",)], "path string")
    assert rows(W.slug_plan(docs)) == [("/a b.md", "/a-b.md", True), ("/c  d/e.md", "/c-d/e.md", False)]
    moved = W.move_plan(spark.createDataFrame([("/a.md", "/b.md"), ("/b.md", "/c/d.md"), ("/x.md", "/y.md")], "from_path string, target string"), spark.createDataFrame([("/b.md", "/c/b.md")], "old string, new string"))
    assert rows(moved) == [("/a.md", "/b.md", "/a.md", "./c/b.md"), ("/b.md", "/c/d.md", "/c/b.md", "./d.md")]


def test_edits(tmp_path):
    doc = "---\n# c\ntype: 'a'\ntags:\n  - x\n  - y\nz: 1\n---\nbody\n- [ ] t\n"
    assert W.set_field(doc, "type", "b") == doc.replace("'a'", "'b'")
    assert W.set_field(doc, "type", "0.1") == doc.replace("'a'", '"0.1"')
    assert W.set_field(doc, "tags", ["q", "no"]) == doc.replace("  - x\n  - y\n", '  - q\n  - "no"\n')
    assert W.set_field(doc, "tags", None) == doc.replace("tags:\n  - x\n  - y\n", "")
    assert W.set_field("body", "a", "b") == "---\na: b\n---\nbody"
    assert W.set_checkbox(doc, 10, True) == doc.replace("[ ] t", "[x] t")
    assert W.apply_plan("[a](/b.md) [c](/b.md#x)", [("/b.md", "./b.md"), ("/b.md#x", "./b.md#x")]) == "[a](./b.md) [c](./b.md#x)"
    f = tmp_path / "a.md"
    f.write_text("old")
    W.write_file(str(f), "new")
    assert f.read_text() == "new" and len(list(tmp_path.iterdir())) == 1
