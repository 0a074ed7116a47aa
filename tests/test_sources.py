"""Trees, ignore rules, locks, pages, sinks and the streaming door."""

import datetime as dt
import json

import pytest

from vellumgrid import sinks
from vellumgrid.sources import files as S
from vellumgrid.sources import pages as G
from vellumgrid.streaming import watch


def tree(root, files):
    for name, text in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())


def test_project_and_corpus(spark, tmp_path, rows):
    tree(tmp_path, {"project.toml": 'name = "n"\ncorpus = "docs"\noutput = "docs/out"\nignore = ["drafts/**"]\nodd = 1\n[tool.x]\na = 1\n', "docs/a.md": "A", "docs/sub dir/b+c.md": "B", "docs/.hidden/x.md": "x", "docs/out/y.md": "y", "docs/drafts/z.md": "z", "docs/C.MD": "c", "docs/pic.png": b"\0"})
    p = S.discover_project(str(tmp_path / "docs" / "sub dir"))
    assert (p.name, p.unknown, p.spec) == ("n", ("odd",), "0.2")
    assert rows(S.corpus_files(spark, p), "path", "content") == [("/a.md", "A"), ("/sub dir/b+c.md", "B")]
    assert rows(S.assets(spark, p)) == [("/C.MD",), ("/pic.png",)]
    (tmp_path / "docs" / "l.md").symlink_to(tmp_path / "docs" / "a.md")
    with pytest.raises(ValueError):
        S.corpus_files(spark, p)
    for bad in ('corpus = "../x"', "name = 3", 'spec = "9"', 'types = "a"'):
        (tmp_path / "bad.toml").write_text(bad)
        with pytest.raises(ValueError):
            S.load_project(str(tmp_path / "bad.toml"))
    with pytest.raises(FileNotFoundError):
        S.discover_project("/", config="none.toml")


def test_compiled_corpus(spark, rows):
    df = spark.createDataFrame([("a", b"x\r\ny\rz"), ("b", b""), ("c", b"q\n")], "path string, content binary")
    assert rows(S.compiled_corpus(df)) == [("a", "x\ny\nz\n"), ("b", ""), ("c", "q\n")]
    with pytest.raises(ValueError):
        S.compiled_corpus(df, max_docs=2)
    with pytest.raises(Exception, match="not UTF-8"):
        S.compiled_corpus(spark.createDataFrame([("a", b"\xff")], "path string, content binary")).collect()


IGNORE = "# c\n*.log\n!keep.log\n/top\nbuild/\na/**\ndocs/*.txt\n\\#x\n"
IGNORED = {"x.log": True, "d/x.log": True, "d/keep.log": False, "top": True, "d/top": False, "build/x": True, "d/build/x": True, "build": False, "a/b/c": True, "a": False, "docs/t.txt": True, "docs/d/t.txt": False, "#x": True, "y": False, "top/keep.log": True}


def test_ignore_rules(spark, tmp_path, rows):
    df = spark.createDataFrame(list(IGNORED.items()), "path string, want boolean")
    for r in df.select("*", S.ignored("path", S.parse_ignore(IGNORE)).alias("got")).collect():
        assert r.got == r.want, r
    tree(tmp_path, {".gitignore": "*.tmp\n", "d/.gitignore": "!x.tmp\n/only\n", "x.tmp": "", "d/x.tmp": "", "d/only": "", "only": "", "e/f.txt": ""})
    got = rows(S.source_files(spark, str(tmp_path), S.read_ignore_rules(str(tmp_path)), exclude=["e"]), "path")
    assert got == [(".gitignore",), ("d/.gitignore",), ("d/x.tmp",), ("only",)]


def test_urls_and_locks(spark, tmp_path, rows):
    src = spark.createDataFrame([("a.py", b"x = 'https://a.org/b).'\n# http://c.org, and https://\n")], "path string, content binary")
    assert rows(S.literal_urls(src)) == [("a.py", 1, "https://a.org/b"), ("a.py", 2, "http://c.org")]
    inv = spark.createDataFrame([("b", "go", 2, "0" * 64), ("a", "other", 1, "f" * 64)], S.INVENTORY)
    lock = tmp_path / "lock.json"
    S.write_lock(inv, str(lock))
    assert rows(S.read_lock(spark, str(lock))) == rows(inv)
    with pytest.raises(FileExistsError):
        S.write_lock(inv, str(lock))
    S.write_lock(inv.limit(0), str(lock), replace=True)
    assert S.read_lock(spark, str(lock)).count() == 0
    for bad in ({"version": "1"}, {"version": "0", "files": {"../a": {"sha256": "0" * 64}}}, {"version": "0", "files": {"a": {"sha256": "x"}}}):
        lock.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            S.read_lock(spark, str(lock))
    out = spark.createDataFrame([("a b",), ("c*",), ("d",)], "path string")
    assert S.quarantine_lines(out, "/d\n") == ["/a\\ b", "/c\\*"]


def test_pages(spark, rows):
    body = '<script>https://no.org</script><a class=x href="/a.md#f">1</a> <A HREF=\'b.html?x=1&amp;y=2\'>2</A> <a href=#top>3</a> https://o.org/z. [t](c.md) <a href="http://plain.org">4</a>\n[d]: <https://d.org/e>\n<a href="/a.md">5</a>'
    assert G.page_links(body, "https://H.org/dir/") == ["https://h.org/a.md", "https://h.org/dir/b.html?x=1&y=2", "https://o.org/z", "https://h.org/dir/c.md", "https://d.org/e"]
    assert len(G.page_links(" ".join(f"https://x.org/{i}" for i in range(400)), "https://x.org/")) == 256
    data = [("https://s.org/d/", '<a href="a.md">'), ("https://s.org/d/a.md", '<a href="b.md"> <a href="../out.md">'), ("https://s.org/d/b.md", '<a href="./">'), ("https://s.org/out.md", ""), ("https://s.org/d/c.md", None)]
    df = spark.createDataFrame(data, "url string, body string")
    seeds = spark.createDataFrame([("https://S.org/d/",), ("https://none.org/",)], "url string")
    assert rows(G.crawl(seeds, df), "url", "depth") == [("https://s.org/d/", 0), ("https://s.org/d/a.md", 1), ("https://s.org/d/b.md", 2)]


def test_crawl_budget(spark, rows):
    page = lambda s, n, *to: (f"https://{s}.org/{n}.md", "".join(f'<a href="{x}.md">' for x in to))
    data = [page("a", 0, 1, 2, 3), page("a", 1), page("a", 2), page("a", 3), page("b", 0, 1, 9), page("b", 1, "../../x", "https://a.org/0"), page("a", 9)]
    df = spark.createDataFrame(data, "url string, body string")
    seeds = spark.createDataFrame([("https://a.org/0.md",), ("https://b.org/0.md",)], "url string")
    got = G.crawl(seeds, df, fetches=4).cache()
    assert rows(got, "url") == [("https://a.org/0.md",), ("https://a.org/1.md",), ("https://b.org/0.md",), ("https://b.org/1.md",)]
    assert rows(G.not_fetched(got, df), "url", "reason") == [("https://a.org/0.md", "outside"), ("https://a.org/2.md", "budget"), ("https://a.org/3.md", "budget"), ("https://b.org/9.md", "unknown"), ("https://b.org/x.md", "unknown")]
    assert G.crawl(seeds, df).count() == 6


def test_manifest():
    h = "0" * 64
    good = {"files": {"a.md": {"sha256": h}}, "artifacts": {"z": {"sha256": h}}, "external": [{"url": "https://a.org/graph.json", "sha256": h, "from": "a", "line": 1}]}
    assert G.decode_manifest(json.dumps(good))[0] == {"a.md": h, "z": h}
    for bad in ({"files": {"a": {"sha256": "x"}}}, {"files": {"a": {"sha256": h}}, "artifacts": {"a": {"sha256": h}}}, {"external": [{"url": "http://a", "sha256": h}]}):
        with pytest.raises(ValueError):
            G.decode_manifest(json.dumps(bad))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("é<", 1, ["a", "b"], True), (None, 22, [], False)], "s string, n int, l array<string>, b boolean").coalesce(1)
    assert sinks.emit(df, "csv") == "s,n,l,b\né<,1,a; b,true\n,22,,false\n"
    assert sinks.emit(df, "tsv").splitlines()[1] == "é<\t1\ta; b\ttrue"
    assert "\\u003c" in sinks.emit(df, "json") and json.loads(sinks.emit(df, "json"))[0]["s"] == "é<"
    assert sinks.emit(df).splitlines()[0] == "s    n   l     b"
    assert sinks.emit(df.limit(0), "json") == "[]\n"
    with pytest.raises(ValueError):
        sinks.emit(df, "xml")
    sinks.write_table(df, str(tmp_path / "t"), "csv")
    assert spark.read.csv(str(tmp_path / "t"), header=True).count() == 2
    order = spark.createDataFrame([("/b c.md", 1, "T [x]"), ("/a.md", 2, None)], "path string, seq int, title string")
    assert sinks.llms_txt(" My\ncorpus ", order).endswith("## Reading order\n\n- [T \\[x\\]](b%20c.md)\n- [a.md](a.md)\n")
    files = spark.createDataFrame([("/b.md", 1), ("/a.md", 2)], "path string, bytes int")
    nav = spark.createDataFrame([("/a.md", None, "/b.md")], "path string, prev string, next string")
    g = json.loads(sinks.graph_json(files, nav))
    assert list(g["files"]) == ["/a.md", "/b.md"] and g["nav"] == {"/a.md": {"next": "/b.md"}}
    with pytest.raises(ValueError):
        sinks.graph_json(files, nav, limit=10)


def test_stream(spark, tmp_path, rows):
    t = dt.datetime(2025, 1, 1)
    df = spark.createDataFrame([(i, "the cat" if i % 2 else "a dog", t + dt.timedelta(minutes=i)) for i in range(10)] + [(0, "a dog", t)], "id long, text string, at timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = watch.first_arrivals(watch.documents(spark, str(tmp_path / "in"), df.schema), "id", "at", "1 hour")
    watch.write_to(watch.matches(stream, "text", "the cat", "id"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == [(i, 1) for i in range(1, 10, 2)]
    counts = watch.windowed_counts(watch.documents(spark, str(tmp_path / "in"), df.schema), "at", "0 seconds", "5 minutes")
    q = counts.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("w"), "n_docs") == [(5,), (6,)]
