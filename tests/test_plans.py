"""Registered queries over small written tables."""

import datetime as dt

from vellumgrid.plans import corpus as C

T = dt.datetime(2025, 5, 10)


def put(spark, d, name, rows, ddl):
    spark.createDataFrame(rows, ddl).write.parquet(f"{d}/{name}.parquet")


def put_links(spark, d, rows):
    put(spark, d, "links", [(i, "b", f, i, "t", raw, target, None, i, False) for i, (f, raw, target) in enumerate(rows)], "link_id long, bundle string, from_path string, ord int, link_text string, raw string, target string, anchor string, line_no int, wikilink boolean")


def put_files(spark, d, rows):
    put(spark, d, "corpus_files", [(i, "b", p, "note", text, T if gone else None) for i, (p, text, gone) in enumerate(rows)], "file_id long, bundle string, path string, entry_type string, content string, deleted_at timestamp")


def test_health_signals(spark, rows, tmp_path):
    d = str(tmp_path)
    with_source = lambda r: f"---\ntype: note\nsources:\n  - resource: {r}\n---\nx\n"
    put_files(spark, d, [("/index.md", "x", 0), ("/same.md", with_source("s/same"), 0), ("/changed.md", with_source("s/changed"), 0), ("/fresh.md", with_source("s/fresh"), 0), ("/gone.md", with_source("s/gone"), 0), ("/bare.md", "x", 0), ("/lone.md", with_source("s/same"), 0), ("/x.md", with_source("s/same"), 0), ("/y.md", with_source("s/same"), 0), ("/dead.md", with_source("s/gone"), 1)])
    put_links(spark, d, [("/index.md", p, p) for p in ("/same.md", "/changed.md", "/fresh.md", "/gone.md", "/bare.md")] + [("/x.md", "/y.md", "/y.md"), ("/y.md", "/x.md", "/x.md")])
    snaps = [(1, "s/same", "1"), (1, "s/changed", "1"), (1, "s/gone", "1"), (2, "s/same", "1"), (2, "s/changed", "2"), (2, "s/fresh", "1")]
    put(spark, d, "inventory_snapshots", [("b", n, p, h, T, "go", 1) for n, p, h in snaps], "project string, snapshot_no int, path string, sha256 string, ingested_at timestamp, entry_type string, bytes long")
    assert rows(C.QUERIES["health_signals"](spark, d)) == [("missing_sources", 1), ("orphan", 1), ("source_changed", 1), ("source_missing", 1), ("source_not_in_baseline", 1), ("unreachable", 2)]


def test_link_paths_all(spark, rows, tmp_path):
    d = str(tmp_path)
    raws = ["/a/b.md#X", "../c.md#Über uns", "./e.md", "f.md", "#here", "../../../out.md", "<../g h.md#y>", "[[w#z]]", "https://x.example/p", "//x.example/p", None]
    put_links(spark, d, [("/k/l/doc.md", raw, None) for raw in raws])
    got = rows(C.QUERIES["link_paths_all"](spark, d))
    assert got[:7] == [(0, "/a/b.md", "X", False), (1, "/k/c.md", "Über uns", False), (2, "/k/l/e.md", None, False), (3, "/k/l/f.md", None, False), (4, "/k/l/doc.md", "here", False), (5, "/out.md", None, True), (6, "/k/g h.md", "y", False)]
    assert len(got) == 7


def test_checkin_generated(spark, rows, tmp_path):
    d = str(tmp_path)
    put_files(spark, d, [("/same.md", "x", 0), ("/own.md", "x", 0)])
    builds = [(1, "/same.md", "1"), (1, "/changed.md", "1"), (1, "/dropped.md", "1"), (2, "/same.md", "1"), (2, "/changed.md", "2")]
    put(spark, d, "graph_files", [("b", *x) for x in builds], "bundle string, build_no int, path string, sha256 string")
    got = rows(C.QUERIES["checkin_generated"](spark, d), "path", "change")
    assert got == [("/changed.md", "conflict"), ("/dropped.md", "converged"), ("/own.md", "workspace"), ("/same.md", "workspace")]
