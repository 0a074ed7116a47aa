"""Orphan references, with a hot key that the split join must keep whole."""

import datetime as dt
import random

from pyspark.sql import functions as F

from vellumgrid.operators import references as R

T = dt.datetime(2025, 5, 10)
DAY = dt.timedelta(days=1)
LINKS = "link_id long, bundle string, target string, anchor string, seen_at timestamp, extra int"
FILES = "file_id long, bundle string, path string, created_at timestamp, deleted_at timestamp"
HEADS = "heading_id long, file_id long, ord int, heading_text string"
GRAPH = "graph_id long, bundle string, build_no int, path string, links array<string>, built_at timestamp"


def tables(spark):
    files = spark.createDataFrame([(1, "b", "/a.md", T - DAY, None), (2, "b", "/old.md", T - 9 * DAY, T - DAY), (3, "b", "/old.md", T + DAY, None), (4, "b", None, T, None)], FILES)
    heads = spark.createDataFrame([(1, 1, 1, "Über uns"), (2, 1, 2, "Notes"), (3, 1, 3, "notes"), (3, 1, 3, "notes"), (4, 1, 4, None)], HEADS)
    return files, heads


def test_links(spark, rows):
    files, heads = tables(spark)
    data = [
        (1, "b", "/a.md", None, T, 0),
        (2, "b", "/a.md", "über-uns", T, 0),
        (3, "b", "/a.md", "Über uns!", T, 0),
        (4, "b", "/a.md", "notes-1", T, 0),
        (5, "b", "/a.md", "notes-2", T, 0),
        (6, "b", "/a.md", "^block", T, 0),
        (7, "b", "/old.md", None, T, 0),
        (8, "b", "/old.md", None, T + 2 * DAY, 0),
        (9, "b", "/a.md", None, T - 2 * DAY, 0),
        (10, "c", "/a.md", None, T, 0),
        (11, "b", None, None, T, 0),
        (12, None, "/a.md", None, T, 0),
        (13, "b", "/a.md", None, None, 0),
        (14, "b", "/old.md", None, T - 2 * DAY, 0),
        (7, "b", "/old.md", None, T, 1),
    ]
    data += [(100 + i, "b", "/gone.md", None, T, 0) for i in range(300)] + [(1000 + i, "b", "/a.md", "notes", T, 0) for i in range(300)]
    got = rows(R.orphan_links(spark.createDataFrame(data, LINKS), files, heads), "link_id", "reason")
    want = [(5, "anchor")] + [(i, "target") for i in (7, 9, 10, 12, 13)] + [(100 + i, "target") for i in range(300)]
    assert got == sorted(want, key=repr)


def test_graph_links(spark, rows):
    data = [
        (1, "b", 1, "/a", ["/b", "/x", None, "/a"], T),
        (2, "b", 1, "/b", [], T),
        (3, "b", 1, "/c", None, T),
        (4, "b", 2, "/x", ["/a", "/x"], T),
        (1, "b", 1, "/a", ["/b", "/x", None, "/a"], T),
        (5, "b", None, None, ["/a"], T),
    ]
    got = rows(R.orphan_graph_links(spark.createDataFrame(data, GRAPH)), "graph_id", "item_pos")
    assert got == [(1, 2), (1, 3), (4, 1), (5, 1)]


def test_report_and_empty(spark, rows):
    files, heads = tables(spark)
    links = spark.createDataFrame([(1, "b", "/no", None, T, 0), (2, "b", "/no", None, T + 40 * DAY, 0)], LINKS)
    graph = spark.createDataFrame([], GRAPH)
    twice = links.unionByName(links)
    assert rows(R.orphan_report(twice, files, heads, graph)) == [("links", dt.datetime(2025, 5, 1), 1), ("links", dt.datetime(2025, 6, 1), 1)]
    none = R.orphan_references(links.limit(0), files.limit(0), heads.limit(0), graph)
    assert none.count() == 0 and R.orphan_report(links.limit(0), files.limit(0), heads.limit(0), graph).count() == 0


def test_months_that_do_not_decide(spark, rows):
    """Records that come and go within a month, several alive at once, against a look at each link."""
    rnd = random.Random(3)
    at = lambda: T + dt.timedelta(hours=rnd.randrange(2000))
    files = [(i, "b", f"/{rnd.randrange(6)}.md", at(), rnd.choice([None, at(), at()])) for i in range(40)]
    heads = [(i, rnd.randrange(40), i, rnd.choice(["A", "b", "b-1", "B 1"])) for i in range(90)]
    links = [(i, "b", f"/{rnd.randrange(7)}.md", rnd.choice([None, "a", "b", "b-1", "b-2", "b-1-1", ""]), at(), 0) for i in range(900)]
    slugs = {}
    for _, f, _, text in heads:
        have = slugs.setdefault(f, [])
        have.append(text.lower().replace(" ", "-"))
    final = {f: {s if k == 0 else f"{s}-{k}" for s in have for k in range(have.count(s))} for f, have in slugs.items()}
    want = []
    for i, _, p, a, t, _ in links:
        alive = [f for f, _, q, c, d in files if p == q and c <= t and (d is None or d > t)]
        if not alive:
            want.append((i, "target"))
        elif a is not None and not any(a in final.get(f, ()) for f in alive):
            want.append((i, "anchor"))
    frames = [spark.createDataFrame(links, LINKS), spark.createDataFrame(files, FILES), spark.createDataFrame(heads, HEADS)]
    assert rows(R.orphan_links(*frames), "link_id", "reason") == sorted(want, key=repr)
    report = R.orphan_report(*frames, spark.createDataFrame([], GRAPH)).collect()
    assert sum(r.n_orphans for r in report) == len(want)


def test_heavy_keys(spark, rows):
    """Small keys by broadcast, or heavy keys by broadcast and the others by shuffle: the same rows."""
    data = [(i, "hot" if i % 3 else None) for i in range(300)] + [(1000 + i, f"k{i % 7}") for i in range(50)]
    refs = spark.createDataFrame(data, "id long, k string")
    sums = refs.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    for missing in (["hot", "k3"], ["k1"], ["hot"]):
        keys = spark.createDataFrame([(k, "x") for k in [*missing, None]], "k string, status string")
        want = sorted(i for i, k in data if k is None or k in missing)
        for limit in (0, 1 << 20):
            got = R.pick(refs, keys, ["k"], sums, rows_per_task=40, broadcast_bytes=limit)
            assert sorted(r.id for r in got.collect()) == want
