"""Snapshot changes against a brute-force comparison of neighbours."""

import datetime as dt
import random

from vellumgrid.operators.snapshots import canonical_path, snapshot_changes

SCHEMA = "project string, snapshot_no int, path string, sha256 string, ingested_at timestamp, status string"


def _at(i):
    return dt.datetime(2025, 1, 1) + dt.timedelta(minutes=i)


def brute(data):
    held = {}
    for p, n, path, sha, t, _ in data:
        if p is None or n is None or path is None:
            continue
        path = path.replace("\\", "/")
        while path.startswith("./"):
            path = path[2:].lstrip("/")
        cell = held.setdefault(p, {}).setdefault(n, {})
        key = (t or dt.datetime.min, sha is not None, "o" in (sha or ""), (sha or "").lower())
        if path not in cell or cell[path][0] < key:
            cell[path] = (key, None if sha is None else sha.lower())
    out = set()
    for p, snaps in held.items():
        order = sorted(snaps)
        for a, b in zip(order, order[1:]):
            old, new = snaps[a], snaps[b]
            out |= {(p, b, k, "added") for k in new.keys() - old.keys()} | {(p, b, k, "removed") for k in old.keys() - new.keys()}
            out |= {(p, b, k, "modified") for k in new.keys() & old.keys() if new[k][1] != old[k][1]}
    return out


def test_random(spark):
    rnd = random.Random(1)
    data = []
    for i in range(1500):
        project = "hot" if rnd.random() < 0.5 else f"p{rnd.randint(1, 4)}"
        path = rnd.choice(["", "./", "./"]) + rnd.choice(["a/b", "a\\b", "c", "D", "d", "x/y/z"]) + str(rnd.randint(0, 3))
        sha = rnd.choice([None, "ab" * 32, "AB" * 32, "cd" * 32, "odd", "ODD"])
        data.append((project, rnd.choice([1, 2, 3, 5, 8, 13]), path, sha, rnd.choice([None, _at(i)]), "clash"))
    data += data[:100]
    data += [(None, 1, "n", "ab", _at(0), ""), ("p1", None, "n", "ab", _at(0), ""), ("p1", 1, None, "ab", _at(0), "")]
    df = spark.createDataFrame(data, SCHEMA)
    got = [tuple(r) for r in snapshot_changes(df, key=canonical_path("path")).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(data)


def test_one_snapshot_and_empty(spark):
    one = spark.createDataFrame([("p", 4, "a", "00", _at(0), "")], SCHEMA)
    assert snapshot_changes(one).count() == 0
    assert snapshot_changes(one.limit(0)).count() == 0


def test_gap_then_return(spark, rows):
    data = [("p", n, "keep", "00", _at(n), "") for n in (1, 2, 3, 4)] + [("p", 1, "x", "aa", _at(0), ""), ("p", 4, "x", "aa", _at(9), "")]
    assert rows(snapshot_changes(spark.createDataFrame(data, SCHEMA))) == [("p", 2, "x", "removed"), ("p", 4, "x", "added")]
