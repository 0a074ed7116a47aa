"""Packing: capacities hold, nothing is lost, little room is left."""

import random

import pytest
from pyspark.sql import functions as F

from vellumgrid.llm import packing as P


def best(packer, size):
    """The rule stated plainly: try every gap, keep the smallest sum of squares."""
    n = {g: int(packer.n[g]) for g in range(1, packer.capacity + 1)}
    options = []
    for g in [g for g in range(size, packer.capacity) if n[g]] + [packer.capacity]:
        m = dict(n)
        if g < packer.capacity:
            m[g] -= 1
        if g > size:
            m[g - size] += 1
        options.append(sum(v * v for v in m.values()))
    return min(options)


def test_each_step_is_least_squares():
    rnd = random.Random(1)
    p = P.Packer(20)
    for _ in range(400):
        size = rnd.randint(1, 20)
        want = best(p, size)
        p.place(size)
        assert int((p.n[1:] ** 2).sum()) == want


@pytest.mark.parametrize("shard", [1000, 40])
def test_pack(spark, shard):
    rnd = random.Random(2)
    data = [(i, rnd.choice([rnd.randint(1, 30), rnd.randint(1, 100), rnd.randint(100, 450)])) for i in range(300)]
    odd = [(5, data[5][1]), (900, None), (901, 0), (902, -3), (None, 5)]
    df = spark.createDataFrame(data + odd, "id long, s long").selectExpr("*", "1 AS bin", "2 AS piece")
    got = P.pack(df, "id", F.col("s"), 100, shard).collect()
    by_id, by_bin = {}, {}
    for r in got:
        by_id.setdefault(r.id, []).append(r)
        by_bin[(r.shard, r.bin)] = by_bin.get((r.shard, r.bin), 0) + r["size"]
    assert max(by_bin.values()) <= 100
    assert {k: sum(r["size"] for r in v) for k, v in by_id.items()} == dict(data)
    for k, v in by_id.items():
        size = dict(data)[k]
        assert len(v) == v[0].n_pieces == -(-size // 100) and sorted(r.piece for r in v) == list(range(len(v)))
    if shard == 1000:
        assert len(by_bin) <= 1.1 * sum(s for _, s in data) / 100


def test_tokens_and_empty(spark):
    df = spark.createDataFrame([(1, "é"), (2, ""), (3, None)], "id long, t string")
    assert [r[0] for r in df.select(P.byte_tokens("t")).collect()] == [3, 1, None]
    none = P.pack(df.limit(0), "id", P.byte_tokens("t"))
    assert none.count() == 0
    r = P.fill_report(P.pack(df, "id", P.byte_tokens("t"), 4), 4).first()
    assert (r.n_containers, r.n_tokens, r.unused_share) == (1, 4, 0.0)


def test_other_ids(spark):
    df = spark.createDataFrame([("a", 5000), ("b", 10), (None, 3)], "id string, size int")
    got = sorted(tuple(r)[:4] for r in P.pack(df, "id", F.col("size")).collect())
    assert got == [("a", 0, 2, 4096), ("a", 1, 2, 904), ("b", 0, 1, 10)]
