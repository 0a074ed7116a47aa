"""The similarity join against all pairs."""

import random
import re

import numpy as np
import pytest

from vellumgrid.llm import neardup as N

WORD = re.compile(r"[^\W_]+")


def corpus(seed=7, n=120):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["the", "of", "end"] * 10
    base = [[rnd.choice(vocabulary) for _ in range(rnd.randint(30, 90))] for _ in range(25)]
    out = []
    for i in range(n):
        words = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2, 4, 8])):
            at = rnd.randrange(len(words))
            kind = rnd.random()
            if kind < 0.4:
                words[at] = rnd.choice(vocabulary)
            elif kind < 0.7:
                words.insert(at, rnd.choice(vocabulary))
            else:
                cut = rnd.randrange(len(words))
                words = words[cut:] + words[:cut]
        out.append((i, " ".join(w.upper() if rnd.random() < 0.1 else w for w in words) + rnd.choice(["", ".", "\n"])))
    return out


def brute(data, n, t, least):
    sets = {}
    for i, text in data:
        w = WORD.findall((text or "").lower())
        if i is not None and len(w) >= least:
            sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    ids = sorted(sets)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9}


@pytest.mark.parametrize("n,t,cell", [(3, 0.6, 4096), (3, 0.6, 4), (5, 0.8, 4096), (1, 0.5, 8)])
def test_all_pairs(spark, n, t, cell):
    data = corpus()
    data += [(500, data[0][1]), (501, data[0][1]), (0, data[0][1]), (600, None), (601, ""), (602, "too short"), (None, data[0][1])]
    df = spark.createDataFrame(data, "id long, text string").selectExpr("id", "text", "1 AS cls", "2 AS n").repartition(3)
    got = [tuple(r) for r in N.pairs_of(*N.near_duplicates(df, "id", "text", n, t, 40, log_counters=8, cell=cell)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(data, n, t, 40)


def test_hot_family(spark):
    """A third of all rows are one text with small edits, another group exact copies."""
    rnd = random.Random(2)
    words = [f"f{i}" for i in range(60)]
    family = []
    for i in range(60):
        w = list(words)
        w[rnd.randrange(60)] = f"x{i}"
        family.append((i, " ".join(w)))
    copies = [(100 + i, " ".join(f"c{k}" for k in range(50))) for i in range(60)]
    rest = [(300 + i, " ".join(f"r{i}_{k}" for k in range(50))) for i in range(60)]
    data = family + copies + rest
    members, links = N.near_duplicates(spark.createDataFrame(data, "id long, text string"), "id", "text", 3, 0.6, 40, log_counters=8, cell=16)
    assert {tuple(r) for r in N.pairs_of(members, links).collect()} == brute(data, 3, 0.6, 40)
    groups = {r.id: r.group_id for r in N.groups_of(members, links).collect()}
    assert len({groups[i] for i, _ in family}) == 1 and len({groups[i] for i, _ in copies}) == 1 and len(set(groups.values())) == 62


def test_chain_is_one_group(spark):
    words = [f"k{i}" for i in range(160)]
    data = [(i, " ".join(words[i * 6 : i * 6 + 60])) for i in range(16)]
    members, links = N.near_duplicates(spark.createDataFrame(data, "id long, text string"), "id", "text", 3, 0.6, 40)
    got = N.groups_of(members, links).collect()
    assert len({r.group_id for r in got}) == 1 and min(r.n_links for r in got) == 2


def test_nothing(spark):
    df = spark.createDataFrame([], "id long, text string")
    assert N.pairs_of(*N.near_duplicates(df, "id", "text")).count() == 0
    assert N.groups_of(*N.near_duplicates(df, "id", "text")).count() == 0


def test_other_ids(spark):
    data = [(f"d{i}", t) for i, t in corpus(6, 60)]
    members, links = N.near_duplicates(spark.createDataFrame([*data, data[0]], "id string, text string"), "id", "text", 3, 0.6, 40, log_counters=8)
    got = {tuple(r) for r in N.pairs_of(members, links).collect()}
    assert got == brute(data, 3, 0.6, 40) and len(got) > 3


@pytest.mark.parametrize("some,counts", [([0], [1]), ([0, 255, 511], [255, 1, 2]), ([3, 65535], [1, 1]), ([1, 2], [256, 1]), ([300, 40000], [70000, 1])])
def test_counter_blocks(some, counts):
    got = N._unpacked(N._packed(np.array(some), np.array(counts, np.int32)))
    assert [x.tolist() for x in got] == [some, counts]
