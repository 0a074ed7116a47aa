"""Leaked passages against a search for all 12-word runs."""

import random
import re

from vellumgrid.llm import leakage as L

WORD = re.compile(r"[^\W_]+")


def brute(docs, items, least):
    runs = {}
    for i, t in items:
        w = WORD.findall((t or "").lower())
        for k in range(len(w) - least + 1):
            runs.setdefault(tuple(w[k : k + least]), set()).add(i)
    out = set()
    for d, t in docs:
        w = WORD.findall((t or "").lower())
        for k in range(len(w) - least + 1):
            out |= {(d, i) for i in runs.get(tuple(w[k : k + least]), ())}
    return out


def world(seed):
    rnd = random.Random(seed)
    vocabulary = "the of a in on red blue green fox dog cat runs over under lazy quick".split()
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(5, 40)))) for i in range(25)]
    docs = []
    for d in range(150):
        w = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 60))]
        if rnd.random() < 0.6:
            it = rnd.choice(items)[1].split()
            a = rnd.randrange(len(it))
            part = it[a : a + rnd.randint(5, 25)]
            if rnd.random() < 0.3:
                part[rnd.randrange(len(part))] = "odd"
            at = rnd.randint(0, len(w))
            w[at:at] = part
        docs.append((d, "".join(x.upper() + rnd.choice([" ", "\n> ", "** ", "_ _", ", ", " | "]) if rnd.random() < 0.5 else x + " " for x in w)))
    return docs, items


def test_random(spark):
    docs, items = world(4)
    docs += [(0, docs[0][1]), (900, None), (901, ""), (None, items[0][1])]
    items += [(0, items[0][1]), (800, None), (801, ""), (None, docs[0][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id")
    i = spark.createDataFrame(items, "item_id long, item_text string")
    want = brute([x for x in docs if x[0] is not None], [x for x in items if x[0] is not None], 12)
    got = [(r.doc_id, r.item_id) for r in L.leaked_items(d, i).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 10


def test_by_shuffle(spark):
    docs, items = world(5)
    d, i = spark.createDataFrame([(f"d{k}", t) for k, t in [*docs, docs[0]]], "doc_id string, text string"), spark.createDataFrame(items, "item_id int, item_text string")
    got = [sorted(map(tuple, L.leaked_items(d, i, broadcast_bytes=n).collect())) for n in (0, 1 << 20)]
    assert got[0] == got[1] and {(int(x[0][1:]), x[1]) for x in got[0]} == brute(docs, items, 12)


def test_many_items(spark):
    """A hundred thousand items are more than is broadcast."""
    rnd = random.Random(8)
    w = lambda n: " ".join(f"w{rnd.randrange(400)}" for _ in range(n))
    items = [(i, w(13)) for i in range(100_000)]
    docs = [(d, f"{w(20)} {items[rnd.randrange(100_000)][1]} {w(9)} {items[rnd.randrange(100_000)][1][3:]}") for d in range(60)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string")
    assert {(r.doc_id, r.item_id) for r in L.leaked_items(d, i).collect()} == brute(docs, items, 12)


def test_longest_run_and_repeats(spark):
    w = [f"w{k}" for k in range(30)]
    docs = [(1, " ".join(w[:14] + ["x"] + w[14:30])), (2, " ".join((w[3:16] + ["-"]) * 40)), (3, " ".join(w[:11]))]
    got = {r.doc_id: r.n_words for r in L.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(w))], "item_id long, item_text string")).collect()}
    assert got == {1: 16, 2: 13}


def test_empty(spark):
    d, i = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, item_text string")
    assert L.leaked_items(d, i).count() == 0
    assert L.leaked_items(d, spark.createDataFrame([(1, "a " * 20)], "item_id long, item_text string")).count() == 0
