"""Near-duplicate texts: an exact similarity self-join by rare-first prefix filtering.

The texts are sets of word n-grams. Texts with the same set form a class; the
join runs over classes. Under a global order of the n-grams from rare to
frequent, two sets of similarity ``t`` share an n-gram in their first
``|x| - ceil(t |x|) + 1`` ones. Those prefixes are brought together by n-gram;
pairs that pass the length, positional and suffix filters are verified once each
on the texts themselves.

The order comes from a counter array of fixed size: all n-grams of all texts are
counted in ``2**log_counters`` counters. Any total order gives the same pairs;
a finer one only makes fewer candidates. An n-gram whose counter is 1 is in one
text only and is not posted at all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumgrid.llm.words import U, gram_sets, mix
from vellumgrid.runtime import BROADCAST_BYTES, materialise, measured_bytes

#: 2**24 counters of one byte when sent: a broadcast of 16 MB whatever the input.
LOG_COUNTERS = 24
_BLOCK = 1 << 16
#: Postings of one n-gram that one cell of the candidate join handles.
CELL = 4096
#: Postings of one task of the candidate join.
TASK_POSTINGS = 1_500_000
#: Classes of n-grams in the suffix filter's signature, two to a byte.
SIGNATURE = 128
_EPS = 1e-9

# Blocks of counters, and the profiles of texts, whose ids may have any type.
_PROFILE = pa.schema([("block", pa.int32()), ("data", pa.binary()), ("cls", pa.int64()), ("n", pa.int32()), ("prefix", pa.int64())])


def _prefix(n: int, t: float) -> int:
    return n - math.ceil(t * n - _EPS) + 1


def _class(grams: np.ndarray) -> int:
    """A set's identity: order-free 64-bit hash, recomputed alike in every pass."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(grams ^ U(0xA0761D6478BD642F)).sum() + U(len(grams))], U))[0].astype(np.int64))


def _signature(grams: np.ndarray) -> bytes:
    """How many n-grams fall in each class, at most 15; clipping keeps differences lower bounds."""
    n = np.minimum(np.bincount((grams & U(SIGNATURE - 1)).astype(np.int64), minlength=SIGNATURE), 15).astype(np.uint8)
    return (n[::2] | (n[1::2] << 4)).tobytes()


def _profiler(n: int, least: int, t: float, log_counters: int):
    shift = U(64 - log_counters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = None
        for b in batches:
            at, out = [], []
            kind = b.column(0).type
            for i, _, grams in gram_sets(b.column(1).to_pylist(), n, least):
                if counters is None:
                    counters = np.zeros(1 << log_counters, np.int32)
                np.add.at(counters, (grams >> shift).astype(np.int64), 1)
                at.append(i)
                out.append((None, _signature(grams), _class(grams), len(grams), _prefix(len(grams), t)))
            if out:
                yield _profiles(b.column(0).take(pa.array(at)), out)
        if counters is not None:
            for k in range(0, len(counters), _BLOCK):
                some = np.flatnonzero(counters[k : k + _BLOCK])
                if len(some):
                    yield _profiles(pa.nulls(1, kind), [(k // _BLOCK, _packed(some, counters[k + some]), None, None, None)])

    return run


def _profiles(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, *(pa.array(x, f.type) for x, f in zip(zip(*rows), _PROFILE))], names=["id", *_PROFILE.names])


#: Counts are sent as eighths of their binary logarithm, rounded up; 0 is none, 1 exactly one.
_STEPS = 8


def _coded(counts: np.ndarray) -> np.ndarray:
    return np.where(counts > 0, np.minimum(np.ceil(np.log2(np.maximum(counts, 1)) * _STEPS) + 1, 255), 0).astype(np.uint8)


def _bounds() -> np.ndarray:
    """The greatest count each code stands for."""
    return np.concatenate(([0.0], np.ceil(2.0 ** (np.arange(255) / _STEPS))))


def _packed(some: np.ndarray, counts: np.ndarray) -> bytes:
    """Which counters of a block are used, as steps, and their counts; in single bytes where all of them fit."""
    steps = np.diff(some, prepend=0)
    small = steps.max() < 256, counts.max() < 256
    return bytes(map(int, small)) + steps.astype(np.uint8 if small[0] else np.uint16).tobytes() + counts.astype(np.uint8 if small[1] else np.int32).tobytes()


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    kinds = np.dtype(np.uint8 if data[0] else np.uint16), np.dtype(np.uint8 if data[1] else np.int32)
    n = (len(data) - 2) // (kinds[0].itemsize + kinds[1].itemsize)
    return np.cumsum(np.frombuffer(data, kinds[0], n, 2), dtype=np.int64), np.frombuffer(data, kinds[1], n, 2 + n * kinds[0].itemsize)


def _sum_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(_BLOCK, np.int64)
    for x in pdf["data"]:
        some, counts = _unpacked(x)
        total[some] += counts
    return pd.DataFrame({"block": [pdf["block"].iloc[0]], "data": [_coded(total).tobytes()], "total": [int(total.sum())]})


_POSTINGS = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("docs", pa.binary()), ("places", pa.binary()), ("classes", pa.binary()), ("sizes", pa.binary())])
#: Places are sent in 14 bits beside the two of the side; a smaller place than the true one only weakens the positional bound.
_PLACES = (1 << 14) - 1


def _poster(n: int, least: int, t: float, log_counters: int, counts, parts: int, cell: int):
    """Prefixes by part of the n-grams' hashes: half a hash, the text's number among those of the batch, and the place in its order."""
    shift = U(64 - log_counters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        bounds = _bounds()
        keys, docs, places, classes, sizes, held = [], [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            k, d, p = np.concatenate(keys), np.concatenate(docs), np.concatenate(places)
            part = (k % U(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            cut = np.flatnonzero(np.diff(part[order])) + 1
            all_classes, all_sizes = np.array(classes, np.int64), np.array(sizes, np.uint32)
            cols: list[list] = [[] for _ in _POSTINGS]
            for at in np.split(order, cut):
                here, d_here = np.unique(d[at], return_inverse=True)
                row = (int(part[at[0]]), (k[at] >> U(32)).astype(np.uint32), d_here.astype(np.uint16), p[at], all_classes[here], all_sizes[here])
                for col, x in zip(cols, row):
                    col.append(x if isinstance(x, int) else x.tobytes())
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, _POSTINGS)], schema=_POSTINGS)

        for b in batches:
            for _, _, grams in gram_sets(b.column(0).to_pylist(), n, least):
                cls = _class(grams)
                if cls in seen:  # copies within a task add nothing
                    continue
                if len(seen) < 1 << 20:
                    seen.add(cls)
                code = counts.value[(grams >> shift).astype(np.int64)]
                top = _prefix(len(grams), t)
                order = np.lexsort((grams, code))[:top]
                key, place, load = grams[order], np.minimum(np.arange(top), _PLACES).astype(np.uint16), bounds[code[order]]
                shared = load > 1
                key, place, load = key[shared], place[shared], load[shared]
                hot = np.flatnonzero(load > cell)
                if len(hot):  # split the n-gram's postings into blocks, a cell for every pair of blocks
                    cold = load <= cell
                    ks, ps = [key[cold]], [place[cold]]
                    for i in hot:
                        blocks = -(-int(load[i]) // cell)
                        mine = (cls & (2**63 - 1)) % blocks
                        other = np.arange(blocks, dtype=U)
                        low, high = np.minimum(other, U(mine)), np.maximum(other, U(mine))
                        ks.append(mix(key[i] ^ mix(low * U(0x9E3779B1) + high + U(1))))
                        side = np.where(other == U(mine), 0, np.where(other > U(mine), 1, 2)).astype(np.uint16)
                        ps.append(place[i] | (side << np.uint16(14)))
                    key, place = np.concatenate(ks), np.concatenate(ps)
                if not len(key):
                    continue
                keys.append(key)
                places.append(place)
                docs.append(np.full(len(key), len(classes), np.uint16))
                classes.append(cls)
                sizes.append(len(grams))
                held += len(key)
                if held > 1_000_000 or len(classes) == 1 << 16:
                    yield flush()
                    keys, docs, places, classes, sizes, held = [], [], [], [], [], 0
        if held:
            yield flush()

    return run


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _candidates(t: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, list[tuple]] = {}
        for b in batches:
            for i, p in enumerate(b.column(0).to_pylist()):
                key, doc, place, cls, size = (np.frombuffer(b.column(1 + j)[i].as_buffer(), kind) for j, kind in enumerate((np.uint32, np.uint16, np.uint16, np.int64, np.uint32)))
                rows.setdefault(p, []).append((key, cls[doc], size[doc], place))
        for blobs in rows.values():
            key, cls, size, place = (np.concatenate(x) for x in zip(*blobs))
            blobs.clear()
            order = np.lexsort((cls, size, key))
            key, cls, size, place = key[order], cls[order], size[order].astype(np.int64), place[order]
            first = np.concatenate(([True], (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])))  # copies from other tasks
            key, cls, size, side, place = key[first], cls[first], size[first], place[first] >> np.uint16(14), (place[first] & np.uint16(_PLACES)).astype(np.int64)
            at, step, found, held = np.arange(len(key)), 0, [], 0
            while len(at):
                step += 1
                at = at[at + step < len(key)]
                other = at + step
                # sorted by size within a key: once too long, all later ones are
                keep = (key[at] == key[other]) & (size[at] >= t * size[other] - _EPS)
                at, other = at[keep], other[keep]
                need = np.ceil(t / (1 + t) * (size[at] + size[other]) - _EPS)
                ok = 1 + np.minimum(size[at] - place[at], size[other] - place[other]) - 1 >= need
                ok &= (side[at] == 0) | (side[at] != side[other])
                if ok.any():
                    x, y = cls[at[ok]], cls[other[ok]]
                    found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], 1))
                    held += len(x)
                    if held > 2_000_000:
                        yield _batch(found)
                        found, held = [], 0
            if held:
                yield _batch(found)

    return run


def _batch(found: list[np.ndarray]) -> pa.RecordBatch:
    pairs = np.unique(np.concatenate(found), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=_PAIRS)


def _suffix_filter(t: float):
    """Drop pairs whose signatures differ by more n-grams than a similar pair may."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            packed = [np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, SIGNATURE // 2).astype(np.int16) for c in (4, 5)]
            sig = [np.concatenate((x & 15, x >> 4), 1) for x in packed]
            size = b.column(6).to_numpy().astype(np.int64) + b.column(7).to_numpy()
            apart = np.abs(sig[0] - sig[1]).sum(1)
            keep = apart <= size - 2 * np.ceil(t / (1 + t) * size - _EPS)
            yield b.select([0, 1, 2, 3]).filter(pa.array(keep))

    return run


def _verify(n: int, t: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            cache: dict = {}
            a_id, b_id = b.column(2).to_pylist(), b.column(3).to_pylist()
            for ids, col in ((a_id, 4), (b_id, 5)):
                fresh = {x: i for i, x in enumerate(ids) if x not in cache}
                texts = b.column(col).take(pa.array(list(fresh.values()), pa.int64())).to_pylist()
                names = list(fresh)
                for i, _, grams in gram_sets(texts, n, n):
                    cache[names[i]] = grams
            sim = np.zeros(b.num_rows)
            for i, (x, y) in enumerate(zip(a_id, b_id)):
                p, q = cache.get(x), cache.get(y)
                if p is not None and q is not None:
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    sim[i] = both / (len(p) + len(q) - both)
            keep = pa.array(sim >= t - _EPS)
            out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sim)], schema=schema)
            yield out.filter(keep)

    return run


def near_duplicates(
    df: DataFrame, id: str, text: str, n: int = 5, threshold: float = 0.8, least_words: int = 40, log_counters: int = LOG_COUNTERS, cell: int = CELL
) -> tuple[DataFrame, DataFrame]:
    """``(members, links)``: every text's class, and the similar pairs of classes.

    ``members(id, cls, n)`` has a row per text of at least ``least_words`` words
    (NULL, empty and shorter texts are in no class); texts with the same set of
    word ``n``-grams share ``cls``. ``links(a, b, similarity)`` has every pair of
    classes ``a < b`` with Jaccard similarity of ``threshold`` or more. Rows with
    a NULL id are left out, ids may have any type; a row delivered twice counts once. Other columns are
    ignored. An empty table gives empty results.
    """
    spark = df.sparkSession
    kind = df.schema[id].dataType.simpleString()
    rows = df.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    profile = materialise(rows.mapInArrow(_profiler(n, least_words, threshold, log_counters), f"id {kind}, {_ddl(_PROFILE)}"), "profile")

    blocks = profile.where(F.col("block").isNotNull()).select("block", "data").groupBy("block").applyInPandas(_sum_blocks, "block int, data binary, total long").collect()
    counts, total = np.zeros(1 << log_counters, np.uint8), 0
    for b in blocks:  # 2**log_counters bytes in all at most
        part = np.frombuffer(b.data, np.uint8)
        size = min(_BLOCK, len(counts) - b.block * _BLOCK)
        counts[b.block * _BLOCK : b.block * _BLOCK + size] = part[:size]
        total += b.total
    load = max(1.0, total / len(counts))
    shared = spark.sparkContext.broadcast(counts)

    texts = profile.where(F.col("id").isNotNull())
    members = texts.select("id", "cls", "n").distinct()
    total = texts.agg(F.sum("prefix")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // TASK_POSTINGS))
    postings = rows.select("text").mapInArrow(_poster(n, least_words, threshold, log_counters, shared, parts, max(cell, int(4 * load))), _ddl(_POSTINGS))
    spread = postings.repartitionById(parts, F.col("part"))
    pairs = spread.mapInArrow(_candidates(threshold), "a long, b long").distinct()

    chosen = texts.groupBy("cls").agg(F.min(F.struct("id", "data", "n")).alias("r")).select("cls", "r.id", "r.data", "r.n")
    left, right = (chosen.select(F.col("cls").alias(x), F.col("id").alias(f"id_{x}"), F.col("data").alias(f"data_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    close = pairs.join(left, "a").join(right, "b").select("a", "b", "id_a", "id_b", "data_a", "data_b", "n_a", "n_b")
    close = materialise(close.mapInArrow(_suffix_filter(threshold), f"a long, b long, id_a {kind}, id_b {kind}"), "close", measure=True)

    wanted = close.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
    # two ids of a pair are half of what the pair was measured to have
    small = F.broadcast(wanted) if measured_bytes(close) <= BROADCAST_BYTES else wanted
    texts_of = rows.join(small, "id", "left_semi")
    both = close.join(texts_of.select(F.col("id").alias("id_a"), F.col("text").alias("text_a")), "id_a").join(
        texts_of.select(F.col("id").alias("id_b"), F.col("text").alias("text_b")), "id_b"
    )
    found = both.select("a", "b", "id_a", "id_b", "text_a", "text_b").mapInArrow(_verify(n, threshold), "a long, b long, similarity double")
    return members, found.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))  # rows delivered twice were verified twice


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def pairs_of(members: DataFrame, links: DataFrame) -> DataFrame:
    """All pairs of texts ``(id_a, id_b)``, smaller first: those of linked classes and those within a class.

    As many rows as there are similar pairs; a class of many copies is joined on
    its key, which adaptive execution splits.
    """
    m = members.select("id", "cls")
    x, y = m.select(F.col("id").alias("x"), F.col("cls").alias("a")), m.select(F.col("id").alias("y"), F.col("cls").alias("b"))
    across = links.join(x, "a").join(y, "b").select("x", "y")
    within = x.join(y.withColumnRenamed("b", "a"), "a").where(F.col("x") < F.col("y")).select("x", "y")
    return across.unionByName(within).where(F.col("x") != F.col("y")).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def groups_of(members: DataFrame, links: DataFrame, rounds: int = 40) -> DataFrame:
    """One row per text: ``(id, group_id, n_links)``; texts joined by a chain of links share the smallest class.

    ``n_links`` counts the linked classes. Labels are propagated to neighbours and
    halved by pointer jumping, so a chain of length ``k`` takes about ``log k``
    rounds; every round is a written table. A chain not done after ``rounds``
    raises instead of giving an unfinished answer.
    """
    links = materialise(links.select("a", "b"), "links")
    edges = materialise(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = materialise(edges.select(F.col("a").alias("v")).distinct().withColumn("l", F.col("v")), "labels")
    for _ in range(rounds):
        near = edges.join(labels, edges.b == labels.v).groupBy("a").agg(F.min("l").alias("m"))
        step = labels.join(near, labels.v == near.a).select("v", "l", F.least("l", "m").alias("m"))
        jump = labels.select(F.col("v").alias("m"), F.col("l").alias("j"))
        new = materialise(step.join(jump, "m").select("v", "l", F.least("m", "j").alias("m")), "labels")
        moved = new.where(F.col("l") != F.col("m")).limit(1).count()
        labels = new.select("v", F.col("m").alias("l"))
        if not moved:
            break
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    degree = edges.groupBy(F.col("a").alias("v")).agg(F.count(F.lit(1)).alias("n_links"))
    tops = labels.join(degree, "v").select(F.col("v").alias("cls"), F.col("l").alias("group_id"), "n_links")
    return members.select("id", "cls").join(tops, "cls", "left").select("id", F.coalesce("group_id", "cls").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
