"""Evaluation passages inside a corpus: a prefix-filtered set join on word shingles.

A text leaks an item when it holds ``least`` consecutive words of it. Every such
run contains all shingles of one of the item's windows of ``least`` words, so a
window can only be matched where its rarest shingle (its necessary prefix under
a rare-first order) occurs. One pass over the texts counts the items' shingles;
a table of prefixes (shingle, item, offset) is made of them, and a second pass
probes the texts for these alone. Each hit fixes the offset between text and
item; the room both have around it bounds the run, and the words are compared.

Where items and prefixes are small, by their measured size, they are broadcast
and no text moves. Beyond, shingles are joined by shuffle and only texts that
share a prefix with an item meet it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumgrid.llm.words import U, chunks, ngrams
from vellumgrid.runtime import BROADCAST_BYTES, materialise, written_rows

SHINGLE = 5
LEAST = 12


def _positions(sorted_values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Index in ``sorted_values`` of each asked value, or -1."""
    if not len(sorted_values):
        return np.full(len(asked), -1)
    at = np.minimum(np.searchsorted(sorted_values, asked), len(sorted_values) - 1)
    return np.where(sorted_values[at] == asked, at, -1)


def _shingler(shingle: int, least: int):
    """``(item, at, gram)`` rows and, at -1, how many words an item ``(item, text)`` has and their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column(1).to_pylist()):
                item, at, gram, held = [], [], [], []
                for k in np.flatnonzero(np.diff(c.bounds) >= least):
                    words = c.hashes[c.bounds[k] : c.bounds[k + 1]]
                    grams = np.concatenate(([U(len(words))], ngrams(words, shingle)))
                    item.append(np.full(len(grams), c.lo + int(k)))
                    at.append(np.arange(-1, len(grams) - 1))
                    gram.append(grams)
                    held += [words.tobytes()] + [None] * (len(grams) - 1)
                if item:
                    ids = b.column(0).take(pa.array(np.concatenate(item)))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(at), pa.int32()), pa.array(np.concatenate(gram).astype(np.int64)), pa.array(held, pa.binary())], names=["item", "at", "gram", "words"])

    return run


def _counter(wanted, shingle: int):
    """``(gram, n)``: how often the wanted shingles, or all if NULL, occur in texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = wanted.value if wanted is not None else None
        counts = np.zeros(len(known), np.int64) if known is not None else None
        for b in batches:
            for c in chunks(b.column(0).to_pylist()):
                grams = ngrams(c.hashes, shingle)
                if known is None:
                    yield _tally(*np.unique(grams, return_counts=True))
                else:
                    at = _positions(known, grams)
                    counts += np.bincount(at[at >= 0], minlength=len(counts))
        if known is not None:
            some = np.flatnonzero(counts)
            yield _tally(known[some], counts[some])

    return run


def _tally(grams: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))], names=["gram", "n"])


def _longest(text: np.ndarray, item: np.ndarray, p: int, o: int) -> tuple[int, int]:
    """The run of equal words around position ``p`` of the text and ``o`` of the item: its length, and the text's position behind it."""
    back, ahead = min(p, o), min(len(text) - p, len(item) - o)
    miss = np.flatnonzero(text[p - back : p + ahead] != item[o - back : o + ahead])
    left, right = miss[miss < back], miss[miss >= back]
    first = int(left[-1]) + 1 if len(left) else 0
    last = int(right[0]) if len(right) else back + ahead
    return last - first, p - back + last


def _finder(shared, shingle: int, least: int):
    """``(doc_id, item, n_words)`` of texts ``(doc_id, text)`` by broadcast prefixes and items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams_of, starts, items, offsets, words = shared.value  # prefixes sorted by shingle, the first of each, item and offset of all
        for b in batches:
            doc, item, n = [], [], []
            for c in chunks(b.column(1).to_pylist()):
                at = _positions(grams_of, ngrams(c.hashes, shingle))
                hits = np.flatnonzero(at >= 0)
                if not len(hits):
                    continue
                owner = np.searchsorted(c.bounds, hits, side="right") - 1
                for k, mine in groupby(zip(owner.tolist(), hits.tolist()), lambda x: x[0]):
                    text = c.hashes[c.bounds[k] : c.bounds[k + 1]]
                    best: dict[int, int] = {}
                    done: dict[tuple[int, int], int] = {}  # (item, offset): behind the run compared last
                    for _, hit in mine:
                        p, g = hit - int(c.bounds[k]), int(at[hit])
                        if p + shingle > len(text):
                            continue
                        for i, o in zip(items[starts[g] : starts[g + 1]].tolist(), offsets[starts[g] : starts[g + 1]].tolist()):
                            if done.get((i, p - o), -1) > p or min(p, o) + min(len(text) - p, len(words[i]) - o) < least:
                                continue
                            run_, behind = _longest(text, words[i], p, o)
                            done[(i, p - o)] = behind
                            if run_ >= least:
                                best[i] = max(best.get(i, 0), run_)
                    doc += [c.lo + k] * len(best)
                    item += best.keys()
                    n += best.values()
            if doc:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), pa.array(item, pa.int64()), pa.array(n, pa.int32())], names=["doc_id", "item", "n_words"])

    return run


def _grams(shingle: int, least: int):
    """Distinct shingles of each text of at least ``least`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column(1).to_pylist()):
                grams, doc, got = ngrams(c.hashes, shingle), [], []
                for k in np.flatnonzero(np.diff(c.bounds) >= least):
                    mine = np.unique(grams[c.bounds[k] : c.bounds[k + 1] - shingle + 1])
                    got.append(mine)
                    doc.append(np.full(len(mine), c.lo + int(k)))
                if doc:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.concatenate(doc))), pa.array(np.concatenate(got).astype(np.int64))], names=["doc_id", "gram"])

    return run


def _verify(shingle: int, least: int):
    """``(doc_id, item, n_words)`` of pairs ``(doc_id, item, text, words, offsets)``, by the prefixes at the item's offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items, words, offsets = b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()
            rows, n = [], []
            for c in chunks(b.column(2).to_pylist()):
                grams = ngrams(c.hashes, shingle)
                for k in range(c.hi - c.lo):
                    row = c.lo + k
                    lo, hi = int(c.bounds[k]), int(c.bounds[k + 1])
                    text, item = c.hashes[lo:hi], np.frombuffer(words[row], U)
                    own, best = grams[lo : max(lo, hi - shingle + 1)], 0
                    of_item = ngrams(item, shingle)
                    for o in offsets[row]:
                        for p in np.flatnonzero(own == of_item[o]).tolist():
                            best = max(best, _longest(text, item, p, o)[0])
                    if best >= least:
                        rows.append(row)
                        n.append(best)
            if rows:
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(n, pa.int32())], names=["doc_id", "item", "n_words"])

    return run


def prefix_table(grams: DataFrame, counts: DataFrame, shingle: int, least: int) -> DataFrame:
    """``(gram, item, at)``: the rarest shingle of every window of ``least`` words, at each place where its item has it."""
    rare = grams.join(counts, "gram", "left").select("item", "at", "gram", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram").alias("rank"))
    ahead = Window.partitionBy("item").orderBy("at").rowsBetween(0, least - shingle)
    windows = rare.withColumn("best", F.min("rank").over(ahead)).withColumn("last", F.max("at").over(Window.partitionBy("item")))
    needed = windows.where(F.col("at") + (least - shingle) <= F.col("last")).select("item", F.col("best.gram").alias("gram")).distinct()
    return grams.join(needed, ["item", "gram"], "left_semi").select("gram", "item", "at")


def leaked_items(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "item_text", shingle: int = SHINGLE, least: int = LEAST, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """``(doc_id, item_id, n_words, item_words)``: the longest run of the item's words in the text, if ``least`` or more.

    Items or texts of fewer than ``least`` words, NULL ones included, match
    nothing. Rows with a NULL id are left out; ids may have any type. A text or
    item delivered twice counts once. Other columns are ignored; empty tables
    give an empty result. Items and prefixes of at most ``broadcast_bytes`` in
    all are broadcast; more of them are joined by shuffle, with the same result.
    """
    spark = docs.sparkSession
    corpus = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text")).where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    asked = asked.withColumn("item", F.xxhash64("item_id", "text")).distinct()

    shingles = materialise(asked.select("item", "text").mapInArrow(_shingler(shingle, least), "item long, at int, gram long, words binary"), "shingles", measure=True)
    grams, words = shingles.where(F.col("at") >= 0).select("item", "at", "gram"), shingles.where(F.col("at") < 0).select("item", "words")
    # what would be sent: 8 bytes a shingle and a word, and as much for prefixes
    small = written_rows(shingles) * 24 <= broadcast_bytes
    vocabulary = grams.select("gram").distinct()
    wanted = spark.sparkContext.broadcast(np.sort(vocabulary.toPandas()["gram"].to_numpy(np.int64).astype(U))) if small else None
    counts = corpus.select("text").mapInArrow(_counter(wanted, shingle), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    prefixes = materialise(prefix_table(grams, counts, shingle, least), "prefixes")
    if wanted is not None:
        wanted.destroy()

    kind = docs.schema[doc_id].dataType.simpleString()
    found_ddl = f"doc_id {kind}, item long, n_words int"
    if small:
        table = prefixes.toPandas()
        table["gram"] = table["gram"].to_numpy(np.int64).astype(U)
        table = table.sort_values(["gram", "item", "at"])
        grams_of, starts = np.unique(table["gram"].to_numpy(), return_index=True)
        by_item = {r["item"]: np.frombuffer(r["words"], U) for r in words.toLocalIterator()}
        shared = spark.sparkContext.broadcast((grams_of, np.append(starts, len(table)), table["item"].to_numpy(np.int64), table["at"].to_numpy(np.int32), by_item))
        found = corpus.mapInArrow(_finder(shared, shingle, least), found_ddl)
    else:
        met = corpus.mapInArrow(_grams(shingle, least), f"doc_id {kind}, gram long").join(prefixes, "gram").groupBy("doc_id", "item").agg(F.collect_set("at").alias("offsets"))
        met = materialise(met, "met")  # at most the prefixes of an item a row
        pairs = corpus.join(met, "doc_id").join(words, "item").select("doc_id", "item", "text", "words", "offsets")
        found = pairs.mapInArrow(_verify(shingle, least), found_ddl)
    sizes = shingles.where(F.col("at") < 0).select("item", F.col("gram").cast("int").alias("item_words"))
    named = asked.select("item", "item_id").join(sizes, "item")
    best = found.groupBy("doc_id", "item").agg(F.max("n_words").alias("n_words"))
    return best.join(F.broadcast(named) if small else named, "item").groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"), F.max("item_words").alias("item_words"))
