"""Filling containers of fixed capacity: the sum-of-squares heuristic, run in independent shards.

An item of size ``s`` goes to the open container, or a new one, for which the
sum over all gaps ``g`` of (open containers with gap ``g``)**2 becomes smallest.
Placing it in a gap ``g`` changes that sum by ``2 (N[g - s] - N[g] + 1)``, so the
state of a shard is one counter per gap and a list of containers per gap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITY = 4096
#: Items of one shard; each shard leaves a few containers partly filled, so larger shards waste less.
SHARD_ITEMS = 50_000


def byte_tokens(text: Column | str) -> Column:
    """Tokens of the byte-level tokenizer: one per UTF-8 byte and an end token; NULL has none."""
    return F.octet_length(text).cast("long") + 1


class Packer:
    """Sum-of-squares packing of a sequence of sizes, none above the capacity."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.n = np.zeros(capacity + 1, np.int64)  # open containers by gap; full ones (gap 0) don't count
        self.by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.containers = 0

    def place(self, size: int) -> int:
        c, n = self.capacity, self.n
        # gaps size..c-1 of open containers; a fresh one has gap c
        gaps = np.flatnonzero(n[size:c]) + size
        fresh = 2 * n[c - size] + 1 if size < c else 0
        best, gap = fresh, c
        if len(gaps):
            after = n[gaps - size].copy()
            delta = 2 * (after - n[gaps] + 1)
            if gaps[0] == size:  # the container becomes full and leaves the sum
                delta[0] = 1 - 2 * n[size]
            k = int(np.argmin(delta))  # ties: the smallest gap
            if delta[k] <= best:
                best, gap = delta[k], int(gaps[k])
        if gap == c:
            container = self.containers
            self.containers += 1
        else:
            container = self.by_gap[gap].pop()
            n[gap] -= 1
        if gap > size:
            n[gap - size] += 1
            self.by_gap[gap - size].append(container)
        return container


def _pack(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # large items first: the rest fills their gaps
        pdf = pdf.sort_values(["size", "id", "piece"], ascending=[False, True, True], kind="stable")
        packer = Packer(capacity)
        pdf["bin"] = [packer.place(int(s)) for s in pdf["size"]]
        return pdf

    return run


def pack(df: DataFrame, id: str, size: Column, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """One row per placed piece: ``(id, piece, n_pieces, size, shard, bin)``.

    ``(shard, bin)`` names the container. An item above the capacity, and no
    other, is divided: into full containers' worth and a rest (``n_pieces`` > 1).
    Items are spread over shards by a hash of their id, so no source or group
    shapes a shard; the number of shards follows the number of items. Rows whose
    id (of any type) is NULL or whose size is NULL or not positive are left out; a row delivered
    twice is placed once (if its sizes differ, the largest). An empty table gives
    an empty result.
    """
    items = df.select(F.col(id).alias("id"), size.cast("long").alias("size")).where(F.col("id").isNotNull() & (F.col("size") > 0))
    shards = max(1, -(-df.count() // shard_items))
    whole = items.groupBy("id").agg(F.max("size").alias("size"))
    pieces = whole.select(
        "id", F.ceil(F.col("size") / capacity).cast("int").alias("n_pieces"), F.posexplode(F.expr(f"transform(sequence(0L, (size - 1) div {capacity}L), i -> least({capacity}L, size - i * {capacity}L))")).alias("piece", "size")
    )
    placed = pieces.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    return placed.groupBy("shard").applyInPandas(_pack(capacity), f"id {df.schema[id].dataType.simpleString()}, n_pieces int, piece int, size long, shard int, bin int").select("id", "piece", "n_pieces", "size", "shard", "bin")


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, the least number any packing needs, tokens, and the share of unused room."""
    bins = packed.groupBy("shard", "bin").agg(F.sum("size").alias("used"))
    return bins.agg(
        F.count(F.lit(1)).alias("n_containers"),
        F.ceil(F.sum("used") / capacity).alias("least_containers"),
        F.sum("used").alias("n_tokens"),
        F.max("used").alias("fullest"),
        (1 - F.sum("used") / (F.count(F.lit(1)) * capacity)).alias("unused_share"),
    )
