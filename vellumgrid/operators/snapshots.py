"""Changes between consecutive full snapshots of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumgrid.runtime import broadcast_if_small, materialise


def canonical_path(path: Column | str) -> Column:
    """Forward slashes, no leading ``./``; case is kept."""
    return F.regexp_replace(F.translate(F.col(path) if isinstance(path, str) else path, "\\", "/"), r"\A(?:\./+)+", "")


def snapshot_changes(
    snapshots: DataFrame,
    group: str = "project",
    index: str = "snapshot_no",
    key: Column | str = "path",
    digest: Column | str = "sha256",
    arrival: str = "ingested_at",
) -> DataFrame:
    """Rows ``(group, index, key, status)`` with status ``added``, ``removed`` or ``modified``.

    Each key's rows are put in order of the dense snapshot index; the lagged
    digest shows modifications, a gap in the index shows a removal (dated at
    the snapshot after the last sight) and a later addition. All of it needs one
    exchange on ``(group, key)``, so that no group, however large, is one task.

    * A snapshot that holds a key more than once counts its latest arrival
      (NULL arrivals count as earliest; ties take the greatest digest, one that is
      not hexadecimal before all others).
    * ``index`` values a group lacks are no snapshots; its first one gives no rows.
    * Rows whose group, index or key is NULL belong to no snapshot and are left out.
    * A NULL digest is a value of its own: NULL to NULL is no change.
    * Extra columns are ignored; an empty table gives an empty result.
    """
    key = F.col(key) if isinstance(key, str) else key
    digest = F.col(digest) if isinstance(digest, str) else digest
    rows = snapshots.select(
        F.col(group).alias("_g"),
        F.col(index).cast("long").alias("_n"),
        key.alias("_k"),
        # 32 bytes instead of 64 characters where the digest is hexadecimal
        F.coalesce(F.unhex(F.when(digest.rlike(r"\A(?:[0-9A-Fa-f]{2})+\z"), digest)), F.concat(F.lit(b"\xff"), F.encode(F.lower(digest), "UTF-8"))).alias("_d"),
        F.col(arrival).alias("_t"),
    ).where(F.col("_g").isNotNull() & F.col("_n").isNotNull() & F.col("_k").isNotNull())

    # one row per group with its sorted snapshot numbers: (groups x snapshots) numbers in all
    calendar = (
        snapshots.select(F.col(group).alias("_g"), F.col(index).cast("long").alias("_n"))
        .where(F.col("_g").isNotNull() & F.col("_n").isNotNull())
        .distinct()
        .groupBy("_g")
        .agg(F.array_sort(F.collect_list("_n")).alias("_all"))
    )
    seen = rows.join(broadcast_if_small(materialise(calendar, "calendar", measure=True)), "_g")

    by_key = Window.partitionBy("_g", "_k").orderBy("_n", F.col("_t").asc_nulls_first(), "_d")
    seen = seen.withColumn("_later", F.lead("_n").over(by_key)).where(~F.col("_later").eqNullSafe(F.col("_n")))
    seen = seen.withColumn("_i", F.array_position("_all", F.col("_n")).cast("int")).withColumn("_last", F.size("_all"))

    by_key = Window.partitionBy("_g", "_k").orderBy("_n")
    seen = (
        seen.withColumn("_before", F.lag("_i").over(by_key))
        .withColumn("_old", F.lag("_d").over(by_key))
        .withColumn("_after", F.lead("_i").over(by_key))
    )
    here = (
        F.when(F.col("_before").isNull(), F.when(F.col("_i") > 1, F.lit("added")))
        .when(F.col("_before") < F.col("_i") - 1, F.lit("added"))
        .when(~F.col("_old").eqNullSafe(F.col("_d")), F.lit("modified"))
    )
    gone = F.when((F.col("_i") < F.col("_last")) & (F.col("_after").isNull() | (F.col("_after") > F.col("_i") + 1)), F.lit("removed"))
    event = F.filter(
        F.array(
            F.struct(F.col("_n").alias("n"), here.alias("s")),
            F.struct(F.try_element_at("_all", F.col("_i") + 1).alias("n"), gone.alias("s")),
        ),
        lambda e: e["s"].isNotNull(),
    )
    return seen.select("_g", "_k", F.explode(event).alias("_e")).select(
        F.col("_g").alias(group),
        F.col("_e.n").cast(snapshots.schema[index].dataType).alias(index),
        F.col("_k").alias("path" if not isinstance(key, str) else key),
        F.col("_e.s").alias("status"),
    )
