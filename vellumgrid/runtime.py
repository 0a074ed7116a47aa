"""Session defaults and the few places where a plan has to touch the cluster itself."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its measured size is below this many bytes.
BROADCAST_BYTES = 16 << 20

_written: list[tuple[SparkSession, str]] = []


def session(app: str = "vellumgrid", cpus: str | int = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own settings."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the standard Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only where the cluster names none and the master is local (tests, single
    machine) is a folder of this process used instead.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="vellumgrid-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext.getCheckpointDir() or path


def materialise(df: DataFrame, label: str = "stage", measure: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.

    The files outlive lost executors and are compressed, unlike RDD
    checkpoints. They are deleted by :func:`release` or at exit. ``measure``
    counts rows and bytes while writing, for :func:`broadcast_if_small` and
    :func:`written_rows`, so that no job of its own is needed for that.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
    seen = Observation() if measure else None
    out = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(_width(df)).alias("bytes")) if seen is not None else df
    out.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    back = spark.read.schema(df.schema).parquet(path)
    if seen is not None:
        got = seen.get
        back._measured = (int(got.get("rows") or 0), int(got.get("bytes") or 0))
    return back


def written_rows(df: DataFrame) -> int:
    """The number of rows of a measured table, or a count."""
    known = df.__dict__.get("_measured")
    return known[0] if known else df.count()


def release() -> None:
    """Delete everything :func:`materialise` has written."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may be gone at exit
            shutil.rmtree(path.removeprefix("file:"), ignore_errors=True)


atexit.register(release)


def _width(df: DataFrame) -> Column:
    """Upper estimate of a row's size in memory."""
    width = sum(
        (F.coalesce(F.octet_length(F.to_json(F.struct(name))), F.lit(0)) if kind.startswith(("array", "map", "struct"))
         else F.coalesce(F.octet_length(F.col(name)), F.lit(0)) if kind in ("string", "binary")
         else F.lit(8)) + F.lit(16)
        for name, kind in df.dtypes
    )
    return width.cast("long")


def measured_bytes(df: DataFrame) -> int:
    """Upper estimate of the in-memory size of ``df``: as measured when it was written, else by one aggregate."""
    known = df.__dict__.get("_measured")
    return known[1] if known else int(df.agg(F.sum(_width(df)).alias("b")).first().b or 0)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast when its measured size is below ``limit``; else leave the choice to Spark.

    ``df`` should be cheap to evaluate twice (materialise it first otherwise).
    """
    return F.broadcast(df) if measured_bytes(df) <= limit else df
