"""The batch operators over documents that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from vellumgrid.operators import search


def documents(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of a folder as a stream, each file once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def matches(stream: DataFrame, text: str, query: str, *keep: str, mode: str = "all") -> DataFrame:
    """Search hits of arriving documents; stateless."""
    return search.search(stream, text, query, *keep, mode=mode)


def windowed_counts(stream: DataFrame, at: str, late: str, width: str, *keys: str) -> DataFrame:
    """Documents per key and window of their own time; a window closes when nothing later than ``late`` can come."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.count(F.lit(1)).alias("n_docs")).select(F.col("window.start").alias("start"), *keys, "n_docs")


def first_arrivals(stream: DataFrame, id: str, at: str, late: str) -> DataFrame:
    """Each id once; ids are remembered as long as a repeat may come."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([id])


def write_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to a folder, exactly once, taking what is there and then stopping."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
