"""An extension: row checks and event counts over streams. Batch inputs give the same rows as their stream read to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.expressions import holds, names_of


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """A parquet folder or file as a stream with the schema it has now."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 16)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    status = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place)
    if status.isDirectory():
        return reader.parquet(path)
    # a stream watches folders: this one for a single file
    return reader.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())


def violations(rows: DataFrame, constraint: str) -> DataFrame:
    """Rows of a batch or stream for which the constraint is not true; stateless, so it runs in append mode."""
    return rows.where(~holds(constraint, names_of(rows)))


def windowed_counts(rows: DataFrame, ts: str, size: str, late: str, *keys: str) -> DataFrame:
    """Counts by event-time window and keys; state is bounded by the watermark."""
    watched = rows.withWatermark(ts, late) if rows.isStreaming else rows
    return watched.groupBy(F.window(ts, size).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(rows: DataFrame, ts: str, gap: str, late: str, key: str) -> DataFrame:
    watched = rows.withWatermark(ts, late) if rows.isStreaming else rows
    return watched.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
