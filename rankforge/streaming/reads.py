"""Streams of candidate scores and observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.functions.exprs import finite
from rankforge.runtime import bounded


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """A stream of the parquet files of a folder, with the schema they have."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def accepted(stream: DataFrame, thresholds: DataFrame, score: str, key: str = "method") -> DataFrame:
    """Rows whose score meets the threshold of their key: a stateless join of the stream with a small fixed table."""
    small = thresholds.select(key, "threshold")
    return stream.join(bounded(small.withColumn("__w", F.col(key).cast("string")), "__w")(small), key).where(finite(score) >= F.col("threshold")).drop("threshold")


def site_counts(stream: DataFrame, at: str = "sampled_at", late: str = "30 days", window: str = "90 days") -> DataFrame:
    """(window, site20, true_tree_label, reads) by event time; rows later than the watermark do not count."""
    w = F.window(at, window)
    return stream.where("site20 is not null").withWatermark(at, late).groupBy(w.alias("w"), "site20", "true_tree_label").agg(F.sum("read_count").alias("reads")).select(F.col("w.start").alias("window_start"), "site20", "true_tree_label", "reads")


def distinct_reads(stream: DataFrame, keys: list[str], at: str = "loaded_at", late: str = "30 days") -> DataFrame:
    """The first row of each key within the watermark; state of older keys is let go."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)
