"""Samples, sites and priors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankforge.functions.exprs import finite, haversine_km


def presence(df: DataFrame, keys: Sequence[str], reads: str, asvs: str, tags: str) -> DataFrame:
    """(keys, reads, asvs, n_rows, tags): sums and the sorted set of tags, which is as long as the tags' vocabulary."""
    return df.groupBy(*keys).agg(F.coalesce(F.sum(reads), F.lit(0)).alias("read_count"), F.coalesce(F.sum(asvs), F.lit(0)).alias("asv_count"), F.count(F.lit(1)).alias("n_rows"), F.array_join(F.array_sort(F.collect_set(tags)), ";").alias("tags"))


def wide_to_long(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, column, count) of the counts above 0 of a wide matrix."""
    return df.unpivot(list(keys), list(columns), "column", "count").where("count > 0")


def event_table(df: DataFrame, event: str, label: str, lat: str, lon: str, quantity: str) -> DataFrame:
    """Per event: number of labels, total quantity (what is not above 0 counts as 1), mean place of the finite coordinates."""
    q = F.when(F.col(quantity) > 0, F.col(quantity)).otherwise(1)
    return df.where(F.col(event).isNotNull()).groupBy(event).agg(F.countDistinct(label).alias("n_labels"), F.sum(q).alias("quantity"), F.avg(finite(lat)).alias("lat"), F.avg(finite(lon)).alias("lon"))


def prior_counts(df: DataFrame, site: str, label: str, quantity: str) -> DataFrame:
    """(site, label, occurrence_count): summed quantity; null sites and labels go."""
    return df.where(F.col(site).isNotNull() & F.col(label).isNotNull()).groupBy(site, label).agg(F.sum(F.coalesce(quantity, F.lit(0))).alias("occurrence_count"))


def bounding_boxes(df: DataFrame, group: str, lat: str, lon: str, pad: float) -> DataFrame:
    """(group, wkt) of the padded box round each group's points, clamped to the globe."""
    g = df.where(finite(lat).isNotNull() & finite(lon).isNotNull() & F.col(group).isNotNull()).groupBy(group)
    b = g.agg(F.greatest(F.min(lat) - pad, F.lit(-90.0)).alias("a"), F.least(F.max(lat) + pad, F.lit(90.0)).alias("b"), F.greatest(F.min(lon) - pad, F.lit(-180.0)).alias("c"), F.least(F.max(lon) + pad, F.lit(180.0)).alias("d"))
    return b.select(group, F.format_string("POLYGON((%.4f %.4f,%.4f %.4f,%.4f %.4f,%.4f %.4f,%.4f %.4f))", "c", "a", "d", "a", "d", "b", "c", "b", "c", "a").alias("wkt"))


def near_pairs(points: DataFrame, key: str, lat: str, lon: str, km: float) -> DataFrame:
    """(key_a, key_b, distance_km) of different points at most `km` apart.

    Points fall into cells of latitude bands `km` high; a band's cells are as wide as `km` at its pole side. A point meets its own
    cell and the eight round it (across the date line too) by an equi-join, instead of all points. Points without finite
    coordinates have no pair. Near a pole, where a band holds few cells, cells are merged.
    """
    step = max(km / 111.0, 1e-6)
    rows = F.floor((F.col("la") + 90) / step)
    width = lambda r: F.greatest(F.lit(1.0), F.floor(F.lit(360.0 / step) * F.greatest(F.lit(0.0), F.cos(F.radians(F.least(F.lit(90.0), F.greatest(F.abs(r * step - 90), F.abs((r + 1) * step - 90)) + step))))))
    p = points.select(F.col(key).alias("k"), finite(lat).alias("la"), finite(lon).alias("lo")).where("k is not null and la is not null and lo is not null").distinct()
    p = p.withColumn("r", rows)
    cell = lambda r: F.floor(F.pmod(F.col("lo") + 180, F.lit(360.0)) / 360 * width(r))
    a = p.withColumn("c", cell(F.col("r")).cast("long")).withColumn("cellrow", F.col("r").cast("long"))
    around = p.withColumn("cellrow", F.explode(F.array(*[F.col("r").cast("long") + d for d in (-1, 0, 1)])))
    n = width(F.col("cellrow").cast("double")).cast("long")
    base = F.floor(F.pmod(F.col("lo") + 180, F.lit(360.0)) / 360 * n).cast("long")
    b = around.withColumn("c", F.explode(F.array_distinct(F.array(*[F.pmod(base + d, n) for d in (-1, 0, 1)]))))
    j = a.select(F.col("k").alias("key_a"), F.col("la").alias("la1"), F.col("lo").alias("lo1"), "cellrow", "c").join(
        b.select(F.col("k").alias("key_b"), F.col("la").alias("la2"), F.col("lo").alias("lo2"), "cellrow", "c"), ["cellrow", "c"]
    )
    d = haversine_km("la1", "lo1", "la2", "lo2")
    return j.where(F.col("key_a") < F.col("key_b")).withColumn("distance_km", d).where(F.col("distance_km") <= km).groupBy("key_a", "key_b").agg(F.min("distance_km").alias("distance_km"))


def shared_support(top: DataFrame, sample: str, query: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """(*by, sample, query, label, support): how many other queries of the sample have the label among their candidates.

    Counts per sample and label less the query's own; no pair of queries is formed.
    """
    own = top.where(F.col(label).isNotNull()).select(*by, sample, query, label).distinct()
    n = own.groupBy(*by, sample, label).agg(F.count(F.lit(1)).alias("n"))
    return own.join(n, [*by, sample, label]).select(*by, sample, query, label, (F.col("n") - 1).alias("support"))


def prior_ranking(priors: DataFrame, site: str, label: str, count: str, k: int) -> DataFrame:
    """The k labels of each site by count, ties by label."""
    w = Window.partitionBy(site).orderBy(F.desc(count), F.asc(label))
    return priors.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select(site, F.col("place").cast("long").alias("place"), label, count)


def reference_overlap(labels: DataFrame, label: str, reference: DataFrame, ref_label: str, flag: str) -> DataFrame:
    """(n_labels, n_listed, n_with_reference) of the distinct labels against a reference list."""
    x = labels.where(F.col(label).isNotNull()).select(F.col(label).alias("l")).distinct()
    r = reference.select(F.col(ref_label).alias("l"), F.coalesce(flag, F.lit(False)).alias("f")).where("l is not null").groupBy("l").agg(F.max("f").alias("f"))
    j = x.join(r, "l", "left")
    return j.agg(F.count(F.lit(1)).alias("n_labels"), F.count("f").alias("n_listed"), F.count(F.when(F.col("f"), 1)).alias("n_with_reference"))
