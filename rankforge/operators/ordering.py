"""Running sums and places over whole tables, without one task that sees them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankforge.runtime import keep, shuffle_partitions
from rankforge.sources.formats import record_numbers


def running_sums(df: DataFrame, group: Sequence[str], order: str, sums: Sequence[str], descending: bool = False) -> DataFrame:
    """`df` with run_<c> for each column of sums: its sum over the group's rows up to and with the row.

    `order` must be unique in a group. Rows are range-partitioned by group and order, so a group of any size is spread over many
    tasks; within a partition a window sums, and the sums of the partitions before, one row each, are added.
    """
    n = shuffle_partitions(df.sparkSession)
    o = F.desc(order) if descending else F.asc(order)
    r = keep(df.repartitionByRange(n, *group, o).withColumn("__pid", F.spark_partition_id()))
    w = Window.partitionBy(*group, "__pid").orderBy(o).rowsBetween(Window.unboundedPreceding, 0)
    local = r.select("*", *[F.sum(c).over(w).alias(f"__l_{c}") for c in sums])
    before = Window.partitionBy(*group).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    total = r.groupBy(*group, "__pid").agg(*[F.sum(c).alias(f"__t_{c}") for c in sums])
    base = total.select(*[F.col(g).alias(f"__g_{g}") for g in group], F.col("__pid").alias("__p"), *[F.coalesce(F.sum(f"__t_{c}").over(before), F.lit(0)).alias(f"__b_{c}") for c in sums])
    on = F.col("__pid") == F.col("__p")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    return local.join(base, on).select(*df.columns, *[(F.col(f"__l_{c}") + F.col(f"__b_{c}")).alias(f"run_{c}") for c in sums])


def global_places(df: DataFrame, order: Sequence[Column | str], name: str = "place") -> DataFrame:
    """Rows numbered from 1 in the order given, by a range sort and the counts of its partitions."""
    return record_numbers(keep(df.orderBy(*order)), name)
