"""The best N items of every group by descending score bands (p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankforge.runtime import cut, keep


def top_per_group(
    rows: DataFrame,
    group: str,
    item: str,
    score: str,
    tie: str,
    n: int,
    rows_a_band: float = 4.0,
) -> DataFrame:
    """(group, place, item): the n best items of each group, places 1 to n.

    Order: score descending, `tie` ascending with null last, item ascending by code points. An item counts once, at its first
    row. Rows with null or NaN score, null group or null item do not count; NaN in `tie` sorts after numbers and before null.
    Groups with fewer items keep what they have; an empty input gives no rows.

    Rows are dealt to bands of the score range, cut at approximate quantiles of the raw scores, each of about rows_a_band x n rows a
    group on average. Bands are taken from the top: rows of groups that have n items already are left out before anything is moved, and an
    item met again in a lower band has its place from the higher one. In a band an item's rows are combined on the map side, spread by group
    and item, so that a group with a third of all rows is many small pieces, and the n best are kept on both sides of the shuffle.
    """
    s, t = F.col(score).cast("double"), F.col(tie).cast("double")
    valid = rows.where(s.isNotNull() & ~F.isnan(s) & F.col(group).isNotNull() & F.col(item).isNotNull())
    valid = valid.select(F.col(group).alias("g"), F.col(item).alias("i"), (-s).alias("down"), t.isNull().alias("void"), t.alias("tie"))
    told = valid.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("g").alias("g"), F.percentile_approx("down", F.array(*[F.lit(x / 64) for x in range(1, 64)]), F.lit(1000)).alias("e")).first()
    width = min(1.0, rows_a_band * n * max(1, told["g"]) / max(1, told["n"]))
    edges, at = [], width
    while at < 1.0 and told["e"]:
        edges.append(told["e"][min(62, max(0, round(at * 64) - 1))])
        at += max(width, at)  # each band is as wide as all before it
    edges = sorted(set(edges))
    kept, filled = None, None
    for low, high in zip([None, *edges], [*edges, None]):
        band = valid
        if low is not None:
            band = band.where(F.col("down") > F.lit(low))
        if high is not None:
            band = band.where(F.col("down") <= F.lit(high))
        if filled is not None:
            band = band.join(filled, "g", "left_anti")
        best = band.groupBy("g", "i").agg(F.min(F.struct("down", "void", "tie")).alias("k")).select("g", "i", "k.down", "k.void", "k.tie")
        best = _ranked(best, n)
        if kept is not None:
            # of an item met above only the first row counts; the n best of both are the group's n best so far
            both = kept.unionByName(best).groupBy("g", "i").agg(F.min(F.struct("down", "void", "tie")).alias("k")).select("g", "i", "k.down", "k.void", "k.tie")
            best = _ranked(both, n)
        kept = best
        if high is not None:
            kept = cut(kept)
            filled = keep(kept.groupBy("g").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= n).select("g"))
    w = Window.partitionBy("g").orderBy("down", "void", "tie", "i")
    out = kept.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
    return out.select(F.col("g").alias(group), F.col("place").cast("int").alias("place"), F.col("i").alias(item))


def _ranked(band: DataFrame, n: int) -> DataFrame:
    """The n best of each group in a band; the limit is applied on both sides of the shuffle."""
    w = Window.partitionBy("g").orderBy("down", "void", "tie", "i")
    return band.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")
