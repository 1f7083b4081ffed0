"""Rank values of labels with their fall-backs, hits and agreement at four ranks, and the fitted rank policy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.functions.exprs import RANKS, clean_taxon, deepest, finite, genus_of_label, meets
from rankforge.operators.candidates import fit_thresholds
from rankforge.runtime import bounded, keep

#: What decides at each rank: the lead over place 2 for species, the share of the best ten that agree with place 1 above.
FEATURES = {"species": "relative_margin", "genus": "genus_consensus", "family": "family_consensus", "order": "order_consensus"}


def lineages(listed: DataFrame) -> DataFrame:
    """(label, genus, family, order) of each listed label, blanks null; of a label listed twice the smallest values."""
    x = listed.where("tree_label is not null").select(F.col("tree_label").alias("label"), *[clean_taxon(f"{r}_name").alias(r) for r in RANKS[1:]])
    return x.groupBy("label").agg(*[F.min(r).alias(r) for r in RANKS[1:]])


def with_rank_values(df: DataFrame, label: str, lineage: DataFrame, prefix: str) -> DataFrame:
    """`df` with <prefix>_species, _genus, _family and _order of a label. The species is the label; an unlisted label, or one without a genus,
    has the genus it begins with; family and order are null where the list has none."""
    names = lineage.toDF("__label", *[f"__{r}" for r in RANKS[1:]])
    j = df.join(names, F.col(label) == F.col("__label"), "left")
    j = j.withColumns({f"{prefix}_species": F.col(label), f"{prefix}_genus": F.coalesce("__genus", genus_of_label(label)), f"{prefix}_family": F.col("__family"), f"{prefix}_order": F.col("__order")})
    return j.drop("__label", *[f"__{r}" for r in RANKS[1:]])


def rank_hits(top: DataFrame, keys: Sequence[str], group: Sequence[str], ks: Sequence[int]) -> DataFrame:
    """(group, rank, k, n_queries, hit_rate): share of the queries with candidates whose first k hold the true value of a rank.

    `top` has place and value_<rank>, truth_<rank>. A query whose truth has no value at a rank is never hit there, yet counts.
    """
    first = [F.min(F.when(F.col(f"value_{r}") == F.col(f"truth_{r}"), F.col("place"))).alias(r) for r in RANKS]
    per = top.groupBy(*keys).agg(*first)
    long = per.select(*group, F.explode(F.array(*[F.struct(F.lit(r).alias("rank"), F.col(r).alias("h")) for r in RANKS])).alias("x")).select(*group, "x.rank", "x.h")
    grid = long.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    return grid.groupBy(*group, "rank", "k").agg(F.count(F.lit(1)).alias("n_queries"), F.avg((F.coalesce("h", F.lit(1 << 30)) <= F.col("k")).cast("int")).alias("hit_rate"))


def rank_features(top: DataFrame, keys: Sequence[str], score: str, carry: Sequence[str] = (), best: int = 10) -> DataFrame:
    """One row per key: top_score, relative_margin, and per rank first_<r>, <r>_consensus and right_<r>, all of the best ten in one aggregation.

    Consensus is the share of the known values that equal place 1's, null where that has none. right is null where the truth has no value.
    """
    values = [F.col(f"value_{r}").alias(r) for r in RANKS]
    c = F.array_sort(F.collect_list(F.struct("place", F.col(score).alias("s"), *values)))
    g = top.where(F.col("place") <= best).groupBy(*keys).agg(c.alias("c"), *[F.min(f"truth_{r}").alias(f"truth_{r}") for r in RANKS], *[F.min(x).alias(x) for x in carry])
    s1, s2 = F.get("c", F.lit(0))["s"], F.get("c", F.lit(1))["s"]
    out = {"top_score": s1, "relative_margin": (s1 - s2) / F.nullif(F.abs(s1), F.lit(0.0))}
    for r in RANKS:
        lead = F.get("c", F.lit(0))[r]
        known = F.filter("c", lambda x: x[r].isNotNull())
        out[f"first_{r}"] = lead
        out[f"{r}_consensus"] = F.when(lead.isNotNull(), F.size(F.filter(known, lambda x: x[r] == lead)) / F.size(known))
        out[f"right_{r}"] = F.when(F.col(f"truth_{r}").isNotNull(), F.coalesce(lead == F.col(f"truth_{r}"), F.lit(False)))
    return g.withColumns(out).drop("c")


def fitted_policy(features: DataFrame, group: Sequence[str], targets: Sequence[float]) -> DataFrame:
    """(group, target_precision, rank, threshold, n_accepted, n_correct) of each rank's feature, over rows whose truth is known at the rank."""
    one = [F.struct(F.lit(r).alias("rank"), finite(f).alias("feature"), F.col(f"right_{r}").alias("right")) for r, f in FEATURES.items()]
    long = features.select(*group, F.explode(F.array(*one)).alias("x")).select(*group, "x.*").where("right is not null")
    return fit_thresholds(long, [*group, "rank"], "feature", "right", targets)


def applied_policy(features: DataFrame, fitted: DataFrame, group: Sequence[str]) -> DataFrame:
    """`features` once per target_precision with assigned_rank, the deepest rank whose feature meets its threshold, and whether that call is right.

    A rank without a threshold is never assigned; groups without thresholds have no rows. `right` is null for no_call and unknown truths.
    """
    wide = keep(fitted.groupBy(*group, "target_precision").pivot("rank", list(RANKS)).agg(F.first("threshold")).toDF(*group, "target_precision", *[f"__{r}" for r in RANKS]))
    x = features.join(bounded(wide.withColumn("__w", F.concat_ws("", *group)), "__w")(wide), list(group))
    x = x.withColumn("assigned_rank", deepest({r: meets(f, F.col(f"__{r}")) for r, f in FEATURES.items()}))
    right = F.lit(None).cast("boolean")
    for r in RANKS:
        right = F.when(F.col("assigned_rank") == r, F.col(f"right_{r}")).otherwise(right)
    return x.withColumn("right", right).drop(*[f"__{r}" for r in RANKS])
