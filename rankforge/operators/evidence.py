"""Evidence beyond the scores: support of sources, identities, coverage of lineages, novelty, gaps, gates, locks and packs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankforge.functions.exprs import finite, genus_of_label
from rankforge.operators.candidates import fit_thresholds, ranked
from rankforge.runtime import keep


def union_support(a: DataFrame, b: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    """(keys, a, b, either): a's keys with the flags of two sources; a source without the key does not support it."""
    j = a.select(*keys, F.coalesce(flag, F.lit(False)).alias("a")).join(b.select(*keys, F.coalesce(flag, F.lit(False)).alias("b")), list(keys), "left")
    j = j.withColumn("b", F.coalesce("b", F.lit(False)))
    return j.withColumn("either", F.col("a") | F.col("b"))


def identity_features(rows: DataFrame, key: str, label: str, identity: str, levels: Sequence[float], at: float) -> DataFrame:
    """(key, n_levels, max_level, share): identity levels at which the key has a label, the highest such level, 0 where there is none, and the
    share of its labels that reach `at`."""
    one = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key, label).agg(F.max(finite(identity)).alias("v"))
    best = one.groupBy(key).agg(F.max("v").alias("v"), F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("v") >= at, 1)).alias("m"))
    met = F.filter(F.array(*[F.lit(float(x)) for x in sorted(levels)]), lambda x: x <= F.col("v"))
    return best.withColumn("met", F.coalesce(met, F.array().cast("array<double>"))).select(key, F.size("met").cast("long").alias("n_levels"), F.coalesce(F.array_max("met"), F.lit(0.0)).alias("max_level"), (F.col("m") / F.col("n")).alias("share"))


def lineage_coverage(listed: DataFrame, levels: dict[str, str], flag: str) -> DataFrame:
    """(rank, taxon, n_labels, coverage): share of the labels below each taxon that have a reference, at all ranks in one pass."""
    long = listed.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rank"), F.col(c).alias("taxon")) for r, c in levels.items()])).alias("x"), F.coalesce(flag, F.lit(False)).alias("f"))
    return long.select("x.*", "f").where("taxon is not null").groupBy("rank", "taxon").agg(F.count(F.lit(1)).alias("n_labels"), F.avg(F.col("f").cast("int")).alias("coverage"))


def novelty_features(top: DataFrame, keys: Sequence[str], score: str, genus: str, k: int) -> DataFrame:
    """(keys, top_score, margin, modal_share, mean_top, n) over candidates that have a reference: the lead over the second (0 for a single one), the
    share of the most frequent genus, the mean of the first k."""
    r = ranked(top.select(*keys, "place", F.col(score).alias("__s"), F.col(genus).alias("__g")), keys, [F.asc("place")], name="__r")
    first, second, among = F.col("__r") == 1, F.col("__r") == 2, F.col("__r") <= k
    per = r.groupBy(*keys, "__g").agg(F.count(F.lit(1)).alias("__c"), F.max(F.when(first, F.col("__s"))).alias("__s1"), F.max(F.when(second, F.col("__s"))).alias("__s2"), F.sum(F.when(among, F.col("__s"))).alias("__t"), F.count(F.when(among, 1)).alias("__m"))
    most = F.max(F.when(F.col("__g").isNotNull(), F.col("__c")))
    out = per.groupBy(*keys).agg(F.max("__s1").alias("top_score"), F.max("__s2").alias("__s2"), most.alias("__mode"), F.sum("__c").alias("n"), (F.sum("__t") / F.sum("__m")).alias("mean_top"))
    return out.select(*keys, "top_score", F.coalesce(F.col("top_score") - F.col("__s2"), F.lit(0.0)).alias("margin"), (F.coalesce("__mode", F.lit(0)) / F.col("n")).alias("modal_share"), "mean_top", "n")


def gap_targets(top: DataFrame, keys: Sequence[str], label: str, truth: str, references: DataFrame, ref: str) -> DataFrame:
    """(keys, truth_listed, truth_among): whether a key's truth has a reference, and whether it is among the candidates."""
    per = top.groupBy(*keys, truth).agg(F.max((F.col(label) == F.col(truth)).cast("int")).alias("m"))
    r = references.select(F.col(ref).alias("__r")).where("__r is not null").distinct()
    j = per.join(r, F.col(truth) == F.col("__r"), "left")
    return j.select(*keys, F.col("__r").isNotNull().alias("truth_listed"), (F.coalesce("m", F.lit(0)) == 1).alias("truth_among"))


def gap_overlay(calls: DataFrame, group: Sequence[str], gap: Column, limit: float) -> DataFrame:
    """(group, n_called, n_warned, n_wrong, n_wrong_warned): calls whose estimate of a missing reference is `limit` or more are warned of."""
    c = calls.where(F.col("assigned_rank") != "no_call").withColumn("__w", F.coalesce(gap >= limit, F.lit(False)))
    wrong = F.col("right") == F.lit(False)
    return c.groupBy(*group).agg(F.count(F.lit(1)).alias("n_called"), F.count(F.when(F.col("__w"), 1)).alias("n_warned"), F.count(F.when(wrong, 1)).alias("n_wrong"), F.count(F.when(wrong & F.col("__w"), 1)).alias("n_wrong_warned"))


def gate_grid(fit: DataFrame, group: Sequence[str], features: Sequence[str], quantiles: Sequence[float]) -> DataFrame:
    """(group, feature, quantile, gate): quantiles of the distinct values of each feature; a feature without values has no gates."""
    one = fit.select(*group, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), finite(f).alias("v")) for f in features])).alias("x")).select(*group, "x.*").where("v is not null").distinct()
    q = F.percentile("v", F.array(*[F.lit(float(x)) for x in quantiles]))
    p = one.groupBy(*group, "feature").agg(q.alias("q"))
    return p.select(*group, "feature", F.posexplode("q").alias("i", "gate")).select(*group, "feature", F.element_at(F.array(*[F.lit(float(x)) for x in quantiles]), F.col("i") + 1).alias("quantile"), "gate")


def gate_counts(rows: DataFrame, group: Sequence[str], gates: DataFrame, features: Sequence[str], correct: str) -> DataFrame:
    """`gates` with n_accepted and n_correct of the rows whose feature is at the gate or above; a missing value passes none.

    Rows are first counted by value; gates are few (features by quantiles), so each value meets a group's gates only.
    """
    one = rows.where(F.col(correct).isNotNull()).select(*group, correct, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), finite(f).alias("v")) for f in features])).alias("x")).select(*group, correct, "x.*").where("v is not null")
    c = one.groupBy(*group, "feature", "v").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(correct).cast("int")).alias("k"))
    hit = F.col("v") >= F.col("gate")
    j = gates.join(c, [*group, "feature"], "left")
    return j.groupBy(*group, "feature", "quantile", "gate").agg(F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_accepted"), F.coalesce(F.sum(F.when(hit, F.col("k"))), F.lit(0)).alias("n_correct"))


def best_gate(counts: DataFrame, group: Sequence[str], target: float) -> DataFrame:
    """The gate of most accepted rows whose precision meets the target; ties to the lower quantile, then the smaller feature. None met: no row."""
    ok = counts.where((F.col("n_accepted") > 0) & (F.col("n_correct") >= target * F.col("n_accepted")))
    return ranked(ok, group, [F.desc("n_accepted"), F.asc("quantile"), F.asc("feature")], 1, "__r").drop("__r")


def locked_thresholds(repeats: DataFrame, repeat: str, source: str, confidence: str, correct: str, target: float) -> DataFrame:
    """(source, lock): the greatest of the thresholds fitted in the repeats over all sources, or over the source's own rows, whichever is greater."""
    every = fit_thresholds(repeats, [repeat], confidence, correct, [target]).agg(F.max("threshold")).first()[0]
    own = fit_thresholds(repeats, [repeat, source], confidence, correct, [target]).groupBy(source).agg(F.max("threshold").alias("own"))
    return own.select(source, F.greatest("own", F.lit(every).cast("double")).alias("lock"))


def stable_choice(repeats: DataFrame, group: Sequence[str], strategy: str, met: str, size: str) -> DataFrame:
    """(group, strategy, share_met, mean_size): strategies that meet their target in every repeat come first, then those in more, then the smaller."""
    s = repeats.groupBy(*group, strategy).agg(F.avg(F.col(met).cast("int")).alias("share_met"), F.avg(size).alias("mean_size"))
    return ranked(s, group, [F.desc("share_met"), F.asc("mean_size"), F.asc(strategy)], 1, "__r").drop("__r")


def support_rerank(top: DataFrame, support: DataFrame, keys: Sequence[str], label: str, score: str, weight: float) -> DataFrame:
    """`top` with support, combined (the score plus weight times the log of 1 + support) and new_place; weight None ranks by support alone."""
    j = top.join(support, [*keys, label], "left").withColumn("support", F.coalesce("support", F.lit(0)))
    value = F.col("support").cast("double") if weight is None else F.col(score) + weight * F.log1p("support")
    return ranked(j.withColumn("combined", value), keys, [F.desc(F.round("combined", 9)), F.asc(label)], name="new_place")


def label_taxonomy(records: DataFrame, listed: DataFrame, label: str, columns: dict[str, str]) -> DataFrame:
    """(label, columns): per label the most frequent value of its records, ties to the smaller; else the list's; the genus at last from the label.

    `columns` names the record's column and the list's of the same meaning; the first is the genus.
    """
    out = listed.select(F.col("tree_label").alias(label), *[F.col(b).alias(f"__l_{a}") for a, b in columns.items()]).where(F.col(label).isNotNull()).groupBy(label).agg(*[F.min(f"__l_{a}").alias(f"__l_{a}") for a in columns])
    for a in columns:
        c = records.where(F.col(label).isNotNull() & F.col(a).isNotNull()).groupBy(label, a).agg(F.count(F.lit(1)).alias("n"))
        best = c.groupBy(label).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(a).alias("v"))).alias("x")).select(label, F.col("x.v").alias(f"__m_{a}"))
        out = out.join(best, label, "left")
    first = next(iter(columns))
    return out.select(label, *[F.coalesce(f"__m_{a}", f"__l_{a}", *([genus_of_label(label)] if a == first else [])).alias(a) for a in columns])


def split_modes(df: DataFrame, key: str, group: str, named: DataFrame, share: float, salt: str, draw) -> DataFrame:
    """(key, by_list, by_group, by_row): whether a record is held out when its group is on a list, when its group is drawn, when itself is drawn."""
    n = named.select(F.col(named.columns[0]).alias("__g")).where("__g is not null").distinct()
    j = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(group).alias(group)).join(n, F.col(group) == F.col("__g"), "left")
    return j.select(key, F.col("__g").isNotNull().alias("by_list"), F.coalesce(draw(group, salt) < share, F.lit(False)).alias("by_group"), (draw(key, salt) < share).alias("by_row"))


def cluster_labels(reads: DataFrame, key: str, clusters: DataFrame, cluster: str) -> DataFrame:
    """`reads` with their cluster, "-1" for reads in none."""
    return reads.join(clusters.select(key, F.col(cluster).cast("string").alias(cluster)), key, "left").withColumn(cluster, F.coalesce(cluster, F.lit("-1")))


def saved_statistics(fit: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, mean, std) of finite values, to be kept with a model."""
    row = fit.agg(F.array(*[F.struct(F.lit(c).alias("feature"), F.avg(finite(c)).alias("mean"), F.stddev_pop(finite(c)).alias("std")) for c in columns]).alias("a"))
    return row.select(F.explode("a").alias("x")).select("x.*")


def standardised_by(df: DataFrame, stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`df` with z_<column> by saved statistics, one row a column; a missing value has the mean's place, 0, and a column without spread is 0."""
    saved = {r["feature"]: (r["mean"], r["std"]) for r in stats.where(F.col("feature").isin(*columns)).collect()}
    out = df
    for c in columns:
        m, s = saved.get(c, (None, None))
        out = out.withColumn(f"z_{c}", F.coalesce((finite(c) - F.lit(m)) / F.nullif(F.lit(s), F.lit(0.0)), F.lit(0.0)))
    return out


def pruned(closure: DataFrame, tips: DataFrame, tip: str) -> DataFrame:
    """(ancestor, n_tips, n_children) of the tree of the tips given: nodes left with a single child are taken out, but for tips and the root."""
    kept = keep(closure.join(tips.select(F.col(tip).alias("tip")).distinct(), "tip", "left_semi"))
    child = kept.select("tip", F.col("ancestor").alias("child"), (F.col("hops") + 1).alias("hops"))
    top = kept.groupBy("tip").agg(F.max("hops").alias("m"))
    j = kept.join(top, "tip").join(child, ["tip", "hops"], "left")
    g = j.groupBy("ancestor").agg(F.countDistinct("tip").alias("n_tips"), F.countDistinct("child").alias("n_children"), F.min("hops").alias("h"), F.max(F.col("hops") == F.col("m")).alias("is_root"))
    return g.where("n_children >= 2 or h = 0 or is_root").select("ancestor", "n_tips", "n_children")


def placement_summary(placed: DataFrame, group: Sequence[str], distance: str, excess: str) -> DataFrame:
    """(group, n, n_placed, median_distance, median_excess, share_nearest): of placements by their distance to the truth and what it exceeds the nearest
    reference's by."""
    return placed.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.count(distance).alias("n_placed"), F.percentile(distance, 0.5).alias("median_distance"), F.percentile(excess, 0.5).alias("median_excess"), F.avg((F.col(excess) <= 0).cast("int")).alias("share_nearest"))


