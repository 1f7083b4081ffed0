"""Rank statistics, agreement of clusterings, enrichment, residuals, intervals and stratified roll-ups."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankforge.functions.exprs import entropy_term, finite
from rankforge.operators.ordering import running_sums


def average_ranks(df: DataFrame, value: str, group: Sequence[str], name: str) -> DataFrame:
    """(group, value, name, n): average rank of each distinct value, by running sums over distinct values."""
    g = df.where(finite(value).isNotNull()).groupBy(*group, finite(value).alias(value)).agg(F.count(F.lit(1)).alias("n"))
    r = running_sums(g, list(group), value, ["n"])
    return r.select(*group, value, (F.col("run_n") - F.col("n") + (F.col("n") + 1) / 2).alias(name), "n")


def auroc(df: DataFrame, score: str, positive: str, group: Sequence[str] = ()) -> DataFrame:
    """(group, n_positive, n_negative, auroc) by average ranks; null where a class lacks. Null or non-finite scores and null classes go."""
    ok = df.where(finite(score).isNotNull() & F.col(positive).isNotNull())
    g = ok.groupBy(*group, finite(score).alias("s")).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.count(F.lit(1)).alias("n"))
    r = running_sums(g, list(group), "s", ["n"]).withColumn("rank", F.col("run_n") - F.col("n") + (F.col("n") + 1) / 2)
    t = r.groupBy(*group).agg(F.sum("p").alias("n_positive"), F.sum(F.col("n") - F.col("p")).alias("n_negative"), F.sum(F.col("rank") * F.col("p")).alias("rs"))
    p, q = F.col("n_positive"), F.col("n_negative")
    return t.select(*group, "n_positive", "n_negative", ((F.col("rs") - p * (p + 1) / 2) / F.nullif(p * q, F.lit(0))).alias("auroc"))


def spearman(df: DataFrame, x: str, y: str, group: Sequence[str] = ()) -> DataFrame:
    """(group, n, spearman, pearson) of pairs that are both finite."""
    ok = df.where(finite(x).isNotNull() & finite(y).isNotNull()).select(*group, finite(x).alias("x"), finite(y).alias("y"))
    rx = average_ranks(ok, "x", group, "rx").drop("n")
    ry = average_ranks(ok, "y", group, "ry").drop("n")
    j = ok.join(rx, [*group, "x"]).join(ry, [*group, "y"])
    return j.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.corr("rx", "ry").alias("spearman"), F.corr("x", "y").alias("pearson"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """(label_a, label_b, n, n_a, n_b) of pairs that are both not null."""
    x = df.select(F.col(a).alias("label_a"), F.col(b).alias("label_b")).where("label_a is not null and label_b is not null")
    g = x.groupBy("label_a", "label_b").agg(F.count(F.lit(1)).alias("n"))
    na, nb = g.groupBy("label_a").agg(F.sum("n").alias("n_a")), g.groupBy("label_b").agg(F.sum("n").alias("n_b"))
    return g.join(na, "label_a").join(nb, "label_b")


def clustering_agreement(df: DataFrame, truth: str, cluster: str) -> DataFrame:
    """(n, homogeneity, completeness, mutual_information, adjusted_rand) of two labellings, all from the contingency table.

    One row; measures are null for no pairs, and where a labelling has one value only.
    """
    c = contingency(df, truth, cluster)
    two = lambda x: F.col(x) * (F.col(x) - 1) / 2
    total = c.agg(F.sum("n")).first()[0] or 0
    t = F.lit(float(max(total, 1)))
    mi, pairs = c.agg(F.sum(F.col("n") / t * F.ln(F.col("n") * t / (F.col("n_a") * F.col("n_b")))), F.sum(two("n"))).first()

    def side(k: str):
        return c.groupBy(k).agg(F.sum("n").alias("s")).agg(F.sum(entropy_term("s", t)), F.sum(two("s"))).first()

    (ha, ca), (hb, cb) = side("label_a"), side("label_b")
    row = [total, None, None, None, None]
    if total:
        expected = ca * cb / (total * (total - 1) / 2) if total > 1 else 0.0
        most = (ca + cb) / 2
        row = [total, mi / ha if ha else None, mi / hb if hb else None, mi, (pairs - expected) / (most - expected) if most != expected else None]
    return df.sparkSession.createDataFrame([row], "n long, homogeneity double, completeness double, mutual_information double, adjusted_rand double")


def adjusted_mutual_information(df: DataFrame, truth: str, cluster: str) -> float | None:
    """Adjusted mutual information with arithmetic mean of entropies; None for no pairs.

    The expectation needs the two marginals only, as sizes with the number of labels of each size: of n rows no more than the square root
    of 2 n come to the driver.
    """
    c = contingency(df, truth, cluster)
    a = c.groupBy("label_a").agg(F.sum("n").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("m")).collect()
    b = c.groupBy("label_b").agg(F.sum("n").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("m")).collect()
    n = sum(r["s"] * r["m"] for r in a)
    if not n:
        return None
    mi = clustering_agreement(df, truth, cluster).first()["mutual_information"]
    lg = math.lgamma
    expected = 0.0
    for ra in a:
        for rb in b:
            x, y = ra["s"], rb["s"]
            base = lg(x + 1) + lg(y + 1) + lg(n - x + 1) + lg(n - y + 1) - lg(n + 1)
            for k in range(max(1, x + y - n), min(x, y) + 1):
                p = math.exp(base - lg(k + 1) - lg(x - k + 1) - lg(y - k + 1) - lg(n - x - y + k + 1))
                expected += ra["m"] * rb["m"] * k / n * math.log(n * k / (x * y)) * p
    h = [-sum(r["m"] * r["s"] / n * math.log(r["s"] / n) for r in side) for side in (a, b)]
    mean = sum(h) / 2
    return 1.0 if mean - expected == 0 else (mi - expected) / (mean - expected)


def enrichment(top: DataFrame, pool: DataFrame, keys: Sequence[str], true_value: str, value: str, pool_value: str) -> DataFrame:
    """(keys, observed, expected, enrichment): share of a query's candidates with its true value over that value's share of the pool."""
    p = pool.where(F.col(pool_value).isNotNull()).groupBy(pool_value).agg(F.count(F.lit(1)).alias("m"))
    n = pool.where(F.col(pool_value).isNotNull()).count()
    q = top.where(F.col(true_value).isNotNull()).groupBy(*keys, true_value).agg(F.avg(F.coalesce((F.col(value) == F.col(true_value)).cast("int"), F.lit(0))).alias("observed"))
    j = q.join(p, F.col(true_value) == F.col(pool_value))
    e = F.col("m") / F.lit(float(max(n, 1)))
    return j.select(*keys, "observed", e.alias("expected"), (F.col("observed") / e).alias("enrichment"))


def bin_residuals(df: DataFrame, x: str, y: str, edges: Sequence[float]) -> DataFrame:
    """(bin, n, mean_x, mean_y, mean_residual) of a straight line fitted to all rows, by bins whose right edges belong to them."""
    ok = df.where(finite(x).isNotNull() & finite(y).isNotNull()).select(finite(x).alias("x"), finite(y).alias("y"))
    f = ok.agg(F.regr_slope("y", "x").alias("a"), F.regr_intercept("y", "x").alias("b")).first()
    a, b = f["a"], f["b"]
    bin_ = F.lit(len(edges))
    for i, e in reversed(list(enumerate(edges))):
        bin_ = F.when(F.col("x") <= e, i).otherwise(bin_)
    r = F.col("y") - (F.lit(a) * F.col("x") + F.lit(b))
    return ok.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"), F.avg(r).alias("mean_residual"))


def bootstrap(df: DataFrame, unit: str, value: str, group: Sequence[str], resamples: int, salt: str) -> DataFrame:
    """(group, mean, low, high): mean and its 95 % interval over resamples, in each of which a unit has a Poisson weight drawn by hash.

    Rows are summed per unit first; only sums per group and resample are shuffled after that.
    """
    out_group = list(group)
    group = out_group or ["__all"]
    df = df if out_group else df.withColumn("__all", F.lit(1))
    u = df.where(finite(value).isNotNull()).groupBy(*group, unit).agg(F.sum(finite(value)).alias("s"), F.count(F.lit(1)).alias("c"))
    b = u.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(resamples))))
    x = F.xxhash64(F.lit(salt), F.col(unit), F.col("b")).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    weight, at, p = F.lit(8), 0.0, []
    for k in range(8):
        at += math.exp(-1) / math.factorial(k)
        p.append((at, k))
    for c, k in reversed(p):
        weight = F.when(x < c, k).otherwise(weight)
    r = b.withColumn("w", weight).groupBy(*group, "b").agg((F.sum(F.col("s") * F.col("w")) / F.nullif(F.sum(F.col("c") * F.col("w")), F.lit(0))).alias("m"))
    out = r.groupBy(*group).agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    mean = u.groupBy(*group).agg((F.sum("s") / F.sum("c")).alias("mean"))
    return mean.join(out, list(group)).select(*out_group, "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def strata(df: DataFrame, stratum: str, aggs: Sequence[Column]) -> DataFrame:
    """Aggregates of each stratum and, as stratum "all", of everything, in one pass; a null stratum is "unknown"."""
    x = df.withColumn(stratum, F.coalesce(stratum, F.lit("unknown")))
    g = x.rollup(stratum).agg(F.grouping(stratum).alias("__g"), *aggs)
    return g.withColumn(stratum, F.when(F.col("__g") == 1, "all").otherwise(F.col(stratum))).drop("__g")


def lineage_rollup(df: DataFrame, levels: Sequence[str], n: str, value: str) -> DataFrame:
    """(level, taxon, n, weighted_mean) at each level of a lineage, by grouping sets; weights of null values do not count, null taxa go."""
    x = df.select(*levels, F.col(n).alias("__n"), F.col(value).alias("__v"))
    w = F.when(F.col("__v").isNotNull(), F.col("__n"))
    g = x.groupingSets([[c] for c in levels], *levels).agg(
        F.grouping_id(*levels).alias("gid"), F.sum("__n").alias("n"), (F.sum(F.col("__v") * F.col("__n")) / F.nullif(F.sum(w), F.lit(0))).alias("weighted_mean")
    )
    full = (1 << len(levels)) - 1
    level = F.coalesce(*[F.when(F.col("gid") == full - (1 << (len(levels) - 1 - i)), F.lit(c)) for i, c in enumerate(levels)])
    return g.select(level.alias("level"), F.coalesce(*levels).alias("taxon"), "n", "weighted_mean").where("taxon is not null")


def repeat_summary(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Mean, sample deviation (0 for a single repeat), least, most and the 5 and 95 % points over repeats."""
    v = finite(value)
    g = df.groupBy(*group).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("least"), F.max(v).alias("most"), F.percentile(v, F.array(F.lit(0.05), F.lit(0.95))).alias("q"))
    return g.select(*group, "n", "mean", F.when(F.col("n") == 1, 0.0).otherwise(F.col("sd")).alias("std"), "least", "most", F.col("q")[0].alias("p05"), F.col("q")[1].alias("p95"))
