"""Ranked candidates: consensus, margins, reranking, normalisation, hit rates, thresholds and rank policies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankforge.functions.exprs import RANKS, deepest, finite, hash_fraction, meets, wilson
from rankforge.operators.ordering import running_sums
from rankforge.operators.records import keep_first

KEYS = ("method", "sample_id", "query_processid")


def best_rows(df: DataFrame, keys: Sequence[str], item: str, score: str, tie: str) -> DataFrame:
    """Each item once per key, its best row: score descending, tie ascending, null last. Null or NaN scores and null items go."""
    ok = df.where(finite(score).isNotNull() & F.col(item).isNotNull())
    state = F.min(F.struct((-finite(score)).alias("d"), F.col(tie).isNull().alias("v"), F.col(tie).alias("t")))
    g = ok.groupBy(*keys, item).agg(state.alias("s"))
    return g.select(*keys, item, (-F.col("s.d")).alias(score), F.col("s.t").alias(tie))


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int | None = None, name: str = "place") -> DataFrame:
    """Places from 1 per key; with k, only the first k, limited before the shuffle too."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return out if k is None else out.where(F.col(name) <= k)


def consensus(top: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Per key: value of place 1, share of the non-null values equal to it, number of different values."""
    first = F.max(F.when(F.col("place") == 1, F.col(value)))
    w = Window.partitionBy(*keys)
    t = top.withColumn("__first", first.over(w))
    return t.groupBy(*keys).agg(
        F.max("__first").alias(f"top_{name}"),
        (F.count(F.when(F.col(value) == F.col("__first"), 1)) / F.nullif(F.count(value), F.lit(0))).alias(f"{name}_consensus"),
        F.countDistinct(value).alias(f"{name}_unique"),
    )


def margins(top: DataFrame, keys: Sequence[str], score: str, others: Sequence[int] = (2, 5, 10)) -> DataFrame:
    """Score of place 1, its lead over later places, and the lead over place 2 relative to it; null where a place is empty."""
    at = lambda k: F.max(F.when(F.col("place") == k, F.col(score)))
    g = top.groupBy(*keys).agg(at(1).alias("s1"), *[at(k).alias(f"s{k}") for k in others])
    lead = [(F.col("s1") - F.col(f"s{k}")).alias(f"margin_1_{k}") for k in others]
    return g.select(*keys, F.col("s1").alias("top_score"), *lead, ((F.col("s1") - F.col("s2")) / F.nullif(F.abs("s1"), F.lit(0.0))).alias("relative_margin"))


def mode_stats(top: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Most frequent value, its count and share, number of values; ties go to the value met first."""
    n = top.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("p"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    kinds = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    best = ranked(n.withColumn("__t", total).withColumn("__k", kinds), keys, [F.desc("n"), F.asc("p")], name="__r").where("__r = 1")
    return best.select(*keys, F.col(value).alias("mode_value"), F.col("n").alias("mode_count"), (F.col("n") / F.col("__t")).alias("mode_fraction"), F.col("__k").alias("n_values"))


def top_k_stats(top: DataFrame, keys: Sequence[str], score: str, k: int) -> DataFrame:
    """Mean and population deviation of the first k scores, and how many there are."""
    t = top.where(F.col("place") <= k)
    return t.groupBy(*keys).agg(F.avg(score).alias("mean_score"), F.stddev_pop(score).alias("std_score"), F.count(score).alias("n"))


def deltas(df: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """Distance and ratio of each score to the best of its key."""
    w = Window.partitionBy(*keys)
    best = F.max(finite(score)).over(w)
    return df.withColumn("delta_to_best", best - finite(score)).withColumn("ratio_to_best", finite(score) / F.nullif(best, F.lit(0.0)))


def standardised(df: DataFrame, group: str, score: str) -> DataFrame:
    """z-scores by group with the population deviation, which counts as 1 where it is 0; two passes, the first a small aggregate."""
    s = df.groupBy(group).agg(F.avg(finite(score)).alias("__m"), F.stddev_pop(finite(score)).alias("__d"))
    return df.join(s, group).withColumn("z_score", (finite(score) - F.col("__m")) / F.when(F.col("__d") > 0, F.col("__d")).otherwise(1.0)).drop("__m", "__d")


def rerank_window(df: DataFrame, keys: Sequence[str], distance: str, m: int) -> DataFrame:
    """The first m places of each key in order of distance, null last, the rest untouched; ties keep their place."""
    order = [(F.col("place") > m).asc(), F.when(F.col("place") <= m, F.coalesce(finite(distance), F.lit(float("inf")))).asc_nulls_last(), F.asc("place")]
    return ranked(df, keys, order, name="new_place")


def rerank_by_prior(df: DataFrame, keys: Sequence[str], score: str, counts: Sequence[str], weight: float, penalty: float) -> DataFrame:
    """score + weight * sum of log1p(count), less the penalty where no count is above 0; places by the result, ties by the old place."""
    n = [F.greatest(F.coalesce(finite(c), F.lit(0.0)), F.lit(0.0)) for c in counts]
    bonus, absent = F.lit(0.0), F.lit(True)
    for c in n:
        bonus, absent = bonus + F.log1p(c), absent & (c <= 0)
    out = df.withColumn("combined_score", finite(score) + weight * bonus - F.when(absent, penalty).otherwise(0.0))
    return ranked(out, keys, [F.desc_nulls_last("combined_score"), F.asc("place")], name="new_place")


def topk_hits(top: DataFrame, keys: Sequence[str], truth: str, value: str, ks: Sequence[int], group: Sequence[str] = ()) -> DataFrame:
    """(group, n_queries, top<k> for each k): share of the keys with a prediction whose truth is among the first k."""
    first = F.min(F.when(F.col(value) == F.col(truth), F.col("place")))
    per = top.groupBy(*keys).agg(first.alias("h"))
    return per.groupBy(*group).agg(F.count(F.lit(1)).alias("n_queries"), *[F.avg((F.coalesce(F.col("h"), F.lit(1 << 30)) <= k).cast("int")).alias(f"top{k}") for k in ks])


def set_scores(pred: DataFrame, true: DataFrame, key: str, value: str) -> DataFrame:
    """Per key: sizes, Jaccard, precision and recall of the predicted set of values; two empty sets have Jaccard 1, an empty divisor null."""
    a = pred.groupBy(key).agg(F.collect_set(value).alias("p"))
    b = true.groupBy(key).agg(F.collect_set(value).alias("t"))
    empty = F.array().cast("array<string>")
    x = a.join(b, key, "full").select(key, F.coalesce("p", empty).alias("p"), F.coalesce("t", empty).alias("t"))
    n = F.size(F.array_intersect("p", "t"))
    u = F.size(F.array_union("p", "t"))
    return x.select(
        key,
        F.size("p").alias("n_predicted"),
        F.size("t").alias("n_true"),
        F.when(u == 0, 1.0).otherwise(n / F.nullif(u, F.lit(0))).alias("jaccard"),
        (n / F.nullif(F.size("p"), F.lit(0))).alias("precision"),
        (n / F.nullif(F.size("t"), F.lit(0))).alias("recall"),
    )


# -- thresholds ----------------------------------------------------------------------------------


def precision_curve(df: DataFrame, group: Sequence[str], confidence: str, correct: str) -> DataFrame:
    """(group, confidence, n, k): rows and right rows with at least each confidence. Equal confidences are one point.

    Values are aggregated before the running sums, which see distinct confidences, spread over the tasks by range.
    """
    ok = df.where(finite(confidence).isNotNull() & F.col(correct).isNotNull())
    g = ok.groupBy(*group, finite(confidence).alias("confidence")).agg(F.count(F.lit(1)).alias("n1"), F.sum(F.col(correct).cast("int")).alias("k1"))
    r = running_sums(g, list(group), "confidence", ["n1", "k1"], descending=True)
    return r.select(*group, "confidence", F.col("run_n1").alias("n"), F.col("run_k1").alias("k"))


def fit_thresholds(df: DataFrame, group: Sequence[str], confidence: str, correct: str, targets: Sequence[float], least_n: int = 1, use_wilson: bool = False) -> DataFrame:
    """(group, target_precision, threshold, n_accepted, n_correct): the lowest confidence at which the precision, or its Wilson bound, meets the target.

    Ties are accepted together, so applying `>=` gives what was fitted. Where no confidence meets a target the threshold is null
    and nothing is accepted.
    """
    c = precision_curve(df, group, confidence, correct)
    value = wilson("k", "n")[0] if use_wilson else F.col("k") / F.col("n")
    grid = c.withColumn("v", value).withColumn("target_precision", F.explode(F.array(*[F.lit(float(t)) for t in targets])))
    ok = (F.col("v") >= F.col("target_precision")) & (F.col("n") >= least_n)
    best = F.max(F.when(ok, F.struct("n", F.col("confidence").alias("c"), "k")))
    return grid.groupBy(*group, "target_precision").agg(best.alias("b")).select(
        *group, "target_precision", F.col("b.c").alias("threshold"), F.coalesce("b.n", F.lit(0)).alias("n_accepted"), F.coalesce("b.k", F.lit(0)).alias("n_correct")
    )


def fit_thresholds_rowwise(df: DataFrame, group: Sequence[str], confidence: str, correct: str, tie: Sequence[str], targets: Sequence[float]) -> DataFrame:
    """As fit_thresholds, but row by row: the last row, in descending confidence and then `tie`, at which the running precision meets the target."""
    ok = df.where(finite(confidence).isNotNull() & F.col(correct).isNotNull())
    ok = ok.select(*group, finite(confidence).alias("c"), F.struct((-finite(confidence)).alias("__d"), *tie).alias("__o"), F.lit(1).alias("n"), F.col(correct).cast("int").alias("k"))
    c = running_sums(ok, group, "__o", ["n", "k"]).select(*group, "c", F.col("run_n").alias("n"), F.col("run_k").alias("k"))
    grid = c.withColumn("target_precision", F.explode(F.array(*[F.lit(float(t)) for t in targets])))
    best = F.max(F.when(F.col("k") / F.col("n") >= F.col("target_precision"), F.struct("n", "c")))
    return grid.groupBy(*group, "target_precision").agg(best.alias("b")).select(*group, "target_precision", F.col("b.c").alias("threshold"), F.coalesce("b.n", F.lit(0)).alias("n_accepted"))


def assign_rank(df: DataFrame, features: dict[str, str], thresholds: dict[str, float | None]) -> Column:
    """Deepest rank whose feature meets its threshold; NaN and null never do."""
    return deepest({r: meets(f, F.lit(thresholds.get(r)).cast("double")) for r, f in features.items()})


def policy_summary(df: DataFrame, group: Sequence[str], rank: str, correct: str) -> DataFrame:
    """Queries, assigned, coverage, precision over assigned rows of known truth, and false species calls."""
    called = F.col(rank) != "no_call"
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.count(F.when(called, 1)).alias("n_assigned"),
        F.avg(called.cast("int")).alias("coverage"),
        F.avg(F.when(called, F.col(correct).cast("int"))).alias("precision"),
        F.count(F.when((F.col(rank) == "species") & ~F.col(correct), 1)).alias("n_false_species"),
        *[F.count(F.when(F.col(rank) == r, 1)).alias(f"n_{r}") for r in RANKS],
    )


def coverage_curve(df: DataFrame, group: Sequence[str], confidence: str, correct: str, tie: Sequence[str], points: Sequence[float]) -> DataFrame:
    """(group, coverage, n_accepted, accuracy): accuracy of the most confident share of the rows, one row at least."""
    value = finite(confidence)
    r = df.select(*group, F.struct(value.isNull().alias("__v"), (-value).alias("__d"), *tie).alias("__o"), F.lit(1).alias("n"), F.col(correct).cast("int").alias("k"))
    r = running_sums(r, group, "__o", ["n"])
    total = r.groupBy(*group).agg(F.count(F.lit(1)).alias("__n")).select(*[F.col(g).alias(f"__g_{g}") for g in group], "__n")
    on = F.lit(True)
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    grid = r.join(total, on).withColumn("coverage", F.explode(F.array(*[F.lit(float(p)) for p in points])))
    take = F.greatest(F.lit(1), F.bround(F.col("__n") * F.col("coverage"), 0).cast("int"))
    acc = grid.where(F.col("run_n") <= take)
    return acc.groupBy(*group, "coverage").agg(F.count(F.lit(1)).alias("n_accepted"), F.avg("k").alias("accuracy"))


def threshold_sweep(df: DataFrame, value: str, correct: str, cuts: Sequence[float]) -> DataFrame:
    """(cut, n_accepted, n_correct) at each cut; rows below it are refused. A single pass for all cuts."""
    aggs = []
    for c in cuts:
        hit = meets(value, F.lit(float(c)))
        aggs += [F.struct(F.lit(float(c)).alias("cut"), F.count(F.when(hit, 1)).alias("n_accepted"), F.count(F.when(hit & F.col(correct), 1)).alias("n_correct"))]
    return df.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("x")).select("x.*")


def disjoint_halves(df: DataFrame, unit: str, seeds: int) -> DataFrame:
    """Each row once per seed with its half, fit or apply, by the hash of its unit: units are never in both halves."""
    s = df.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    draw = F.conv(F.substring(F.sha1(F.concat_ws(":", F.col("seed").cast("string"), F.col(unit))), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))
    return s.withColumn("half", F.when(draw < 0.5, "fit").otherwise("apply"))


def nested_parts(df: DataFrame, unit: str, salt: str) -> DataFrame:
    """fit, threshold or evaluation by the hash of the unit: half, a quarter, a quarter."""
    u = hash_fraction(unit, salt)
    return df.withColumn("part", F.when(u < 0.5, "fit").when(u < 0.75, "threshold").otherwise("evaluation"))


def backed_off(rows: DataFrame, keys: Sequence[str], rank: str, probability: str, threshold: dict[str, float]) -> DataFrame:
    """One row per key: of the candidate calls that meet their rank's threshold, the deepest rank, then the highest probability."""
    level = F.coalesce(*[F.when(F.col(rank) == r, i) for i, r in enumerate(RANKS)])
    limit = F.coalesce(*[F.when(F.col(rank) == r, F.lit(t)) for r, t in threshold.items()])
    return keep_first(rows.where(meets(probability, limit)).withColumn("__l", level), keys, [F.asc("__l"), F.desc(probability), F.asc("call")]).drop("__l")


def agreeing_rank(df: DataFrame, a: str, b: str) -> Column:
    """Deepest rank at which two sources' first candidates agree; nulls agree with nothing."""
    return deepest({r: F.col(f"{a}_{r}") == F.col(f"{b}_{r}") for r in RANKS})


def set_valued(top: DataFrame, group: Sequence[str], keys: Sequence[str], truth: str, value: str, sizes: Sequence[int], target: float) -> DataFrame:
    """(group, size, coverage, mean_size): the smallest mean set of first candidates whose coverage meets the target; no row where none does."""
    per = top.groupBy(*group, *keys).agg(F.min(F.when(F.col(value) == F.col(truth), F.col("place"))).alias("h"), F.count(F.lit(1)).alias("n"))
    grid = per.withColumn("size", F.explode(F.array(*[F.lit(s) for s in sizes])))
    g = grid.groupBy(*group, "size").agg(F.avg((F.coalesce("h", F.lit(1 << 30)) <= F.col("size")).cast("int")).alias("coverage"), F.avg(F.least("n", "size")).alias("mean_size"))
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))
    ok = g.where(F.col("coverage") >= target)
    return ok.withColumn("__r", F.row_number().over(w.orderBy("mean_size", F.desc("coverage"), "size"))).where("__r = 1").drop("__r")


def reason_codes(checks: Sequence[tuple[str, Column]]) -> Column:
    """Codes of the checks that hold, in order, joined by a semicolon; empty where none does."""
    codes = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks])
    return F.concat_ws(";", F.array_distinct(F.filter(codes, lambda x: x.isNotNull())))


def competition_rank(df: DataFrame, keys: Sequence[str], score: str, is_target: Column) -> DataFrame:
    """(keys, target_rank): 1 + candidates that beat the best target; ties count for the target; keys without a target have no row."""
    best = F.max(F.when(is_target, finite(score))).over(Window.partitionBy(*keys))
    x = df.withColumn("__b", best).where(F.col("__b").isNotNull())
    return x.groupBy(*keys).agg((F.count(F.when(finite(score) > F.col("__b"), 1)) + 1).alias("target_rank"))


def feature_drift(df: DataFrame, cohort: str, baseline: str, features: Sequence[str]) -> DataFrame:
    """(cohort, feature, n, missing_share, mean, std, median, p05, p95, delta): delta is the shift of the mean against the baseline cohort in its deviations."""
    long = df.select(cohort, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), finite(f).alias("v")) for f in features])).alias("x")).select(cohort, "x.feature", "x.v")
    g = long.groupBy(cohort, "feature").agg(F.count(F.lit(1)).alias("n"), (1 - F.count("v") / F.count(F.lit(1))).alias("missing_share"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.percentile("v", F.array(F.lit(0.5), F.lit(0.05), F.lit(0.95))).alias("q"))
    base = g.where(F.col(cohort) == baseline).select("feature", F.col("mean").alias("bm"), F.col("std").alias("bs"))
    return g.join(base, "feature", "left").select(cohort, "feature", "n", "missing_share", "mean", "std", F.get("q", F.lit(0)).alias("median"), F.get("q", F.lit(1)).alias("p05"), F.get("q", F.lit(2)).alias("p95"), ((F.col("mean") - F.col("bm")) / F.nullif("bs", F.lit(0.0))).alias("delta"))


def union_sources(a: Column | str, b: Column | str) -> Column:
    """Candidates of both lists, the first list's order kept, each once."""
    return F.array_distinct(F.concat(a, b))


def intersect_sources(a: Column | str, b: Column | str) -> Column:
    return F.array_intersect(a, b)
