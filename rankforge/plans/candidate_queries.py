"""Queries on ranked candidates: consensus, thresholds, policies, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.functions import exprs as X
from rankforge.functions.exprs import RANKS
from rankforge.operators import candidates as C
from rankforge.operators import rank_policy as RP
from rankforge.operators import statistics as S
from rankforge.runtime import keep, table

K = list(C.KEYS)
TARGETS = [0.5, 0.8, 0.9, 0.95]
POINTS = [0.01, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 1.0]
POLICY_TARGETS = [0.5, 0.8, 0.9]
SWEEP = [0.3, 0.5, 0.7, 0.8, 0.9, 0.95]


def _eco(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eco_phylo_candidate_features_top5")


def _top(spark: SparkSession, d: str) -> DataFrame:
    """First places of each method, sample and query, with the candidate's genus and the true label and genus of the sample map."""
    df = _eco(spark, d)
    best = C.best_rows(df, K, "candidate_tree_label", "candidate_score", "candidate_rank_num")
    top = C.ranked(best, K, [F.desc("candidate_score"), F.asc_nulls_last("candidate_rank_num"), F.asc("candidate_tree_label")])
    truth = df.where("true_tree_label is not null").groupBy("query_processid").agg(F.min("true_tree_label").alias("truth"))
    t = top.join(truth, "query_processid", "left")
    return t.withColumn("genus", X.genus_of_label("candidate_tree_label")).withColumn("true_genus", X.genus_of_label("truth"))


def _first(spark: SparkSession, d: str) -> DataFrame:
    """Place 1 with its score and whether its label and genus are right."""
    t = _top(spark, d).where("place = 1 and truth is not null")
    return t.withColumn("right_species", F.col("candidate_tree_label") == F.col("truth")).withColumn("right_genus", F.col("genus") == F.col("true_genus"))


def a_consensus(spark, d):
    x = C.consensus(_top(spark, d), K, "genus", "genus")
    return x.select(*K, "top_genus", F.round("genus_consensus", 6).alias("genus_consensus"), "genus_unique")


def w_margins(spark, d):
    x = C.margins(_top(spark, d), K, "candidate_score", (2, 5, 10))
    return x.select(*K, *[F.round(c, 6).alias(c) for c in ("top_score", "margin_1_2", "margin_1_5", "margin_1_10", "relative_margin")])


def w_deltas(spark, d):
    x = C.deltas(_top(spark, d), K, "candidate_score")
    return x.select(*K, "candidate_tree_label", F.round("delta_to_best", 6).alias("delta_to_best"), F.round("ratio_to_best", 6).alias("ratio_to_best"))


def w_topk_stats(spark, d):
    x = C.top_k_stats(_top(spark, d), K, "candidate_score", 3)
    return x.select(*K, F.round("mean_score", 6).alias("mean_score"), F.round("std_score", 6).alias("std_score"), "n")


def w_cum_precision(spark, d):
    x = C.precision_curve(_first(spark, d), ["method"], "candidate_score", "right_genus")
    return x.select("method", "confidence", "n", "k")


def a_mode_stats(spark, d):
    x = C.mode_stats(_top(spark, d), K, "genus")
    return x.select(*K, "mode_value", "mode_count", F.round("mode_fraction", 6).alias("mode_fraction"), "n_values")


def a_zscore(spark, d):
    x = C.standardised(_eco(spark, d), "method", "candidate_score")
    return x.select(*K, "candidate_tree_label", F.unix_micros("loaded_at").alias("loaded_us"), F.round("z_score", 5).alias("z_score"))


def a_topk_hits(spark, d):
    return C.topk_hits(_top(spark, d).where("truth is not null"), K, "truth", "candidate_tree_label", [1, 3, 5], ["method"]).select("method", "n_queries", *[F.round(f"top{k}", 6).alias(f"top{k}") for k in (1, 3, 5)])


def a_topk_hits_genus(spark, d):
    return C.topk_hits(_top(spark, d).where("truth is not null"), K, "true_genus", "genus", [1, 3, 5], ["method"]).select("method", "n_queries", *[F.round(f"top{k}", 6).alias(f"top{k}") for k in (1, 3, 5)])


def a_sample_jaccard(spark, d):
    pred = _top(spark, d).where("place = 1").select("sample_id", "candidate_tree_label")
    true = table(spark, d, "sample_query_map").where("true_tree_label is not null").select("sample_id", F.col("true_tree_label").alias("candidate_tree_label"))
    x = C.set_scores(pred, true, "sample_id", "candidate_tree_label")
    return x.select("sample_id", F.col("n_predicted").cast("long").alias("n_predicted"), F.col("n_true").cast("long").alias("n_true"), *[F.round(c, 6).alias(c) for c in ("jaccard", "precision", "recall")])


def a_wilson(spark, d):
    g = _first(spark, d).groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("right_genus").cast("long")).alias("k"))
    lo, hi = X.wilson("k", "n")
    return g.select("method", "n", "k", F.round(lo, 6).alias("low"), F.round(hi, 6).alias("high"))


def c_fit_tied(spark, d):
    return C.fit_thresholds(_first(spark, d), ["method"], "candidate_score", "right_genus", TARGETS)


def c_fit_wilson(spark, d):
    return C.fit_thresholds(_first(spark, d), ["method"], "candidate_score", "right_genus", TARGETS, 10, True)


def c_fit_rowwise(spark, d):
    return C.fit_thresholds_rowwise(_first(spark, d), ["method"], "candidate_score", "right_species", ["sample_id", "query_processid"], TARGETS)


def _ranked(spark, d):
    """Places with the values of candidate and truth at four ranks."""
    lineage = RP.lineages(table(spark, d, "candidate_species"))
    t = _top(spark, d).where("truth is not null")
    return RP.with_rank_values(RP.with_rank_values(t, "candidate_tree_label", lineage, "value"), "truth", lineage, "truth")


def _features(spark, d):
    part = _eco(spark, d).groupBy(*K).agg(F.min("calibration_split").alias("part"))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in K]
    part = part.toDF(*[f"__{k}" for k in K], "part")
    f = RP.rank_features(_ranked(spark, d), K, "candidate_score")
    return keep(f.join(part, on).drop(*[f"__{k}" for k in K]))


def _policy(spark, d):
    """Thresholds fitted on the calibration part, method by method, and applied to the evaluation part."""
    f = _features(spark, d)
    fit = RP.fitted_policy(f.where("part = 'calibration'"), ["method"], POLICY_TARGETS)
    return RP.applied_policy(f.where("part = 'evaluation'"), fit, ["method"])


def c_policy_thresholds(spark, d):
    x = RP.fitted_policy(_features(spark, d).where("part = 'calibration'"), ["method"], POLICY_TARGETS)
    return x.withColumn("threshold", F.round("threshold", 6))


def c_deepest_rank(spark, d):
    return _policy(spark, d).select(*K, "target_precision", "assigned_rank", "right")


def a_policy_summary(spark, d):
    x = C.policy_summary(_policy(spark, d), ["method", "target_precision"], "assigned_rank", "right")
    return x.withColumn("coverage", F.round("coverage", 6)).withColumn("precision", F.round("precision", 6))


def a_rank_hits(spark, d):
    """Top-k hit rates at four ranks."""
    x = RP.rank_hits(_ranked(spark, d), K, ["method"], [1, 3, 5])
    return x.select("method", "rank", F.col("k").cast("long").alias("k"), "n_queries", F.round("hit_rate", 6).alias("hit_rate"))


def a_rank_consensus(spark, d):
    """Agreement of the candidates with the first one at four ranks."""
    return _features(spark, d).select(*K, *[c for r in RANKS for c in (F.col(f"first_{r}"), F.round(f"{r}_consensus", 6).alias(f"{r}_consensus"), F.col(f"right_{r}"))])


def a_coverage_curve(spark, d):
    x = C.coverage_curve(_first(spark, d), ["method"], "candidate_score", "right_genus", ["sample_id", "query_processid"], POINTS)
    return x.select("method", "coverage", "n_accepted", F.round("accuracy", 6).alias("accuracy"))


def c_threshold_sweep(spark, d):
    return C.threshold_sweep(_first(spark, d), "candidate_score", "right_genus", SWEEP)


def c_species_disjoint(spark, d):
    """Thresholds fitted on one half of the true genera, applied to the other, for thirty draws."""
    h = C.disjoint_halves(_first(spark, d), "true_genus", 30)
    fit = C.fit_thresholds(h.where("half = 'fit'"), ["seed"], "candidate_score", "right_genus", [0.9])
    a = h.where("half = 'apply'").join(F.broadcast(fit.select("seed", "threshold")), "seed")  # a row a draw
    hit = C.meets("candidate_score", "threshold")
    return a.groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(hit, 1)).alias("n_accepted"), F.count(F.when(hit & F.col("right_genus"), 1)).alias("n_correct"))


def c_hash_split(spark, d):
    x = table(spark, d, "sample_query_map").where("site20 is not null").select("site20").distinct()
    return x.select("site20", X.hash_parity("site20").alias("parity"), F.round(X.hash_fraction("site20", "candidate-posterior-nested-0"), 9).alias("fraction"))


def c_nested_parts(spark, d):
    return C.nested_parts(_first(spark, d), "sample_id", "nested-1").groupBy("part").agg(F.count(F.lit(1)).alias("n"))


def c_backoff(spark, d):
    f = _first(spark, d).where("sample_id is not null and query_processid is not null")
    calls = f.select(*K, F.explode(F.array(F.struct(F.lit("species").alias("rank"), F.col("candidate_tree_label").alias("call"), F.col("candidate_score").alias("p")), F.struct(F.lit("genus").alias("rank"), F.col("genus").alias("call"), F.col("candidate_score").alias("p")))).alias("x")).select(*K, "x.*")
    return C.backed_off(calls, ["sample_id", "query_processid"], "rank", "p", {"species": 0.95, "genus": 0.7}).select("sample_id", "query_processid", "rank", "call")


def c_source_agreement(spark, d):
    """Deepest rank at which the first candidates of two methods agree."""
    t = _features(spark, d).where("sample_id is not null and query_processid is not null")
    one = lambda m, p: t.where(F.col("method") == m).select("sample_id", "query_processid", *[F.col(f"first_{r}").alias(f"{p}_{r}") for r in RANKS])
    j = one("ssm_plain", "a").join(one("kmer_rls", "b"), ["sample_id", "query_processid"], "full")
    return j.withColumn("rank", C.agreeing_rank(j, "a", "b")).groupBy("rank").agg(F.count(F.lit(1)).alias("n"))


def c_set_valued(spark, d):
    x = C.set_valued(_top(spark, d).where("truth is not null"), ["method"], K[1:], "truth", "candidate_tree_label", [1, 2, 3, 4, 5], 0.5)
    return x.select("method", F.col("size").cast("long").alias("size"), F.round("coverage", 6).alias("coverage"), F.round("mean_size", 6).alias("mean_size"))


def c_reason_codes(spark, d):
    x = _policy(spark, d)
    codes = C.reason_codes([("species_supported", F.col("assigned_rank") == "species"), ("genus_supported", F.col("assigned_rank").isin("species", "genus")), ("genus_ambiguous", F.col("genus_consensus") < 0.8), ("low_score", F.col("top_score") < 0.5), ("no_second", F.col("relative_margin").isNull())])
    return x.withColumn("reasons", codes).groupBy("method", "target_precision", "reasons").agg(F.count(F.lit(1)).alias("n"))


def t_rerank_window(spark, d):
    e = _eco(spark, d).where("blast_candidate_pident is not null").groupBy(*K, "candidate_tree_label").agg(F.max("blast_candidate_pident").alias("pident"))
    t = _top(spark, d).join(e, [*K, "candidate_tree_label"], "left").withColumn("distance", 100 - X.finite("pident"))
    return C.rerank_window(t, K, "distance", 3).select(*K, "candidate_tree_label", F.col("place").cast("long").alias("place"), F.col("new_place").cast("long").alias("new_place"))


def e_combined_rerank(spark, d):
    e = _eco(spark, d).groupBy(*K, "candidate_tree_label").agg(F.max(X.finite("rls_prior_count")).alias("rls"), F.max(X.finite("obis_prior_count")).alias("obis"))
    t = _top(spark, d).join(e, [*K, "candidate_tree_label"])
    x = C.rerank_by_prior(t, K, "candidate_score", ["rls", "obis"], 0.05, 0.03)
    return x.select(*K, "candidate_tree_label", F.round("combined_score", 6).alias("combined_score"))


def x_competition_rank(spark, d):
    t = _top(spark, d)
    return C.competition_rank(t, K, "candidate_score", F.col("genus") == F.col("true_genus"))


DRIFT = ["candidate_score", "sequence_only_score", "rls_prior_count", "obis_prior_count"]


def x_feature_drift(spark, d):
    """At the level of rows, and of first candidates by the table's own rank."""
    out = None
    for level, rows in (("rows", _eco(spark, d)), ("first", _eco(spark, d).where("candidate_rank = 1"))):
        x = C.feature_drift(rows, "method", "ssm_plain", DRIFT)
        x = x.select(F.lit(level).alias("level"), "method", "feature", "n", *[F.round(c, 5).alias(c) for c in ("missing_share", "mean", "std", "median", "p05", "p95", "delta")])
        out = x if out is None else out.unionByName(x)
    return out


def x_weighted_top_label(spark, d):
    g = _top(spark, d).where("query_processid is not null").groupBy("query_processid", "candidate_tree_label").agg(F.round(F.sum("candidate_score"), 6).alias("weight"))
    from rankforge.operators.records import keep_first

    return keep_first(g, ["query_processid"], [F.desc("weight"), F.asc("candidate_tree_label")])


def p_method_parts(spark, d):
    x = _eco(spark, d).select("method").distinct()
    return x.select("method", *[c.alias(n) for n, c in X.method_parts("method").items()])


def u_candidate_sets(spark, d):
    """Union and intersection of two methods' candidates of a query, over its samples, in the order of the first method's best places."""

    def one(m, n):
        x = _top(spark, d).where((F.col("method") == m) & F.col("query_processid").isNotNull()).groupBy("query_processid", "candidate_tree_label").agg(F.min("place").alias("p"))
        return x.groupBy("query_processid").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "candidate_tree_label"))), lambda s: s["candidate_tree_label"]).alias(n))

    j = one("ssm_plain", "a").join(one("cnn_cooc", "b"), "query_processid", "inner")
    u, i = C.union_sources("a", "b"), C.intersect_sources("a", "b")
    return j.select("query_processid", F.size(u).cast("long").alias("n_union"), F.size(i).cast("long").alias("n_common"), F.array_join(u, "|").alias("all_labels"), F.array_join(i, "|").alias("common_labels"))


def a_auroc(spark, d):
    x = S.auroc(_first(spark, d), "candidate_score", "right_genus", ["method"])
    return x.select("method", "n_positive", "n_negative", F.round("auroc", 6).alias("auroc"))


def a_spearman(spark, d):
    x = S.spearman(_eco(spark, d), "candidate_score", "sequence_only_score", ["method"])
    return x.select("method", "n", F.round("spearman", 5).alias("spearman"), F.round("pearson", 5).alias("pearson"))


def a_strata(spark, d):
    f = _first(spark, d)
    return S.strata(f, "method", [F.count(F.lit(1)).alias("n"), F.sum(F.col("right_genus").cast("long")).alias("n_right")])


def a_enrichment(spark, d):
    t = _top(spark, d).where("truth is not null")
    x = S.enrichment(t, table(spark, d, "candidate_species"), K, "true_genus", "genus", "genus_from_label")
    return x.select(*K, F.round("observed", 6).alias("observed"), F.round("expected", 9).alias("expected"), F.round("enrichment", 4).alias("enrichment"))


def a_regression_residual(spark, d):
    x = S.bin_residuals(_eco(spark, d), "sequence_only_score", "candidate_score", [0.2, 0.4, 0.6, 0.8])
    return x.select(F.col("bin").cast("long").alias("bin"), "n", *[F.round(c, 5).alias(c) for c in ("mean_x", "mean_y", "mean_residual")])


def a_bootstrap(spark, d):
    f = _first(spark, d).withColumn("v", F.col("right_genus").cast("double")).where("query_processid is not null")
    return S.bootstrap(f, "query_processid", "v", ["method"], 200, "boot-1")


def a_repeat_percentiles(spark, d):
    f = _first(spark, d).groupBy("method", "sample_id").agg(F.avg("candidate_score").alias("m"))
    x = S.repeat_summary(f, ["method"], "m")
    return x.select("method", "n", *[F.round(F.col(c) + 1e-9, 5).alias(c) for c in ("mean", "std", "least", "most", "p05", "p95")])


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and len(k) > 2 and k[1] == "_" and k[0] in "awctexpu"}

_T = """b AS (SELECT method, sample_id, query_processid, candidate_tree_label, candidate_score AS s, candidate_rank_num AS r,
        row_number() OVER (PARTITION BY method, sample_id, query_processid, candidate_tree_label ORDER BY candidate_score DESC, candidate_rank_num ASC NULLS LAST) AS k
        FROM eco_phylo_candidate_features_top5 WHERE candidate_score IS NOT NULL AND NOT isnan(candidate_score) AND candidate_tree_label IS NOT NULL),
    tr AS (SELECT query_processid, min(true_tree_label) AS truth FROM eco_phylo_candidate_features_top5 WHERE true_tree_label IS NOT NULL GROUP BY query_processid),
    t AS (SELECT method, sample_id, b.query_processid, candidate_tree_label, s, r, truth, split_part(candidate_tree_label, '_', 1) AS genus, split_part(truth, '_', 1) AS true_genus,
        row_number() OVER (PARTITION BY method, sample_id, b.query_processid ORDER BY s DESC, r ASC NULLS LAST, candidate_tree_label) AS place
        FROM b LEFT JOIN tr ON b.query_processid = tr.query_processid WHERE k = 1),
    f AS (SELECT *, candidate_tree_label = truth AS right_species, genus = true_genus AS right_genus FROM t WHERE place = 1 AND truth IS NOT NULL)"""
_KS = "method, sample_id, query_processid"
_ECO = "eco_phylo_candidate_features_top5"
_CONS = f"""cs AS (SELECT {_KS}, max(fg) AS top_genus, count(*) FILTER (genus = fg) / count(genus) AS genus_consensus, count(DISTINCT genus) AS genus_unique
    FROM (SELECT *, max(CASE WHEN place = 1 THEN genus END) OVER (PARTITION BY {_KS}) AS fg FROM t) GROUP BY ALL)"""
_MARG = f"mg AS (SELECT {_KS}, max(s) FILTER (place = 1) AS s1, max(s) FILTER (place = 2) AS s2, max(s) FILTER (place = 5) AS s5, max(s) FILTER (place = 10) AS s10 FROM t GROUP BY ALL)"
_LIN = """li AS (SELECT tree_label AS l, min(genus_name) AS g, min(family_name) AS fa, min(order_name) AS o FROM candidate_species WHERE tree_label IS NOT NULL GROUP BY 1)"""
_RV = f"""{_T}, {_LIN}, rv AS (SELECT t.method, t.sample_id, t.query_processid, t.place, t.s, candidate_tree_label AS v_species, coalesce(a.g, genus) AS v_genus, a.fa AS v_family, a.o AS v_order,
        truth AS t_species, coalesce(b.g, true_genus) AS t_genus, b.fa AS t_family, b.o AS t_order FROM t LEFT JOIN li a ON a.l = candidate_tree_label LEFT JOIN li b ON b.l = truth WHERE truth IS NOT NULL)"""
_PART = f"pt AS (SELECT {_KS}, min(calibration_split) AS part FROM {_ECO} GROUP BY ALL)"
_FEAT = (
    f"{_RV}, {_PART}, ra AS (SELECT *, "
    + ", ".join(f"max(CASE WHEN place = 1 THEN v_{r} END) OVER (PARTITION BY {_KS}) AS f_{r}" for r in RANKS)
    + f" FROM rv WHERE place <= 10), rb AS (SELECT {_KS}, max(s) FILTER (place = 1) AS s1, max(s) FILTER (place = 2) AS s2, "
    + ", ".join(f"max(f_{r}) AS first_{r}, CASE WHEN max(f_{r}) IS NOT NULL THEN count(*) FILTER (v_{r} = f_{r}) / count(v_{r}) END AS c_{r}, CASE WHEN max(t_{r}) IS NOT NULL THEN coalesce(max(f_{r}) = max(t_{r}), false) END AS right_{r}" for r in RANKS)
    + f""" FROM ra GROUP BY ALL), fe AS (SELECT rb.*, (s1 - s2) / nullif(abs(s1), 0) AS m_species, part FROM rb JOIN pt ON rb.method IS NOT DISTINCT FROM pt.method AND rb.sample_id IS NOT DISTINCT FROM pt.sample_id
        AND rb.query_processid IS NOT DISTINCT FROM pt.query_processid)"""
)
_FIT = (
    f"{_FEAT}, lo AS ("
    + " UNION ALL ".join(f"SELECT method, '{r}' AS rank, {'m_species' if r == 'species' else 'c_' + r} AS feature, right_{r} AS ok FROM fe WHERE part = 'calibration' AND right_{r} IS NOT NULL" for r in RANKS)
    + f"""), lg AS (SELECT method, rank, feature, count(*) AS n1, count(*) FILTER (ok) AS k1 FROM lo WHERE feature IS NOT NULL AND NOT isnan(feature) GROUP BY ALL),
    lc AS (SELECT method, rank, feature, CAST(sum(n1) OVER w AS BIGINT) AS n, CAST(sum(k1) OVER w AS BIGINT) AS k FROM lg WINDOW w AS (PARTITION BY method, rank ORDER BY feature DESC ROWS UNBOUNDED PRECEDING)),
    th AS (SELECT method, rank, target_precision, max_by(feature, n) FILTER (k / n >= target_precision) AS threshold, coalesce(max(n) FILTER (k / n >= target_precision), 0) AS n_accepted,
        coalesce(max_by(k, n) FILTER (k / n >= target_precision), 0) AS n_correct FROM lc, (SELECT unnest({POLICY_TARGETS}::DOUBLE[]) AS target_precision) GROUP BY ALL)"""
)
_POL = (
    f"{_FIT}, pv AS (SELECT method, target_precision, "
    + ", ".join(f"max(threshold) FILTER (rank = '{r}') AS h_{r}" for r in RANKS)
    + " FROM th GROUP BY ALL), pr AS (SELECT fe.*, target_precision, CASE "
    + " ".join(f"WHEN coalesce({'m_species' if r == 'species' else 'c_' + r} >= h_{r}, false) THEN '{r}'" for r in RANKS)
    + " ELSE 'no_call' END AS assigned_rank FROM fe JOIN pv ON fe.method = pv.method WHERE part = 'evaluation'), pp AS (SELECT *, CASE assigned_rank "
    + " ".join(f"WHEN '{r}' THEN right_{r}" for r in RANKS)
    + " END AS rt FROM pr)"
)
_CURVE = """g AS (SELECT method, s AS confidence, count(*) AS n1, count(*) FILTER (right_genus) AS k1 FROM f GROUP BY ALL),
    c AS (SELECT method, confidence, CAST(sum(n1) OVER w AS BIGINT) AS n, CAST(sum(k1) OVER w AS BIGINT) AS k FROM g WINDOW w AS (PARTITION BY method ORDER BY confidence DESC ROWS UNBOUNDED PRECEDING))"""
_TG = f"(SELECT unnest({TARGETS}::DOUBLE[]) AS target_precision)"
_WL = "((k / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4.0 * n * n)) / (1 + 1.96 * 1.96 / n))"
_WH = _WL.replace(" - 1.96 * sqrt", " + 1.96 * sqrt")


def _hits(truth: str, value: str) -> str:
    tops = ", ".join(f"round(avg(CASE WHEN h <= {k} THEN 1 ELSE 0 END), 6) AS top{k}" for k in (1, 3, 5))
    return f"WITH {_T}, h AS (SELECT {_KS}, coalesce(min(place) FILTER ({value} = {truth}), 1000000) AS h FROM t WHERE truth IS NOT NULL GROUP BY ALL) SELECT method, count(*) AS n_queries, {tops} FROM h GROUP BY method"


def _fit(ok: str) -> str:
    return f"""WITH {_T}, {_CURVE}, j AS (SELECT * FROM c, {_TG}) SELECT method, target_precision, max_by(confidence, n) FILTER ({ok}) AS threshold,
        coalesce(max(n) FILTER ({ok}), 0) AS n_accepted, coalesce(max_by(k, n) FILTER ({ok}), 0) AS n_correct FROM j GROUP BY ALL"""


_F1 = "(CASE WHEN {0} IS NOT NULL AND NOT isnan({0}) AND abs({0}) < 'infinity'::DOUBLE THEN {0} END)"
ORACLE = {
    "a_consensus": f"WITH {_T}, {_CONS} SELECT {_KS}, top_genus, round(genus_consensus, 6) AS genus_consensus, genus_unique FROM cs",
    "w_margins": f"WITH {_T}, {_MARG} SELECT {_KS}, round(s1, 6) AS top_score, round(s1 - s2, 6) AS margin_1_2, round(s1 - s5, 6) AS margin_1_5, round(s1 - s10, 6) AS margin_1_10, round((s1 - s2) / nullif(abs(s1), 0), 6) AS relative_margin FROM mg",
    "w_deltas": f"WITH {_T}, x AS (SELECT *, max(s) OVER (PARTITION BY {_KS}) AS m FROM t) SELECT {_KS}, candidate_tree_label, round(m - s, 6) AS delta_to_best, round(s / nullif(m, 0), 6) AS ratio_to_best FROM x",
    "w_topk_stats": f"WITH {_T} SELECT {_KS}, round(avg(s), 6) AS mean_score, round(stddev_pop(s), 6) AS std_score, count(s) AS n FROM t WHERE place <= 3 GROUP BY ALL",
    "w_cum_precision": f"WITH {_T}, {_CURVE} SELECT method, confidence, n, k FROM c",
    "a_mode_stats": f"""WITH {_T}, g AS (SELECT {_KS}, genus, count(*) AS n, min(place) AS p FROM t GROUP BY ALL),
        h AS (SELECT *, sum(n) OVER w AS tt, count(*) OVER w AS kk, row_number() OVER (PARTITION BY {_KS} ORDER BY n DESC, p) AS rr FROM g WINDOW w AS (PARTITION BY {_KS}))
        SELECT {_KS}, genus AS mode_value, n AS mode_count, round(n / tt, 6) AS mode_fraction, kk AS n_values FROM h WHERE rr = 1""",
    "a_zscore": f"""WITH s AS (SELECT method, avg({_F1.format('candidate_score')}) AS m, stddev_pop({_F1.format('candidate_score')}) AS d FROM {_ECO} GROUP BY method)
        SELECT e.method, sample_id, query_processid, candidate_tree_label, epoch_us(loaded_at) AS loaded_us, round(({_F1.format('candidate_score')} - m) / CASE WHEN d > 0 THEN d ELSE 1.0 END, 5) AS z_score FROM {_ECO} e JOIN s ON e.method = s.method""",
    "a_topk_hits": _hits("truth", "candidate_tree_label"),
    "a_topk_hits_genus": _hits("true_genus", "genus"),
    "a_sample_jaccard": f"""WITH {_T}, p AS (SELECT DISTINCT sample_id, candidate_tree_label AS v FROM t WHERE place = 1), q AS (SELECT DISTINCT sample_id, true_tree_label AS v FROM sample_query_map WHERE true_tree_label IS NOT NULL),
        ix AS (SELECT p.sample_id, count(*) AS i FROM p JOIN q ON p.sample_id = q.sample_id AND p.v = q.v GROUP BY ALL),
        pa AS (SELECT sample_id, count(*) AS a FROM p GROUP BY ALL), qb AS (SELECT sample_id, count(*) AS b FROM q GROUP BY ALL),
        j AS (SELECT coalesce(pa.sample_id, qb.sample_id) AS sample_id, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM pa FULL JOIN qb ON pa.sample_id = qb.sample_id)
        SELECT j.sample_id, a AS n_predicted, b AS n_true, round(coalesce(i, 0) / (a + b - coalesce(i, 0)), 6) AS jaccard, round(coalesce(i, 0) / nullif(a, 0), 6) AS precision, round(coalesce(i, 0) / nullif(b, 0), 6) AS recall
        FROM j LEFT JOIN ix ON j.sample_id = ix.sample_id""",
    "a_wilson": f"WITH {_T}, g AS (SELECT method, count(*) AS n, count(*) FILTER (right_genus) AS k FROM f GROUP BY method) SELECT method, n, k, round(greatest(0, {_WL}), 6) AS low, round(least(1, {_WH}), 6) AS high FROM g",
    "c_fit_tied": _fit("k / n >= target_precision"),
    "c_fit_wilson": _fit(f"greatest(0, {_WL}) >= target_precision AND n >= 10"),
    "c_fit_rowwise": f"""WITH {_T}, c AS (SELECT method, s, count(*) OVER w AS n, count(*) FILTER (right_species) OVER w AS k FROM f WINDOW w AS (PARTITION BY method ORDER BY s DESC, sample_id NULLS FIRST, query_processid NULLS FIRST ROWS UNBOUNDED PRECEDING)),
        j AS (SELECT * FROM c, {_TG}) SELECT method, target_precision, max_by(s, n) FILTER (k / n >= target_precision) AS threshold, coalesce(max(n) FILTER (k / n >= target_precision), 0) AS n_accepted FROM j GROUP BY ALL""",
    "c_deepest_rank": f"WITH {_POL} SELECT {_KS}, target_precision, assigned_rank, rt AS right FROM pp",
    "c_policy_thresholds": f"WITH {_FIT} SELECT method, rank, target_precision, round(threshold, 6) AS threshold, n_accepted, n_correct FROM th",
    "a_rank_hits": f"""WITH {_RV}, h AS ("""
    + " UNION ALL ".join(f"SELECT method, sample_id, query_processid, '{r}' AS rank, coalesce(min(place) FILTER (v_{r} = t_{r}), 1000000) AS h FROM rv GROUP BY ALL" for r in RANKS)
    + """) SELECT method, rank, k, count(*) AS n_queries, round(avg(CASE WHEN h <= k THEN 1 ELSE 0 END), 6) AS hit_rate FROM h, (SELECT unnest([1, 3, 5]::BIGINT[]) AS k) GROUP BY ALL""",
    "a_rank_consensus": f"WITH {_FEAT} SELECT {_KS}, " + ", ".join(f"first_{r}, round(c_{r}, 6) AS {r}_consensus, right_{r}" for r in RANKS) + " FROM fe",
    "a_policy_summary": f"""WITH {_POL} SELECT method, target_precision, count(*) AS n_queries, count(*) FILTER (assigned_rank <> 'no_call') AS n_assigned, round(avg(CASE WHEN assigned_rank <> 'no_call' THEN 1 ELSE 0 END), 6) AS coverage,
        round(avg(CASE WHEN assigned_rank <> 'no_call' THEN CAST(rt AS INT) END), 6) AS precision, count(*) FILTER (assigned_rank = 'species' AND NOT rt) AS n_false_species,
        count(*) FILTER (assigned_rank = 'species') AS n_species, count(*) FILTER (assigned_rank = 'genus') AS n_genus, count(*) FILTER (assigned_rank = 'family') AS n_family, count(*) FILTER (assigned_rank = 'order') AS n_order FROM pp GROUP BY method, target_precision""",
    "a_coverage_curve": f"""WITH {_T}, r AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY s DESC, sample_id NULLS FIRST, query_processid NULLS FIRST) AS rr, count(*) OVER (PARTITION BY method) AS nn FROM f),
        j AS (SELECT * FROM r, (SELECT unnest({POINTS}::DOUBLE[]) AS coverage)) SELECT method, coverage, count(*) AS n_accepted, round(avg(CAST(right_genus AS INT)), 6) AS accuracy FROM j
        WHERE rr <= greatest(1, CAST(round_even(nn * coverage, 0) AS BIGINT)) GROUP BY ALL""",
    "c_threshold_sweep": f"WITH {_T} SELECT cut, count(*) FILTER (s >= cut) AS n_accepted, count(*) FILTER (s >= cut AND right_genus) AS n_correct FROM f, (SELECT unnest({SWEEP}::DOUBLE[]) AS cut) GROUP BY cut",
    "c_species_disjoint": f"""WITH {_T}, h AS (SELECT f.*, seed, CAST(('0x' || substr(sha1(seed || ':' || true_genus), 1, 12)) AS BIGINT) / 281474976710656.0 < 0.5 AS fit FROM f, (SELECT unnest(range(30)) AS seed)),
        g AS (SELECT seed, s, count(*) AS n1, count(*) FILTER (right_genus) AS k1 FROM h WHERE fit GROUP BY ALL),
        c AS (SELECT seed, s, sum(n1) OVER w AS n, sum(k1) OVER w AS k FROM g WINDOW w AS (PARTITION BY seed ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
        th AS (SELECT seed, max_by(s, n) FILTER (k / n >= 0.9) AS th FROM c GROUP BY seed)
        SELECT h.seed, count(*) AS n, count(*) FILTER (coalesce(s >= th, false)) AS n_accepted, count(*) FILTER (coalesce(s >= th, false) AND right_genus) AS n_correct FROM h JOIN th ON h.seed = th.seed WHERE NOT fit GROUP BY h.seed""",
    "c_hash_split": """SELECT DISTINCT site20, CAST(CAST(('0x' || substr(sha1(site20), 1, 8)) AS BIGINT) % 2 AS INT) AS parity,
        round(CAST(('0x' || substr(sha1('candidate-posterior-nested-0:' || site20), 1, 12)) AS BIGINT) / 281474976710656.0, 9) AS fraction FROM sample_query_map WHERE site20 IS NOT NULL""",
    "c_nested_parts": f"""WITH {_T}, u AS (SELECT CAST(('0x' || substr(sha1('nested-1:' || sample_id), 1, 12)) AS BIGINT) / 281474976710656.0 AS u FROM f)
        SELECT CASE WHEN u < 0.5 THEN 'fit' WHEN u < 0.75 THEN 'threshold' ELSE 'evaluation' END AS part, count(*) AS n FROM u GROUP BY ALL""",
    "c_backoff": f"""WITH {_T}, c AS (SELECT method, sample_id, query_processid, 0 AS l, 'species' AS rank, candidate_tree_label AS call, s FROM f WHERE s >= 0.95 UNION ALL SELECT method, sample_id, query_processid, 1, 'genus', genus, s FROM f WHERE s >= 0.7)
        SELECT sample_id, query_processid, rank, call FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, query_processid ORDER BY l, s DESC, call) AS rr FROM c WHERE sample_id IS NOT NULL AND query_processid IS NOT NULL) WHERE rr = 1""",
    "c_source_agreement": f"""WITH {_FEAT}, x AS (SELECT * FROM fe WHERE method = 'ssm_plain' AND sample_id IS NOT NULL AND query_processid IS NOT NULL), y AS (SELECT * FROM fe WHERE method = 'kmer_rls' AND sample_id IS NOT NULL AND query_processid IS NOT NULL)
        SELECT CASE WHEN x.first_species = y.first_species THEN 'species' WHEN x.first_genus = y.first_genus THEN 'genus' WHEN x.first_family = y.first_family THEN 'family' WHEN x.first_order = y.first_order THEN 'order' ELSE 'no_call' END AS rank, count(*) AS n
        FROM x FULL JOIN y ON x.sample_id = y.sample_id AND x.query_processid = y.query_processid GROUP BY ALL""",
    "c_set_valued": f"""WITH {_T}, h AS (SELECT {_KS}, min(place) FILTER (candidate_tree_label = truth) AS h, count(*) AS n FROM t WHERE truth IS NOT NULL GROUP BY ALL),
        g AS (SELECT method, size, avg(CASE WHEN coalesce(h, 1000000) <= size THEN 1 ELSE 0 END) AS coverage, avg(least(n, size)) AS mean_size FROM h, (SELECT unnest([1, 2, 3, 4, 5]) AS size) GROUP BY ALL)
        SELECT method, CAST(size AS BIGINT) AS size, round(coverage, 6) AS coverage, round(mean_size, 6) AS mean_size FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY mean_size, coverage DESC, size) AS rr FROM g WHERE coverage >= 0.5) WHERE rr = 1""",
    "c_reason_codes": f"""WITH {_POL} SELECT method, target_precision, coalesce(array_to_string([CASE WHEN assigned_rank = 'species' THEN 'species_supported' END, CASE WHEN assigned_rank IN ('species', 'genus') THEN 'genus_supported' END,
        CASE WHEN c_genus < 0.8 THEN 'genus_ambiguous' END, CASE WHEN s1 < 0.5 THEN 'low_score' END, CASE WHEN m_species IS NULL THEN 'no_second' END], ';'), '') AS reasons, count(*) AS n FROM pp GROUP BY ALL""",
    "t_rerank_window": f"""WITH {_T}, e AS (SELECT {_KS}, candidate_tree_label, max(blast_candidate_pident) AS p FROM {_ECO} WHERE blast_candidate_pident IS NOT NULL GROUP BY ALL),
        j AS (SELECT t.*, 100 - {_F1.format('p')} AS d FROM t LEFT JOIN e ON t.method = e.method AND t.sample_id = e.sample_id AND t.query_processid = e.query_processid AND t.candidate_tree_label = e.candidate_tree_label)
        SELECT {_KS}, candidate_tree_label, place, row_number() OVER (PARTITION BY {_KS} ORDER BY place > 3, CASE WHEN place <= 3 THEN coalesce(d, 'infinity'::DOUBLE) END NULLS LAST, place) AS new_place FROM j""",
    "e_combined_rerank": f"""WITH {_T}, e AS (SELECT {_KS}, candidate_tree_label, max({_F1.format('rls_prior_count')}) AS x, max({_F1.format('obis_prior_count')}) AS y FROM {_ECO} GROUP BY ALL)
        SELECT t.method, t.sample_id, t.query_processid, t.candidate_tree_label, round(s + 0.05 * (ln(1 + greatest(coalesce(x, 0), 0)) + ln(1 + greatest(coalesce(y, 0), 0))) - CASE WHEN greatest(coalesce(x, 0), 0) <= 0 AND greatest(coalesce(y, 0), 0) <= 0 THEN 0.03 ELSE 0 END, 6) AS combined_score
        FROM t JOIN e ON t.method = e.method AND t.sample_id = e.sample_id AND t.query_processid = e.query_processid AND t.candidate_tree_label = e.candidate_tree_label""",
    "x_competition_rank": f"""WITH {_T}, x AS (SELECT *, max(s) FILTER (genus = true_genus) OVER (PARTITION BY {_KS}) AS bb FROM t) SELECT {_KS}, count(*) FILTER (s > bb) + 1 AS target_rank FROM x WHERE bb IS NOT NULL GROUP BY ALL""",
    "x_feature_drift": "WITH l AS (" + " UNION ALL ".join(f"SELECT '{lv}' AS level, method, '{c}' AS feature, {_F1.format(c)} AS v FROM {_ECO} WHERE {w}" for c in DRIFT for lv, w in (("rows", "true"), ("first", "candidate_rank = 1"))) + """),
        g AS (SELECT level, method, feature, count(*) AS n, 1 - count(v) / count(*) AS ms, avg(v) AS m, stddev_pop(v) AS sd, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.05) AS p5, quantile_cont(v, 0.95) AS p95 FROM l GROUP BY ALL), b AS (SELECT level, feature, m AS bm, sd AS bs FROM g WHERE method = 'ssm_plain')
        SELECT level, method, feature, n, round(ms, 5) AS missing_share, round(m, 5) AS mean, round(sd, 5) AS std, round(p50, 5) AS median, round(p5, 5) AS p05, round(p95, 5) AS p95, round((m - bm) / nullif(bs, 0), 5) AS delta FROM g LEFT JOIN b USING (level, feature)""",
    "x_weighted_top_label": f"""WITH {_T}, g AS (SELECT query_processid, candidate_tree_label, round(sum(s), 6) AS weight FROM t WHERE query_processid IS NOT NULL GROUP BY ALL)
        SELECT query_processid, candidate_tree_label, weight FROM (SELECT *, row_number() OVER (PARTITION BY query_processid ORDER BY weight DESC, candidate_tree_label) AS rr FROM g) WHERE rr = 1""",
    "p_method_parts": f"""WITH m AS (SELECT DISTINCT method, lower(method) AS m FROM {_ECO}), p AS (SELECT *, CASE WHEN contains(m, 'rls_obis') THEN 'rls_obis' WHEN contains(m, 'rls') THEN 'rls' WHEN contains(m, 'obis') THEN 'obis' WHEN contains(m, 'cooc') THEN 'cooc' ELSE 'none' END AS prior_kind FROM m)
        SELECT method, CASE WHEN m LIKE 'kmer%' THEN 'kmer' WHEN m LIKE 'cnn%' THEN 'cnn' WHEN m LIKE 'ssm%' THEN 'ssm' WHEN m LIKE 'blast%' THEN 'blast' ELSE 'other' END AS encoder_kind, prior_kind,
        CASE WHEN contains(m, 'cooc') THEN 'sample' WHEN prior_kind <> 'none' THEN 'prior' ELSE 'sequence' END AS context_kind FROM p""",
    "u_candidate_sets": f"""WITH {_T}, xx AS (SELECT method, query_processid, candidate_tree_label AS v, min(place) AS p FROM t WHERE method IN ('ssm_plain', 'cnn_cooc') AND query_processid IS NOT NULL GROUP BY ALL),
        ll AS (SELECT method, query_processid, list(v ORDER BY p, v) AS l FROM xx GROUP BY ALL), jj AS (SELECT x.query_processid, x.l AS a, y.l AS b FROM ll x JOIN ll y ON x.method = 'ssm_plain' AND y.method = 'cnn_cooc' AND x.query_processid = y.query_processid),
        uu AS (SELECT query_processid, list_concat(a, list_filter(b, lambda z: NOT list_contains(a, z))) AS u, list_filter(a, lambda z: list_contains(b, z)) AS i FROM jj)
        SELECT query_processid, len(u) AS n_union, len(i) AS n_common, array_to_string(u, '|') AS all_labels, coalesce(array_to_string(i, '|'), '') AS common_labels FROM uu""",
    "a_auroc": f"""WITH {_T}, g AS (SELECT method, s, count(*) FILTER (right_genus) AS p, count(*) AS n FROM f GROUP BY ALL),
        r AS (SELECT *, sum(n) OVER (PARTITION BY method ORDER BY s ROWS UNBOUNDED PRECEDING) - n + (n + 1) / 2 AS rk FROM g),
        z AS (SELECT method, CAST(sum(p) AS BIGINT) AS np, CAST(sum(n - p) AS BIGINT) AS nn, sum(rk * p) AS rs FROM r GROUP BY method)
        SELECT method, np AS n_positive, nn AS n_negative, round((rs - np * (np + 1) / 2) / nullif(np * nn, 0), 6) AS auroc FROM z""",
    "a_spearman": f"""WITH o AS (SELECT method, {_F1.format('candidate_score')} AS x, {_F1.format('sequence_only_score')} AS y FROM {_ECO}), p AS (SELECT * FROM o WHERE x IS NOT NULL AND y IS NOT NULL),
        q AS (SELECT *, rank() OVER (PARTITION BY method ORDER BY x) + (count(*) OVER (PARTITION BY method, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY method ORDER BY y) + (count(*) OVER (PARTITION BY method, y) - 1) / 2 AS ry FROM p)
        SELECT method, count(*) AS n, round(corr(rx, ry), 5) AS spearman, round(corr(x, y), 5) AS pearson FROM q GROUP BY method""",
    "a_strata": f"WITH {_T} SELECT coalesce(method, 'all') AS method, count(*) AS n, count(*) FILTER (right_genus) AS n_right FROM f GROUP BY GROUPING SETS ((method), ())",
    "a_enrichment": f"""WITH {_T}, p AS (SELECT genus_from_label AS gg, count(*) AS m FROM candidate_species WHERE genus_from_label IS NOT NULL GROUP BY ALL), nn AS (SELECT sum(m) AS nn FROM p),
        q AS (SELECT {_KS}, true_genus, avg(CASE WHEN genus = true_genus THEN 1 ELSE 0 END) AS observed FROM t WHERE truth IS NOT NULL GROUP BY ALL)
        SELECT {_KS}, round(observed, 6) AS observed, round(m / nn, 9) AS expected, round(observed / (m / nn), 4) AS enrichment FROM q JOIN p ON q.true_genus = p.gg, nn""",
    "a_regression_residual": f"""WITH o AS (SELECT {_F1.format('sequence_only_score')} AS x, {_F1.format('candidate_score')} AS y FROM {_ECO}), p AS (SELECT * FROM o WHERE x IS NOT NULL AND y IS NOT NULL), l AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM p)
        SELECT CAST(CASE WHEN x <= 0.2 THEN 0 WHEN x <= 0.4 THEN 1 WHEN x <= 0.6 THEN 2 WHEN x <= 0.8 THEN 3 ELSE 4 END AS BIGINT) AS bin, count(*) AS n, round(avg(x), 5) AS mean_x, round(avg(y), 5) AS mean_y, round(avg(y - (a * x + b)), 5) AS mean_residual FROM p, l GROUP BY ALL""",
    "a_repeat_percentiles": f"""WITH {_T}, g AS (SELECT method, sample_id, avg(s) AS m FROM f GROUP BY ALL)
        SELECT method, count(m) AS n, round(avg(m) + 1e-9::DOUBLE, 5) AS mean, round(CASE WHEN count(m) = 1 THEN 0.0 ELSE stddev_samp(m) END + 1e-9::DOUBLE, 5) AS std, round(min(m) + 1e-9::DOUBLE, 5) AS least, round(max(m) + 1e-9::DOUBLE, 5) AS most,
        round(quantile_cont(m, 0.05) + 1e-9::DOUBLE, 5) AS p05, round(quantile_cont(m, 0.95) + 1e-9::DOUBLE, 5) AS p95 FROM g GROUP BY method""",
}
