"""Further queries: gates, bins, random splits, overrides, look-ups, agreement of sources, tree recovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankforge.functions import exprs as X
from rankforge.operators import candidates as C
from rankforge.operators import records as R
from rankforge.operators import statistics as S
from rankforge.operators import trees as T
from rankforge.plans.candidate_queries import _ECO, _F1, _T, _eco, _first, _top
from rankforge.plans.evidence_queries import _CL, _closure, _dist
from rankforge.plans.record_queries import TR, UN, _clean
from rankforge.operators.ordering import global_places
from rankforge.runtime import keep, table

GATES = [("score_high", "candidate_score", 0.9), ("score_mid", "candidate_score", 0.6), ("sequence_high", "sequence_only_score", 0.9)]


def p_gates(spark, d):
    """Rows that pass each gate; rows without a value pass none."""
    e = _eco(spark, d)
    aggs = [F.count(F.when(C.meets(c, F.lit(t)), 1)).alias(n) for n, c, t in GATES]
    row = e.agg(F.count(F.lit(1)).alias("all_rows"), *aggs)
    return row.unpivot([], row.columns, "gate", "n_rows")


def w_equal_bins(spark, d):
    """Five bins of equal count by score within each method, ties in the order of the keys."""
    f = _first(spark, d)
    p = keep(global_places(f, ["method", "candidate_score", "sample_id", "query_processid"]))
    # a method's rows follow one another, so its own places begin after the least
    m = p.groupBy("method").agg((F.min("place") - 1).alias("before"), F.count(F.lit(1)).alias("in_method")).withColumnRenamed("method", "m")
    x = p.join(m, F.col("method").eqNullSafe(F.col("m")))
    b = x.withColumn("bin", F.floor((F.col("place") - F.col("before") - 1) * 5 / F.col("in_method").cast("double")).cast("long"))
    return b.groupBy("method", "bin").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("right_genus"), 1)).alias("n_right"))


def b_random_split(spark, d):
    """Species in three splits by ranked hash: 70, 15 and 15 in 100, cut at the shares of their places."""
    s = _clean(spark, d).where("species_name is not null").select("species_name").distinct()
    p = keep(global_places(s, [X.hash_fraction("species_name", "random-1"), "species_name"]))
    at = (F.col("place") - 1) / F.lit(float(max(p.count(), 1)))
    return p.select("species_name", F.when(at < 0.7, "train").when(at < 0.85, "validation").otherwise("test").alias("split"))


def a_finite_stats(spark, d):
    v = X.finite("blast_candidate_pident")
    g = _eco(spark, d).groupBy("method").agg(F.count(v).alias("n"), F.min(v).alias("least"), F.avg(v).alias("mean"), F.max(v).alias("most"), F.percentile(v, 0.5).alias("median"))
    return g.select("method", "n", "least", F.round(F.col("mean") + 1e-9, 5).alias("mean"), "most", F.round(F.col("median") + 1e-9, 5).alias("median"))


def x_top_shift(spark, d):
    """The two features that shift most in each method against the baseline."""
    x = C.feature_drift(_eco(spark, d), "method", "ssm_plain", ["candidate_score", "sequence_only_score", "rls_prior_count", "obis_prior_count"]).where("delta is not null and method <> 'ssm_plain'")
    return C.ranked(x, ["method"], [F.desc(F.round(F.abs("delta"), 6)), F.asc("feature")], 2).select("method", F.col("place").cast("long").alias("place"), "feature")


def x_source_override(spark, d):
    """One row per processid over the three tables, the last table's winning."""
    rows = None
    for i, n in enumerate(("supervised_train", "eval_c_unseen_species", "unseen")):
        y = table(spark, d, n).where("processid is not null").select("processid", F.lit(n).alias("root"), F.lit(i).alias("i"))
        rows = y if rows is None else rows.unionByName(y)
    return R.keep_first(rows, ["processid"], [F.desc("i")]).groupBy("root").agg(F.count(F.lit(1)).alias("n"))


def x_metric_lookup(spark, d):
    """Counts of the rank of the true genus among a method's candidates, one column a place."""
    t = _top(spark, d).where("genus = true_genus").groupBy("method", "sample_id", "query_processid").agg(F.min("place").alias("place"))
    return t.groupBy("method").pivot("place", [1, 2, 3]).agg(F.count(F.lit(1))).fillna(0).select("method", *[F.col(str(i)).alias(f"at_{i}") for i in (1, 2, 3)])


def e_best_by_rank(spark, d):
    """Each query's best evidence for its true genus over all methods and samples."""
    t = _top(spark, d).where("genus = true_genus and query_processid is not null")
    b = t.groupBy("query_processid").agg(F.max(F.struct("candidate_score", "candidate_tree_label")).alias("x"))
    return b.select("query_processid", F.col("x.candidate_score").alias("score"), F.col("x.candidate_tree_label").alias("label"))


def u_side_overlap(spark, d):
    """Genera of the training and the unseen records: both, only one."""
    a = _clean(spark, d).where("genus_name is not null").select("genus_name", F.lit(1).alias("a")).distinct()
    b = _clean(spark, d, "unseen").where("genus_name is not null").select("genus_name", F.lit(1).alias("b")).distinct()
    j = a.join(b, "genus_name", "full")
    return j.agg(F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("n_both"), F.count(F.when(F.col("b").isNull(), 1)).alias("n_only_train"), F.count(F.when(F.col("a").isNull(), 1)).alias("n_only_unseen"))


def c_gap_guard(spark, d):
    """Deepest rank by score, where ranks whose taxon lacks a reference are passed over."""
    ref = table(spark, d, "candidate_species").select(F.col("tree_label").alias("candidate_tree_label"), F.coalesce("has_reference_sequence", F.lit(False)).alias("has_ref"))
    f = _first(spark, d).join(ref, "candidate_tree_label", "left")
    ok = F.coalesce("has_ref", F.lit(False))
    rank = X.deepest({"species": ok & C.meets("candidate_score", F.lit(0.9)), "genus": C.meets("candidate_score", F.lit(0.6))})
    return f.groupBy("method", rank.alias("rank")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("right_genus"), 1)).alias("n_right_genus"))


def c_pair_agreement(spark, d):
    """Confidence of agreement of two methods: the lower score where both name the same genus, else 0."""
    f = _first(spark, d).where("sample_id is not null and query_processid is not null")
    a, b = (f.where(F.col("method") == m).select("sample_id", "query_processid", F.col("genus").alias(f"g{i}"), F.col("candidate_score").alias(f"s{i}")) for i, m in enumerate(("ssm_plain", "cnn_cooc")))
    j = a.join(b, ["sample_id", "query_processid"])
    return j.select("sample_id", "query_processid", F.when(F.col("g0") == F.col("g1"), F.least("s0", "s1")).otherwise(0.0).alias("confidence"))


def g_tree_recovery(spark, d):
    """Rank correlation of a candidate's score with its path distance to the truth, by method."""
    t = _top(spark, d).where("truth is not null").select("method", F.col("candidate_tree_label").alias("a"), F.col("truth").alias("b"), "candidate_score")
    x = T.path_distance(t, _closure(spark, d)).withColumn("near", -F.col("distance"))
    return S.spearman(x, "candidate_score", "near", ["method"]).select("method", "n", F.round("spearman", 5).alias("spearman"))


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and len(k) > 2 and k[1] == "_" and k[0] in "pwbaxeucg"}

_CLEANSP = f"(SELECT DISTINCT species_name FROM {TR} WHERE species_name IS NOT NULL)"
ORACLE = {
    "p_gates": f"SELECT 'all_rows' AS gate, count(*) AS n_rows FROM {_ECO} " + " ".join(f"UNION ALL SELECT '{n}', count(*) FILTER ({_F1.format(c)} >= {t}) FROM {_ECO}" for n, c, t in GATES),
    "w_equal_bins": f"""WITH {_T}, x AS (SELECT *, (row_number() OVER (PARTITION BY method ORDER BY s, sample_id NULLS FIRST, query_processid NULLS FIRST) - 1) * 5 / count(*) OVER (PARTITION BY method) AS bb FROM f)
        SELECT method, CAST(floor(bb) AS BIGINT) AS bin, count(*) AS n, count(*) FILTER (right_genus) AS n_right FROM x GROUP BY ALL""",
    "b_random_split": f"""WITH p AS (SELECT species_name, (row_number() OVER (ORDER BY CAST(('0x' || substr(sha1('random-1:' || species_name), 1, 12)) AS BIGINT), species_name) - 1) / count(*) OVER () AS p FROM {_CLEANSP})
        SELECT species_name, CASE WHEN p < 0.7::DOUBLE THEN 'train' WHEN p < 0.85::DOUBLE THEN 'validation' ELSE 'test' END AS split FROM p""",
    "a_finite_stats": f"""WITH x AS (SELECT method, {_F1.format('blast_candidate_pident')} AS v FROM {_ECO}) SELECT method, count(v) AS n, min(v) AS least, round(avg(v) + 1e-9::DOUBLE, 5) AS mean, max(v) AS most, round(quantile_cont(v, 0.5) + 1e-9::DOUBLE, 5) AS median FROM x GROUP BY method""",
    "x_top_shift": "WITH l AS (" + " UNION ALL ".join(f"SELECT method, '{c}' AS feature, {_F1.format(c)} AS v FROM {_ECO}" for c in ("candidate_score", "sequence_only_score", "rls_prior_count", "obis_prior_count")) + """),
        g AS (SELECT method, feature, avg(v) AS m, stddev_pop(v) AS sd FROM l GROUP BY ALL), b AS (SELECT feature, m AS bm, sd AS bs FROM g WHERE method = 'ssm_plain'),
        x AS (SELECT method, feature, (m - bm) / nullif(bs, 0) AS delta FROM g JOIN b USING (feature) WHERE method <> 'ssm_plain')
        SELECT method, place, feature FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY round(abs(delta), 6) DESC, feature) AS place FROM x WHERE delta IS NOT NULL) WHERE place <= 2""",
    "x_source_override": """WITH t AS (SELECT processid, 'supervised_train' AS root, 0 AS i FROM supervised_train UNION SELECT processid, 'eval_c_unseen_species', 1 FROM eval_c_unseen_species UNION SELECT processid, 'unseen', 2 FROM unseen)
        SELECT root, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY processid ORDER BY i DESC) AS r FROM t WHERE processid IS NOT NULL) WHERE r = 1 GROUP BY root""",
    "x_metric_lookup": f"""WITH {_T}, p AS (SELECT method, sample_id, query_processid, min(place) AS place FROM t WHERE genus = true_genus GROUP BY ALL)
        SELECT method, count(*) FILTER (place = 1) AS at_1, count(*) FILTER (place = 2) AS at_2, count(*) FILTER (place = 3) AS at_3 FROM p GROUP BY method""",
    "e_best_by_rank": f"""WITH {_T} SELECT query_processid, s AS score, candidate_tree_label AS label FROM (SELECT *, row_number() OVER (PARTITION BY query_processid ORDER BY s DESC, candidate_tree_label DESC) AS rr FROM t WHERE genus = true_genus AND query_processid IS NOT NULL) WHERE rr = 1""",
    "u_side_overlap": f"""WITH x AS (SELECT DISTINCT genus_name AS g FROM {TR} WHERE genus_name IS NOT NULL), y AS (SELECT DISTINCT genus_name AS h FROM {UN} WHERE genus_name IS NOT NULL)
        SELECT count(*) FILTER (g IS NOT NULL AND h IS NOT NULL) AS n_both, count(*) FILTER (h IS NULL) AS n_only_train, count(*) FILTER (g IS NULL) AS n_only_unseen FROM x FULL JOIN y ON g = h""",
    "c_gap_guard": f"""WITH {_T}, x AS (SELECT f.*, coalesce(has_reference_sequence, false) AS ok FROM f LEFT JOIN candidate_species c ON c.tree_label = candidate_tree_label)
        SELECT method, CASE WHEN ok AND s >= 0.9 THEN 'species' WHEN s >= 0.6 THEN 'genus' ELSE 'no_call' END AS rank, count(*) AS n, count(*) FILTER (right_genus) AS n_right_genus FROM x GROUP BY ALL""",
    "c_pair_agreement": f"""WITH {_T}, x AS (SELECT * FROM f WHERE sample_id IS NOT NULL AND query_processid IS NOT NULL) SELECT a.sample_id, a.query_processid, CASE WHEN a.genus = b.genus THEN least(a.s, b.s) ELSE 0.0 END AS confidence
        FROM x a JOIN x b ON a.method = 'ssm_plain' AND b.method = 'cnn_cooc' AND a.sample_id = b.sample_id AND a.query_processid = b.query_processid""",
    "g_tree_recovery": f"""WITH {_T}, {_CL}, pairs AS (SELECT DISTINCT candidate_tree_label AS a, truth AS b FROM t WHERE truth IS NOT NULL), {_dist('pairs')},
        p AS (SELECT method, s AS x, -distance AS y FROM t JOIN dd ON candidate_tree_label = a AND truth = dd.b WHERE distance IS NOT NULL),
        q AS (SELECT *, rank() OVER (PARTITION BY method ORDER BY x) + (count(*) OVER (PARTITION BY method, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY method ORDER BY y) + (count(*) OVER (PARTITION BY method, y) - 1) / 2 AS ry FROM p)
        SELECT method, count(*) AS n, round(corr(rx, ry), 5) AS spearman FROM q GROUP BY method""",
}
