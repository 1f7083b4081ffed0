"""Queries on variants: gates of other kinds, policy features, hits by sample at several ranks, hybrids, ablation, picks, random samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rankforge.functions import exprs as X
from rankforge.operators import candidates as C
from rankforge.operators import records as R
from rankforge.plans.candidate_queries import _ECO, _F1, _KS, _POL, _RV, _T, K, _eco, _first, _policy, _ranked, _top
from rankforge.plans.record_queries import TR, UN, _clean, _frac
from rankforge.runtime import table

CUTS = [90.0, 95.0, 97.0, 99.0]


def p_gate_kinds(spark, d):
    """Rows let through by gates of each kind; a gate at a quantile keeps rows without a value, as rows that nothing was called for."""
    v = X.finite("candidate_score")
    e = _eco(spark, d)
    at = e.agg(F.percentile(v, 0.9).alias("q")).first()["q"]
    x = e.agg(F.count(F.when(v <= 0.5, 1)).alias("at_most"), F.count(F.when(F.col("candidate_rank") == 1, 1)).alias("equal"), F.count(F.when(v >= F.lit(at), 1)).alias("quantile"), F.count(F.when(v.isNull() | (v >= F.lit(at)), 1)).alias("quantile_or_none"))
    return x.unpivot([], x.columns, "gate", "n_rows")


def x_policy_features(spark, d):
    """What a method's name tells, and the clipped logit of its mean score."""
    g = _eco(spark, d).where("method is not null").groupBy("method").agg(F.avg(X.finite("candidate_score")).alias("p"))
    flags = [F.lower("method").contains(w).alias(f"has_{w}") for w in ("rls", "obis", "cooc", "tree")]
    return g.select("method", *flags, F.round(X.clipped_logit("p"), 5).alias("logit"))


def a_sample_scores(spark, d):
    """Overlap of predicted and true sets of each sample, by rank and depth, averaged."""
    true = table(spark, d, "sample_query_map").where("true_tree_label is not null and sample_id is not null").select("sample_id", F.col("true_tree_label").alias("species"), X.genus_of_label("true_tree_label").alias("genus"))
    top = _top(spark, d).where("sample_id is not null").select("sample_id", "place", F.col("candidate_tree_label").alias("species"), "genus")
    out = None
    for rank in ("species", "genus"):
        for k in (1, 3):
            x = C.set_scores(top.where(F.col("place") <= k).select("sample_id", rank), true.select("sample_id", rank), "sample_id", rank)
            y = x.agg(F.count(F.lit(1)).alias("n_samples"), F.round(F.avg("jaccard"), 6).alias("jaccard"), F.round(F.avg("n_predicted"), 5).alias("richness")).select(F.lit(rank).alias("rank"), F.lit(k).cast("long").alias("k"), "*")
            out = y if out is None else out.unionByName(y)
    return out


def c_hybrid_sweep(spark, d):
    """First candidates of one method where their identity reaches a cut, else of another method."""
    ident = _eco(spark, d).groupBy(*K, "candidate_tree_label").agg(F.max(X.finite("blast_candidate_pident")).alias("pident"))
    t = _top(spark, d).where("place = 1 and truth is not null and sample_id is not null and query_processid is not null").join(ident, [*K, "candidate_tree_label"], "left")
    one = lambda m, p: t.where(F.col("method") == m).select("sample_id", "query_processid", (F.col("candidate_tree_label") == F.col("truth")).alias(f"{p}_right"), F.col("pident").alias(f"{p}_pident"))
    j = one("ssm_plain", "a").join(one("cnn_cooc", "b").drop("b_pident"), ["sample_id", "query_processid"])
    g = j.withColumn("cut", F.explode(F.array(*[F.lit(c) for c in CUTS])))
    near = F.coalesce(F.col("a_pident") >= F.col("cut"), F.lit(False))
    return g.groupBy("cut").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(near, 1)).alias("n_near"), F.count(F.when(F.when(near, F.col("a_right")).otherwise(F.col("b_right")), 1)).alias("n_right"))


def a_hidden_rank(spark, d):
    """Place of the first candidate of the true family once those of the true species, and those of the true genus, are hidden."""
    t = _ranked(spark, d)
    out = None
    for hide in ("species", "genus"):
        left = t.where(F.coalesce(F.col(f"value_{hide}") != F.col(f"truth_{hide}"), F.lit(True)))
        r = C.ranked(left, K, [F.asc("place")], name="new_place").where("value_family = truth_family").groupBy(*K).agg(F.min("new_place").alias("p"))
        y = r.groupBy("method").agg(F.count(F.lit(1)).alias("n_hit"), F.count(F.when(F.col("p") == 1, 1)).alias("n_first")).withColumn("hidden", F.lit(hide))
        out = y if out is None else out.unionByName(y)
    return out


def r_reference_lengths(spark, d):
    """Of each species the longest record, and the one of median length; ties to the smaller processid."""
    x = _clean(spark, d).where("seq_len > 0 and species_name is not null and processid is not null").groupBy("species_name", "processid").agg(F.max("seq_len").alias("n"))
    m = x.groupBy("species_name").agg(F.percentile("n", 0.5).alias("median"), F.min(F.struct((-F.col("n")).alias("n"), "processid")).alias("long"))
    near = x.join(m.select("species_name", "median"), "species_name").groupBy("species_name").agg(F.min(F.struct(F.abs(F.col("n") - F.col("median")).alias("off"), "processid")).alias("mid"))
    return m.join(near, "species_name").select("species_name", F.col("long.processid").alias("longest"), F.col("mid.processid").alias("median"))


def g_backbone_random(spark, d):
    """A third of the labels by hash, without regard to families."""
    return table(spark, d, "candidate_species").where("tree_label is not null").select("tree_label").distinct().where(X.hash_fraction("tree_label", "backbone-2") < 0.3)


def u_side_metrics(spark, d):
    """Genera of the training side against the unseen side: shares in common, and of the complement of either side in the list."""
    side = lambda n, c: _clean(spark, d, n).where("genus_name is not null").select("genus_name", F.lit(1).alias(c)).distinct()
    listed = table(spark, d, "candidate_species").where("genus_name is not null").select("genus_name", F.lit(1).alias("c")).distinct()
    j = listed.join(side("supervised_train", "a"), "genus_name", "full").join(side("unseen", "b"), "genus_name", "full")
    both, some = F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)), F.count(F.coalesce("a", "b"))
    neither = F.count(F.when(F.col("a").isNull() & F.col("b").isNull(), 1))
    return j.agg(both.alias("n_common"), F.round(both / some, 6).alias("jaccard"), neither.alias("n_complement"))


def w_place_share(spark, d):
    """Cumulative share of a method's first candidates by score, at each hundredth of a point."""
    g = _top(spark, d).where("place = 1").groupBy("method", F.round("candidate_score", 2).alias("score")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("method")
    return g.select("method", (F.col("score") + 0.0).alias("score"), F.round(F.sum("n").over(w.orderBy("score").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(w), 6).alias("share"))


def a_dedup_id_then_sequence(spark, d):
    """First load of each id, then of each sequence among these."""
    x = _clean(spark, d).where("processid is not null and seq_len > 0").select("processid", "nucleotides", "loaded_at")
    one = R.keep_first(x, ["processid"], [F.asc("loaded_at"), F.asc("nucleotides")])
    return R.keep_first(one, ["nucleotides"], [F.asc("loaded_at"), F.asc("processid")]).select("processid", F.unix_micros("loaded_at").alias("loaded_us"))


def a_event_abundance(spark, d):
    """Labels of each sample with their quantity, a read count that is not above 0 counting as 1, as one text in the order of the labels."""
    q = F.when(F.col("read_count") > 0, F.col("read_count")).otherwise(1)
    x = table(spark, d, "sample_query_map").where("sample_id is not null and true_tree_label is not null").groupBy("sample_id", "true_tree_label").agg(F.sum(q).alias("q"))
    m = x.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("true_tree_label", "q"))).alias("m"))
    return m.select("sample_id", F.size("m").cast("long").alias("n_labels"), F.array_join(F.transform("m", lambda e: F.concat_ws("=", e["true_tree_label"], e["q"].cast("string"))), ";").alias("abundance"))


def a_repeat_targets(spark, d):
    """Precision of thirty draws of half the genera, fitted for 0.7: mean, spread, and the share of draws that meet the target on the other half."""
    h = C.disjoint_halves(_first(spark, d), "true_genus", 30)
    fit = C.fit_thresholds(h.where("half = 'fit'"), ["seed"], "candidate_score", "right_genus", [0.7]).where("threshold is not null").select("seed", "threshold")
    a = h.where("half = 'apply'").join(F.broadcast(fit), "seed").where(C.meets("candidate_score", "threshold"))  # a row a draw
    p = a.groupBy("seed").agg(F.avg(F.col("right_genus").cast("int")).alias("p"))
    return p.agg(F.count(F.lit(1)).alias("n"), *[F.round(f("p"), 6).alias(n) for n, f in (("mean", F.avg), ("least", F.min), ("most", F.max))], F.round(F.percentile("p", 0.05), 6).alias("p05"), F.round(F.percentile("p", 0.95), 6).alias("p95"), F.round(F.avg((F.col("p") >= 0.7).cast("int")), 6).alias("met"))


def a_lineage_dominant(spark, d):
    """Per first candidate's family: calls, the rank assigned most, and its five species called most."""
    p = _policy(spark, d).where("target_precision = 0.8 and first_family is not null")
    act = C.ranked(p.groupBy("first_family", "assigned_rank").agg(F.count(F.lit(1)).alias("n")), ["first_family"], [F.desc("n"), F.asc("assigned_rank")], 1, "r").select("first_family", F.col("assigned_rank").alias("dominant"))
    sp = C.ranked(p.groupBy("first_family", "first_species").agg(F.count(F.lit(1)).alias("n")), ["first_family"], [F.desc("n"), F.asc("first_species")], 5, "r")
    top = sp.groupBy("first_family").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "first_species"))), lambda e: e["first_species"]), ";").alias("top_species"))
    n = p.groupBy("first_family").agg(F.count(F.lit(1)).alias("n_calls"))
    return n.join(act, "first_family").join(top, "first_family").withColumnRenamed("first_family", "family")


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and len(k) > 2 and k[1] == "_" and k[0] in "pxacrguw"}

_S = _F1.format("candidate_score")
_SETS = """(SELECT {r} AS rank, {k} AS k, count(*) AS n_samples, round(avg(CASE WHEN u > 0 THEN c / u ELSE 0 END), 6) AS jaccard, round(avg(np), 5) AS richness FROM (SELECT sample_id, count(*) FILTER (p) AS np, count(*) FILTER (p AND q) AS c, count(*) AS u FROM
    (SELECT sample_id, v, bool_or(p) AS p, bool_or(q) AS q FROM (SELECT sample_id, {pv} AS v, true AS p, false AS q FROM t WHERE place <= {k} AND sample_id IS NOT NULL UNION ALL SELECT sample_id, {tv}, false, true FROM sample_query_map WHERE true_tree_label IS NOT NULL AND sample_id IS NOT NULL) GROUP BY ALL) GROUP BY sample_id))"""
ORACLE = {
    "p_gate_kinds": f"""WITH e AS (SELECT {_S} AS v, candidate_rank AS r FROM {_ECO}), q AS (SELECT quantile_cont(v, 0.9) AS q FROM e) SELECT 'at_most' AS gate, count(*) FILTER (v <= 0.5) AS n_rows FROM e UNION ALL SELECT 'equal', count(*) FILTER (r = 1) FROM e
        UNION ALL SELECT 'quantile', count(*) FILTER (v >= q) FROM e, q UNION ALL SELECT 'quantile_or_none', count(*) FILTER (v IS NULL OR v >= q) FROM e, q""",
    "x_policy_features": f"""WITH g AS (SELECT method, least(greatest(avg({_S}), 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) AS p FROM {_ECO} WHERE method IS NOT NULL GROUP BY 1) SELECT method, contains(lower(method), 'rls') AS has_rls, contains(lower(method), 'obis') AS has_obis, contains(lower(method), 'cooc') AS has_cooc,
        contains(lower(method), 'tree') AS has_tree, round(ln(p / (1 - p)), 5) AS logit FROM g""",
    "a_sample_scores": f"WITH {_T} " + " UNION ALL ".join(f"SELECT * FROM {_SETS.format(r=repr(r), k=k, pv=pv, tv=tv)}" for r, pv, tv in (("species", "candidate_tree_label", "true_tree_label"), ("genus", "genus", "split_part(true_tree_label, '_', 1)")) for k in (1, 3)),
    "c_hybrid_sweep": f"""WITH {_T}, i AS (SELECT {_KS}, candidate_tree_label, max({_F1.format('blast_candidate_pident')}) AS p FROM {_ECO} GROUP BY ALL), x AS (SELECT t.method, t.sample_id, t.query_processid, t.candidate_tree_label = truth AS ok, p FROM t
            LEFT JOIN i ON i.method = t.method AND i.sample_id = t.sample_id AND i.query_processid = t.query_processid AND i.candidate_tree_label = t.candidate_tree_label WHERE place = 1 AND truth IS NOT NULL),
        j AS (SELECT a.p, a.ok AS ao, b.ok AS bo FROM x a JOIN x b ON a.method = 'ssm_plain' AND b.method = 'cnn_cooc' AND a.sample_id = b.sample_id AND a.query_processid = b.query_processid)
        SELECT cut, count(*) AS n, count(*) FILTER (coalesce(p >= cut, false)) AS n_near, count(*) FILTER (CASE WHEN coalesce(p >= cut, false) THEN ao ELSE bo END) AS n_right FROM j, (SELECT unnest({CUTS}::DOUBLE[]) AS cut) GROUP BY cut""",
    "a_hidden_rank": f"WITH {_RV}" + "".join(f""", h_{h} AS (SELECT *, row_number() OVER (PARTITION BY {_KS} ORDER BY place) AS np FROM rv WHERE coalesce(v_{h} <> t_{h}, true)), g_{h} AS (SELECT {_KS}, min(np) AS p FROM h_{h} WHERE v_family = t_family GROUP BY ALL)""" for h in ("species", "genus"))
    + " UNION ALL ".join(f" SELECT method, count(*) AS n_hit, count(*) FILTER (p = 1) AS n_first, '{h}' AS hidden FROM g_{h} GROUP BY method" for h in ("species", "genus")),
    "r_reference_lengths": f"""WITH x AS (SELECT species_name, processid, max(seq_len) AS n FROM {TR} WHERE seq_len > 0 AND species_name IS NOT NULL AND processid IS NOT NULL GROUP BY ALL), m AS (SELECT *, quantile_cont(n, 0.5) OVER (PARTITION BY species_name) AS md FROM x),
        r AS (SELECT *, row_number() OVER (PARTITION BY species_name ORDER BY n DESC, processid) AS a, row_number() OVER (PARTITION BY species_name ORDER BY abs(n - md), processid) AS b FROM m)
        SELECT species_name, max(processid) FILTER (a = 1) AS longest, max(processid) FILTER (b = 1) AS median FROM r GROUP BY species_name""",
    "g_backbone_random": f"SELECT DISTINCT tree_label FROM candidate_species WHERE tree_label IS NOT NULL AND {_frac('tree_label', 'backbone-2')} < 0.3",
    "u_side_metrics": f"""WITH a AS (SELECT DISTINCT genus_name AS g FROM {TR} WHERE genus_name IS NOT NULL), b AS (SELECT DISTINCT genus_name AS g FROM {UN} WHERE genus_name IS NOT NULL), c AS (SELECT DISTINCT genus_name AS g FROM candidate_species WHERE genus_name IS NOT NULL)
        SELECT (SELECT count(*) FROM a WHERE g IN (SELECT g FROM b)) AS n_common, round((SELECT count(*) FROM a WHERE g IN (SELECT g FROM b)) / (SELECT count(*) FROM (SELECT g FROM a UNION SELECT g FROM b)), 6) AS jaccard,
            (SELECT count(*) FROM c WHERE g NOT IN (SELECT g FROM a) AND g NOT IN (SELECT g FROM b)) AS n_complement""",
    "w_place_share": f"""WITH {_T}, g AS (SELECT method, round(s, 2) + 0.0::DOUBLE AS score, count(*) AS n FROM t WHERE place = 1 GROUP BY ALL)
        SELECT method, score, round(sum(n) OVER (PARTITION BY method ORDER BY score ROWS UNBOUNDED PRECEDING) / sum(n) OVER (PARTITION BY method), 6) AS share FROM g""",
    "a_dedup_id_then_sequence": f"""WITH x AS (SELECT processid, nucleotides AS s, loaded_at AS l FROM {TR} WHERE processid IS NOT NULL AND seq_len > 0), a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY processid ORDER BY l ASC NULLS FIRST, s) AS r1 FROM x) WHERE r1 = 1)
        SELECT processid, epoch_us(l) AS loaded_us FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY l ASC NULLS FIRST, processid) AS r2 FROM a) WHERE r2 = 1""",
    "a_event_abundance": """WITH x AS (SELECT sample_id, true_tree_label AS l, CAST(sum(CASE WHEN read_count > 0 THEN read_count ELSE 1 END) AS BIGINT) AS q FROM sample_query_map WHERE sample_id IS NOT NULL AND true_tree_label IS NOT NULL GROUP BY ALL)
        SELECT sample_id, count(*) AS n_labels, string_agg(l || '=' || q, ';' ORDER BY l) AS abundance FROM x GROUP BY sample_id""",
    "a_repeat_targets": f"""WITH {_T}, h AS (SELECT f.*, seed, CAST(('0x' || substr(sha1(seed || ':' || true_genus), 1, 12)) AS BIGINT) / 281474976710656.0 < 0.5 AS fit FROM f, (SELECT unnest(range(30)) AS seed)), g AS (SELECT seed, s, count(*) AS n1, count(*) FILTER (right_genus) AS k1 FROM h WHERE fit GROUP BY ALL),
        c AS (SELECT seed, s, sum(n1) OVER w AS n, sum(k1) OVER w AS k FROM g WINDOW w AS (PARTITION BY seed ORDER BY s DESC ROWS UNBOUNDED PRECEDING)), th AS (SELECT seed, min(s) FILTER (k / n >= 0.7::DOUBLE) AS th FROM c GROUP BY seed),
        p AS (SELECT h.seed, avg(CASE WHEN right_genus THEN 1.0 ELSE 0.0 END) AS p FROM h JOIN th ON h.seed = th.seed WHERE NOT fit AND s >= th GROUP BY 1)
        SELECT count(*) AS n, round(avg(p), 6) AS mean, round(min(p), 6) AS least, round(max(p), 6) AS most, round(quantile_cont(p, 0.05), 6) AS p05, round(quantile_cont(p, 0.95), 6) AS p95, round(avg(CASE WHEN p >= 0.7::DOUBLE THEN 1 ELSE 0 END), 6) AS met FROM p""",
    "a_lineage_dominant": f"""WITH {_POL}, pf AS (SELECT * FROM pp WHERE target_precision = 0.8 AND first_family IS NOT NULL), ac AS (SELECT first_family, assigned_rank FROM (SELECT first_family, assigned_rank, row_number() OVER (PARTITION BY first_family ORDER BY count(*) DESC, assigned_rank) AS q FROM pf GROUP BY first_family, assigned_rank) WHERE q = 1),
        ts AS (SELECT first_family, string_agg(first_species, ';' ORDER BY q) AS top_species FROM (SELECT first_family, first_species, row_number() OVER (PARTITION BY first_family ORDER BY count(*) DESC, first_species) AS q FROM pf GROUP BY first_family, first_species) WHERE q <= 5 GROUP BY 1)
        SELECT n.first_family AS family, n_calls, assigned_rank AS dominant, top_species FROM (SELECT first_family, count(*) AS n_calls FROM pf GROUP BY 1) n JOIN ac ON ac.first_family = n.first_family JOIN ts ON ts.first_family = n.first_family""",
}
