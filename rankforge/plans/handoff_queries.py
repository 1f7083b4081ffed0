"""Queries of joins with a contract, further evidence, gates, locks, packs, saved statistics and SQL functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.functions import exprs as X
from rankforge.functions.sql_names import register
from rankforge.operators import candidates as C
from rankforge.operators import evidence as E
from rankforge.operators import joins as J
from rankforge.operators import trees as T
from rankforge.operators.places import shared_support
from rankforge.plans.candidate_queries import _ECO, _FEAT, _KS, _POL, _T, K, _eco, _features, _first, _policy, _top
from rankforge.plans.evidence_queries import _CL, _closure, _dist
from rankforge.plans.record_queries import EV, TR, UN, _clean, _frac
from rankforge.runtime import keep, table

SQ = ["sample_id", "query_processid"]
GATED = ["top_score", "genus_consensus", "relative_margin"]
QUANTILES = [0.1, 0.25, 0.5, 0.75, 0.9]


def _one(spark, d, method: str) -> DataFrame:
    return _top(spark, d).where((F.col("method") == method) & F.col("sample_id").isNotNull() & F.col("query_processid").isNotNull())


# -- joins ---------------------------------------------------------------------------------------


def j_shaped(spark, d):
    """Labels of the map's rows: by sample and query where a method has them, else by query alone from another method."""
    left = table(spark, d, "sample_query_map").where("sample_id is not null and query_processid is not null").select(*SQ).distinct()
    by_sample = _one(spark, d, "ssm_plain").where("place = 1").select(*SQ, F.col("candidate_tree_label").alias("label"))
    by_query = _one(spark, d, "kmer_rls").groupBy("query_processid").agg(F.min("candidate_tree_label").alias("label"))
    return J.shaped_join(J.shaped_join(left, by_query, SQ), by_sample, SQ)


def j_many_to_one(spark, d):
    site = table(spark, d, "sample_query_map").where("sample_id is not null").groupBy("sample_id").agg(F.min("site20").alias("site20"))
    x = J.many_to_one(_first(spark, d).where("sample_id is not null"), site, ["sample_id"])
    return x.groupBy("method", "site20").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("right_genus"), 1)).alias("n_right"))


def j_derived_key(spark, d):
    """Evaluation and training records of one batch, the letters that their ids begin with."""
    count = lambda x, n: x.select(F.upper("processid").alias("processid")).withColumn("b", F.regexp_extract("processid", "^([A-Z]+)", 1)).where("b <> ''").groupBy("b").agg(F.count(F.lit(1)).alias(n), F.min("processid").alias("processid"))
    a, b = count(table(spark, d, "eval_c_unseen_species"), "n_eval"), count(table(spark, d, "supervised_train"), "n_train")
    return J.derived_key_join(a.drop("b"), b.drop("b"), "processid", "^([A-Z]+)", "batch").select("batch", "n_eval", "n_train")


def j_ordered_lookup(spark, d):
    """The first candidates of a method in the order of their scores, looked up in the list."""
    from rankforge.operators.ordering import global_places

    c = table(spark, d, "candidate_species").where("tree_label is not null").select("tree_label", "genus_from_label", "has_reference_sequence")
    t = _one(spark, d, "ssm_plain").where("place = 1").select(F.col("candidate_tree_label").alias("tree_label"), "candidate_score", *SQ).join(c.select("tree_label"), "tree_label", "left_semi")
    p = keep(global_places(t, [F.desc("candidate_score"), *SQ], "position"))
    return J.ordered_lookup(p, "position", "tree_label", c)


def j_paired_first(spark, d):
    x = J.paired_first(_one(spark, d, "ssm_plain"), _one(spark, d, "cnn_cooc"), SQ, ["candidate_tree_label", "genus"])
    return x.select(*SQ, "a_candidate_tree_label", "b_candidate_tree_label", (F.col("a_genus") == F.col("b_genus")).alias("same_genus"))


def j_sampled_pairs(spark, d):
    """Two thousand drawn pairs of labels with their distance in the tree."""
    p = J.sampled_pairs(table(spark, d, "candidate_species"), "tree_label", 2000, "pairs-1")
    return T.path_distance(p, _closure(spark, d))


def j_priority_match(spark, d):
    """Texts of species_name against the list: as a name, as a label, by the genus alone."""
    rows = table(spark, d, "zero_shot_queries").select(X.clean_taxon("species_name").alias("text")).where("text is not null").distinct()
    low = F.lower("text")
    forms = [low, low, F.lower(F.regexp_extract("text", "^([^ _]+)", 1))]
    fields = [F.lower("species_name"), F.lower("tree_label"), F.lower("genus_from_label")]
    return J.prioritised_match(rows, forms, table(spark, d, "candidate_species"), fields, "tree_label").select("text", "match", F.col("matched_by").cast("long").alias("matched_by"))


# -- evidence ------------------------------------------------------------------------------------


def _hits(spark, d, method):
    return _one(spark, d, method).where("truth is not null").groupBy(*SQ).agg(F.max(F.col("candidate_tree_label") == F.col("truth")).alias("hit"))


def x_union_support(spark, d):
    x = E.union_support(_hits(spark, d, "ssm_plain"), _hits(spark, d, "kmer_rls"), SQ, "hit")
    return x.groupBy("a", "b", "either").agg(F.count(F.lit(1)).alias("n"))


def x_identity_features(spark, d):
    x = E.identity_features(_eco(spark, d), "query_processid", "candidate_tree_label", "blast_candidate_pident", [90, 95, 97, 99], 97.0)
    return x.withColumn("share", F.round("share", 6))


def x_lineage_coverage(spark, d):
    """Coverage of the lineages that the policy assigned."""
    cov = E.lineage_coverage(table(spark, d, "candidate_species"), {"genus": "genus_name", "family": "family_name", "order": "order_name"}, "has_reference_sequence")
    p = _policy(spark, d)
    taxon = F.when(F.col("assigned_rank") == "genus", F.col("first_genus")).when(F.col("assigned_rank") == "family", F.col("first_family")).when(F.col("assigned_rank") == "order", F.col("first_order"))
    c = p.withColumn("taxon", taxon).where("taxon is not null").groupBy(F.col("assigned_rank").alias("rank"), "taxon").agg(F.count(F.lit(1)).alias("n_calls"))
    return c.join(cov, ["rank", "taxon"], "left").select("rank", "taxon", "n_calls", "n_labels", F.round("coverage", 6).alias("coverage"))


def c_novelty_features(spark, d):
    ref = table(spark, d, "candidate_species").where("has_reference_sequence").select(F.col("tree_label").alias("candidate_tree_label")).distinct()
    x = E.novelty_features(_top(spark, d).join(ref, "candidate_tree_label", "left_semi"), K, "candidate_score", "genus", 5)
    return x.select(*K, *[F.round(c, 6).alias(c) for c in ("top_score", "margin", "modal_share", "mean_top")], "n")


def m_gap_targets(spark, d):
    ref = table(spark, d, "candidate_species").where("has_reference_sequence")
    x = E.gap_targets(_top(spark, d).where("truth is not null"), K, "candidate_tree_label", "truth", ref, "tree_label")
    return x.groupBy("method", "truth_listed", "truth_among").agg(F.count(F.lit(1)).alias("n"))


def c_gap_warnings(spark, d):
    """Calls warned of because the candidates do not agree on a genus."""
    return E.gap_overlay(_policy(spark, d), ["method", "target_precision"], 1 - F.col("genus_consensus"), 0.5)


def c_quantile_gate(spark, d):
    """Of each method's score quantiles on the calibration part, the gate of most accepted rows at precision 0.8, and what it gives on the other part."""
    return _gated(spark, d, ["top_score"])


def c_gate_search(spark, d):
    """As c_quantile_gate, over the gates of three features."""
    return _gated(spark, d, GATED)


def _gated(spark, d, features):
    f = _features(spark, d)
    fit = f.where("part = 'calibration'")
    best = E.best_gate(E.gate_counts(fit, ["method"], keep(E.gate_grid(fit, ["method"], features, QUANTILES)), features, "right_genus"), ["method"], 0.8)
    out = E.gate_counts(f.where("part = 'evaluation'"), ["method"], keep(best.select("method", "feature", "quantile", "gate")), features, "right_genus")
    return out.select("method", "feature", "quantile", F.round("gate", 6).alias("gate"), "n_accepted", "n_correct")


def c_locked_thresholds(spark, d):
    """Greatest threshold of five draws of half the genera, over all methods or the method's own."""
    h = C.disjoint_halves(_first(spark, d), "true_genus", 5).where("half = 'fit'")
    return E.locked_thresholds(h, "seed", "method", "candidate_score", "right_genus", 0.7)


def x_stable_choice(spark, d):
    """Size of the candidate set that holds the truth in half of the queries, in as many of five parts as can be."""
    per = _top(spark, d).where("truth is not null and query_processid is not null").groupBy(*K).agg(F.min(F.when(F.col("candidate_tree_label") == F.col("truth"), F.col("place"))).alias("h"))
    part = F.conv(F.substring(F.sha1("query_processid"), 1, 6), 16, 10).cast("long") % 5
    g = per.withColumn("part", part).withColumn("size", F.explode(F.array(*[F.lit(i) for i in range(1, 6)]))).groupBy("method", "part", "size").agg((F.avg((F.coalesce("h", F.lit(99)) <= F.col("size")).cast("int")) >= 0.5).alias("met"))
    x = E.stable_choice(g.withColumn("s", F.col("size")), ["method"], "size", "met", "s")
    return x.select("method", F.col("size").cast("long").alias("size"), F.round("share_met", 6).alias("share_met"))


def _reranked(spark, d, weight):
    t = _top(spark, d).where("sample_id is not null and query_processid is not null and method is not null")
    return E.support_rerank(t, shared_support(t, "sample_id", "query_processid", "candidate_tree_label", ["method"]), K, "candidate_tree_label", "candidate_score", weight)


def e_cooccurrence_rerank(spark, d):
    return _reranked(spark, d, 0.05).select(*K, "candidate_tree_label", F.round("combined", 6).alias("combined"), F.col("new_place").cast("long").alias("new_place"))


def e_cooccurrence_only(spark, d):
    """First candidate by the support of the sample's other queries alone."""
    return _reranked(spark, d, None).where("new_place = 1").select(*K, "candidate_tree_label", "support")


# -- packs, splits, models, trees ----------------------------------------------------------------


def b_pack(spark, d):
    """Rows and labels of the parts of an input pack: reference, queries whose label has no reference, candidates."""
    lab = lambda n: _clean(spark, d, n).where("seq_len > 0").select(X.tree_label("species_name").alias("l")).where("l is not null")
    ref = lab("supervised_train")
    q = lab("eval_c_unseen_species").unionByName(lab("unseen")).join(ref.distinct(), "l", "left_anti")
    c = table(spark, d, "candidate_species").select(F.col("tree_label").alias("l")).where("l is not null").distinct()
    out = None
    for name, x in (("species_sequences", ref), ("zero_shot_queries", q), ("candidate_species", c)):
        y = x.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("l").alias("n_labels")).select(F.lit(name).alias("part"), "*")
        out = y if out is None else out.unionByName(y)
    return out


def b_label_taxonomy(spark, d):
    """Genus and family of each listed label: the records' most frequent, else the list's, else the label's."""
    x = _clean(spark, d).select(X.tree_label("species_name").alias("label"), "genus_name", "family_name")
    return E.label_taxonomy(x, table(spark, d, "candidate_species"), "label", {"genus_name": "genus_name", "family_name": "family_name"})


def b_split_modes(spark, d):
    """Records held out by a list of species, by drawn species, by drawn records."""
    named = table(spark, d, "candidate_species").where("has_eval_c_query").select("species_name")
    x = E.split_modes(_clean(spark, d), "processid", "species_name", named, 0.2, "modes-1", X.hash_fraction)
    return x.groupBy("by_list", "by_group", "by_row").agg(F.count(F.lit(1)).alias("n"))


def m_saved_statistics(spark, d):
    """Scores of the evaluation part standardised by the statistics of the calibration part."""
    cols = ["candidate_score", "sequence_only_score"]
    e = _eco(spark, d)
    stats = E.saved_statistics(e.where("calibration_split = 'calibration'"), cols)
    z = E.standardised_by(e.where("calibration_split = 'evaluation'"), stats, cols)
    return z.groupBy("method").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(f"z_{c}"), 5).alias(f"z_{c}") for c in cols])


def x_cluster_labels(spark, d):
    """Records by their group of equal sequences, "-1" for those alone: how many species a cluster label covers."""
    x = _clean(spark, d).where("seq_len > 0 and processid is not null").groupBy("processid").agg(F.max("nucleotides").alias("s"), F.max("species_name").alias("species_name"))
    big = x.groupBy(F.md5("s").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.min("processid").alias("cluster")).where("n > 1")
    c = x.select("processid", F.md5("s").alias("h")).join(big, "h").select("processid", "cluster")
    return E.cluster_labels(x, "processid", c, "cluster").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("species_name").alias("n_species"))


def g_prune(spark, d):
    """The tree of the labels that have a reference."""
    return E.pruned(_closure(spark, d), table(spark, d, "candidate_species").where("has_reference_sequence"), "tree_label")


def a_placement_summary(spark, d):
    """First candidates as placements: their distance to the truth, and what it exceeds the nearest reference's by."""
    cl = _closure(spark, d)
    p = T.path_distance(_first(spark, d).select("method", F.col("candidate_tree_label").alias("a"), F.col("truth").alias("b")), cl)
    ref = table(spark, d, "candidate_species").where("has_reference_sequence")
    near = T.nearest_reference(p.select("b").distinct(), "b", cl, ref, "tree_label").select("b", F.col("distance").alias("least"))
    x = E.placement_summary(p.join(near, "b", "left").withColumn("excess", F.col("distance") - F.col("least")), ["method"], "distance", "excess")
    return x.select("method", "n", "n_placed", "median_distance", "median_excess", F.round("share_nearest", 6).alias("share_nearest"))


def f_sql_functions(spark, d):
    """The functions under their SQL names, in a SQL text."""
    register(spark)
    table(spark, d, "embeddings").createOrReplaceTempView("rf_embeddings")
    table(spark, d, "supervised_train").createOrReplaceTempView("rf_train")
    return spark.sql(
        """SELECT 'cosine' AS name, round(sum(rf_cosine(embedding, embedding)), 3) AS value FROM rf_embeddings UNION ALL
        SELECT 'wilson_lower', round(w, 6) FROM (SELECT rf_wilson_lower(k, n) AS w FROM (SELECT count(species_name) AS k, count(*) AS n FROM rf_train)) UNION ALL
        SELECT 'clean_taxon', cast(count(DISTINCT rf_clean_taxon(species_name)) AS double) FROM rf_train UNION ALL
        SELECT 'kmers', cast(sum(size(rf_kmers(regexp_replace(upper(nucleotides), '[^ACGTN]', ''), 8))) AS double) FROM rf_train UNION ALL
        SELECT 'p_distance', round(sum(rf_p_distance(upper(nucleotides), reverse(upper(nucleotides)))), 3) FROM rf_train"""
    )


def f_newick_nodes(spark, d):
    """The nodes of a tree in Newick form, one a family, by the table function."""
    register(spark)
    c = table(spark, d, "candidate_species").where("family_name is not null and tree_label is not null").groupBy("family_name").agg(F.concat(F.lit("("), F.array_join(F.array_sort(F.collect_set(F.concat("tree_label", F.lit(":1.5")))), ","), F.lit(")root;")).alias("tree"))
    c.createOrReplaceTempView("rf_trees")
    return spark.sql("SELECT family_name, count(*) AS n_nodes, count(parent) AS n_below, max(length) AS length, min(name) AS first FROM rf_trees, LATERAL rf_newick_nodes(tree) GROUP BY family_name")


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and len(k) > 2 and k[1] == "_" and k[0] in "jxcmebgaf"}

_TQ = "method IS NOT NULL AND sample_id IS NOT NULL AND query_processid IS NOT NULL"
_LAB = "regexp_replace(regexp_replace(species_name, '[''\"]', '', 'g'), '\\s+', '_', 'g')"


def _gate_sql(features: list[str]) -> str:
    col = {"top_score": "s1", "genus_consensus": "c_genus", "relative_margin": "m_species"}
    long = " UNION ALL ".join(f"SELECT method, part, '{f}' AS feature, {col[f]} AS v, right_genus AS ok FROM fe WHERE {col[f]} IS NOT NULL AND NOT isnan({col[f]})" for f in features)
    return f"""WITH {_FEAT}, lo AS ({long}), dv AS (SELECT DISTINCT method, feature, v FROM lo WHERE part = 'calibration'), gv AS (SELECT method, feature, quantile_cont(v, {QUANTILES}) AS gs FROM dv GROUP BY ALL),
        gg AS (SELECT method, feature, unnest({QUANTILES}::DOUBLE[]) AS quantile, unnest(gs) AS gate FROM gv),
        ca AS (SELECT g.method, g.feature, g.quantile, g.gate, count(*) FILTER (v >= gate AND ok IS NOT NULL) AS n, count(*) FILTER (v >= gate AND ok) AS k FROM gg g LEFT JOIN lo ON lo.method = g.method AND lo.feature = g.feature AND part = 'calibration' GROUP BY ALL),
        be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY n DESC, quantile, feature) AS r FROM ca WHERE n > 0 AND k >= 0.8::DOUBLE * n) WHERE r = 1)
        SELECT b.method, b.feature, b.quantile, round(b.gate, 6) AS gate, count(*) FILTER (v >= b.gate AND ok IS NOT NULL) AS n_accepted, count(*) FILTER (v >= b.gate AND ok) AS n_correct
        FROM be b LEFT JOIN lo ON lo.method = b.method AND lo.feature = b.feature AND part = 'evaluation' GROUP BY ALL"""


_SUP = f"""o AS (SELECT DISTINCT method, sample_id, query_processid, candidate_tree_label FROM t WHERE {_TQ}), n AS (SELECT method, sample_id, candidate_tree_label, count(*) AS n FROM o GROUP BY ALL),
    su AS (SELECT t.*, n - 1 AS support FROM t JOIN n ON n.method = t.method AND n.sample_id = t.sample_id AND n.candidate_tree_label = t.candidate_tree_label WHERE t.method IS NOT NULL AND t.sample_id IS NOT NULL AND t.query_processid IS NOT NULL)"""

ORACLE = {
    "j_shaped": f"""WITH {_T}, l AS (SELECT DISTINCT sample_id, query_processid FROM sample_query_map WHERE sample_id IS NOT NULL AND query_processid IS NOT NULL), ja AS (SELECT sample_id, query_processid, candidate_tree_label AS x FROM t WHERE method = 'ssm_plain' AND place = 1),
        jb AS (SELECT query_processid, min(candidate_tree_label) AS y FROM t WHERE method = 'kmer_rls' AND sample_id IS NOT NULL GROUP BY 1) SELECT l.sample_id, l.query_processid, coalesce(x, y) AS label FROM l
        LEFT JOIN ja ON ja.sample_id = l.sample_id AND ja.query_processid = l.query_processid LEFT JOIN jb ON jb.query_processid = l.query_processid""",
    "j_many_to_one": f"WITH {_T}, s AS (SELECT sample_id, min(site20) AS site20 FROM sample_query_map WHERE sample_id IS NOT NULL GROUP BY 1) SELECT method, site20, count(*) AS n, count(*) FILTER (right_genus) AS n_right FROM f LEFT JOIN s ON s.sample_id = f.sample_id WHERE f.sample_id IS NOT NULL GROUP BY ALL",
    "j_derived_key": """WITH a AS (SELECT regexp_extract(upper(processid), '^([A-Z]+)', 1) AS batch, count(*) AS n_eval FROM eval_c_unseen_species GROUP BY 1), b AS (SELECT regexp_extract(upper(processid), '^([A-Z]+)', 1) AS batch, count(*) AS n_train FROM supervised_train GROUP BY 1)
        SELECT batch, n_eval, n_train FROM a JOIN b USING (batch) WHERE batch <> ''""",
    "j_ordered_lookup": f"""WITH {_T}, c AS (SELECT tree_label, genus_from_label, has_reference_sequence FROM candidate_species WHERE tree_label IS NOT NULL), p AS (SELECT candidate_tree_label AS tree_label, row_number() OVER (ORDER BY s DESC, sample_id, query_processid) AS position FROM t
            WHERE method = 'ssm_plain' AND place = 1 AND {_TQ} AND candidate_tree_label IN (SELECT tree_label FROM c)) SELECT * FROM p JOIN c USING (tree_label)""",
    "j_paired_first": f"""WITH {_T}, x AS (SELECT * FROM t WHERE place = 1 AND {_TQ}) SELECT a.sample_id, a.query_processid, a.candidate_tree_label AS a_candidate_tree_label, b.candidate_tree_label AS b_candidate_tree_label, a.genus = b.genus AS same_genus
        FROM x a JOIN x b ON a.method = 'ssm_plain' AND b.method = 'cnn_cooc' AND a.sample_id = b.sample_id AND a.query_processid = b.query_processid""",
    "j_sampled_pairs": f"""WITH {_CL}, p AS (SELECT tree_label, row_number() OVER (ORDER BY tree_label) - 1 AS i FROM (SELECT DISTINCT tree_label FROM candidate_species WHERE tree_label IS NOT NULL)), n AS (SELECT count(*) AS n FROM p),
        r AS (SELECT CAST(('0x' || substr(sha1('pairs-1:a:' || i), 1, 12)) AS BIGINT) % n AS x, CAST(('0x' || substr(sha1('pairs-1:b:' || i), 1, 12)) AS BIGINT) % (n - 1) AS y FROM range(2000) q(i), n), s AS (SELECT x, (x + 1 + y) % n AS y FROM r, n),
        u AS (SELECT DISTINCT least(x, y) AS x, greatest(x, y) AS y FROM s), pairs AS (SELECT a.tree_label AS a, b.tree_label AS b FROM u JOIN p a ON a.i = x JOIN p b ON b.i = y), {_dist('pairs')}
        SELECT pairs.a, pairs.b, CASE WHEN pairs.a IN (SELECT tip FROM cl) AND pairs.b IN (SELECT tip FROM cl) THEN distance END AS distance FROM pairs LEFT JOIN dd ON dd.a = pairs.a AND dd.b = pairs.b""",
    "j_priority_match": """WITH x AS (SELECT DISTINCT regexp_replace(species_name, '^\\s+|\\s+$', '', 'g') AS text FROM zero_shot_queries), r AS (SELECT text FROM x WHERE text IS NOT NULL AND lower(text) NOT IN ('', 'na', 'nan', 'none', 'unclassified')),
        a AS (SELECT lower(species_name) AS k, min(tree_label) AS v FROM candidate_species WHERE species_name IS NOT NULL GROUP BY 1), b AS (SELECT lower(tree_label) AS k, min(tree_label) AS v FROM candidate_species WHERE tree_label IS NOT NULL GROUP BY 1),
        c AS (SELECT lower(genus_from_label) AS k, min(tree_label) AS v FROM candidate_species WHERE genus_from_label IS NOT NULL GROUP BY 1)
        SELECT text, coalesce(a.v, b.v, c.v) AS match, CASE WHEN a.v IS NOT NULL THEN 1 WHEN b.v IS NOT NULL THEN 2 WHEN c.v IS NOT NULL THEN 3 END AS matched_by FROM r LEFT JOIN a ON a.k = lower(text) LEFT JOIN b ON b.k = lower(text) LEFT JOIN c ON c.k = lower(regexp_extract(text, '^([^ _]+)', 1))""",
    "x_union_support": f"""WITH {_T}, h AS (SELECT method, sample_id, query_processid, max(CASE WHEN candidate_tree_label = truth THEN 1 ELSE 0 END) = 1 AS hit FROM t WHERE truth IS NOT NULL AND {_TQ} GROUP BY ALL),
        j AS (SELECT a.hit AS a, coalesce(b.hit, false) AS b FROM (SELECT * FROM h WHERE method = 'ssm_plain') a LEFT JOIN (SELECT * FROM h WHERE method = 'kmer_rls') b ON a.sample_id = b.sample_id AND a.query_processid = b.query_processid)
        SELECT a, b, a OR b AS either, count(*) AS n FROM j GROUP BY ALL""",
    "x_identity_features": f"""WITH o AS (SELECT query_processid, candidate_tree_label, max(CASE WHEN NOT isnan(blast_candidate_pident) AND abs(blast_candidate_pident) < 'infinity'::DOUBLE THEN blast_candidate_pident END) AS v FROM {_ECO} WHERE query_processid IS NOT NULL AND candidate_tree_label IS NOT NULL GROUP BY ALL),
        g AS (SELECT query_processid, max(v) AS v, count(*) AS n, count(*) FILTER (v >= 97) AS m FROM o GROUP BY 1), l AS (SELECT *, coalesce(list_filter([90.0, 95.0, 97.0, 99.0]::DOUBLE[], lambda x: x <= v), []) AS met FROM g)
        SELECT query_processid, len(met) AS n_levels, coalesce(list_max(met), 0.0) AS max_level, round(m / n, 6) AS share FROM l""",
    "x_lineage_coverage": f"""WITH {_POL}, lc2 AS (SELECT 'genus' AS rank, genus_name AS taxon, has_reference_sequence AS f FROM candidate_species UNION ALL SELECT 'family', family_name, has_reference_sequence FROM candidate_species UNION ALL SELECT 'order', order_name, has_reference_sequence FROM candidate_species),
        cv AS (SELECT rank, taxon, count(*) AS n_labels, avg(CASE WHEN f THEN 1 ELSE 0 END) AS coverage FROM lc2 WHERE taxon IS NOT NULL GROUP BY ALL),
        ct AS (SELECT assigned_rank AS rank, CASE assigned_rank WHEN 'genus' THEN first_genus WHEN 'family' THEN first_family WHEN 'order' THEN first_order END AS taxon, count(*) AS n_calls FROM pp GROUP BY ALL)
        SELECT rank, taxon, n_calls, n_labels, round(coverage, 6) AS coverage FROM ct LEFT JOIN cv USING (rank, taxon) WHERE taxon IS NOT NULL""",
    "c_novelty_features": f"""WITH {_T}, x AS (SELECT *, row_number() OVER (PARTITION BY {_KS} ORDER BY place) AS rq FROM t WHERE candidate_tree_label IN (SELECT tree_label FROM candidate_species WHERE has_reference_sequence)),
        m AS (SELECT {_KS}, max(c) AS c FROM (SELECT {_KS}, genus, count(*) AS c FROM x WHERE genus IS NOT NULL GROUP BY ALL) GROUP BY ALL),
        g AS (SELECT {_KS}, max(s) FILTER (rq = 1) AS s1, max(s) FILTER (rq = 2) AS s2, avg(s) FILTER (rq <= 5) AS mt, count(*) AS n FROM x GROUP BY ALL)
        SELECT g.method, g.sample_id, g.query_processid, round(s1, 6) AS top_score, round(coalesce(s1 - s2, 0.0), 6) AS margin, round(coalesce(c, 0) / n, 6) AS modal_share, round(mt, 6) AS mean_top, n FROM g
        LEFT JOIN m ON m.method IS NOT DISTINCT FROM g.method AND m.sample_id IS NOT DISTINCT FROM g.sample_id AND m.query_processid IS NOT DISTINCT FROM g.query_processid""",
    "m_gap_targets": f"""WITH {_T}, g AS (SELECT {_KS}, truth, max(CASE WHEN candidate_tree_label = truth THEN 1 ELSE 0 END) = 1 AS truth_among FROM t WHERE truth IS NOT NULL GROUP BY ALL)
        SELECT method, truth IN (SELECT tree_label FROM candidate_species WHERE has_reference_sequence AND tree_label IS NOT NULL) AS truth_listed, truth_among, count(*) AS n FROM g GROUP BY ALL""",
    "c_gap_warnings": f"""WITH {_POL} SELECT method, target_precision, count(*) AS n_called, count(*) FILTER (1 - c_genus >= 0.5) AS n_warned, count(*) FILTER (rt = false) AS n_wrong, count(*) FILTER (rt = false AND 1 - c_genus >= 0.5) AS n_wrong_warned
        FROM pp WHERE assigned_rank <> 'no_call' GROUP BY ALL""",
    "c_quantile_gate": _gate_sql(["top_score"]),
    "c_gate_search": _gate_sql(GATED),
    "c_locked_thresholds": f"""WITH {_T}, h AS (SELECT f.*, seed FROM f, (SELECT unnest([0, 1, 2, 3, 4]) AS seed) WHERE CAST(('0x' || substr(sha1(seed || ':' || true_genus), 1, 12)) AS BIGINT) / 281474976710656.0 < 0.5),
        z AS (SELECT seed, method, s, count(*) AS n1, count(*) FILTER (right_genus) AS k1 FROM h GROUP BY ALL), zz AS (SELECT seed, '~' AS method, s, sum(n1) AS n1, sum(k1) AS k1 FROM z GROUP BY ALL UNION ALL SELECT * FROM z),
        c AS (SELECT seed, method, s, sum(n1) OVER w AS n, sum(k1) OVER w AS k FROM zz WINDOW w AS (PARTITION BY seed, method ORDER BY s DESC ROWS UNBOUNDED PRECEDING)), th AS (SELECT seed, method, min(s) FILTER (k / n >= 0.7::DOUBLE) AS th FROM c GROUP BY ALL),
        m AS (SELECT method, max(th) AS th FROM th GROUP BY 1) SELECT m.method, greatest(m.th, (SELECT th FROM m WHERE method = '~')) AS lock FROM m WHERE method <> '~'""",
    "x_stable_choice": f"""WITH {_T}, h AS (SELECT method, query_processid, coalesce(min(place) FILTER (candidate_tree_label = truth), 99) AS h FROM t WHERE truth IS NOT NULL AND query_processid IS NOT NULL GROUP BY {_KS}),
        g AS (SELECT method, CAST(('0x' || substr(sha1(query_processid), 1, 6)) AS BIGINT) % 5 AS part, size, avg(CASE WHEN h <= size THEN 1 ELSE 0 END) >= 0.5 AS met FROM h, (SELECT unnest([1, 2, 3, 4, 5]) AS size) GROUP BY ALL),
        s AS (SELECT method, size, avg(CASE WHEN met THEN 1 ELSE 0 END) AS sm FROM g GROUP BY ALL) SELECT method, CAST(size AS BIGINT) AS size, round(sm, 6) AS share_met FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY sm DESC, size) AS r FROM s) WHERE r = 1""",
    "e_cooccurrence_rerank": f"""WITH {_T}, {_SUP} SELECT {_KS}, candidate_tree_label, round(s + 0.05 * ln(1 + support), 6) AS combined, row_number() OVER (PARTITION BY {_KS} ORDER BY round(s + 0.05 * ln(1 + support), 9) DESC, candidate_tree_label) AS new_place FROM su""",
    "e_cooccurrence_only": f"WITH {_T}, {_SUP} SELECT {_KS}, candidate_tree_label, support FROM (SELECT *, row_number() OVER (PARTITION BY {_KS} ORDER BY support DESC, candidate_tree_label) AS rr FROM su) WHERE rr = 1",
    "b_pack": f"""WITH r AS (SELECT {_LAB} AS l FROM {TR} WHERE seq_len > 0), q AS (SELECT {_LAB} AS l FROM {EV} WHERE seq_len > 0 UNION ALL SELECT {_LAB} FROM {UN} WHERE seq_len > 0)
        SELECT 'species_sequences' AS part, count(l) AS n_rows, count(DISTINCT l) AS n_labels FROM r UNION ALL SELECT 'zero_shot_queries', count(l), count(DISTINCT l) FROM q WHERE l NOT IN (SELECT l FROM r WHERE l IS NOT NULL)
        UNION ALL SELECT 'candidate_species', count(DISTINCT tree_label), count(DISTINCT tree_label) FROM candidate_species""",
    "b_label_taxonomy": f"""WITH r AS (SELECT {_LAB} AS label, genus_name, family_name FROM {TR}), l AS (SELECT tree_label AS label, min(genus_name) AS g, min(family_name) AS f FROM candidate_species WHERE tree_label IS NOT NULL GROUP BY 1),
        a AS (SELECT label, genus_name FROM (SELECT label, genus_name, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, genus_name) AS k FROM r WHERE label IS NOT NULL AND genus_name IS NOT NULL GROUP BY label, genus_name) WHERE k = 1),
        b AS (SELECT label, family_name FROM (SELECT label, family_name, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, family_name) AS k FROM r WHERE label IS NOT NULL AND family_name IS NOT NULL GROUP BY label, family_name) WHERE k = 1)
        SELECT l.label, coalesce(a.genus_name, g, split_part(l.label, '_', 1)) AS genus_name, coalesce(b.family_name, f) AS family_name FROM l LEFT JOIN a ON a.label = l.label LEFT JOIN b ON b.label = l.label""",
    "b_split_modes": f"""WITH o AS (SELECT processid, min(species_name) AS species_name FROM {TR} WHERE processid IS NOT NULL GROUP BY 1)
        SELECT coalesce(species_name IN (SELECT species_name FROM candidate_species WHERE has_eval_c_query AND species_name IS NOT NULL), false) AS by_list, coalesce({_frac('species_name', 'modes-1')} < 0.2, false) AS by_group, {_frac('processid', 'modes-1')} < 0.2 AS by_row, count(*) AS n FROM o GROUP BY ALL""",
    "m_saved_statistics": "WITH e AS (SELECT method, calibration_split AS p, " + ", ".join(f"CASE WHEN NOT isnan({c}) AND abs({c}) < 'infinity'::DOUBLE THEN {c} END AS {c}" for c in ("candidate_score", "sequence_only_score")) + f" FROM {_ECO}), s AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in ("candidate_score", "sequence_only_score")) + " FROM e WHERE p = 'calibration') SELECT method, count(*) AS n, " + ", ".join(f"round(avg(coalesce(({c} - m_{c}) / nullif(s_{c}, 0), 0)), 5) AS z_{c}" for c in ("candidate_score", "sequence_only_score")) + " FROM e, s WHERE p = 'evaluation' GROUP BY method",
    "x_cluster_labels": f"""WITH x AS (SELECT processid, max(nucleotides) AS s, max(species_name) AS sp FROM {TR} WHERE seq_len > 0 AND processid IS NOT NULL GROUP BY 1), b AS (SELECT s, min(processid) AS c FROM x GROUP BY s HAVING count(*) > 1)
        SELECT coalesce(c, '-1') AS cluster, count(*) AS n, count(DISTINCT sp) AS n_species FROM x LEFT JOIN b USING (s) GROUP BY 1""",
    "g_prune": f"""WITH {_CL}, k AS (SELECT * FROM cl WHERE tip IN (SELECT tree_label FROM candidate_species WHERE has_reference_sequence)), j AS (SELECT k.ancestor, k.tip, k.hops, c.ancestor AS child FROM k LEFT JOIN k c ON c.tip = k.tip AND c.hops = k.hops - 1)
        SELECT ancestor, count(DISTINCT tip) AS n_tips, count(DISTINCT child) AS n_children FROM j GROUP BY ancestor HAVING count(DISTINCT child) >= 2 OR min(hops) = 0 OR max(hops) = 4""",
    "a_placement_summary": f"""WITH {_T}, {_CL}, pairs AS (SELECT candidate_tree_label AS a, truth AS b FROM f), {_dist('pairs')}, r AS (SELECT DISTINCT tree_label AS b FROM candidate_species WHERE has_reference_sequence), ra AS (SELECT ancestor, min(7.5 - depth) AS below FROM cl JOIN r ON r.b = cl.tip GROUP BY 1),
        nr AS (SELECT tip, min(7.5 - depth + below) AS least FROM cl JOIN ra USING (ancestor) GROUP BY 1), x AS (SELECT method, CASE WHEN candidate_tree_label IN (SELECT tip FROM cl) AND truth IN (SELECT tip FROM cl) THEN distance END AS distance, least FROM f LEFT JOIN dd ON a = candidate_tree_label AND b = truth LEFT JOIN nr ON tip = truth)
        SELECT method, count(*) AS n, count(distance) AS n_placed, CAST(median(distance) AS DOUBLE) AS median_distance, CAST(median(distance - least) AS DOUBLE) AS median_excess, round(avg(CASE WHEN distance - least <= 0 THEN 1 WHEN distance - least > 0 THEN 0 END), 6) AS share_nearest FROM x GROUP BY method""",
    "f_sql_functions": f"""SELECT 'cosine' AS name, round(CAST(count(*) AS DOUBLE), 3) AS value FROM embeddings UNION ALL SELECT 'wilson_lower', round((k / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4.0 * n * n)) / (1 + 1.96 * 1.96 / n), 6)
            FROM (SELECT count(species_name) AS k, count(*) AS n FROM supervised_train) UNION ALL
        SELECT 'clean_taxon', CAST(count(DISTINCT x) AS DOUBLE) FROM (SELECT regexp_replace(species_name, '^\\s+|\\s+$', '', 'g') AS x FROM supervised_train) WHERE lower(x) NOT IN ('', 'na', 'nan', 'none', 'unclassified') UNION ALL
        SELECT 'kmers', CAST(sum(n) AS DOUBLE) FROM (SELECT count(DISTINCT substr(s, i, 8)) FILTER (NOT contains(substr(s, i, 8), 'N')) AS n FROM (SELECT r, s, unnest(range(1, length(s) - 6)) AS i FROM (SELECT row_number() OVER () AS r, regexp_replace(upper(nucleotides), '[^ACGTN]', '', 'g') AS s FROM supervised_train)) GROUP BY r) UNION ALL
        SELECT 'p_distance', round(sum(p), 3) FROM (SELECT count(*) FILTER (a <> b) / count(*) AS p FROM (SELECT r, substr(s, i, 1) AS a, substr(s, length(s) - i + 1, 1) AS b FROM (SELECT r, s, unnest(range(1, length(s) + 1)) AS i FROM (SELECT row_number() OVER () AS r, upper(nucleotides) AS s FROM supervised_train))) WHERE a IN ('A', 'C', 'G', 'T') AND b IN ('A', 'C', 'G', 'T') GROUP BY r)""",
    "f_newick_nodes": """SELECT family_name, count(DISTINCT tree_label) + 1 AS n_nodes, count(DISTINCT tree_label) AS n_below, 1.5::DOUBLE AS length, least(min(tree_label), 'root') AS first FROM candidate_species WHERE family_name IS NOT NULL AND tree_label IS NOT NULL GROUP BY family_name""",
}
