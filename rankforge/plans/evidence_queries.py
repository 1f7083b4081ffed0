"""Queries on vectors, k-mers, samples, sites, trees and learned fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.functions.pairwise import best_ungapped, edit_identity
from rankforge.operators import candidates as C
from rankforge.operators import places as P
from rankforge.operators import retrieval as V
from rankforge.operators import statistics as S
from rankforge.operators import trees as T
from rankforge.plans.candidate_queries import K, _first, _T, _top
from rankforge.plans.record_queries import TR, _clean, _every_split, led
from rankforge.runtime import keep, table
from rankforge.sources.formats import manifest

TREE = ["order_name", "family_name", "genus_from_label", "tree_label"]
LENGTHS = [3.0, 2.0, 1.5, 1.0]


# -- vectors and k-mers --------------------------------------------------------------------------


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The query set, ids divisible by 20, and every row as the catalogue."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return e.where("vec_id % 20 = 0"), e


def r_cosine_topk(spark, d):
    """Against every row but the query's own."""
    q, c = _vectors(spark, d)
    return V.cosine_topk(q, c, 10, own=False).select("query_id", "place", "candidate_id", F.round("score", 4).alias("score"))


def r_knn_labels(spark, d):
    """1-nearest-neighbour labels against the true ones."""
    q, c = _vectors(spark, d)
    lab = table(spark, d, "embeddings").select("vec_id", "label")
    n = V.cosine_topk(q, c, 1, own=False).join(lab.withColumnRenamed("vec_id", "query_id").withColumnRenamed("label", "truth"), "query_id")
    n = n.join(lab.withColumnRenamed("vec_id", "candidate_id"), "candidate_id")
    return n.groupBy("truth").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("truth") == F.col("label"), 1)).alias("n_right"))


def r_masked(spark, d):
    """Nearest candidates of all rows where those of the query's own label are hidden."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    return V.cosine_topk(e.where("vec_id % 20 = 0"), e, 1, own=False).select("query_id", "candidate_id")


def r_prototypes(spark, d):
    p = V.prototypes(table(spark, d, "embeddings"), "label", "embedding")
    return p.select("label", F.size("embedding").cast("long").alias("dim"), F.round(F.element_at("embedding", 1), 5).alias("first"), F.round(F.element_at("embedding", -1), 5).alias("last"))


def r_nearest_prototype(spark, d):
    e = table(spark, d, "embeddings")
    n = V.nearest_prototype(e, "vec_id", "embedding", V.prototypes(e, "label", "embedding"), "label")
    return n.select("vec_id", F.col("label").cast("long").alias("label"))


def r_cell_recall(spark, d):
    """Recall at 10 of the index of cells, every row indexed, against the exact search."""
    q, c = _vectors(spark, d)
    return V.recall_at(V.cell_topk(q, c, 10, own=False), V.cosine_topk(q, c, 10, own=False))


def _species_hits(spark, d, idf: bool) -> DataFrame:
    """The three nearest species of every usable evaluation record, over all usable training records."""
    q = _clean(spark, d, "eval_c_unseen_species").unionByName(_clean(spark, d, "unseen")).select("processid", "nucleotides")
    n = V.kmer_topk_groups(q, _clean(spark, d).select("processid", "nucleotides", "species_name"), 6, 3, idf)
    return n.select("query_id", "place", F.col("group").alias("species_name"), "candidate_id", F.round("score", 6).alias("score"))


def r_kmer_cosine(spark, d):
    return _species_hits(spark, d, False)


def r_tfidf(spark, d):
    return _species_hits(spark, d, True)


def _barcodes(spark, d):
    return _clean(spark, d).select(F.col("processid").alias("id"), F.col("nucleotides").alias("s"))


def j_kmer_similar(spark, d):
    """All pairs of the whole barcode table with a 12-mer Jaccard of 0.8 or more, over classes of exact copies."""
    return V.similar_classes(_barcodes(spark, d), 0.8)


def j_kmer_classes(spark, d):
    """The class of each record of j_kmer_similar."""
    return V.sequence_classes(_barcodes(spark, d))


def r_negative_control(spark, d):
    m = V.shuffled_labels(table(spark, d, "candidate_species"), "tree_label", "control-1")
    t = _top(spark, d).where("place = 1 and truth is not null").join(m, F.col("candidate_tree_label") == F.col("tree_label"))
    return t.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("shuffled") == F.col("truth"), 1)).alias("n_right"))


def r_random_control(spark, d):
    """How often the truth is among five labels drawn at random for each query."""
    t = _top(spark, d).where("place = 1 and truth is not null")
    x = V.random_ranking(t, K, table(spark, d, "candidate_species"), "tree_label", 5, "control-1").join(t.select(*K, "truth"), K)
    return x.groupBy("method").agg(F.count(F.when(F.col("place") == 1, 1)).alias("n"), F.count(F.when((F.col("place") == 1) & (F.col("tree_label") == F.col("truth")), 1)).alias("n_right"), F.count(F.when(F.col("tree_label") == F.col("truth"), 1)).alias("n_right_in_5"))


def q_ungapped(spark, d):
    """Each record laid without gaps on the smallest processid of its genus."""
    return led(_every_split(spark, d), "genus_name").select("processid", "lead_id", best_ungapped("s", "lead").alias("b")).select("processid", "lead_id", "b.*")


def q_edit_identity(spark, d):
    x = table(spark, d, "zero_shot_queries").where("genus_name is not null and nucleotides is not null")
    return led(x, "genus_name").select("processid", "lead_id", edit_identity("s", "lead").alias("identity"))


# -- samples, sites, priors ----------------------------------------------------------------------


def _map(spark, d):
    return table(spark, d, "sample_query_map")


def a_presence(spark, d):
    return P.presence(_map(spark, d), ["sample_id", "true_tree_label"], "read_count", "asv_count", "source_region_dir")


def a_event_table(spark, d):
    x = P.event_table(_map(spark, d), "sample_id", "true_tree_label", "latitude_start_clean", "longitude_start_clean", "read_count")
    return x.select("sample_id", "n_labels", "quantity", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"))


def a_prior_counts(spark, d):
    return P.prior_counts(_map(spark, d), "site20", "true_tree_label", "read_count")


def e_prior_ranking(spark, d):
    return P.prior_ranking(a_prior_counts(spark, d), "site20", "true_tree_label", "occurrence_count", 5)


def p_bounding_box(spark, d):
    return P.bounding_boxes(_map(spark, d), "source_region_dir", "latitude_start_clean", "longitude_start_clean", 0.5)


def j_range_haversine(spark, d):
    x = _map(spark, d).groupBy("sample_id").agg(F.max("latitude_start_clean").alias("la"), F.max("longitude_start_clean").alias("lo"))
    return P.near_pairs(x, "sample_id", "la", "lo", 1500.0).select("key_a", "key_b", F.round("distance_km", 3).alias("distance_km"))


def e_geo_rerank(spark, d):
    """Scores with the site's prior: log counts of the label at the sample's site, a penalty where it was never seen there."""
    site = _map(spark, d).where("site20 is not null").groupBy("sample_id").agg(F.min("site20").alias("site20"))
    prior = a_prior_counts(spark, d).withColumnRenamed("true_tree_label", "candidate_tree_label")
    t = _top(spark, d).join(site, "sample_id", "left").join(prior, ["site20", "candidate_tree_label"], "left")
    return C.rerank_by_prior(t, K, "candidate_score", ["occurrence_count"], 0.05, 0.03).select(*K, "candidate_tree_label", F.round("combined_score", 6).alias("combined_score"))


def e_cooccurrence(spark, d):
    """Support within each of the methods."""
    return P.shared_support(_top(spark, d), "sample_id", "query_processid", "candidate_tree_label", ["method"])


def e_overlap_audit(spark, d):
    return P.reference_overlap(_map(spark, d), "true_tree_label", table(spark, d, "candidate_species"), "tree_label", "has_reference_sequence")


def a_lineage_rollup(spark, d):
    c = table(spark, d, "candidate_species").select(F.col("tree_label").alias("candidate_tree_label"), "order_name", "family_name", F.col("genus_from_label").alias("genus_name"))
    g = _top(spark, d).where("place = 1").groupBy("candidate_tree_label").agg(F.count(F.lit(1)).alias("n"), F.avg("candidate_score").alias("v")).join(c, "candidate_tree_label")
    x = S.lineage_rollup(g, ["order_name", "family_name", "genus_name"], "n", "v")
    return x.select("level", "taxon", "n", F.round(F.col("weighted_mean") + 1e-10, 6).alias("weighted_mean"))


# -- trees ---------------------------------------------------------------------------------------


def _closure(spark, d):
    return T.taxonomy_closure(table(spark, d, "candidate_species"), TREE, LENGTHS)


def g_closure(spark, d):
    return _closure(spark, d).groupBy("ancestor").agg(F.count(F.lit(1)).alias("n_tips"), F.max("depth").alias("depth"))


def g_path_distance(spark, d):
    pairs = _first(spark, d).select(F.col("candidate_tree_label").alias("a"), F.col("truth").alias("b")).distinct()
    return T.path_distance(pairs, _closure(spark, d))


def g_nearest_reference(spark, d):
    c = table(spark, d, "candidate_species")
    return T.nearest_reference(c.where("coalesce(has_reference_sequence, false) = false"), "tree_label", _closure(spark, d), c.where("has_reference_sequence"), "tree_label")


def g_neighborhood(spark, d):
    x = T.neighbourhood(_top(spark, d).where("place <= 5"), K, "candidate_tree_label", _closure(spark, d))
    return x.select(*K, "n_pairs", "min_distance", F.round("mean_distance", 6).alias("mean_distance"), "max_distance", F.round("mean_to_top", 6).alias("mean_to_top"))


def g_sister_support(spark, d):
    c = table(spark, d, "candidate_species")
    return T.sister_support(c, "tree_label", _closure(spark, d), c.where("has_reference_sequence"), "tree_label")


def g_backbone_sample(spark, d):
    return T.stratified_quota(table(spark, d, "candidate_species"), "tree_label", "family_name", 0.3, "backbone-1")


# -- learned -------------------------------------------------------------------------------------


def m_posterior(spark, d):
    """Probability that a first candidate's genus is right, fitted on half of the samples and applied to the other half."""
    from rankforge.operators.learned import balanced, posterior

    m = C.margins(_top(spark, d), K, "candidate_score", (2, 5))
    x = keep(C.nested_parts(_first(spark, d).join(m, K), "sample_id", "posterior-1").withColumn("y", F.col("right_genus").cast("int")))
    fit = balanced(x.where("part = 'fit'"), "y", "query_processid", 50_000, "posterior-1")
    return posterior(fit, x.where("part <> 'fit'"), "y", ["candidate_score", "margin_1_2", "relative_margin"], ["method"]).select(*K, "y", "probability")


def m_kmeans_agreement(spark, d):
    from rankforge.operators.learned import kmeans_clusters

    e = table(spark, d, "embeddings")
    c = kmeans_clusters(e, "vec_id", "embedding", 10)
    return S.clustering_agreement(e.select("vec_id", "label").join(c, "vec_id"), "label", "cluster")


def a_cluster_agreement(spark, d):
    """Agreement of genus and family labels of the training records."""
    x = S.clustering_agreement(_clean(spark, d), "family_name", "genus_name")
    return x.select("n", *[F.round(c, 5).alias(c) for c in ("homogeneity", "completeness", "mutual_information", "adjusted_rand")])


def a_adjusted_information(spark, d):
    """Adjusted mutual information of genus and family labels of the training records."""
    v = S.adjusted_mutual_information(_clean(spark, d), "family_name", "genus_name")
    return spark.createDataFrame([(v if v is None else round(v, 6),)], "adjusted_mutual_information double")


def s_manifest(spark, d):
    return manifest(table(spark, d, "candidate_species")).withColumn("table", F.lit("candidate_species"))


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and len(k) > 2 and k[1] == "_" and k[0] in "rjqaepgms"}

_CL = """l AS (SELECT DISTINCT order_name, family_name, genus_from_label, tree_label FROM candidate_species WHERE order_name IS NOT NULL AND family_name IS NOT NULL AND genus_from_label IS NOT NULL AND tree_label IS NOT NULL),
    cl AS (SELECT tree_label AS tip, 'root' AS ancestor, 4 AS hops, 0.0 AS depth FROM l UNION ALL SELECT tree_label, order_name, 3, 3.0 FROM l UNION ALL SELECT tree_label, order_name || '|' || family_name, 2, 5.0 FROM l
        UNION ALL SELECT tree_label, order_name || '|' || family_name || '|' || genus_from_label, 1, 6.5 FROM l UNION ALL SELECT tree_label, order_name || '|' || family_name || '|' || genus_from_label || '|' || tree_label, 0, 7.5 FROM l)"""


def _dist(pairs: str) -> str:
    return f"""mm AS (SELECT a, b, max(x.depth) AS m FROM (SELECT DISTINCT a, b FROM {pairs}) p JOIN cl x ON x.tip = a JOIN cl y ON y.tip = b AND y.ancestor = x.ancestor GROUP BY ALL),
    dd AS (SELECT p.a, p.b, CAST(15.0 - 2 * m AS DOUBLE) AS distance FROM (SELECT DISTINCT a, b FROM {pairs}) p LEFT JOIN mm ON p.a = mm.a AND p.b = mm.b)"""


_SIM = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"
_NN = f"""nn AS (SELECT a.vec_id AS query_id, b.vec_id AS candidate_id, a.label AS truth, b.label AS label, {_SIM} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
    rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id) AS place FROM nn)"""
_PROTO = """ex AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), mn AS (SELECT label, i, avg(x::DOUBLE) AS x FROM ex GROUP BY ALL),
    pr AS (SELECT label, list(x ORDER BY i) AS v FROM mn GROUP BY label), pn AS (SELECT label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM pr)"""
_F0 = "(CASE WHEN {0} IS NOT NULL AND NOT isnan({0}) THEN {0} END)"
_HAV = "2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin((radians(b.la) - radians(a.la)) / 2), 2) + cos(radians(a.la)) * cos(radians(b.la)) * pow(sin((radians(b.lo) - radians(a.lo)) / 2), 2))))"
_PRIOR = "pc AS (SELECT site20, true_tree_label, CAST(sum(coalesce(read_count, 0)) AS BIGINT) AS occurrence_count FROM sample_query_map WHERE site20 IS NOT NULL AND true_tree_label IS NOT NULL GROUP BY ALL)"

ORACLE = {
    "r_cosine_topk": f"WITH {_NN} SELECT query_id, place, candidate_id, round(score, 4) AS score FROM rk WHERE place <= 10",
    "r_knn_labels": f"WITH {_NN} SELECT truth, count(*) AS n, count(*) FILTER (truth = label) AS n_right FROM rk WHERE place = 1 GROUP BY truth",
    "r_masked": f"WITH {_NN}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS r FROM rk WHERE truth <> label) SELECT query_id, candidate_id FROM k WHERE r = 1",
    "r_prototypes": f"WITH {_PROTO} SELECT label, len(v) AS dim, round(v[1], 5) AS first, round(v[len(v)], 5) AS last FROM pn",
    "r_nearest_prototype": f"""WITH {_PROTO}, s AS (SELECT e.vec_id, p.label, list_dot_product(e.embedding::DOUBLE[], p.v) / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) AS score FROM embeddings e, pn p)
        SELECT vec_id, CAST(label AS BIGINT) AS label FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS r FROM s) WHERE r = 1""",
    "r_negative_control": f"""WITH {_T}, la AS (SELECT tree_label, row_number() OVER (ORDER BY tree_label) AS r FROM (SELECT DISTINCT tree_label FROM candidate_species WHERE tree_label IS NOT NULL)), lb AS (SELECT tree_label AS shuffled, row_number() OVER (ORDER BY sha1('control-1' || tree_label), tree_label) AS r FROM (SELECT DISTINCT tree_label FROM candidate_species WHERE tree_label IS NOT NULL)),
        m AS (SELECT tree_label, shuffled FROM la JOIN lb USING (r)) SELECT method, count(*) AS n, count(*) FILTER (shuffled = truth) AS n_right FROM f JOIN m ON candidate_tree_label = tree_label GROUP BY method""",
    "a_presence": """SELECT sample_id, true_tree_label, CAST(coalesce(sum(read_count), 0) AS BIGINT) AS read_count, CAST(coalesce(sum(asv_count), 0) AS BIGINT) AS asv_count, count(*) AS n_rows,
        coalesce(array_to_string(list_sort(list(DISTINCT source_region_dir) FILTER (source_region_dir IS NOT NULL)), ';'), '') AS tags FROM sample_query_map GROUP BY ALL""",
    "a_event_table": f"""SELECT sample_id, count(DISTINCT true_tree_label) AS n_labels, CAST(sum(CASE WHEN read_count > 0 THEN read_count ELSE 1 END) AS BIGINT) AS quantity, round(avg({_F0.format('latitude_start_clean')}), 4) AS lat,
        round(avg({_F0.format('longitude_start_clean')}), 4) AS lon FROM sample_query_map WHERE sample_id IS NOT NULL GROUP BY sample_id""",
    "a_prior_counts": f"WITH {_PRIOR} SELECT * FROM pc",
    "e_prior_ranking": f"WITH {_PRIOR} SELECT site20, place, true_tree_label, occurrence_count FROM (SELECT *, row_number() OVER (PARTITION BY site20 ORDER BY occurrence_count DESC, true_tree_label) AS place FROM pc) WHERE place <= 5",
    "p_bounding_box": """WITH g AS (SELECT source_region_dir, greatest(min(latitude_start_clean) - 0.5, -90) AS a, least(max(latitude_start_clean) + 0.5, 90) AS b, greatest(min(longitude_start_clean) - 0.5, -180) AS c, least(max(longitude_start_clean) + 0.5, 180) AS d
        FROM sample_query_map WHERE latitude_start_clean IS NOT NULL AND NOT isnan(latitude_start_clean) AND longitude_start_clean IS NOT NULL AND NOT isnan(longitude_start_clean) AND source_region_dir IS NOT NULL GROUP BY ALL)
        SELECT source_region_dir, format('POLYGON(({:.4f} {:.4f},{:.4f} {:.4f},{:.4f} {:.4f},{:.4f} {:.4f},{:.4f} {:.4f}))', c, a, d, a, d, b, c, b, c, a) AS wkt FROM g""",
    "j_range_haversine": f"""WITH x AS (SELECT sample_id, max(latitude_start_clean) AS la, max(longitude_start_clean) AS lo FROM sample_query_map GROUP BY sample_id), y AS (SELECT * FROM x WHERE sample_id IS NOT NULL AND la IS NOT NULL AND lo IS NOT NULL AND NOT isnan(la) AND NOT isnan(lo))
        SELECT a.sample_id AS key_a, b.sample_id AS key_b, round({_HAV}, 3) AS distance_km FROM y a JOIN y b ON a.sample_id < b.sample_id AND {_HAV} <= 1500""",
    "e_geo_rerank": f"""WITH {_T}, {_PRIOR}, si AS (SELECT sample_id, min(site20) AS site20 FROM sample_query_map WHERE site20 IS NOT NULL GROUP BY sample_id)
        SELECT method, t.sample_id, query_processid, candidate_tree_label, round(s + 0.05 * ln(1 + greatest(coalesce(occurrence_count, 0), 0)) - CASE WHEN coalesce(occurrence_count, 0) <= 0 THEN 0.03 ELSE 0 END, 6) AS combined_score
        FROM t LEFT JOIN si ON t.sample_id = si.sample_id LEFT JOIN pc ON si.site20 = pc.site20 AND t.candidate_tree_label = pc.true_tree_label""",
    "e_cooccurrence": f"""WITH {_T}, o AS (SELECT DISTINCT method, sample_id, query_processid, candidate_tree_label FROM t), n AS (SELECT method, sample_id, candidate_tree_label, count(*) AS n FROM o GROUP BY ALL)
        SELECT o.method, o.sample_id, query_processid, o.candidate_tree_label, n - 1 AS support FROM o JOIN n ON o.method = n.method AND o.sample_id = n.sample_id AND o.candidate_tree_label = n.candidate_tree_label""",
    "e_overlap_audit": """WITH x AS (SELECT DISTINCT true_tree_label AS l FROM sample_query_map WHERE true_tree_label IS NOT NULL), r AS (SELECT tree_label AS l, max(coalesce(has_reference_sequence, false)) AS f FROM candidate_species WHERE tree_label IS NOT NULL GROUP BY tree_label)
        SELECT count(*) AS n_labels, count(f) AS n_listed, count(*) FILTER (f) AS n_with_reference FROM x LEFT JOIN r USING (l)""",
    "a_lineage_rollup": f"""WITH {_T}, g AS (SELECT candidate_tree_label, count(*) AS n, avg(s) AS v FROM t WHERE place = 1 GROUP BY ALL), j AS (SELECT g.*, order_name, family_name, genus_from_label AS genus_name FROM g JOIN candidate_species c ON c.tree_label = candidate_tree_label),
        u AS (SELECT 'order_name' AS level, order_name AS taxon, n, v FROM j UNION ALL SELECT 'family_name', family_name, n, v FROM j UNION ALL SELECT 'genus_name', genus_name, n, v FROM j)
        SELECT level, taxon, CAST(sum(n) AS BIGINT) AS n, round(sum(v * n) / sum(n) + 1e-10::DOUBLE, 6) AS weighted_mean FROM u WHERE taxon IS NOT NULL GROUP BY ALL""",
    "g_closure": f"WITH {_CL} SELECT ancestor, count(*) AS n_tips, CAST(max(depth) AS DOUBLE) AS depth FROM cl GROUP BY ancestor",
    "g_path_distance": f"WITH {_T}, {_CL}, pairs AS (SELECT DISTINCT candidate_tree_label AS a, truth AS b FROM f), {_dist('pairs')} SELECT a, b, distance FROM dd",
    "g_nearest_reference": f"""WITH {_CL}, q AS (SELECT DISTINCT tree_label AS a FROM candidate_species WHERE coalesce(has_reference_sequence, false) = false), r AS (SELECT DISTINCT tree_label AS b FROM candidate_species WHERE has_reference_sequence),
        m AS (SELECT a, b, max(x.depth) AS m FROM q JOIN cl x ON x.tip = a JOIN cl y ON y.ancestor = x.ancestor JOIN r ON r.b = y.tip GROUP BY ALL)
        SELECT a AS tree_label, b AS nearest, CAST(15.0 - 2 * m AS DOUBLE) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY m DESC, b) AS rr FROM m) WHERE rr = 1""",
    "g_neighborhood": f"""WITH {_T}, {_CL}, tt AS (SELECT * FROM t WHERE place <= 5), pairs AS (SELECT x.method, x.sample_id, x.query_processid, x.candidate_tree_label AS a, y.candidate_tree_label AS b, x.place AS pa FROM tt x JOIN tt y
            ON x.method = y.method AND x.sample_id = y.sample_id AND x.query_processid = y.query_processid AND x.place < y.place), {_dist('pairs')}
        SELECT method, sample_id, query_processid, count(distance) AS n_pairs, min(distance) AS min_distance, round(avg(distance), 6) AS mean_distance, max(distance) AS max_distance, round(avg(distance) FILTER (pa = 1), 6) AS mean_to_top
        FROM pairs p JOIN dd ON p.a = dd.a AND p.b = dd.b GROUP BY ALL""",
    "g_sister_support": f"""WITH {_CL}, r AS (SELECT DISTINCT tree_label AS tip FROM candidate_species WHERE has_reference_sequence), ra AS (SELECT cl.tip, ancestor FROM cl JOIN r ON cl.tip = r.tip), n AS (SELECT ancestor, count(*) AS n FROM ra GROUP BY ancestor),
        x AS (SELECT cl.tip, hops, cl.ancestor, n - CASE WHEN ra.tip IS NOT NULL THEN 1 ELSE 0 END AS m FROM cl JOIN n ON cl.ancestor = n.ancestor LEFT JOIN ra ON ra.tip = cl.tip AND ra.ancestor = cl.ancestor WHERE hops > 0)
        SELECT tip AS tree_label, CAST(hops AS BIGINT) AS hops, ancestor, m AS n_support FROM (SELECT *, row_number() OVER (PARTITION BY tip ORDER BY hops) AS rr FROM x WHERE m > 0) WHERE rr = 1""",
    "g_backbone_sample": """WITH o AS (SELECT tree_label, min(family_name) AS family_name FROM candidate_species WHERE tree_label IS NOT NULL AND family_name IS NOT NULL GROUP BY tree_label), q AS (SELECT family_name, n * 0.3::DOUBLE AS want, floor(n * 0.3::DOUBLE) AS base FROM (SELECT family_name, count(*) AS n FROM o GROUP BY ALL)),
        lf AS (SELECT CAST(round_even((SELECT count(*) FROM o) * 0.3::DOUBLE, 0) AS BIGINT) - CAST(sum(base) AS BIGINT) AS spare FROM q), rq AS (SELECT *, row_number() OVER (ORDER BY want - base DESC, family_name) AS rr FROM q),
        qu AS (SELECT family_name, base + CASE WHEN rr <= spare THEN 1 ELSE 0 END AS quota FROM rq, lf),
        x AS (SELECT *, row_number() OVER (PARTITION BY family_name ORDER BY CAST(('0x' || substr(sha1('backbone-1:' || tree_label), 1, 12)) AS BIGINT) / 281474976710656.0, tree_label) AS r FROM o)
        SELECT tree_label, x.family_name FROM x JOIN qu ON x.family_name = qu.family_name WHERE r <= quota""",
    "a_cluster_agreement": f"""WITH p AS (SELECT family_name AS a, genus_name AS b FROM {TR} WHERE family_name IS NOT NULL AND genus_name IS NOT NULL), c AS (SELECT a, b, count(*) AS n FROM p GROUP BY ALL), xa AS (SELECT a, count(*) AS na FROM p GROUP BY a), xb AS (SELECT b, count(*) AS nb FROM p GROUP BY b), t AS (SELECT count(*) AS t FROM p),
        m AS (SELECT sum(n / t * ln(n * t / (na * nb))) AS mi, sum(n * (n - 1) / 2) AS cc, max(t) AS n FROM c JOIN xa USING (a) JOIN xb USING (b), t), ha AS (SELECT sum(-(na / t) * ln(na / t)) AS ha, sum(na * (na - 1) / 2) AS ca FROM xa, t), hb AS (SELECT sum(-(nb / t) * ln(nb / t)) AS hb, sum(nb * (nb - 1) / 2) AS cb FROM xb, t)
        SELECT n, round(mi / ha, 5) AS homogeneity, round(mi / hb, 5) AS completeness, round(mi, 5) AS mutual_information, round((cc - ca * cb / (n * (n - 1) / 2)) / ((ca + cb) / 2 - ca * cb / (n * (n - 1) / 2)), 5) AS adjusted_rand FROM m, ha, hb""",
}
