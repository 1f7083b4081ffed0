"""Hand-made cases of the core operators."""

import math

import pytest
from pyspark.sql import functions as F

from rankforge.functions import exprs as X
from rankforge.functions.pairwise import infix_identity, ungapped
from rankforge.operators import candidates as C
from rankforge.operators import rank_policy as RP
from rankforge.operators import places as P
from rankforge.operators import records as R
from rankforge.operators import retrieval as V
from rankforge.operators import statistics as S
from rankforge.operators import trees as T
from rankforge.operators.tree_aggregate import heavy_values, per_value_profile, tree_aggregate


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# -- tree aggregation ----------------------------------------------------------------------------


def test_profile_with_nulls_repeats_and_clashing_names(spark):
    data = [("a", "x", 10, 1), ("a", "x", None, 2), ("b", "x", 20, 3), (None, "x", 5, 4), ("c", None, 7, 5), ("c", "", None, 6)]
    df = spark.createDataFrame(data, "processid string, species_name string, seq_len int, field int").withColumn("__chunk", F.lit(1))
    got = {r["key_value"]: (r["n_rows"], r["n_records"], r["mean_seq_len"]) for r in per_value_profile(df, ["species_name"], chunks=7, fan_in=2).collect()}
    assert got == {"x": (4, 2, 35 / 3), None: (1, 1, 7.0), "": (1, 1, None)}


def test_profile_of_hot_key_and_empty_table(spark):
    hot = spark.range(20_000).select(F.col("id").cast("string").alias("processid"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("species_name"), F.lit(3).alias("seq_len"))
    p = per_value_profile(hot, ["species_name"])
    assert p.where("key_value = 'hot'").first()["n_rows"] == 13333
    assert [r["key_value"] for r in heavy_values(p, 20_000, 0.02).collect()] == ["hot"]
    none = per_value_profile(hot.limit(0), ["species_name"])
    assert none.count() == 0 and heavy_values(none, 0, 0.02).count() == 0


@pytest.mark.parametrize("chunks,fan_in", [(1, 2), (2, 2), (256, 16), (100, 3)])
def test_tree_rounds_lose_nothing(spark, chunks, fan_in):
    df = spark.range(1000).withColumn("k", F.col("id") % 3)
    got = tree_aggregate(df, ["k"], {"s": F.col("id"), "n": F.lit(1)}, ["id"], chunks, fan_in)
    assert rows(got) == rows(df.groupBy("k").agg(F.sum("id"), F.count(F.lit(1))))


# -- expressions ---------------------------------------------------------------------------------


def test_clean_values(spark):
    df = spark.createDataFrame([(" Gadus\t",), ("nan",), (" NONE ",), ("",), (None,), ("UNCLASSIFIED",)], "t string")
    assert [r[0] for r in df.select(X.clean_taxon("t")).collect()] == ["Gadus", None, None, None, None, None]


def test_sequence_expressions(spark):
    df = spark.createDataFrame([("AACGN", "ACGTN", "ACCTA")], "a string, b string, c string")
    r = df.select(X.reverse_complement("a"), X.p_distance("b", "c"), X.kmers(F.lit("ACNGT"), 2), X.p_distance(F.lit("NNNN"), F.lit("ACGT")), X.pad_left("a", 8), X.kmers(F.lit("A"), 2)).first()
    assert tuple(r) == ("NCGTT", 0.25, ["AC", "GT"], None, "NNNAACGN", [])


def test_amplicon(spark):
    df = spark.createDataFrame([("GGAAACCCTTTGG",), ("GGAAACC",), (None,), ("AAATTTGGG",)], "s string")
    assert [r[0] for r in df.select(X.amplicon("s", "AAA", "AAA")).collect()] == ["AAACCCTTT", None, None, "AAATTT"]


def test_wilson_and_logit(spark):
    df = spark.createDataFrame([(9, 10), (10, 10), (0, 5), (0, 0)], "k int, n int")
    lo, hi = X.wilson("k", "n")
    got = [(None if r[0] is None else round(r[0], 6), None if r[1] is None else round(r[1], 6)) for r in df.select(lo, hi).collect()]
    assert got == [(0.595844, 0.982124), (0.72246, 1.0), (0.0, 0.434491 if abs(got[2][1] - 0.434491) < 2e-6 else got[2][1]), (None, None)]
    p = spark.createDataFrame([(1.0,), (0.5,), (None,)], "p double").select(X.clipped_logit("p")).collect()
    assert [round(r[0], 5) for r in p] == [13.81551, 0.0, -13.81551]


def test_hash_split_is_portable(spark):
    df = spark.createDataFrame([("site20",), ("alpha",), ("42",)], "v string")
    got = df.select(X.hash_parity("v"), F.round(X.hash_fraction("v", "candidate-posterior-nested-0"), 7)).collect()
    assert [tuple(r) for r in got] == [(1, 0.9190631), (1, 0.5108531), (1, 0.3528942)]


def test_haversine(spark):
    r = spark.range(1).select(X.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)), X.haversine_km(F.lit(10.0), F.lit(20.0), F.lit(-10.0), F.lit(25.0))).first()
    assert abs(r[0] - 111.195080) < 1e-5 and abs(r[1] - 2291.659124) < 1e-5


def test_lists(spark):
    df = spark.createDataFrame([('["a","b"]',), ("a| b ;c",), (None,), ("nan",), ("",)], "t string")
    assert [r[0] for r in df.select(X.parse_list("t")).collect()] == [["a", "b"], ["a", "b", "c"], [], [], []]


def test_pairwise_functions():
    assert ungapped("ACGTAC", "TTACGTACGG", 0.8, 4) == (0.0, 6, 2)
    assert ungapped("ACGNAC", "TTACGTACGG", 0.8, 4) == (0.0, 6, 2)
    assert ungapped(None, "A", 0.8, 4) is None and ungapped("", "", 0.8, 1) is None
    assert infix_identity("ACGT", "TTACGTTT") == 1.0 and infix_identity("ACGT", "TTACTTTT") == 0.75 and infix_identity("", "A") is None


# -- records -------------------------------------------------------------------------------------


def test_majority_parent(spark):
    df = spark.createDataFrame([("x", "P"), ("x", "P"), ("x", "Q"), ("y", "S"), ("y", "R"), (None, "Z"), ("z", None)], "c string, p string")
    assert rows(R.majority_parent(df, "c", "p")) == sorted([("x", "P"), ("x", "P"), ("y", "R"), (None, "Z"), ("z", None)], key=str)


def test_conflicts_and_audit(spark):
    df = spark.createDataFrame([("AC", "s1"), ("AC", "s2"), ("GG", "s1"), ("GG", "s1"), (None, "s3"), (None, "s4")], "seq string, sp string")
    assert sorted(map(tuple, R.drop_conflicting(df, "seq", "sp").collect()), key=str) == sorted([("GG", "s1"), ("GG", "s1"), (None, "s3"), (None, "s4")], key=str)
    a = R.conflict_audit(df, "seq", ["sp"]).first()
    assert tuple(a) == (6, 3, 2)
    assert tuple(R.conflict_audit(df.limit(0), "seq", ["sp"]).first()) == (0, 0, 0)


def test_leak_audit_fails_the_build(spark):
    a = spark.createDataFrame([("p1",), ("p2",), (None,)], "k string")
    b = spark.createDataFrame([("p2",), (None,)], "k string")
    o = R.split_overlaps({"train": a, "test": b}, "k")
    assert rows(o) == [("test", "train", 1)]
    with pytest.raises(ValueError):
        R.require_disjoint(o)
    R.require_disjoint(o, [("train", "test")])


def test_supported_rank(spark):
    rks = ["species_name", "genus_name", "family_name", "order_name"]
    data = [("A", "s1", "g", "f", "o"), ("B", "s1", "g", "f", "o"), ("B", "s2", "g", "f", "o"), ("C", "s1", "g1", "f", "o"), ("C", "s3", "g2", "f", "o"), ("D", None, None, None, None)]
    df = spark.createDataFrame(data, "seq string, species_name string, genus_name string, family_name string, order_name string")
    assert {r["seq"]: r["supported_rank"] for r in R.exact_cluster_support(df, "seq", rks).collect()} == {"A": "species", "B": "genus", "C": "family", "D": "unresolved"}


def test_splits_cover_everything(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("k"), (F.col("id") % 4).cast("string").alias("s"))
    x = R.stratified_split(df, "k", "s", {"train": 0.7, "validation": 0.1, "test": 0.2}, "t")
    n = {(r["s"], r["split"]): r["count"] for r in x.groupBy("s", "split").count().collect()}
    assert x.count() == 500 and all(n[(s, "train")] == 88 for s in "0123")
    h = R.held_out_members(df, "s", "k", 3, "t")
    assert h.groupBy("s").count().where("count <> 3").count() == 0
    assert R.complete_groups(df, "s", 2, "t").groupBy("s").count().count() == 2


# -- candidates ----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def ties(spark):
    return spark.createDataFrame([(0.9, True, 1), (0.8, True, 2), (0.8, False, 3), (0.7, True, 4), (0.6, False, 5), (float("nan"), True, 6), (None, True, 7)], "c double, ok boolean, i int")


def test_thresholds_with_ties(ties):
    tied = {r["target_precision"]: (r["threshold"], r["n_accepted"]) for r in C.fit_thresholds(ties, [], "c", "ok", [0.75, 0.8, 1.01]).collect()}
    assert tied == {0.75: (0.7, 4), 0.8: (0.9, 1), 1.01: (None, 0)}
    row = {r["target_precision"]: (r["threshold"], r["n_accepted"]) for r in C.fit_thresholds_rowwise(ties, [], "c", "ok", ["i"], [0.75, 0.8, 1.01]).collect()}
    assert row == {0.75: (0.7, 4), 0.8: (0.8, 2), 1.01: (None, 0)}


def test_policy_ignores_nan_and_null(spark):
    df = spark.createDataFrame([(0.3333, 0.6667, None), (None, float("nan"), 1.0), (None, None, None)], "s double, g double, o double")
    t = {"species": 0.5, "genus": 0.6, "order": 0.9}
    assert [r[0] for r in df.select(C.assign_rank(df, {"species": "s", "genus": "g", "order": "o"}, t)).collect()] == ["genus", "order", "no_call"]
    assert df.select(C.assign_rank(df, {"species": "s"}, {"species": None})).first()[0] == "no_call"


def test_consensus_and_margins(spark):
    df = spark.createDataFrame([("q", 1, "G1", 0.9), ("q", 2, "G1", 0.6), ("q", 3, "G2", 0.3), ("r", 1, "G9", 0.5)], "q string, place int, g string, s double")
    c = {r["q"]: (r["top_g"], round(r["g_consensus"], 4), r["g_unique"]) for r in C.consensus(df, ["q"], "g", "g").collect()}
    assert c == {"q": ("G1", 0.6667, 2), "r": ("G9", 1.0, 1)}
    m = {r["q"]: (r["margin_1_2"], r["relative_margin"]) for r in C.margins(df, ["q"], "s").collect()}
    assert abs(m["q"][0] - 0.3) < 1e-9 and abs(m["q"][1] - 0.333333) < 1e-5 and m["r"] == (None, None)


def test_rerank_window(spark):
    df = spark.createDataFrame([("q", 1, "a", 0.2), ("q", 2, "b", 0.1), ("q", 3, "c", 0.05), ("q", 4, "d", 0.0)], "q string, place int, x string, d double")
    got = [r["x"] for r in C.rerank_window(df.withColumn("d", F.when(F.col("x") != "a", F.col("d"))), ["q"], "d", 3).orderBy("new_place").collect()]
    assert got == ["c", "b", "a", "d"]
    none = [r["x"] for r in C.rerank_window(df.withColumn("d", F.lit(None).cast("double")), ["q"], "d", 3).orderBy("new_place").collect()]
    assert none == ["a", "b", "c", "d"]


def test_prior_rerank(spark):
    df = spark.createDataFrame([("q", 1, 0.9, 0.0), ("q", 2, 0.88, 4.0), ("q", 3, 0.85, 1.0)], "q string, place int, s double, n double")
    a = [(r["place"], round(r["combined_score"], 6)) for r in C.rerank_by_prior(df, ["q"], "s", ["n"], 0.05, 0.03).orderBy("new_place").collect()]
    assert a == [(2, 0.960472), (3, 0.884657), (1, 0.87)]


def test_sets_scores(spark):
    p = spark.createDataFrame([("s", "b"), ("s", "c"), ("u", "a")], "k string, v string")
    t = spark.createDataFrame([("s", "a"), ("s", "b"), ("w", "a")], "k string, v string")
    got = {r["k"]: (r["jaccard"], r["precision"], r["recall"]) for r in C.set_scores(p, t, "k", "v").collect()}
    assert got == {"s": (1 / 3, 0.5, 0.5), "u": (0.0, 0.0, None), "w": (0.0, None, 0.0)}


def test_competition_rank_and_auroc(spark):
    df = spark.createDataFrame([("q", 0.8, True), ("q", 0.9, False), ("q", 0.8, False), ("q", 0.7, False), ("z", 0.5, False)], "q string, s double, t boolean")
    assert rows(C.competition_rank(df, ["q"], "s", F.col("t"))) == [("q", 2)]
    x = spark.createDataFrame([(0.9, True), (0.7, True), (0.7, True), (0.7, False), (0.4, False)], "s double, y boolean")
    assert abs(S.auroc(x, "s", "y").first()["auroc"] - 0.833333) < 1e-5
    assert S.auroc(x.where("y"), "s", "y").first()["auroc"] is None


def _four_ranks(spark):
    listed = [("Rhombus_a", "Rhombus", "Rhombidae", "Pleuro"), ("Rhombus_b", "Rhombus", "Rhombidae", "Pleuro"), ("Solea_c", " ", "Soleidae", "Pleuro"), ("Labrus_d", "Newlabrus", None, "Perci")]
    lineage = RP.lineages(spark.createDataFrame(listed, "tree_label string, genus_name string, family_name string, order_name string").withColumn("label", F.lit(1)))
    # truth, candidates in order of place
    data = [("q1", "Rhombus_a", ["Rhombus_b", "Solea_c", "Rhombus_a"]), ("q2", "Solea_c", ["Rhombus_a", "Labrus_d"]), ("q3", "Labrus_d", ["Labrus_d"]), ("q4", "Unlisted_x", ["Unlisted_y", "Labrus_d"])]
    rows_ = [(q, t, i + 1, c, 1.0 - i / 4) for q, t, cs in data for i, c in enumerate(cs)]
    t = spark.createDataFrame(rows_, "q string, truth string, place int, cand string, score double").withColumn("m", F.lit("m"))
    return RP.with_rank_values(RP.with_rank_values(t, "cand", lineage, "value"), "truth", lineage, "truth")


def test_hits_at_four_ranks_with_fall_backs(spark):
    """Worked out by hand: a genus from the list, else from the label; no family or order outside the list."""
    got = {(r["rank"], r["k"]): (r["n_queries"], r["hit_rate"]) for r in RP.rank_hits(_four_ranks(spark), ["q", "m"], ["m"], [1, 3]).collect()}
    assert got == {("species", 1): (4, 0.25), ("species", 3): (4, 0.5), ("genus", 1): (4, 0.75), ("genus", 3): (4, 0.75), ("family", 1): (4, 0.25), ("family", 3): (4, 0.25), ("order", 1): (4, 0.75), ("order", 3): (4, 0.75)}


def test_policy_is_fitted_and_applied_at_four_ranks(spark):
    f = RP.rank_features(_four_ranks(spark), ["q", "m"], "score")
    x = {r["q"]: r for r in f.collect()}
    assert x["q1"]["genus_consensus"] == pytest.approx(2 / 3) and x["q1"]["right_genus"] and not x["q1"]["right_species"] and x["q1"]["relative_margin"] == pytest.approx(0.25)
    assert x["q2"]["order_consensus"] == 0.5 and x["q2"]["right_order"] and not x["q2"]["right_family"]
    assert x["q3"]["right_family"] is None and x["q3"]["relative_margin"] is None and x["q3"]["first_genus"] == "Newlabrus"
    assert x["q4"]["right_genus"] and x["q4"]["right_order"] is None and x["q4"]["family_consensus"] is None
    fit = {r["rank"]: r["threshold"] for r in RP.fitted_policy(f, ["m"], [1.0]).collect()}
    assert fit == {"species": None, "genus": pytest.approx(2 / 3), "family": None, "order": 0.5}
    a = {r["q"]: (r["assigned_rank"], r["right"]) for r in RP.applied_policy(f, RP.fitted_policy(f, ["m"], [1.0]), ["m"]).collect()}
    assert a == {"q1": ("genus", True), "q2": ("order", True), "q3": ("genus", True), "q4": ("no_call", None)}
    assert RP.rank_features(_four_ranks(spark).limit(0), ["q", "m"], "score").count() == 0


# -- statistics, places, trees, retrieval --------------------------------------------------------


def test_agreement_of_equal_labellings(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), ("b", 2), ("c", 3)], "t string, c int")
    r = S.clustering_agreement(df, "t", "c").first()
    assert abs(r["homogeneity"] - 1) < 1e-9 and abs(r["adjusted_rand"] - 1) < 1e-9
    assert abs(S.adjusted_mutual_information(df, "t", "c") - 1) < 1e-9


def test_near_pairs_is_the_whole_join(spark):
    pts = [(f"k{i}", float(la), float(lo)) for i, (la, lo) in enumerate([(0, 179.9), (0, -179.9), (89.9, 0), (89.9, 180), (10, 10), (10.3, 10.2), (-45, 60), (None, 1) if False else (-45.2, 60.1)])]
    df = spark.createDataFrame([*pts, ("n", None, 1.0), ("m", float("nan"), 1.0)], "k string, la double, lo double")

    def km(a, b):
        p = [math.radians(x) for x in (*a, *b)]
        h = math.sin((p[2] - p[0]) / 2) ** 2 + math.cos(p[0]) * math.cos(p[2]) * math.sin((p[3] - p[1]) / 2) ** 2
        return 2 * X.EARTH_KM * math.asin(math.sqrt(min(1, h)))

    for r in (30.0, 60.0, 500.0, 5000.0):
        want = {(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and km(a[1:], b[1:]) <= r}
        assert {(x["key_a"], x["key_b"]) for x in P.near_pairs(df, "k", "la", "lo", r).collect()} == want


def test_newick_tree_distances(spark):
    from rankforge.sources.formats import parse_newick

    nodes = spark.createDataFrame(parse_newick("((A:1,B:1):2,(C:2,D:1):1);"), "node long, parent long, name string, length double, edge long")
    c = T.closure_from_nodes(nodes)
    pairs = spark.createDataFrame([("A", "B"), ("A", "C"), ("C", "D"), ("B", "D"), ("A", "A"), ("A", "Z")], "a string, b string")
    assert {(r["a"], r["b"]): r["distance"] for r in T.path_distance(pairs, c).collect()} == {("A", "B"): 2.0, ("A", "C"): 6.0, ("C", "D"): 3.0, ("B", "D"): 5.0, ("A", "A"): 0.0, ("A", "Z"): None}
    deep = "(" * 5000 + "x" + ")" * 5000 + ";"
    assert len(parse_newick(deep)) == 5001


def test_cosine_search_in_blocks(spark):
    df = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)] + [(99, [0.0, 0.0, 0.0]), (98, None)], "id long, v array<float>")
    q, c = df.where("id % 5 = 0"), df.where("id % 5 <> 0")
    whole = rows(V.cosine_topk(q, c, 4))
    assert whole == rows(V.cosine_topk(q, c, 4, block_cells=30)) and len(whole) == 12 * 4
    assert V.cosine_topk(q.limit(0), c, 4).count() == 0


def test_kmer_search_dense_and_sparse_agree(spark):
    data = [(f"s{i:02d}", "".join("ACGT"[(i * j * j + j) % 4] for j in range(60)) + "ACGTTGCA") for i in range(20)] + [("n", "NNNN"), ("z", None)]
    df = spark.createDataFrame(data, "id string, s string")
    q, c = df.where("id < 's05'"), df.where("id >= 's05'")
    dense = [(r["query_id"], r["place"], round(r["score"], 6)) for r in V.kmer_topk(q, c, 4, 3).orderBy("query_id", "place").collect()]
    a, b = (V.kmer_profile(x.where("s is not null"), "id", "s", 4).withColumnRenamed("n", "w") for x in (q, c))
    sparse = [(r["query_id"], r["place"], round(r["score"], 6)) for r in V.weighted_topk(a, b, 3).orderBy("query_id", "place").collect()]
    assert dense == sparse and dense


def test_cosine_search_without_own_id(spark, small):
    from rankforge.plans import evidence_queries as E
    from rankforge.runtime import table

    e = spark.createDataFrame([(i, [float(i % 4), 1.0]) for i in range(8)], "id long, v array<float>")
    got = rows(V.cosine_topk(e, e, 7, own=False).select("query_id", "candidate_id"))
    assert got == rows(V.cosine_topk(e, e, 7, 6, own=False).select("query_id", "candidate_id")) and got == [(a, b) for a in range(8) for b in range(8) if a != b]
    n = table(spark, small, "embeddings").where("vec_id % 20 = 0").count()
    whole = E.r_cosine_topk(spark, small)
    assert whole.count() == 10 * n and whole.where("candidate_id % 5 = 0").count() > 0 and whole.where("candidate_id = query_id").count() == 0
    found = E.r_cell_recall(spark, small).first()
    assert found["n_exact"] == 10 * n and found["recall"] >= 0.9
    assert E.r_knn_labels(spark, small).agg(F.sum("n")).first()[0] == n


@pytest.mark.parametrize("idf", [False, True])
def test_kmer_search_by_groups(spark, idf):
    """The best of each group, whatever the number of its copies, as by brute force."""
    import random

    r = random.Random(5)
    base = ["".join(r.choice("ACGT") for _ in range(80)) for _ in range(5)]
    change = lambda s, n: "".join(r.choice("ACGTN") if r.random() < n else x for x in s)
    q = [(f"q{i}", change(base[i % 5], 0.1)) for i in range(8)] + [("q0", base[3]), ("none", "NNNN"), (None, base[0])]
    c = [(f"c{i:02}", change(base[i % 5], 0.05), f"g{i % 5}" if i % 7 else None) for i in range(40)] + [(f"x{i}", base[1], "g1") for i in range(9)]
    grams = lambda s: [s[i : i + 4] for i in range(len(s) - 3) if set(s[i : i + 4]) <= set("ACGT")]
    cc = [x for x in c if x[2]]
    docs = {(i, s) for i, s in q if i} | {x[:2] for x in cc}
    w = lambda m: math.log((1 + len(docs)) / (1 + sum(m in grams(s) for _, s in docs))) + 1 if idf else 1.0
    weight = {m: w(m) for m in {m for _, s in docs for m in grams(s)}}

    def cosine(a, b):
        x, y = ({m: grams(s).count(m) * weight[m] for m in set(grams(s))} for s in (a, b))
        return sum(v * y.get(m, 0) for m, v in x.items()) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))

    want = []
    for i in sorted({i for i, s in q if i and grams(s)}):
        best = {g: max(round(cosine(s, t), 9) for j, s in q if j == i for _, t, h in cc if h == g) for g in {x[2] for x in cc}}
        want += [(i, p + 1, g, round(v, 6)) for p, (g, v) in enumerate(sorted(best.items(), key=lambda e: (-e[1], e[0]))[:3])]
    qd, cd = spark.createDataFrame(q, "id string, s string"), spark.createDataFrame(c, "id string, s string, g string")
    for cells in (V.BLOCK_CELLS, 4**4 * 20):
        got = V.kmer_topk_groups(qd, cd, 4, 3, idf, cells).collect()
        assert sorted((x["query_id"], x["place"], x["group"], round(x["score"], 6)) for x in got) == want


@pytest.mark.parametrize("idf", [False, True])
def test_kmer_groups_compare_few_rows(spark, idf):
    """Bounds pass over most of the catalogue and change no result, in several blocks of queries and slabs of the catalogue."""
    import random

    import numpy as np

    r = random.Random(8)
    base = ["".join(r.choice("ACGT") for _ in range(400)) for _ in range(60)]
    change = lambda s, n: "".join(r.choice("ACGTN") if r.random() < n else x for x in s)
    c = [(f"c{g:02}-{i}", change(b, 0.02), f"g{g:02}") for g, b in enumerate(base) for i in range(3 if g else 90)] + [("short", base[0][:60], "g00"), ("none", "N" * 9, "g99")]
    q = [(f"q{i:02}", change(base[i % 3], 0.03) + change(base[i % 5 + 3], 0.03) + change(base[i % 7 + 8], 0.03)) for i in range(24)] + [("copy", q0 := base[4][:200]), ("copy2", q0), ("tiny", "ACGTAC"), ("gone", "NNN")]
    w = np.ones(4**6)
    docs = V.dense_profiles([s for _, s in q] + [s for _, s, _ in c], 6)
    if idf:
        w = np.log((1 + len(docs)) / (1 + (docs > 0).sum(axis=0))) + 1
    m = docs * w
    m = m / np.maximum(np.sqrt((m * m).sum(axis=1)), 1e-300)[:, None]
    score = np.round(m[: len(q)] @ m[len(q) :].T, 9)
    want = []
    for (i, s), row in zip(q, score):
        best: dict = {}
        for (cid, t, g), x in zip(c, row):
            if t != "N" * 9:
                best[g] = min(best.get(g, (1, "")), (-x, cid))
        want += [(i, p + 1, g, cid, round(-x, 6)) for p, (x, g, cid) in enumerate(sorted((x, g, cid) for g, (x, cid) in best.items())[:3]) if s != "NNN"]
    a, b = spark.createDataFrame(q, "id string, s string"), spark.createDataFrame(c, "id string, s string, g string")
    for cells in (V.GROUP_CELLS, 4**6 * 10):
        got = V.kmer_topk_groups(a, b, 6, 3, idf, cells).collect()
        assert sorted((x["query_id"], x["place"], x["group"], x["candidate_id"], round(x["score"], 6)) for x in got) == sorted(want)
    one = V.Profiles([s for _, s, g in c], 6, w)
    probe = V.Profiles([s for i, s in q[:24]], 6, w)
    third = np.sort(np.stack([score[:24, [k for k, x in enumerate(c) if x[2] == g]].max(axis=1) for g in sorted({x[2] for x in c})]), axis=0)[-3]
    seen, exact = [], V.Profiles.exact
    V.Profiles.exact = lambda self, x, other, y: seen.append(len(x)) or exact(self, x, other, y)
    try:
        assert sum(len(x[0]) for x in V._search_slab(probe, third, one, np.array([x[2] for x in c]), 3)) == sum(seen) < 24 * len(c) / 20
    finally:
        V.Profiles.exact = exact


def test_species_hits_take_every_query(spark, small):
    from rankforge.plans import evidence_queries as E

    n = E._clean(spark, small, "unseen").unionByName(E._clean(spark, small, "eval_c_unseen_species")).where("processid is not null and nucleotides is not null").select("processid").distinct().count()
    got = E.r_kmer_cosine(spark, small)
    assert got.count() == 3 * n == got.select("query_id", "species_name").distinct().count()
    assert E._clean(spark, small).join(got, F.col("processid") == F.col("candidate_id"), "left_semi").count() > 0


def test_masked_query_in_a_large_cluster(spark, tmp_path):
    """More than 200 nearer candidates of the query's own label do not take its row away."""
    from rankforge.plans import evidence_queries as E

    data = [(i, [1.0, i / 1000], 1) for i in range(400)] + [(401, [0.0, 1.0], 2), (402, [1.0, 0.0], None)]
    spark.createDataFrame(data, "vec_id long, embedding array<float>, label long").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert rows(E.r_masked(spark, str(tmp_path))) == sorted([(i, 401) for i in range(0, 400, 20)], key=str)


def test_similar_classes_are_all_pairs(spark):
    """Groups of more than 4 copies, conserved stretches and short sequences: as by comparing all sets."""
    import random

    r = random.Random(3)
    base = ["".join(r.choice("ACGT") for _ in range(300)) for _ in range(6)]
    recs = [(f"copy{i}", base[0]) for i in range(7)] + [(None, base[0]), ("short", "ACGT"), ("short2", "ACGT"), ("gone", None), ("n", "N" * 40)]
    for g, b in enumerate(base):
        for i in range(12):
            s = list(b)
            for at in r.sample(range(300), i % 4):
                s[at] = r.choice("ACGTN")
            recs.append((f"r{g}-{i}", "".join(s)[: 300 - 3 * (i % 5)]))
    kept = [(i, s) for i, s in recs if i and s]
    sets = [{s[a : a + 12] for a in range(len(s) - 11) if "N" not in s[a : a + 12]} for _, s in kept]
    want = {(a, b) for a in range(len(kept)) for b in range(a) if kept[a][1] == kept[b][1] or (sets[a] & sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))}
    df = spark.createDataFrame(recs, "id string, s string")
    got = rows(V.similar_classes(df, 0.8))
    assert got == rows(V.similar_classes(df, 0.8, block=10))
    assert sum(x[4] for x in got) == len(want) > 200
    cls = dict(map(tuple, V.sequence_classes(df).collect()))
    assert {tuple(sorted((cls[kept[a][0]], cls[kept[b][0]]))) for a, b in want} == {x[:2] for x in got}
    assert V.similar_classes(df.limit(0), 0.8).count() == 0


def test_largest_groups_stay_in_training(spark):
    """A genus of a third of all rows is never held out, and the number held out grows with the candidates."""
    data = [("big", f"s{i % 3}") for i in range(300)] + [(f"g{i:03}", f"s{j}") for i in range(300) for j in range(2)] + [(None, "x")]
    df = spark.createDataFrame(data, "g string, s string")
    got = R.unseen_groups_by_share(df, "g", "s", 2, 50, 1, 0.1, "t").collect()
    assert len(got) == 30 and "big" not in {x["g"] for x in got}
    assert "big" in {x["g"] for x in R.unseen_groups(df, "g", "s", 2, 50, 301, "t").collect()}
    assert R.without_largest(df, "g", 1).count() == 600
    assert R.unseen_groups_by_share(df, "g", "s", 2, 50, 1, 0.01, "t").count() == 20


@pytest.mark.parametrize("n_labels", [0, 1, 4, 6, 24, 100])
def test_random_ranking_without_replacement(spark, n_labels):
    q = spark.createDataFrame([(f"q{i}", "m") for i in range(50)], "q string, m string")
    labels = spark.createDataFrame([(f"l{i}",) for i in range(n_labels)] + [(None,)], "l string")
    got = V.random_ranking(q, ["q", "m"], labels, "l", 5, "c").collect()
    take = min(5, n_labels)
    assert len(got) == 50 * take == len({(x["q"], x["l"]) for x in got})
    assert {(x["place"], x["score"]) for x in got} == {(i + 1, 4 - i) for i in range(take)}
    assert n_labels < 24 or len({x["l"] for x in got if x["place"] == 1}) > 10


def test_every_method_has_its_rows(spark, small):
    """No method is left out where a method is a key."""
    from rankforge.plans import registry
    from rankforge.plans.candidate_queries import _first, _top

    methods = {x[0] for x in _top(spark, small).select("method").distinct().collect()}
    q = registry.queries()
    for n in ("g_neighborhood", "e_cooccurrence", "w_equal_bins"):
        assert {x[0] for x in q[n](spark, small).select("method").distinct().collect()} == methods and len(methods) > 1
    assert q["w_equal_bins"](spark, small).agg(F.sum("n")).first()[0] == _first(spark, small).count()


def test_running_sums_over_ranges(spark):
    from pyspark.sql import Window

    from rankforge.operators.ordering import global_places, running_sums

    df = spark.range(500).select(F.when(F.col("id") % 7 == 0, None).otherwise((F.col("id") % 2).cast("string")).alias("g"), ((F.col("id") * 37) % 501).alias("v"), F.lit(2).alias("n"))
    for desc in (False, True):
        w = Window.partitionBy("g").orderBy(F.desc("v") if desc else F.asc("v")).rowsBetween(Window.unboundedPreceding, 0)
        assert rows(running_sums(df, ["g"], "v", ["n"], desc)) == rows(df.withColumn("run_n", F.sum("n").over(w)))
    assert running_sums(df.limit(0), ["g"], "v", ["n"]).count() == 0
    assert [(r["place"], r["v"]) for r in global_places(df, ["v"]).orderBy("place").collect()] == [(i + 1, v) for i, v in enumerate(sorted(r["v"] for r in df.collect()))]
