import pytest
from pyspark.sql import functions as F

from rankforge.functions.sql_names import register
from rankforge.operators import evidence as E
from rankforge.operators import joins as J
from rankforge.operators.trees import taxonomy_closure


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_joins_by_the_shape_of_predictions(spark):
    left = spark.createDataFrame([("s1", "q1", "old"), ("s2", "q1", None), (None, "q2", "x")], "s string, q string, label string")
    by_query = spark.createDataFrame([("q1", "new")], "q string, label string")
    by_both = spark.createDataFrame([("s2", "q1", "both"), (None, "q2", "never")], "s string, q string, label string")
    assert rows(J.shaped_join(left, by_query, ["s", "q"]).select("s", "q", "label")) == rows(spark.createDataFrame([("s1", "q1", "new"), ("s2", "q1", "new"), (None, "q2", "x")], "s string, q string, label string"))
    assert rows(J.shaped_join(left, by_both, ["s", "q"]).select("s", "q", "label")) == rows(spark.createDataFrame([("s1", "q1", "old"), ("s2", "q1", "both"), (None, "q2", "x")], "s string, q string, label string"))
    with pytest.raises(ValueError):
        J.shaped_join(left, by_query.drop("q"), ["s", "q"])


def test_contracts_of_joins(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("a", 4)], "k string, v int")
    right = spark.createDataFrame([("a", 10)], "k string, w int")
    assert rows(J.many_to_one(left, right, ["k"])) == sorted([("a", 1, 10), ("b", 2, None), (None, 3, None), ("a", 4, 10)], key=str)
    with pytest.raises(ValueError, match="2 times"):
        J.many_to_one(left, right.unionByName(right), ["k"])
    ids = spark.createDataFrame([(1, "a"), (2, "a")], "position int, k string")
    assert rows(J.ordered_lookup(ids, "position", "k", right).select("position", "w")) == [(1, 10), (2, 10)]
    with pytest.raises(KeyError):
        J.ordered_lookup(ids.unionByName(spark.createDataFrame([(3, "z")], ids.schema)), "position", "k", right)
    assert J.many_to_one(left.limit(0), right, ["k"]).count() == 0


def test_sampled_pairs(spark):
    items = spark.createDataFrame([(f"i{i:02d}",) for i in range(12)] + [(None,), ("i00",)], "x string")
    p = rows(J.sampled_pairs(items, "x", 30, "s"))
    assert p == rows(J.sampled_pairs(items, "x", 30, "s")) and 10 < len(p) <= 30 and len(set(p)) == len(p) and all(a < b for a, b in p)
    assert J.sampled_pairs(items.where("x = 'i01'"), "x", 5, "s").count() == 0


def test_novelty_of_single_candidates_and_unknown_genera(spark):
    top = spark.createDataFrame([("q", 1, 0.9, "A"), ("q", 3, 0.5, "B"), ("q", 4, 0.4, "B"), ("r", 2, 0.3, None)], "q string, place int, s double, g string")
    got = {r["q"]: r for r in E.novelty_features(top, ["q"], "s", "g", 2).collect()}
    assert got["q"]["margin"] == pytest.approx(0.4) and got["q"]["modal_share"] == pytest.approx(2 / 3) and got["q"]["mean_top"] == pytest.approx(0.7) and got["q"]["n"] == 3
    assert got["r"]["margin"] == 0.0 and got["r"]["modal_share"] == 0.0
    assert E.novelty_features(top.limit(0), ["q"], "s", "g", 2).count() == 0


def test_gates_and_locks(spark):
    df = spark.createDataFrame([("m", float(i), i >= 5) for i in range(10)] + [("m", None, True), ("m", float("nan"), True)], "m string, x double, ok boolean")
    gates = E.gate_grid(df, ["m"], ["x"], [0.25, 0.5, 0.75])
    assert [round(r["gate"], 2) for r in gates.orderBy("quantile").collect()] == [2.25, 4.5, 6.75]
    best = E.best_gate(E.gate_counts(df, ["m"], gates, ["x"], "ok"), ["m"], 0.9).collect()
    assert [(r["quantile"], r["n_accepted"], r["n_correct"]) for r in best] == [(0.5, 5, 5)]
    assert E.best_gate(E.gate_counts(df.withColumn("ok", F.lit(False)), ["m"], gates, ["x"], "ok"), ["m"], 0.9).count() == 0
    h = df.withColumn("seed", F.explode(F.array(F.lit(0), F.lit(1)))).where("seed = 0 or x > 2")
    assert rows(E.locked_thresholds(h, "seed", "m", "x", "ok", 1.0)) == [("m", 5.0)]


def test_pruned_tree_has_no_single_children(spark):
    df = spark.createDataFrame([("o", "f1", "a"), ("o", "f1", "b"), ("o", "f2", "c"), ("o", "f3", "d")], "o string, f string, t string")
    cl = taxonomy_closure(df, ["o", "f", "t"], [1.0, 1.0, 1.0])
    got = {r["ancestor"]: (r["n_tips"], r["n_children"]) for r in E.pruned(cl, spark.createDataFrame([("a",), ("b",), ("c",)], "t string"), "t").collect()}
    assert got == {"root": (3, 1), "o": (3, 2), "o|f1": (2, 2), "o|f1|a": (1, 0), "o|f1|b": (1, 0), "o|f2|c": (1, 0)}


def test_saved_statistics_with_missing_and_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "a double, b double")
    z = E.standardised_by(df, E.saved_statistics(df, ["a", "b"]), ["a", "b"])
    assert rows(z.select("z_a", "z_b")) == sorted([(-1.0, 0.0), (1.0, 0.0), (0.0, 0.0)], key=str)


def test_functions_in_sql(spark):
    register(spark)
    r = spark.sql("SELECT rf_p_distance('ACGN', 'ATGA') AS p, rf_cosine(array(0f), array(1f)) AS c, rf_clean_taxon('  NA ') AS t, rf_kmers('ACGNACG', 3) AS k, rf_wilson_lower(0, 0) AS w, rf_p_distance(null, 'A') AS n").first()
    assert (round(r["p"], 6), r["c"], r["t"], r["k"], r["w"], r["n"]) == (0.333333, None, None, ["ACG"], None, None)
    assert spark.sql("SELECT count(*) AS n, max(length) AS l FROM rf_newick_nodes('((a:1,b:2)x:3,c);')").first() == (5, 3.0)
