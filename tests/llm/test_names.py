import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankforge.llm.components import connected
from rankforge.llm.group_split import assign_splits, placed_largest_first, related_groups, split_report
from rankforge.llm.name_mapping import map_names, unmatched_values
from rankforge.llm.name_trie import GenusReader, Resolver, Trie, is_blank

LIST = [
    ("Gadus_morhua", "Gadus morhua", "Gadus", "Gadus"),
    ("Gadus_ogacensis", "Gadus ogacensis", "Gadus", "Gadus"),
    ("Merlangius_merlangus", "Merlangius merlangus", "Merlangius", "Merlangius"),
    ("Melanogrammus_aeglefinus", "Melanogrammus aeglefinus", "Melanogrammus", "Melanogrammus"),
    ("Pollachius_virens", "Pollachius virens", "Theragra", "Pollachius"),
    ("Pollachius_pollachius", "Pollachius pollachius", "Pollachius", "Pollachius"),
    ("Micromesistius_morhua", "Micromesistius morhua", "Micromesistius", "Micromesistius"),
]


@pytest.fixture(scope="module")
def resolver():
    return Resolver(LIST)


@pytest.mark.parametrize(
    "text,label",
    [
        ("Gadus morhua", "Gadus_morhua"), ("GADUS MORHUA", "Gadus_morhua"), ("  gadus_morhua ", "Gadus_morhua"), ("GadusMorhua", "Gadus_morhua"), ("Gadus+morhua", "Gadus_morhua"),
        ("Gadus&#32;morhua", "Gadus_morhua"), ("Gadus&nbsp;morhua", "Gadus_morhua"), ("Gаdus mоrhua", "Gadus_morhua"), ("Ｇａｄｕｓ　ｍｏｒｈｕａ", "Gadus_morhua"), ("Gadus mor​hua", "Gadus_morhua"),
        ("Gadus morhua (Linnaeus, 1758)", "Gadus_morhua"), ("Gadus morhua Linnaeus 1758", "Gadus_morhua"), ("Taxon Gadus morhua", "Gadus_morhua"), ("species: Gadus morhua", "Gadus_morhua"),
        ("Gadus morhua larva", "Gadus_morhua"), ("Gadus morhua morhua", "Gadus_morhua"), ("[Gadus morhua] #62", "Gadus_morhua"), ("morhua, Gadus", "Gadus_morhua"), ("Gadus morhau", "Gadus_morhua"),
        ("Gadus m0rhua", "Gadus_morhua"), ("Merlangius merlanqus", "Merlangius_merlangus"), ("Melanograrnmus aeglefinus", "Melanogrammus_aeglefinus"), ("P. virens", "Pollachius_virens"), ("P virens", "Pollachius_virens"),
        ("M. aeglefinus", "Melanogrammus_aeglefinus"), ("Gadus sp.", None), ("Gadus", None), ("Gadus macrocephalus", None), ("environmental sample", None), ("", None), (" ", None), ("NA", None), (None, None), ("Sebastes mentella", None),
    ],
)
def test_forms_of_a_name(resolver, text, label):
    assert resolver.species(text) == label


def test_ties_are_no_match():
    r = Resolver([("Aaaaa_bbbbbx", "Aaaaa bbbbbx", None, None), ("Aaaaa_bbbbby", "Aaaaa bbbbby", None, None)])
    assert r.species("Aaaaa bbbbbz") is None and r.species("Aaaaa bbbbbx") == "Aaaaa_bbbbbx"
    s = Resolver([("Gadus_morhua", "Gadus morhua", None, None), ("Genus_morhua", "Genus morhua", None, None)])
    assert s.species("G. morhua") is None


def test_genera(resolver):
    g = GenusReader(resolver)
    assert [g.from_name(t) for t in ("Gadus sp.", "Gaduss indet", "Pollachius virens", "Sebastes mentella", "SEBASTES MENTELLA", "environmental sample", "no hit", None, "nan", "bycatch 3")] == ["Gadus", "Gadus", "Pollachius", "Sebastes", "Sebastes", None, None, None, None, None]
    assert [g.from_genus(t) for t in ("gadus", " Theragra ", "Merlangus", "sebastes", "", None)] == ["Gadus", "Theragra", "Merlangius" if g.listed("merlangus") else "Merlangus", "Sebastes", None, None]


def edits(a: str, b: str) -> int:
    """Plain table: replace, add, lose, exchange neighbours, rn for m."""
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i or not j:
                d[i][j] = i or j
                continue
            x = [d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1])]
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                x.append(d[i - 2][j - 2] + 1)
            if a[i - 2 : i] == "rn" and b[j - 1] == "m" and i > 1:
                x.append(d[i - 2][j - 1] + 1)
            if b[j - 2 : j] == "rn" and a[i - 1] == "m" and j > 1:
                x.append(d[i - 1][j - 2] + 1)
            d[i][j] = min(x)
    return d[-1][-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abmrn", min_size=3, max_size=9), min_size=1, max_size=12), st.text("abmrn", min_size=3, max_size=9), st.integers(0, 3))
def test_automaton_equals_the_table(words, q, k):
    t = Trie()
    for w in set(words):
        t.add(w, w)
    assert t.within(q, k) == {w: d for w in set(words) if (d := edits(q, w)) <= k}


def test_long_text_is_no_name(resolver):
    assert resolver.species('and so ' * 70 + 'Gadus morhau') == resolver.species('Gadus morhau') is not None
    assert resolver.species("word " * 50_000) is None
    assert is_blank(None) and is_blank(" UNCLASSIFIED ") and not is_blank("x")


def _records(spark, data):
    cols = "processid string, species_name string, tree_label string, genus_name string, loaded_at long"
    return spark.createDataFrame(data, cols).withColumn("text", F.lit(1)).withColumn("label", F.lit(2)).withColumn("group_label", F.lit(3))


def _listed(spark):
    return spark.createDataFrame(LIST, "tree_label string, species_name string, genus_name string, genus_from_label string").withColumn("text", F.lit("x"))


def test_mapping_of_records(spark):
    r = _records(spark, [("a", "Gadus morhua", None, None, 1), ("b", None, "Gadus_morhua", None, 1), ("c", "Gadus sp.", "Pollachius_virens", "Gadus", 1), ("d", "no hit", " ", None, 1), ("e", None, None, None, None), ("f", "gadus morhua", None, None, 1), ("f", "gadus morhua", None, None, 2), (None, "gadus morhua", None, None, 1)])
    got = {x["processid"]: x["candidate_label"] for x in map_names(r, _listed(spark)).collect()}
    assert got == {"b": "Gadus_morhua", "c": "Pollachius_virens", "d": "unmatched", "e": "unmatched", "f": "Gadus_morhua"}
    assert map_names(r, _listed(spark)).count() == 5
    assert sum(x["n_records"] for x in unmatched_values(r, _listed(spark)).collect()) == 2
    assert map_names(r.limit(0), _listed(spark)).count() == 0
    assert {x["candidate_label"] for x in map_names(r, _listed(spark).limit(0)).collect()} == {"unmatched"}


def test_related_records_share_a_split(spark):
    data = [("a", "Gadus morhua", None, "Merlangius", 1), ("b", "Merlangius merlangus", None, None, 1), ("c", None, "Pollachius_virens", "Theragra", 1), ("d", "Sebastes mentella", None, None, 1), ("e", "no hit", None, None, 1), ("g", None, None, None, 1)]
    g = related_groups(_records(spark, data), _listed(spark))
    assert {(x["processid"], x["group_label"]) for x in g.collect()} == {("a", "Gadus"), ("b", "Gadus"), ("c", "Pollachius"), ("d", "Sebastes")}
    t = spark.createDataFrame([("train", 0.5), ("test", 0.5)], "split string, target_share double")
    a = assign_splits(g, t)
    assert sorted((x["group_label"], x["n_records"], x["split"]) for x in a.collect()) == [("Gadus", 2, "test"), ("Pollachius", 1, "train"), ("Sebastes", 1, "train")]
    rep = {x["split"]: (x["n_records"], x["actual_share"]) for x in split_report(a, t).collect()}
    assert rep == {"train": (2, 0.5), "test": (2, 0.5)}
    none = assign_splits(g.limit(0), t)
    assert none.count() == 0 and {x["n_records"] for x in split_report(none, t).collect()} == {0}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.integers(1, 90)), max_size=6, unique_by=lambda x: x[0]), st.integers(1, 4))
def test_dealing_by_size_equals_dealing_one_by_one(sizes, k):
    sizes = sorted(sizes, reverse=True)
    total = sum(n * c for n, c in sizes)
    want = {f"s{i}": total * (i + 1) / (k * (k + 1) / 2) for i in range(k)}
    have, out = dict.fromkeys(want, 0), {}
    for size, count in sizes:
        for _ in range(count):
            s = min(want, key=lambda x: (have[x] - want[x], x))
            have[s] += size
            out[size, s] = out.get((size, s), 0) + 1
    got = placed_largest_first(sizes, want)
    assert {k: sum(n for (z, s), n in got.items() if s == k) for k in want}.keys() == want.keys()
    assert got == out


def test_shares_of_many_groups(spark):
    """Far more groups than were once placed one by one: each share is met to a group."""
    groups = spark.range(150_000).select(F.concat(F.lit("g"), (F.col("id") % 30_000 + F.floor(F.sqrt("id")) % 7).cast("string")).alias("group_label"), F.col("id").cast("string").alias("processid"))
    t = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split string, target_share double")
    a = assign_splits(groups, t)
    n = groups.select("group_label").distinct().count()
    assert n > 20_000 and a.count() == n == a.select("group_label").distinct().count() and a.where("split is null").count() == 0
    for x in split_report(a, t).collect():
        assert abs(x["actual_share"] - x["target_share"]) < 0.0001
    assert a.count() and assign_splits(groups.limit(0), t).count() == 0


def test_ordinary_words_name_no_genus(spark):
    """Two words of which the second is no epithet name a genus only if another record surely does."""
    data = [("a", "Golden bream", None, None, 1), ("b", "ghost goby", None, None, 1), ("c", "Zyxwella bream", None, None, 1), ("d", "zyxwella morhuus", None, None, 1), ("e", None, None, "Golden", 1), ("f", "Mesh size", None, None, 1)]
    g = {(x["processid"], x["group_label"]) for x in related_groups(_records(spark, data), _listed(spark)).collect()}
    assert {("a", "Golden"), ("e", "Golden")} <= g and not {"b", "f"} & {p for p, _ in g}


def test_connected_groups_by_forests(spark):
    rnd = random.Random(4)
    links = [(f"n{rnd.randrange(300):03d}", f"n{rnd.randrange(300):03d}") for _ in range(180)] + [("n000", "n000"), (None, "n001"), ("c00", "c01")] + [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(60)]
    parent: dict = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a and b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(links, "a string, b string").withColumn("node", F.lit(1))
    got = {r["node"]: r["root"] for r in connected(df).collect()}
    assert got == {x: root(x) for x in parent}
    nodes = spark.createDataFrame([(5,), (None,)], "k long")
    assert [tuple(r) for r in connected(spark.createDataFrame([], "a long, b long"), nodes).collect()] == [(5, 5)]
