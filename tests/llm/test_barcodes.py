import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import rankforge.llm.segment_join as J
from rankforge.llm.barcode_kernels import banded_edits, canonical, matrix, pack, plain_bases, reverse_complement, sketches, unpack
from rankforge.llm.cluster_profiles import describe_clusters, pivot_groups
from rankforge.llm.barcode_kernels import syncmers
from rankforge.llm.pivot_clusters import ODD, cluster_links, similar
from rankforge.llm.segment_join import overlap_pairs, overlap_report, overlaps

RND = random.Random(11)


def dna(n, rnd=RND):
    return "".join(rnd.choice("ACGT") for _ in range(n))


def changed(s, n, rnd=RND, indels=True):
    s = list(s)
    for _ in range(n):
        p, k = rnd.randrange(20, len(s) - 20), rnd.random()
        if not indels or k < 0.6:
            s[p] = rnd.choice([c for c in "ACGT" if c != s[p]])
        elif k < 0.8:
            del s[p]
        else:
            s.insert(p, rnd.choice("ACGT"))
    return "".join(s)


def forms(s):
    """The same sequence in other written forms."""
    rc = reverse_complement(s.encode()).decode()
    return [s.lower(), s.replace("T", "U"), "N" * 20 + s, s + "NNN", "-" + s[:200] + "---" + s[200:], " ".join(s[i : i + 10] for i in range(0, len(s), 10)), rc, rc.lower(), s[:300] + "\n" + s[300:]]


def overlap_edits(a, b):
    """Least edits of any overlap with 300 compared bases, by the whole table, a row at a time; 99 where there is none."""
    unit = 4096
    x, y = (np.frombuffer(t.encode(), np.uint8) for t in (a, b))
    known = y != 78
    run = np.r_[0, np.cumsum(np.where(known, unit, 0))]
    row, ends = np.zeros(len(y) + 1, np.int64), []
    for c in x:
        step = np.where(known, np.where(y == c, -1, unit - 1), 0) if c != 78 else 0
        new = np.r_[0, np.minimum(row[:-1] + step, row[1:] + (unit if c != 78 else 0))]
        row = np.minimum.accumulate(new - run) + run
        ends.append(row[-1])
    ends = np.r_[ends, row].astype(np.int64)
    e = -(-ends // unit)
    good = e[e * unit - ends >= 300]
    return int(good.min()) if len(good) else 99


def test_canonical_form_and_packing():
    s = dna(400)
    want = {s.encode(), reverse_complement(s.encode())}
    assert all(canonical(f) in want for f in forms(s))
    assert canonical(None) == canonical("") == canonical("nan")[:0] == b"" and canonical("NNNN") == b"" and canonical("ACRT") == b"ACNT"
    t = canonical("ACGTNRAC" * 9)
    assert unpack(pack(t)) == t and unpack(pack(b"")) == b"" and plain_bases(b"ANNC") == 2


def test_banded_alignment_equals_the_whole_table():
    rnd = random.Random(5)
    a, b, diag = [], [], []
    for _ in range(25):
        s = dna(340, rnd)
        left = rnd.randrange(0, 10)
        t = changed(s[left : rnd.randrange(330, 341)], rnd.randrange(0, 5), rnd)
        t = t[:50] + "N" + t[51:]
        a.append(s.encode()), b.append(t.encode()), diag.append(left)
    e, n = banded_edits(matrix(a), np.array([len(x) for x in a]), matrix(b), np.array([len(x) for x in b]), np.array(diag), 8)
    assert [int(x) for x in e] == [overlap_edits(x.decode(), y.decode()) for x, y in zip(a, b)]
    assert (n >= 300).all()


def test_sketch_is_the_same_on_both_strands():
    s = [dna(300).encode() for _ in range(20)] + [b"ACGT" * 4, b"N" * 50]
    k1, _ = sketches(matrix(s), 16, ODD)
    k2, _ = sketches(matrix([reverse_complement(x) for x in s]), 16, ODD)
    assert (k1 == k2).all()


def test_syncmers_lie_close_and_do_not_depend_on_the_strand():
    s = [dna(300).encode() for _ in range(20)] + [b"ACGT" * 4, b"N" * 50, b"ACG"]
    row, place, key = syncmers(matrix(s))
    other, _, key2 = syncmers(matrix([reverse_complement(x) for x in s]))
    assert sorted(zip(row.tolist(), key.tolist())) == sorted(zip(other.tolist(), key2.tolist()))
    for i in range(20):
        at = np.sort(np.where(place[row == i] < 0, -place[row == i] - 1, place[row == i]))
        assert np.diff(at).max() <= 8 and at[0] <= 7 and at[-1] >= 300 - 16 - 7


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(21)
    base = [dna(640, rnd) for _ in range(6)]
    train = [(f"TRAIN{i:03d}-05", s, "lab", 1) for i, s in enumerate(base)]
    train += [(f"FORMS{i:03d}-05", f, "lab", 1) for i, f in enumerate(forms(base[0]))]
    train += [("TRAIN000-05", base[0].lower(), "lab", 2), ("NULLS001-05", None, "lab", 1), ("SHORT001-05", "ACGT", None, 1), (None, base[1], "lab", 1), ("EMPTY001-05", "", "lab", 1), ("LONGX001-05", base[2] + dna(30_000, rnd), "x", 1)]
    ev, want = [], set()
    for i, s in enumerate(base[1:5], 1):
        for e in (0, 3, 5, 6, 9):
            p = f"EVALX{i}{e:02d}-05"
            t = changed(s, e, rnd, indels=False)
            ev.append((p, t[: 640 - 20 * e] if e % 2 else t, "sea", 1))
    for i in range(6):
        ev.append((f"INDEL{i:03d}-05", changed(base[3], 4, rnd), "sea", 1))
    ev += [("PART1001-05", base[4][330:], "sea", 1), ("PART2001-05", base[4][345:] + "N" * 50, "sea", 1), ("train003-05.COI-5P", None, None, 1), (" TRAIN_003-05"[1:], "nan", "a", 1), (None, base[0], "sea", 1)]
    cols = "processid string, nucleotides string, source string, loaded_at int"
    clash = lambda df: df.withColumn("sid", F.lit(1)).withColumn("seq", F.lit("x")).withColumn("split", F.lit("y")).withColumn("k", F.lit(2))
    for p, t, *_ in ev:
        for q, u, *_ in train:
            if p and q and t and u and plain_bases(canonical(t)) >= 300 and plain_bases(canonical(u)) >= 300:
                x, y = canonical(t).decode(), canonical(u).decode()[:800]
                if min(overlap_edits(x, y), overlap_edits(x, reverse_complement(y.encode()).decode())) <= 5:
                    want.add((p, q))
    return clash(spark.createDataFrame(train, cols)), clash(spark.createDataFrame(ev, cols)), want


def test_overlaps_equal_brute_force(spark, tables):
    train, ev, want = tables
    found = overlaps({"eval": ev, "none": ev.limit(0)}, train)
    got = {(r["eval_processid"], r["train_processid"]) for r in found.where("by_sequence").collect()}
    assert got == want and len(want) > 15
    ids = {(r["eval_processid"], r["train_processid"]) for r in found.where("by_id").collect()}
    assert ids == {("train003-05.COI-5P", "TRAIN003-05"), ("TRAIN_003-05", "TRAIN003-05")}
    assert sum(r["n_pairs"] for r in overlap_report(found).collect()) == found.count()
    assert overlaps({"none": ev.limit(0)}, train).count() == 0 and overlaps({"eval": ev}, train.limit(0)).count() == 0


def test_overlaps_by_shuffle_with_a_table_of_bits_that_is_full(spark, tables, monkeypatch):
    """More evaluation sequences than workers may hold, and a table of so few bits that windows come through which are no segments."""
    train, ev, want = tables
    monkeypatch.setattr(J, "INDEX_BOUND", 0)
    monkeypatch.setattr(J, "MOST_BITS", 1 << 17)
    found = overlaps({"eval": ev}, train)
    assert {(r["eval_processid"], r["train_processid"]) for r in found.where("by_sequence").collect()} == want


@pytest.mark.parametrize("bound", [J.INDEX_BOUND, 0])
def test_found_pairs_take_little_disk(spark, tables, monkeypatch, bound):
    """The pairs of overlaps(), which no more than one exchange moves; the index of one table is gone before that of the other is written."""
    train, ev, _ = tables
    monkeypatch.setattr(J, "INDEX_BOUND", bound)
    write, before = J.write_index, []

    def written(sequences, near, classes, folder):
        before.append(os.path.exists(f"{os.path.dirname(folder)}/evaluation"))
        return write(sequences, near, classes, folder)

    monkeypatch.setattr(J, "write_index", written)
    splits = {"eval": ev, "again": ev.limit(5)}
    found = overlap_pairs(splits, train)
    got = [tuple(r) for r in found.collect()]
    assert before == ([False, False] if bound == 0 else [False])
    assert len(got) == len(set(got)) and set(got) == {tuple(sorted(r)) for r in overlaps(splits, train).select("eval_processid", "train_processid").collect()}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Union")]
    assert "Join" not in above and above.count("Aggregate") == 1


@pytest.mark.parametrize("bound", [J.INDEX_BOUND, 0])
def test_overlaps_with_unknown_bases_equal_brute_force(spark, monkeypatch, bound):
    """0 to 20 single unknown bases on each side and 0 to 5 edits, on either strand: no pair is lost, none is added."""
    monkeypatch.setattr(J, "INDEX_BOUND", bound)
    rnd = random.Random(61)
    train, ev, want = [], [], set()

    def holed(s, n):
        s = list(s)
        for p in rnd.sample(range(len(s)), n):
            s[p] = "N"
        return "".join(s)

    for i in range(120):
        s = dna(400, rnd)
        t = holed(s, rnd.choice([0, 0, 1, 4, 8, 10, 15, 20]))
        e = holed(changed(s, rnd.randrange(0, 7), rnd), rnd.choice([0, 0, 1, 4, 8, 10, 15, 20]))
        train.append((f"T{i:03d}", t if i % 2 else reverse_complement(t.encode()).decode()))
        ev.append((f"E{i:03d}", e, "sea"))
        x, y = canonical(e).decode(), canonical(t).decode()
        if plain_bases(x.encode()) >= 300 <= plain_bases(y.encode()) and overlap_edits(x, y) <= 5:
            want.add((f"E{i:03d}", f"T{i:03d}"))
    df = spark.createDataFrame(train, "processid string, nucleotides string")
    found = overlaps({"eval": spark.createDataFrame(ev, "processid string, nucleotides string, source string")}, df)
    got = {(r["eval_processid"], r["train_processid"]) for r in found.collect()}
    assert got == want and len(want) > 80


def test_segment_length_holds_the_guarantee():
    """Any window of LEAST_BASES holds one whole segment more than edits are allowed."""
    size, step = J.CROSS_SPLIT.tiers[0]
    worst = min(sum(1 for s in range(0, 2000, step) if at <= s and s + size <= at + J.LEAST_BASES) for at in range(0, 500))
    assert worst >= J.CROSS_SPLIT.edits + 1


@pytest.fixture(scope="module")
def clustered(spark):
    rnd = random.Random(31)
    data, truth = [], {}
    for c in range(12):
        centre = dna(640, rnd)
        for m in range(rnd.choice([1, 2, 3, 9])):
            s = changed(centre, 5, rnd)
            left = rnd.randrange(0, 40)
            p = f"C{c:02d}M{m:02d}"
            data.append((p, rnd.choice([s[left:], *forms(s)])))
            truth[p] = c
    data += [("C00M00", data[0][1].lower()), ("short", "ACGT"), ("null", None), (None, data[0][1]), ("empty", ""), ("gaps", "-" * 700), ("long", dna(20_000, rnd))]
    return spark.createDataFrame(data, "processid string, nucleotides string").withColumn("root", F.lit(1)).withColumn("pivot", F.lit(2)), truth


def test_clusters_equal_the_planted_ones(spark, clustered):
    df, truth = clustered
    got = {(r["cluster_processid"], r["processid"]) for r in cluster_links(df).collect()}
    first: dict = {}
    for p in sorted(truth):
        first.setdefault(truth[p], p)
    assert got == {(first[c], p) for p, c in truth.items() if p != first[c]}
    assert cluster_links(df.limit(0)).count() == 0


def test_clusters_of_overlapping_reads_and_of_reads_with_unknown_bases(spark):
    """Reads cut every 250 bases from one stretch hang together by their neighbours; unknown bases every 30 hide nothing."""
    rnd = random.Random(77)
    long = dna(640 + 5 * 250, rnd)
    data = [(f"R{i}", long[250 * i : 250 * i + 640]) for i in range(6)]
    s = dna(640, rnd)
    holes = "".join("N" if i % 30 == 29 else c for i, c in enumerate(changed(s, 12, rnd, indels=False)))
    data += [("S0", s), ("S1", reverse_complement(holes.encode()).decode())]
    got = {(r["cluster_processid"], r["processid"]) for r in cluster_links(spark.createDataFrame(data, "processid string, nucleotides string")).collect()}
    assert got == {*(("R0", f"R{i}") for i in range(1, 6)), ("S0", "S1")}


def test_similar_pairs_at_the_limit_are_in_one_cluster(spark):
    """300 bases in common, 12 of them different: of 300 such pairs at least 99 in 100 are found (all, here)."""
    rnd = random.Random(78)
    data = []
    for i in range(300):
        s = dna(300, rnd)
        data += [(f"A{i:03d}", dna(150, rnd) + s), (f"B{i:03d}", changed(s, 12, rnd, indels=False) + dna(150, rnd))]
    got = {(r["cluster_processid"], r["processid"]) for r in cluster_links(spark.createDataFrame(data, "processid string, nucleotides string")).collect()}
    want = set()
    for i in range(300):
        a, b = data[2 * i][1], data[2 * i + 1][1]
        ok, _, _ = similar([a.encode()], [b.encode()], np.array([1]), np.array([-150]))
        want |= {(f"A{i:03d}", f"B{i:03d}")} if ok[0] else set()
    assert len(want) > 250 and len(want & got) >= 0.99 * len(want) and got <= {(f"A{i:03d}", f"B{i:03d}") for i in range(300)}


def test_typical_members(spark, clustered):
    df, truth = clustered
    d = describe_clusters(df).collect()
    sizes: dict = {}
    for c in truth.values():
        sizes[c] = sizes.get(c, 0) + 1
    assert {r["cluster_processid"]: r["n_records"] for r in d} == {min(p for p in truth if truth[p] == c): n for c, n in sizes.items() if n > 1}
    assert all(r["mean_difference"] >= 0 for r in d) and describe_clusters(df.limit(0)).count() == 0


def test_medoid_equals_brute_force(spark):
    """The medoid of a chain of reads on either strand, of which the first and the last have nothing in common."""
    rnd = random.Random(79)
    long = dna(1100, rnd)
    data, at = [], {}
    for i in range(24):
        left = rnd.randrange(0, 460)
        s = changed(long, 6, rnd, indels=False)[left : left + 640]
        at[f"M{i:02d}"] = (left, s)
        data.append((f"M{i:02d}", s if i % 3 else reverse_complement(s.encode()).decode()))

    def differ(a, b):
        (x, s), (y, t) = at[a], at[b]
        return sum(s[p - x] != t[p - y] for p in range(max(x, y), min(x, y) + 640))

    want = sorted((sum(differ(a, b) for b in at), a) for a in at)[:3]
    rows = sorted(describe_clusters(spark.createDataFrame(data, "processid string, nucleotides string")).collect(), key=lambda r: r["place"])
    assert [(r["n_records"], r["processid"], round(r["mean_difference"] * 23)) for r in rows] == [(24, p, d) for d, p in want]


def test_records_go_to_the_closest_centre(spark):
    """Two tight groups 3 % apart are one cluster of two groups, each with its medoid; the third group, a chain's end, is its own."""
    rnd = random.Random(80)
    first = dna(700, rnd)
    second = changed(first, 20, rnd, indels=False)
    data = []
    for name, centre in (("A", first), ("B", second)):
        for i in range(7):
            s = centre if i == 3 else changed(centre, 3, rnd, indels=False)
            data.append((f"{name}{i}", s if i % 2 else reverse_complement(s.encode()).decode()))
    df = spark.createDataFrame(data, "processid string, nucleotides string")
    got = sorted((r["cluster_processid"], r["medoid_processid"], r["n_records"]) for r in pivot_groups(df).collect())
    assert sum(n for _, _, n in got) == 14 and {c for c, _, _ in got} == {"A0"}
    assert got in ([("A0", "A3", 7), ("A0", "B3", 7)], [("A0", got[0][1], 14)])
    assert pivot_groups(df.limit(0)).count() == 0


def test_hot_copies_make_one_cluster(spark):
    s = dna(640)
    hot = spark.range(3000).select(F.format_string("P%05d", "id").alias("processid"), F.lit(s).alias("nucleotides"))
    one = cluster_links(hot)
    assert one.count() == 2999 and one.select("cluster_processid").distinct().count() == 1
