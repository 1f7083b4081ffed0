"""Round trips and odd inputs of the readers."""

import json

import numpy as np

from rankforge.sources import formats as S
from rankforge.streaming import reads


def test_fasta_round_trip(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">a first one\nACGT\nAC\n>a\nGG\n>\nTT\n>b\n")
    got = {r["id"]: r["sequence"] for r in S.read_fasta(spark, str(tmp_path / "a.fa")).collect()}
    assert got == {"a": "ACGTAC", "a_2": "GG", "query_000003": "TT", "b": ""}
    df = spark.createDataFrame([("x y", "ACGTACGT"), ("z", None)], "id string, s string")
    S.write_fasta(df, str(tmp_path / "out"), "id", "s", 3)
    assert [tuple(r) for r in S.read_fasta(spark, str(tmp_path / "out")).collect()] == [("x_y", "", "ACGTACGT")]


def test_query_table_by_aliases(spark, tmp_path):
    (tmp_path / "q.csv").write_text("ID,Sequence,Scientific_Name\nq1,ACGT,Gadus morhua\nq1,CC,\n,GG,\n")
    got = {r["processid"]: (r["nucleotides"], r["species_name"]) for r in S.read_queries(spark, str(tmp_path / "q.csv")).collect()}
    assert got == {"q1": ("ACGT", "Gadus morhua"), "q1_2": ("CC", None), "query_000003": ("GG", None)}


def test_hits_and_clusters(spark, tmp_path):
    (tmp_path / "h.tsv").write_text("q\tr1\t99\t100\t0\t0\t1\t100\t1\t100\t1e-9\t50\nq\tr1\t98\t100\t0\t0\t1\t100\t1\t100\t1e-9\t60\nq\tr2\t99.5\t100\t0\t0\t1\t100\t1\t100\t1e-9\t60\n")
    got = [(r["place"], r["ref_id"], r["bitscore"]) for r in S.best_hits(S.read_hits(spark, str(tmp_path / "h.tsv")), "ref_id", 5).orderBy("place").collect()]
    assert got == [(1, "r2", 60.0), (2, "r1", 60.0)]
    (tmp_path / "c.uc").write_text("S\t0\t100\t*\t*\t*\t*\t*\ta\t*\nH\t0\t100\t99\t+\t*\t*\t=\tb\ta\nC\t0\t2\t*\t*\t*\t*\t*\ta\t*\n")
    assert sorted(map(tuple, S.read_clusters(spark, str(tmp_path / "c.uc")).collect())) == [("a", 0), ("b", 0)]


def test_trees_and_placements(spark, tmp_path):
    (tmp_path / "t.nwk").write_text("(('A b':1,B:2)in:0.5,C:3);")
    names = {r["name"] for r in S.read_newick(spark, str(tmp_path / "t.nwk")).collect()}
    assert {"A b", "B", "in", "C"} <= names
    doc = {"tree": "((A:1{0},B:1{1}):1{2},C:1{3}):0{4};", "fields": ["edge_num", "likelihood", "like_weight_ratio"], "placements": [{"p": [[0, -1.0, 0.7], [3, -2.0, 0.3]], "n": ["q1"]}, {"p": [[1, -1.0, 1.0]], "nm": [["q2", 2]]}]}
    (tmp_path / "p.jplace").write_text(json.dumps(doc))
    placed, nodes = S.read_placements(spark, str(tmp_path / "p.jplace"))
    from rankforge.operators.trees import best_placement

    assert {r["query"]: r["edge"] for r in best_placement(placed, "query", "edge", "weight").collect()} == {"q1": 0, "q2": 1}
    assert nodes.where("name = 'A'").first()["edge"] == 0


def test_vectors_and_nested_sequences(spark, tmp_path):
    np.savez(tmp_path / "e.npz", labels=np.array(["a", "b"]), embeddings=np.eye(2, 3, dtype=np.float32))
    got = {r["label"]: list(r["embedding"]) for r in S.read_embeddings(spark, str(tmp_path / "e.npz")).collect()}
    assert got == {"a": [1.0, 0.0, 0.0], "b": [0.0, 1.0, 0.0]}
    (tmp_path / "s.json").write_text(json.dumps({"A_b": ["ACGT", "AC"], "C_d": []}))
    assert S.read_nested_sequences(spark, str(tmp_path / "s.json")).count() == 2
    (tmp_path / "w.tsv").write_text("OTU\ttotal\ts1\ts2\no1\t3\t3\t0\no2\t2\tx\t2\n")
    assert sorted((r["OTU"], r["column"], r["count"]) for r in S.read_wide_matrix(spark, str(tmp_path / "w.tsv"), ["OTU", "total"]).collect()) == [("o1", "s1", 3.0), ("o2", "s2", 2.0)]


def test_inventory_and_manifest(spark, tmp_path):
    (tmp_path / "a.txt").write_text("version https://git-lfs.github.com/spec/v1\n")
    assert S.file_inventory(spark, str(tmp_path)).first()["is_pointer"]
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, t string")
    assert S.manifest(df).first() == S.manifest(df.orderBy("t")).first()
    assert S.manifest(df).first() != S.manifest(df.where("i = 1")).first()


def test_stream_counts_equal_the_batch(spark, small, tmp_path):
    base = f"{small}/sample_query_map.parquet"
    src = tmp_path / "in"
    spark.read.parquet(base).repartition(3).write.parquet(str(src))
    q = reads.site_counts(reads.read_stream(spark, str(src)), late="20000 days").writeStream.outputMode("complete").format("memory").queryName("site_counts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("site_counts").agg({"reads": "sum"}).first()[0]
    want = spark.read.parquet(base).where("site20 is not null and sampled_at is not null").agg({"read_count": "sum"}).first()[0]
    assert got == want


def test_zip_members_and_encodings(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in/tax.txt", "a\tGadus\r\nb\tSölea\n".encode("latin-1"))
        z.writestr("in/other.fasta", ">x\n")
    got = sorted(map(tuple, S.read_zipped_lines(spark, str(tmp_path / "a.zip"), "*tax.txt", "latin-1").collect()))
    assert got == [("in/tax.txt", 1, "a\tGadus"), ("in/tax.txt", 2, "b\tSölea")]
    (tmp_path / "q.csv").write_bytes("Query_ID;Barcode;Species_Tree_Label;Species\nq;AC;;Sölea x\n".encode("latin-1"))
    r = S.read_queries(spark, str(tmp_path / "q.csv"), ";", "ISO-8859-1").first()
    assert (r["processid"], r["nucleotides"], r["tree_label"]) == ("q", "AC", "Sölea_x")


def test_input_pack_lacks_a_part(spark, tmp_path):
    import shutil

    import pytest

    ref = spark.createDataFrame([("A_b", "ACGT", True), ("A_b", "AC", False), (None, "A", True)], "tree_label string, nucleotides string, train boolean")
    q = spark.createDataFrame([("p", "AC")], "processid string, nucleotides string")
    base = str(tmp_path / "pack")
    S.write_pack(base, ref, q, spark.createDataFrame([("A_b",)], "tree_label string"))
    assert sorted(r["nucleotides"] for r in S.read_pack(spark, base)["species_sequences"].collect()) == ["AC", "ACGT"]
    assert [r["nucleotides"] for r in S.read_pack(spark, base, True)["species_sequences"].collect()] == ["ACGT"]
    S.write_pack(base, ref, q.withColumnRenamed("nucleotides", "n"), spark.createDataFrame([("A_b",)], "tree_label string"))
    with pytest.raises(ValueError, match="nucleotides"):
        S.read_pack(spark, base)
    shutil.rmtree(f"{base}/manifest.json")
    with pytest.raises(FileNotFoundError, match="manifest"):
        S.read_pack(spark, base)


def test_genbank_xml(spark, tmp_path):
    (tmp_path / "g.xml").write_text("<GBSet><GBSeq><GBSeq_accession-version>X1.1</GBSeq_accession-version><GBSeq_organism>Gadus morhua</GBSeq_organism><GBSeq_sequence>acgt</GBSeq_sequence></GBSeq><GBSeq><GBSeq_accession-version>X2</GBSeq_accession-version></GBSeq></GBSet>")
    assert sorted(map(tuple, S.read_genbank_xml(spark, str(tmp_path / "g.xml")).collect())) == [("X1.1", "Gadus morhua", "ACGT"), ("X2", None, None)]
