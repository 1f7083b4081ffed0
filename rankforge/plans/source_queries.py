"""Readers and writers on files that are written from the tables into the shared folder and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.functions import exprs as X
from rankforge.plans.candidate_queries import _ECO, _eco
from rankforge.plans.record_queries import SPLITS, TR, _clean
from rankforge.runtime import ensure_checkpoint_dir, table
from rankforge.sources import formats as S


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/rankforge-files/{name}-{uuid.uuid4().hex}"


def _lines(df: DataFrame, path: str, *columns) -> None:
    df.select(F.concat_ws("\t", *columns).alias("value")).write.mode("overwrite").text(path)


def s_fasta(spark, d):
    """Records written as FASTA, ids unique, and read again."""
    p = _folder(spark, "fasta")
    x = _clean(spark, d).where("processid is not null and seq_len > 0").groupBy("processid").agg(F.max("nucleotides").alias("s"))
    S.write_fasta(x, p, "processid", "s")
    return S.read_fasta(spark, p).select("id", F.md5("sequence").alias("digest"), F.length("sequence").cast("long").alias("n"))


def s_query_table(spark, d):
    """Query records under other column names, with blank labels made from the species."""
    p = _folder(spark, "queries")
    x = table(spark, d, "zero_shot_queries").where("processid is not null").groupBy("processid").agg(F.max(X.clean_sequence("nucleotides")).alias("Barcode"), F.max(X.clean_taxon("species_name")).alias("Species"))
    x.withColumnRenamed("processid", "Sample_ID").write.mode("overwrite").csv(p, header=True, sep=";", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return S.read_queries(spark, p, ";").select("processid", F.length("nucleotides").cast("long").alias("n"), F.col("tree_label").isNotNull().alias("labelled"))


def s_best_hits(spark, d):
    """Candidates written as an aligner's hits and read as the three best labels a query."""
    p = _folder(spark, "hits")
    v = X.finite("blast_candidate_pident")
    e = _eco(spark, d).where(v.isNotNull() & F.col("query_processid").isNotNull() & F.col("candidate_tree_label").isNotNull())
    one = e.select("query_processid", "candidate_tree_label", v.alias("v"), F.lit(100), F.lit(0), F.lit(0), F.lit(1), F.lit(100), F.lit(1), F.lit(100), F.lit(0.001), (v * 10).alias("bits")).toDF(*[f"c{i}" for i in range(12)])
    _lines(one, p, *one.columns)
    return S.best_hits(S.read_hits(spark, p), "ref_id", 3).select("query_id", F.col("place").cast("long").alias("place"), F.col("ref_id").alias("label"), F.round("bitscore", 3).alias("bitscore"))


def s_clusters(spark, d):
    """Groups of equal sequences written as a cluster file, seeds and hits, and read again."""
    p = _folder(spark, "clusters")
    x = _clean(spark, d).where("processid is not null and seq_len > 0").groupBy("processid").agg(F.max("nucleotides").alias("s"))
    g = x.withColumn("h", F.md5("s")).join(x.groupBy(F.md5("s").alias("h")).agg(F.min("processid").alias("seed")), "h")
    number = F.conv(F.substring("h", 1, 7), 16, 10)
    lines = g.select(F.when(F.col("processid") == F.col("seed"), "S").otherwise("H"), number, F.length("s"), F.lit("*"), F.lit("+"), F.lit("*"), F.lit("*"), F.lit("="), F.col("processid"), F.col("seed")).toDF(*[f"c{i}" for i in range(10)])
    _lines(lines, p, *lines.columns)
    return S.read_clusters(spark, p).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min("record_id").alias("first")).select(F.col("cluster").cast("long").alias("cluster"), "n", "first")


def s_nested(spark, d):
    """Sequences by label as JSON, and back."""
    p = _folder(spark, "nested")
    S.write_nested_sequences(_clean(spark, d).where("seq_len > 0").select(X.tree_label("species_name").alias("l"), "nucleotides"), p, "l", "nucleotides")
    return S.read_label_lines(spark, p).groupBy("tree_label").agg(F.count(F.lit(1)).alias("n"), F.sum("seq_len").alias("letters"), F.max("sequence_index").cast("long").alias("last"))


def s_pack(spark, d):
    """An input pack written and read: rows of its parts against its manifest."""
    p = _folder(spark, "pack")
    lab = X.tree_label("species_name").alias("tree_label")
    ref = None
    for n in SPLITS[:2]:
        y = _clean(spark, d, n).where("seq_len > 0").select(lab, "nucleotides", F.lit(n == SPLITS[0]).alias("train")).where("tree_label is not null")
        ref = y if ref is None else ref.unionByName(y)
    q = _clean(spark, d, "unseen").where("seq_len > 0").select("processid", "nucleotides")
    S.write_pack(p, ref, q, table(spark, d, "candidate_species"))
    got, train = S.read_pack(spark, p), S.read_pack(spark, p, True)
    out = train["species_sequences"].agg(F.count(F.lit(1)).alias("n")).select(F.lit("train_species_sequences").alias("part"), "n", F.lit(None).cast("long").alias("n_rows"))
    for name in ("species_sequences", "zero_shot_queries", "candidate_species"):
        y = got[name].agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit(name)).join(got["manifest"], "part").select("part", "n", "n_rows")
        out = out.unionByName(y)
    return out


def s_wide_matrix(spark, d):
    """Read counts of sites by label, written wide and read long."""
    p = _folder(spark, "wide")
    x = table(spark, d, "sample_query_map").where("sample_id is not null and source_region_dir is not null").groupBy("sample_id").pivot("source_region_dir").agg(F.sum("read_count"))
    x.fillna(0).write.mode("overwrite").csv(p, header=True, sep="\t")
    return S.read_wide_matrix(spark, p, ["sample_id"]).select("sample_id", "column", F.col("count").cast("long").alias("count"))


def s_embeddings(spark, d):
    """Vectors written as .npz archives by the executors and read again."""
    p = _folder(spark, "npz")
    S.write_embeddings(table(spark, d, "embeddings"), p, "vec_id", "embedding")
    return S.read_embeddings(spark, p).select(F.col("label").cast("long").alias("vec_id"), F.size("embedding").cast("long").alias("dim"), (F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 3) + 0.0).alias("total"))


def s_genbank_xml(spark, d):
    """Records written as GBSeq XML and read again."""
    p = _folder(spark, "xml")
    x = _clean(spark, d, "unseen").where("processid is not null and seq_len > 0").groupBy("processid").agg(F.max("nucleotides").alias("s"), F.max("species_name").alias("o"))
    x.select(F.col("processid").alias("GBSeq_accession-version"), F.coalesce("o", F.lit("")).alias("GBSeq_organism"), F.lower("s").alias("GBSeq_sequence")).write.mode("overwrite").format("xml").option("rowTag", "GBSeq").option("rootTag", "GBSet").save(p)
    return S.read_genbank_xml(spark, p).select("processid", F.length("nucleotides").cast("long").alias("n"), F.md5("nucleotides").alias("digest"))


def s_placements(spark, d):
    """Candidates of a query written as placements on a tree of the genus labels, and read as the best edge a query."""
    from rankforge.operators.trees import best_placement

    p = _folder(spark, "jplace")
    e = _eco(spark, d).where("query_processid is not null and candidate_rank is not null").groupBy("query_processid", "candidate_rank").agg(F.count(F.lit(1)).alias("n"))
    q = e.groupBy("query_processid").agg(F.array_sort(F.collect_list(F.array(F.col("candidate_rank").cast("double"), F.lit(-1.0), F.col("n").cast("double")))).alias("p"))
    doc = q.select(F.lit("(A:1{0},B:1{1},C:1{2}):0{3};").alias("tree"), F.array(F.lit("edge_num"), F.lit("likelihood"), F.lit("like_weight_ratio")).alias("fields"), F.array(F.struct("p", F.array("query_processid").alias("n"))).alias("placements"))
    doc.write.mode("overwrite").json(p)
    placed, _ = S.read_placements_lines(spark, p)
    return best_placement(placed, "query", "edge", "weight").select("query", "edge", "weight", "total")


def s_inventory(spark, d):
    """The folder of a written table: how many files, whether any is a pointer."""
    p = _folder(spark, "inventory")
    table(spark, d, "split_targets").coalesce(1).write.mode("overwrite").csv(p, header=True)
    x = S.file_inventory(spark, p).where("suffix = '.csv'")
    return x.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_pointer"), 1)).alias("n_pointers"))


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and k.startswith("s_")}
_L = "regexp_replace(regexp_replace(species_name, '[''\"]', '', 'g'), '\\s+', '_', 'g')"
_V = "(CASE WHEN NOT isnan(blast_candidate_pident) AND abs(blast_candidate_pident) < 'infinity'::DOUBLE THEN blast_candidate_pident END)"
_X = f"x AS (SELECT processid, max(nucleotides) AS s FROM {TR} WHERE processid IS NOT NULL AND seq_len > 0 GROUP BY processid)"
_UNX = TR.replace("FROM supervised_train)", "FROM unseen)")
_EVX = TR.replace("FROM supervised_train)", "FROM eval_c_unseen_species)")
ORACLE = {
    "s_fasta": f"WITH {_X} SELECT processid AS id, md5(s) AS digest, length(s) AS n FROM x",
    "s_query_table": """WITH q AS (SELECT processid, max(regexp_replace(upper(nucleotides), '[^ACGTN]', '', 'g')) AS s, max(CASE WHEN lower(regexp_replace(species_name, '^\\s+|\\s+$', '', 'g')) NOT IN ('', 'na', 'nan', 'none', 'unclassified') THEN species_name END) AS sp FROM zero_shot_queries WHERE processid IS NOT NULL GROUP BY 1)
        SELECT processid, nullif(length(s), 0) AS n, sp IS NOT NULL AS labelled FROM q""",
    "s_best_hits": f"""WITH h AS (SELECT query_processid AS q, candidate_tree_label AS l, {_V} AS v FROM {_ECO} WHERE query_processid IS NOT NULL AND candidate_tree_label IS NOT NULL), o AS (SELECT q, l, max(v) AS v FROM h WHERE v IS NOT NULL GROUP BY ALL)
        SELECT q AS query_id, place, l AS label, round(v * 10, 3) AS bitscore FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY v DESC, l) AS place FROM o) WHERE place <= 3""",
    "s_clusters": f"WITH {_X} SELECT CAST('0x' || substr(md5(s), 1, 7) AS BIGINT) AS cluster, count(*) AS n, min(processid) AS first FROM x GROUP BY 1",
    "s_nested": f"SELECT {_L} AS tree_label, count(*) AS n, CAST(sum(seq_len) AS BIGINT) AS letters, count(*) - 1 AS last FROM {TR} WHERE seq_len > 0 AND species_name IS NOT NULL GROUP BY 1",
    "s_pack": f"""SELECT 'train_species_sequences' AS part, count(*) AS n, CAST(NULL AS BIGINT) AS n_rows FROM {TR} WHERE seq_len > 0 AND species_name IS NOT NULL UNION ALL SELECT 'species_sequences', n, n FROM (SELECT (SELECT count(*) FROM {TR} WHERE seq_len > 0 AND species_name IS NOT NULL) + (SELECT count(*) FROM {_EVX} WHERE seq_len > 0 AND species_name IS NOT NULL) AS n)
        UNION ALL SELECT 'zero_shot_queries', count(*), count(*) FROM {_UNX} WHERE seq_len > 0 UNION ALL SELECT 'candidate_species', count(*), count(*) FROM candidate_species""",
    "s_wide_matrix": "SELECT sample_id, source_region_dir AS \"column\", CAST(sum(read_count) AS BIGINT) AS count FROM sample_query_map WHERE sample_id IS NOT NULL AND source_region_dir IS NOT NULL GROUP BY ALL HAVING sum(read_count) > 0",
    "s_embeddings": "SELECT vec_id, len(embedding) AS dim, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 3) + 0.0::DOUBLE AS total FROM embeddings",
    "s_genbank_xml": f"WITH x AS (SELECT processid, max(nucleotides) AS s FROM {_UNX} WHERE processid IS NOT NULL AND seq_len > 0 GROUP BY 1) SELECT processid, length(s) AS n, md5(s) AS digest FROM x",
    "s_placements": f"""WITH e AS (SELECT query_processid AS query, candidate_rank AS edge, CAST(count(*) AS DOUBLE) AS w FROM {_ECO} WHERE query_processid IS NOT NULL AND candidate_rank IS NOT NULL GROUP BY ALL), r AS (SELECT *, sum(w) OVER (PARTITION BY query) AS total, row_number() OVER (PARTITION BY query ORDER BY w DESC, edge) AS k FROM e)
        SELECT query, CAST(edge AS BIGINT) AS edge, w AS weight, total FROM r WHERE k = 1""",
    "s_inventory": "SELECT CAST(1 AS BIGINT) AS n, CAST(0 AS BIGINT) AS n_pointers",
}
