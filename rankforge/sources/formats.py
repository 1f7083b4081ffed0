"""Readers and writers of the field's file formats."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankforge.functions.exprs import clean_taxon, tree_label

#: Columns of tabular hit files, in their order.
HIT_COLUMNS = "query_id string, ref_id string, pident double, alignment_length int, mismatch int, gapopen int, qstart int, qend int, sstart int, send int, evalue double, bitscore double"
#: Columns of cluster files, in their order.
CLUSTER_COLUMNS = "type string, cluster int, length int, pident string, strand string, q1 string, q2 string, cigar string, record_id string, target string"
#: Names under which query tables give their columns.
QUERY_ALIASES = {
    "processid": ("processid", "process_id", "query_id", "sample_id", "sequence_id", "id", "name"),
    "nucleotides": ("nucleotides", "sequence", "seq", "barcode", "nuc", "dna"),
    "tree_label": ("tree_label", "species_tree_label"),
    "species_name": ("species_name", "species", "scientific_name", "scientificname"),
    "genus_name": ("genus_name", "genus"),
    "family_name": ("family_name", "family"),
    "order_name": ("order_name", "order"),
}
#: Files of an input pack.
PACK_FILES = ("species_sequences.json", "train_species_sequences.json", "zero_shot_queries.csv", "candidate_species.csv", "manifest.json")


def record_numbers(df: DataFrame, name: str) -> DataFrame:
    """Rows numbered from 1 in the order they are read; only the counts of the partitions go to the driver."""
    x = df.withColumn("__id", F.monotonically_increasing_id())
    part, at = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r["p"], r["n"]) for r in x.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, start = 0, []
    for p, n in counts:
        start += [F.lit(p), F.lit(before)]
        before += n
    first = F.create_map(*start)[part] if start else F.lit(0)
    return x.withColumn(name, (first + at + 1).cast("long")).drop("__id")


def unique_ids(df: DataFrame, base: str, order: str) -> DataFrame:
    """Column `id`: the base, and from its second row on with _2, _3 and so on."""
    again = F.row_number().over(Window.partitionBy(base).orderBy(order))
    return df.withColumn("__k", again).withColumn("id", F.when(F.col("__k") == 1, F.col(base)).otherwise(F.concat_ws("_", base, F.col("__k").cast("string")))).drop("__k")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, description, sequence) of FASTA files, records of any number of lines.

    The id is the header's first word. An empty header is named query_ and the record's number; an id that comes again
    gets _2, _3 and so on. Records without sequence are kept with an empty one. Files are cut at the record mark, so one
    large file is read by many tasks.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).where(F.trim("value") != "")
    rec = record_numbers(raw.select(F.regexp_replace("value", "^\\s*>", "").alias("v")), "n")
    head = F.trim(F.regexp_extract("v", r"^([^\r\n]*)", 1))
    body = F.regexp_replace(F.regexp_extract("v", r"(?s)^[^\r\n]*(.*)$", 1), r"\s+", "")
    first = F.regexp_extract("h", r"^(\S+)", 1)
    named = rec.select("n", head.alias("h"), body.alias("sequence")).withColumn("base", F.when(first == "", F.format_string("query_%06d", "n")).otherwise(first))
    return unique_ids(named, "base", "n").select("id", F.trim(F.regexp_replace("h", r"^\S+", "")).alias("description"), "sequence")


def write_fasta(df: DataFrame, path: str, key: str, seq: str, width: int = 80) -> None:
    """FASTA files with wrapped lines; null sequences are left out."""
    wrapped = F.regexp_replace(F.col(seq), f"(.{{{width}}})(?=.)", "$1\n")
    df.where(F.col(seq).isNotNull()).select(F.concat(F.lit(">"), F.regexp_replace(key, r"\s+", "_"), F.lit("\n"), wrapped).alias("value")).write.mode("overwrite").text(path)


def read_queries(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """A query table whose columns go by any of their known names, in any case.

    Missing columns are null; a missing id is query_ and the record's number, one that comes again gets _2, _3 and so on. A blank
    tree_label is made from the species.
    """
    df = spark.read.csv(path, header=True, sep=sep, encoding=encoding)
    have = {c.lower().strip(): c for c in df.columns}
    out = []
    for name, aliases in QUERY_ALIASES.items():
        hit = next((have[a] for a in aliases if a in have), None)
        out.append((F.col(f"`{hit}`") if hit else F.lit(None)).cast("string").alias(name))
    x = record_numbers(df.select(*out), "n").withColumn("base", F.coalesce(clean_taxon("processid"), F.format_string("query_%06d", "n")))
    x = unique_ids(x, "base", "n").withColumn("tree_label", F.coalesce(clean_taxon("tree_label"), tree_label("species_name")))
    return x.select(F.col("id").alias("processid"), *[c for c in QUERY_ALIASES if c != "processid"])


def read_zipped_lines(spark: SparkSession, path: str, member: str, encoding: str = "utf-8") -> DataFrame:
    """(file, line_number, line) of the members of zip archives whose name matches a pattern; an archive is read by one task, line by line."""
    import fnmatch
    import io
    import zipfile

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for raw in b["content"]:
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    for name in sorted(n for n in z.namelist() if fnmatch.fnmatch(n, member)):
                        held: list[tuple] = []
                        with z.open(name) as f:
                            for i, line in enumerate(io.TextIOWrapper(f, encoding=encoding), 1):
                                held.append((name, i, line.rstrip("\r\n")))
                                if len(held) >= 8192:
                                    yield pd.DataFrame(held, columns=["file", "line_number", "line"])
                                    held = []
                        if held:
                            yield pd.DataFrame(held, columns=["file", "line_number", "line"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, "file string, line_number long, line string")


def write_nested_sequences(df: DataFrame, path: str, label: str, seq: str) -> None:
    """A JSON object a line, from each label to its sequences in order; null labels and sequences are left out."""
    x = df.where(F.col(label).isNotNull() & F.col(seq).isNotNull()).groupBy(label).agg(F.array_sort(F.collect_list(seq)).alias("s"))
    x.select(F.to_json(F.create_map(label, "s")).alias("value")).write.mode("overwrite").text(path)


def read_label_lines(spark: SparkSession, path: str) -> DataFrame:
    """(tree_label, sequence_index, nucleotides, seq_len) of the lines that write_nested_sequences writes."""
    doc = spark.read.text(path).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    x = doc.select(F.explode("m").alias("tree_label", "s")).select("tree_label", F.posexplode("s").alias("sequence_index", "nucleotides"))
    return x.withColumn("seq_len", F.length("nucleotides"))


def write_pack(base: str, reference: DataFrame, queries: DataFrame, listed: DataFrame) -> None:
    """The five parts of an input pack below `base`: sequences of all and of training labels, queries, candidates, and the manifest of row counts.

    reference has (tree_label, nucleotides, train), queries and listed any columns.
    """
    write_nested_sequences(reference, f"{base}/{PACK_FILES[0]}", "tree_label", "nucleotides")
    write_nested_sequences(reference.where("train"), f"{base}/{PACK_FILES[1]}", "tree_label", "nucleotides")
    queries.write.mode("overwrite").csv(f"{base}/{PACK_FILES[2]}", header=True)
    listed.write.mode("overwrite").csv(f"{base}/{PACK_FILES[3]}", header=True)
    counts = None
    for name, df in (("species_sequences", reference), ("zero_shot_queries", queries), ("candidate_species", listed)):
        n = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("part"), "n_rows")
        counts = n if counts is None else counts.unionByName(n)
    counts.coalesce(1).write.mode("overwrite").json(f"{base}/{PACK_FILES[4]}")


def read_pack(spark: SparkSession, base: str, train_only: bool = False) -> dict[str, DataFrame]:
    """The parts of an input pack; an error names the parts that lack, and the columns that queries and candidates lack."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    missing = [f for f in PACK_FILES if not fs.exists(path(f"{base}/{f}"))]
    if missing:
        raise FileNotFoundError(f"input pack {base} lacks {missing}")
    csv = lambda f: spark.read.csv(f"{base}/{f}", header=True)
    return {
        "species_sequences": read_label_lines(spark, f"{base}/{PACK_FILES[1 if train_only else 0]}"),
        "zero_shot_queries": require_columns(csv(PACK_FILES[2]), ["processid", "nucleotides"]),
        "candidate_species": require_columns(csv(PACK_FILES[3]), ["tree_label"]),
        "manifest": spark.read.json(f"{base}/{PACK_FILES[4]}"),
    }


def write_embeddings(df: DataFrame, path: str, label: str, vector: str, rows: int = 65_536) -> int:
    """.npz archives of labels and embeddings below `path`, at most `rows` each, written by the executors; the number of files.

    The folder must be one that all executors share. A task that runs again writes its files again under their own names.
    """
    import os
    import re

    local = re.sub(r"^file:(//)?(?=/)", "", path)
    os.makedirs(local, exist_ok=True)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        from pyspark import TaskContext

        task, n, held = TaskContext.get().partitionId(), 0, []

        def put(parts: list[pd.DataFrame]) -> None:
            x = pd.concat(parts, ignore_index=True)
            np.savez(f"{local}/part-{task:05d}-{n:05d}.npz", labels=x["label"].astype(str).to_numpy(dtype=str), embeddings=np.array(x["v"].tolist(), np.float32))

        for b in batches:
            if len(b):
                held.append(b)
            if sum(map(len, held)) >= rows:
                put(held)
                n, held = n + 1, []
        if held:
            put(held)
            n += 1
        yield pd.DataFrame({"n": [n]})

    small = df.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).select(F.col(label).cast("string").alias("label"), F.col(vector).alias("v"))
    return small.mapInPandas(write, "n long").agg(F.sum("n")).first()[0] or 0


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """Tabular hits of an aligner; comment lines go."""
    return spark.read.csv(path, sep="\t", schema=HIT_COLUMNS, comment="#")


def best_hits(hits: DataFrame, label: str, k: int) -> DataFrame:
    """(query_id, place, label, bitscore, pident): each label's best hit per query, then the first k.

    Order: bitscore, identity and alignment length descending, e-value and label ascending.
    """
    order = [F.desc("bitscore"), F.desc("pident"), F.desc("alignment_length"), F.asc("evalue"), F.asc(label)]
    one = hits.withColumn("r", F.row_number().over(Window.partitionBy("query_id", label).orderBy(*order))).where("r = 1")
    return one.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("place") <= k).select("query_id", "place", label, "bitscore", "pident")


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, cluster) of seed and hit lines of a cluster file."""
    return spark.read.csv(path, sep="\t", schema=CLUSTER_COLUMNS).where(F.col("type").isin("S", "H")).select("record_id", "cluster")


def parse_newick(text: str) -> list[tuple[int, int | None, str | None, float | None, int | None]]:
    """(node, parent, name, length, edge) of a Newick tree, without recursion, so deep trees are no matter.

    Quoted names, comments in brackets and edge numbers in braces are understood; a missing length is None.
    """
    nodes: list[list] = [[0, None, None, None, None]]
    at, i, n, length_next = 0, 0, len(text), False
    while i < n:
        c = text[i]
        if c == "(":
            nodes.append([len(nodes), at, None, None, None])
            at, length_next = len(nodes) - 1, False
        elif c == ",":
            nodes.append([len(nodes), nodes[at][1], None, None, None])
            at, length_next = len(nodes) - 1, False
        elif c == ")":
            at, length_next = nodes[at][1], False
        elif c == ":":
            length_next = True
        elif c == ";":
            break
        elif c == "[":
            i = text.index("]", i)
        elif c == "{":
            end = text.index("}", i)
            nodes[at][4], i = int(text[i + 1 : end]), end
        elif c in "'\"":
            end = i + 1
            while end < n and (text[end] != c or text[end + 1 : end + 2] == c):
                end += 2 if text[end] == c else 1
            nodes[at][2], i = text[i + 1 : end].replace(c * 2, c), end
        elif not c.isspace():
            end = i
            while end < n and text[end] not in "(),:;[]{}":
                end += 1
            word = text[i:end].strip()
            if length_next:
                nodes[at][3] = float(word)
            elif word:
                nodes[at][2] = word
            i = end - 1
        i += 1
    return [tuple(x) for x in nodes]


_NODE = "node long, parent long, name string, length double, edge long"


def read_newick(spark: SparkSession, path: str) -> DataFrame:
    """(file, node, parent, name, length, edge) of Newick files, one tree a file, parsed on the executors."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for f, t in zip(b["file"], b["value"]):
                x = pd.DataFrame(parse_newick(t), columns=["node", "parent", "name", "length", "edge"])
                x.insert(0, "file", f)
                yield x.astype({"parent": "Int64", "edge": "Int64"})

    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value").mapInPandas(parse, "file string, " + _NODE)


def read_placements_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """As read_placements, of files with one document a line."""
    return read_placements(spark, path, False)


def read_placements(spark: SparkSession, path: str, whole_files: bool = True) -> tuple[DataFrame, DataFrame]:
    """(placements, nodes) of jplace files: (query, multiplicity, fields as columns) and the tree's nodes with their edges."""
    schema = "tree string, fields array<string>, placements array<struct<p array<array<double>>, n array<string>, nm array<array<string>>>>"
    doc = spark.read.schema(schema).json(path, multiLine=whole_files)
    one = doc.select("fields", F.explode("placements").alias("x"))
    names = F.coalesce(F.transform("x.n", lambda n: F.struct(n.alias("query"), F.lit(1.0).alias("multiplicity"))), F.transform("x.nm", lambda m: F.struct(m[0].alias("query"), m[1].cast("double").alias("multiplicity"))))
    flat = one.select("fields", F.explode(names).alias("q"), F.col("x.p").alias("p")).select("fields", "q.*", F.explode("p").alias("v"))
    field = lambda name: F.element_at("v", F.array_position("fields", name).cast("int"))
    placed = flat.select("query", "multiplicity", field("edge_num").cast("long").alias("edge"), field("like_weight_ratio").alias("weight"), field("likelihood").alias("likelihood"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for t in b["tree"]:
                yield pd.DataFrame(parse_newick(t), columns=["node", "parent", "name", "length", "edge"]).astype({"parent": "Int64", "edge": "Int64"})

    return placed, doc.select("tree").mapInPandas(parse, _NODE)


def read_embeddings(spark: SparkSession, path: str, keys: str = "labels", vectors: str = "embeddings") -> DataFrame:
    """(label, embedding) of .npz archives, read on the executors as binary files."""
    import io

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for b in batches:
            for raw in b["content"]:
                with np.load(io.BytesIO(raw), allow_pickle=False) as z:
                    name = keys if keys in z else "processids"
                    yield pd.DataFrame({"label": z[name].astype(str), "embedding": list(z[vectors].astype("float32"))})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "label string, embedding array<float>")


def read_nested_sequences(spark: SparkSession, path: str) -> DataFrame:
    """(tree_label, sequence_index, nucleotides, seq_len) of a JSON document from label to a list of sequences."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    x = doc.select(F.explode("m").alias("tree_label", "s")).select("tree_label", F.posexplode("s").alias("sequence_index", "nucleotides"))
    return x.withColumn("seq_len", F.length("nucleotides"))


def read_wide_matrix(spark: SparkSession, path: str, keys: Sequence[str], sep: str = "\t") -> DataFrame:
    """(keys, column, count) of a wide table of counts; columns that are no keys are unpivoted, zeros go."""
    from rankforge.operators.places import wide_to_long

    df = spark.read.csv(path, sep=sep, header=True)
    counts = [c for c in df.columns if c not in keys]
    return wide_to_long(df.select(*keys, *[F.col(f"`{c}`").try_cast("double").alias(c) for c in counts]), keys, counts)


def read_genbank_xml(spark: SparkSession, path: str) -> DataFrame:
    """(processid, organism, nucleotides) of GBSeq records."""
    df = spark.read.format("xml").option("rowTag", "GBSeq").option("ignoreSurroundingSpaces", "false").schema("`GBSeq_accession-version` string, GBSeq_organism string, GBSeq_sequence string").load(path)
    return df.select(F.col("`GBSeq_accession-version`").alias("processid"), F.col("GBSeq_organism").alias("organism"), F.upper("GBSeq_sequence").alias("nucleotides"))


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, suffix, sha256, is_pointer) of all files below a folder; pointers are stand-ins for large files."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    text = F.decode(F.substring("content", 1, 64), "ISO-8859-1")
    return df.select("path", "length", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("suffix"), F.sha2("content", 256).alias("sha256"), text.startswith("version https://git-lfs").alias("is_pointer"))


def manifest(df: DataFrame) -> DataFrame:
    """(n_rows, content_hash): a hash that does not depend on the order of the rows."""
    row = F.xxhash64(*df.columns)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sha2(F.concat_ws(",", F.count(F.lit(1)).cast("string"), F.coalesce(F.bit_xor(row), F.lit(0)).cast("string"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).cast("string")), 256).alias("content_hash"))


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The table, or an error that names the columns it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {missing}")
    return df
