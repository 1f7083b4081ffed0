"""Queries on barcode records: cleaning, audits, hierarchy repair, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.functions import exprs as X
from rankforge.operators import records as R
from rankforge.runtime import table

LEVELS = ["species_name", "genus_name", "family_name", "order_name"]
SPLITS = ["supervised_train", "eval_c_unseen_species", "unseen"]


def _us():
    """Load time as a number, which engines print alike."""
    return F.unix_micros("loaded_at").alias("loaded_us")


def _clean(spark: SparkSession, d: str, name: str = "supervised_train") -> DataFrame:
    return R.cleaned_records(table(spark, d, name))


def p_clean_sequences(spark, d):
    return _clean(spark, d).select("processid", _us(), "nucleotides", "seq_len", F.round("n_frac", 6).alias("n_frac"))


def p_canonical_taxa(spark, d):
    return _clean(spark, d).groupBy(*LEVELS).agg(F.count(F.lit(1)).alias("n_rows"))


def p_qc_counts(spark, d):
    return R.qc_counts(_clean(spark, d))


def p_pad(spark, d):
    x = _clean(spark, d)
    return x.select("processid", _us(), X.pad_left("nucleotides").alias("padded"))


def p_amplicon(spark, d):
    x = table(spark, d, "zero_shot_queries").select("processid", "loaded_at", X.clean_sequence("nucleotides").alias("s"))
    return x.select("processid", _us(), X.amplicon("s", "TTG", "GGG").alias("amplicon"))


def p_labels(spark, d):
    return R.label_form(table(spark, d, "supervised_train").select("species_name").distinct(), "species_name")


def p_lists(spark, d):
    x = table(spark, d, "zero_shot_queries").select("processid", X.parse_list(F.regexp_replace("eventid", ":", "|")).alias("parts"))
    return x.select("processid", F.size("parts").cast("long").alias("n_parts"), F.array_join("parts", "/").alias("parts"))


def _every_split(spark, d):
    """The cleaned records of all splits."""
    x = None
    for n in SPLITS:
        y = _clean(spark, d, n).select("processid", "loaded_at", "nucleotides", "genus_name", "seq_len")
        x = y if x is None else x.unionByName(y)
    return x


def led(rows: DataFrame, group: str) -> DataFrame:
    """(processid, lead_id, s, lead) of the records of a group but its smallest processid, with that one's sequence; of a record's rows the greatest."""
    x = rows.where(F.col(group).isNotNull() & F.col("processid").isNotNull()).groupBy(group, "processid").agg(F.max("nucleotides").alias("s"))
    lead = x.groupBy(group).agg(F.min("processid").alias("lead_id"), F.min_by("s", "processid").alias("lead"))
    return x.join(lead, group).where("processid <> lead_id").select("processid", "lead_id", "s", "lead")


def q_revcomp(spark, d):
    return _every_split(spark, d).select("processid", _us(), X.reverse_complement("nucleotides").alias("reverse_complement"))


def q_pdistance(spark, d):
    """Distance of each record to the smallest processid of its genus, place by place of the padded form."""
    j = led(_every_split(spark, d).where("seq_len > 0").withColumn("nucleotides", X.pad_left("nucleotides")), "genus_name")
    return j.select("processid", "lead_id", F.round(X.p_distance("s", "lead"), 6).alias("p_distance")).where("p_distance is not null")


def a_dup_conflict_audit(spark, d):
    return R.conflict_audit(_clean(spark, d), "nucleotides", LEVELS)


def a_dedup_priority(spark, d):
    order = [F.asc("loaded_at"), F.asc_nulls_last("nucleotides")]
    return R.keep_first(table(spark, d, "supervised_train").where("processid is not null"), ["processid"], order).select("processid", _us(), F.length("nucleotides").alias("n_chars"))


def a_drop_conflicts(spark, d):
    x = _clean(spark, d).where("seq_len > 0")
    return R.drop_conflicting(x, "nucleotides", "species_name").select("processid", _us(), "species_name")


def a_majority_parent(spark, d):
    x = _clean(spark, d).select("processid", _us(), *LEVELS)
    return R.repaired_hierarchy(x)


def a_exact_clusters(spark, d):
    x = R.exact_cluster_support(_clean(spark, d).where("seq_len > 0"), "nucleotides", LEVELS)
    return x.groupBy("supported_rank").agg(F.count(F.lit(1)).alias("n_clusters"), F.sum("n_rows").alias("n_rows"))


def a_species_resolvability(spark, d):
    return R.species_resolvability(_clean(spark, d).where("seq_len > 0"), "nucleotides", LEVELS)


def a_query_oracle(spark, d):
    """Whether the cluster of an evaluation sequence supports its true genus."""
    c = R.exact_cluster_support(_clean(spark, d).where("seq_len > 0"), "nucleotides", LEVELS)
    q = _clean(spark, d, "eval_c_unseen_species").where("seq_len > 0").select("processid", "loaded_at", "nucleotides")
    return q.join(c, "nucleotides", "left").select("processid", _us(), F.coalesce("supported_rank", F.lit("no_cluster")).alias("supported_rank"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


def r_reference_pick(spark, d):
    x = _clean(spark, d).where("seq_len > 0").groupBy("species_name", "processid").agg(F.max("nucleotides").alias("nucleotides"))
    return R.reference_pick(x, "species_name", "nucleotides", "processid")


def u_overlap_matrix(spark, d):
    return R.split_overlaps({n: _clean(spark, d, n).where("seq_len >= 300") for n in SPLITS}, "nucleotides")


def b_leak_audit(spark, d):
    """Overlap of processids, however they are written, over all splits and the query table."""
    return R.split_overlaps({n: table(spark, d, n).select(X.record_key("processid").alias("k")) for n in [*SPLITS, "zero_shot_queries"]}, "k")


def u_union_sources(spark, d):
    x = None
    for n in SPLITS:
        y = _clean(spark, d, n).select(F.lit(n).alias("split"), "source")
        x = y if x is None else x.unionByName(y)
    return x.groupBy("split", "source").agg(F.count(F.lit(1)).alias("n_rows"))


def b_unseen_genera(spark, d):
    """Genera held out: not among the 50 of most rows, of 2 to 50 species, max(20, a tenth) of such by hash."""
    return R.unseen_groups_by_share(_clean(spark, d), "genus_name", "species_name", 2, 50, 50, 0.1, "genera-1")


def b_unseen_species(spark, d):
    return R.held_out_members(_clean(spark, d), "genus_name", "species_name", 2, "species-1")


def b_stratified(spark, d):
    x = R.stratified_split(_clean(spark, d), "processid", "species_name", {"train": 0.7, "validation": 0.1, "test": 0.2}, "strat-1")
    return x.groupBy("species_name", "split").agg(F.count(F.lit(1)).alias("n"))


def s_complete_group_sample(spark, d):
    return R.complete_groups(_clean(spark, d), "species_name", 25, "sample-1").select("processid", _us(), "species_name")


def j_anti_hide_reference(spark, d):
    q = _clean(spark, d, "unseen")
    return R.hidden_reference(table(spark, d, "candidate_species"), q, "genus_name").select("tree_label", "genus_name")


def j_semi_reference(spark, d):
    c = table(spark, d, "candidate_species")
    return c.join(_clean(spark, d).select("species_name").distinct(), "species_name", "left_semi").select("tree_label", "species_name")


def j_outer_counts(spark, d):
    """Rows per species in each split, by a chain of full joins."""
    out = None
    for n in SPLITS:
        y = _clean(spark, d, n).where("species_name is not null").groupBy("species_name").agg(F.count(F.lit(1)).alias(f"n_{n}"))
        out = y if out is None else out.join(y, "species_name", "full")
    return out.fillna(0)


def x_gap_fill(spark, d):
    main = table(spark, d, "candidate_species").select("genus_name", "family_name").groupBy("genus_name").agg(F.max("family_name").alias("family_name"))
    return R.filled_taxonomy(main, [_clean(spark, d), _clean(spark, d, "unseen")], "genus_name", "family_name")


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and k.split("_")[0] in ("p", "q", "a", "r", "u", "b", "s", "j", "x")}


def _trim(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def _taxon(c: str) -> str:
    return f"CASE WHEN lower({_trim(c)}) NOT IN ('', 'na', 'nan', 'none', 'unclassified') THEN {_trim(c)} END"


def clean_sql(name: str) -> str:
    seq = "regexp_replace(upper(nucleotides), '[^ACGTN]', '', 'g')"
    sp = f"regexp_replace({_taxon('species_name')}, '\\s+', ' ', 'g')"
    return f"""(SELECT processid, {seq} AS nucleotides, {sp} AS species_name,
        coalesce({_taxon('genus_name')}, {_taxon(f"split_part({sp}, ' ', 1)")}) AS genus_name,
        {_taxon('family_name')} AS family_name, {_taxon('order_name')} AS order_name, {_taxon('source')} AS source,
        length({seq}) AS seq_len,
        CASE WHEN length({seq}) > 0 THEN length(regexp_replace({seq}, '[^N]', '', 'g')) / length({seq}) END AS n_frac, loaded_at
        FROM {name})"""


def _frac(value: str, salt: str) -> str:
    return f"(CAST(('0x' || substr(sha1('{salt}:' || {value}), 1, 12)) AS BIGINT) / 281474976710656.0)"


TR, EV, UN = (clean_sql(n) for n in SPLITS)
_RANK_CASE = "CASE WHEN s = 1 THEN 'species' WHEN g = 1 THEN 'genus' WHEN f = 1 THEN 'family' WHEN o = 1 THEN 'order' ELSE 'unresolved' END"
_CLUSTERS = f"""c AS (SELECT nucleotides, count(*) AS n_rows, count(DISTINCT species_name) AS s, count(DISTINCT genus_name) AS g,
    count(DISTINCT family_name) AS f, count(DISTINCT order_name) AS o FROM {TR} WHERE seq_len > 0 GROUP BY nucleotides),
    k AS (SELECT nucleotides, n_rows, {_RANK_CASE} AS supported_rank FROM c)"""


def _majority(src: str, child: str, parent: str, name: str) -> str:
    return f"""{name}b AS (SELECT {child} AS ch, {parent} AS best FROM (SELECT {child}, {parent},
        row_number() OVER (PARTITION BY {child} ORDER BY count(*) DESC, {parent}) AS r FROM {src}
        WHERE {child} IS NOT NULL AND {parent} IS NOT NULL GROUP BY {child}, {parent}) WHERE r = 1),
    {name} AS (SELECT s.* FROM {src} s LEFT JOIN {name}b ON s.{child} = {name}b.ch WHERE best IS NULL OR {parent} IS NULL OR {parent} = best)"""


ORACLE = {
    "p_clean_sequences": f"SELECT processid, epoch_us(loaded_at) AS loaded_us, nucleotides, seq_len, round(n_frac, 6) AS n_frac FROM {TR}",
    "p_canonical_taxa": f"SELECT species_name, genus_name, family_name, order_name, count(*) AS n_rows FROM {TR} GROUP BY ALL",
    "p_qc_counts": f"""WITH x AS (SELECT coalesce(seq_len > 0, false) AS a, coalesce(seq_len >= 500, false) AS b, coalesce(seq_len <= 700, false) AS c,
            coalesce(n_frac <= 0.05, false) AS e, coalesce(regexp_matches(species_name, '^\\S+ \\S+'), false) AS f FROM {TR})
        SELECT '0_all' AS step, count(*) AS n_left FROM x UNION ALL SELECT '1_has_sequence', count(*) FROM x WHERE a
        UNION ALL SELECT '2_long_enough', count(*) FROM x WHERE a AND b UNION ALL SELECT '3_short_enough', count(*) FROM x WHERE a AND b AND c
        UNION ALL SELECT '4_few_unknown', count(*) FROM x WHERE a AND b AND c AND e UNION ALL SELECT '5_binomial', count(*) FROM x WHERE a AND b AND c AND e AND f""",
    "p_pad": f"SELECT processid, epoch_us(loaded_at) AS loaded_us, lpad(nucleotides, 660, 'N') AS padded FROM {TR}",
    "p_amplicon": """WITH q AS (SELECT processid, loaded_at, regexp_replace(upper(nucleotides), '[^ACGTN]', '', 'g') AS s FROM zero_shot_queries),
        f AS (SELECT *, strpos(s, 'TTG') AS f FROM q), g AS (SELECT *, strpos(substr(s, f + 3), 'CCC') AS a, strpos(substr(s, f + 3), 'GGG') AS b FROM f),
        e AS (SELECT *, CASE WHEN a > 0 THEN f + 3 + a - 1 + 3 WHEN b > 0 THEN f + 3 + b - 1 + 3 END AS e FROM g)
        SELECT processid, epoch_us(loaded_at) AS loaded_us, CASE WHEN f > 0 AND e IS NOT NULL THEN substr(s, f, e - f) END AS amplicon FROM e""",
    "p_labels": f"""WITH s AS (SELECT DISTINCT species_name FROM supervised_train),
        l AS (SELECT species_name, regexp_replace(regexp_replace({_taxon('species_name')}, '[''"]', '', 'g'), '\\s+', '_', 'g') AS label FROM s)
        SELECT species_name, label, split_part(label, '_', 1) AS label_genus FROM l""",
    "p_lists": """WITH x AS (SELECT processid, CASE WHEN eventid IS NULL OR lower(trim(eventid)) IN ('', 'na', 'nan', 'none', 'unclassified') THEN []
            ELSE list_filter(string_split(replace(eventid, ':', '|'), '|'), lambda y: trim(y) <> '') END AS l FROM zero_shot_queries)
        SELECT processid, len(l) AS n_parts, coalesce(array_to_string(list_transform(l, lambda y: trim(y)), '/'), '') AS parts FROM x""",
    "q_revcomp": f"WITH x AS (SELECT * FROM {TR} UNION ALL SELECT * FROM {EV} UNION ALL SELECT * FROM {UN}) SELECT processid, epoch_us(loaded_at) AS loaded_us, translate(reverse(nucleotides), 'ACGT', 'TGCA') AS reverse_complement FROM x",
    "q_pdistance": f"""WITH a AS (SELECT * FROM {TR} UNION ALL SELECT * FROM {EV} UNION ALL SELECT * FROM {UN}), x AS (SELECT genus_name, processid, max(lpad(nucleotides, 660, 'N')) AS s FROM a WHERE seq_len > 0 AND genus_name IS NOT NULL AND processid IS NOT NULL GROUP BY ALL),
        l AS (SELECT genus_name, min(processid) AS lead_id, min_by(s, processid) AS lead FROM x GROUP BY genus_name),
        p AS (SELECT x.processid, lead_id, unnest(range(1, least(length(s), length(lead)) + 1)) AS i, s, lead FROM x JOIN l USING (genus_name) WHERE x.processid <> lead_id),
        c AS (SELECT processid, lead_id, substr(s, i, 1) AS a, substr(lead, i, 1) AS b FROM p)
        SELECT processid, lead_id, round(count(*) FILTER (a <> b) / count(*), 6) AS p_distance FROM c WHERE a IN ('A','C','G','T') AND b IN ('A','C','G','T') GROUP BY ALL""",
    "a_dup_conflict_audit": f"""WITH g AS (SELECT nucleotides, count(*) AS n, count(DISTINCT species_name) AS s, count(DISTINCT genus_name) AS g, count(DISTINCT family_name) AS f,
            count(DISTINCT order_name) AS o FROM {TR} GROUP BY nucleotides)
        SELECT CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS rows_in_duplicate_groups, count(*) FILTER (n > 1) AS duplicate_groups,
            count(*) FILTER (s > 1) AS groups_with_several_species_name, count(*) FILTER (g > 1) AS groups_with_several_genus_name,
            count(*) FILTER (f > 1) AS groups_with_several_family_name, count(*) FILTER (o > 1) AS groups_with_several_order_name FROM g""",
    "a_dedup_priority": """SELECT processid, epoch_us(loaded_at) AS loaded_us, length(nucleotides) AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY processid
        ORDER BY loaded_at ASC NULLS FIRST, nucleotides ASC NULLS LAST) AS r FROM supervised_train WHERE processid IS NOT NULL) WHERE r = 1""",
    "a_drop_conflicts": f"""WITH x AS (SELECT * FROM {TR} WHERE seq_len > 0), g AS (SELECT nucleotides FROM x GROUP BY nucleotides HAVING min(species_name) <> max(species_name))
        SELECT processid, epoch_us(loaded_at) AS loaded_us, species_name FROM x WHERE nucleotides NOT IN (SELECT nucleotides FROM g)""",
    "a_majority_parent": f"""WITH l0 AS (SELECT processid, epoch_us(loaded_at) AS loaded_us, species_name, genus_name, family_name, order_name FROM {TR}),
        {_majority('l0', 'species_name', 'genus_name', 'l1')}, {_majority('l1', 'genus_name', 'family_name', 'l2')}, {_majority('l2', 'family_name', 'order_name', 'l3')}
        SELECT * FROM l3""",
    "a_exact_clusters": f"WITH {_CLUSTERS} SELECT supported_rank, count(*) AS n_clusters, CAST(sum(n_rows) AS BIGINT) AS n_rows FROM k GROUP BY supported_rank",
    "a_species_resolvability": f"""WITH {_CLUSTERS}, p AS (SELECT DISTINCT species_name, nucleotides FROM {TR} WHERE seq_len > 0 AND species_name IS NOT NULL),
        j AS (SELECT species_name, CASE supported_rank WHEN 'species' THEN 0 WHEN 'genus' THEN 1 WHEN 'family' THEN 2 WHEN 'order' THEN 3 ELSE 4 END AS l FROM p JOIN k USING (nucleotides)),
        a AS (SELECT species_name, count(*) AS n_clusters, min(l) AS lo, max(l) AS hi FROM j GROUP BY species_name)
        SELECT species_name, n_clusters, (['species','genus','family','order','unresolved'])[lo + 1] AS best_rank,
            (['species','genus','family','order','unresolved'])[hi + 1] AS worst_rank, hi = 0 AS all_species FROM a""",
    "a_query_oracle": f"""WITH {_CLUSTERS} SELECT processid, epoch_us(loaded_at) AS loaded_us, coalesce(supported_rank, 'no_cluster') AS supported_rank, coalesce(n_rows, 0) AS n_rows
        FROM {EV} q LEFT JOIN k USING (nucleotides) WHERE seq_len > 0""",
    "r_reference_pick": f"""WITH x AS (SELECT species_name, processid, max(nucleotides) AS q FROM {TR} WHERE seq_len > 0 GROUP BY ALL),
        s AS (SELECT *, length(regexp_replace(q, '[^ACGT]', '', 'g')) - length(regexp_replace(q, '[^N]', '', 'g')) AS s FROM x WHERE species_name IS NOT NULL)
        SELECT species_name, processid, length(q) AS seq_len FROM (SELECT *, row_number() OVER (PARTITION BY species_name ORDER BY s DESC, length(q) DESC, processid) AS r FROM s) WHERE r = 1""",
    "u_overlap_matrix": f"""WITH t AS (SELECT DISTINCT 'supervised_train' AS split, nucleotides AS k FROM {TR} WHERE seq_len >= 300 UNION SELECT 'eval_c_unseen_species', nucleotides FROM {EV} WHERE seq_len >= 300
            UNION SELECT 'unseen', nucleotides FROM {UN} WHERE seq_len >= 300)
        SELECT a.split AS split_a, b.split AS split_b, count(*) AS n_common FROM t a JOIN t b ON a.k = b.k AND a.split < b.split GROUP BY ALL""",
    "b_leak_audit": "WITH t AS (" + " UNION ".join(f"SELECT '{n}' AS split, nullif(regexp_replace(regexp_replace(upper(processid), '\\..*$', ''), '[^A-Z0-9]', '', 'g'), '') AS k FROM {n}" for n in [*SPLITS, "zero_shot_queries"]) + """)
        SELECT a.split AS split_a, b.split AS split_b, count(*) AS n_common FROM t a JOIN t b ON a.k = b.k AND a.split < b.split GROUP BY ALL""",
    "u_union_sources": " UNION ALL ".join(f"SELECT '{n}' AS split, source, count(*) AS n_rows FROM {q} GROUP BY source" for n, q in zip(SPLITS, (TR, EV, UN))),
    "b_unseen_genera": f"""WITH x AS (SELECT * FROM {TR} WHERE genus_name IS NOT NULL), big AS (SELECT genus_name FROM x GROUP BY genus_name ORDER BY count(*) DESC, genus_name LIMIT 50),
        c AS (SELECT genus_name, count(DISTINCT species_name) AS n_members FROM x WHERE genus_name NOT IN (SELECT genus_name FROM big) GROUP BY genus_name HAVING count(DISTINCT species_name) BETWEEN 2 AND 50),
        r AS (SELECT *, row_number() OVER (ORDER BY {_frac('genus_name', 'genera-1')}, genus_name) AS r, count(*) OVER () AS n FROM c) SELECT genus_name, n_members FROM r WHERE r <= greatest(20, CAST(floor(n * 0.1) AS BIGINT))""",
    "b_unseen_species": f"""WITH p AS (SELECT DISTINCT genus_name, species_name FROM {TR} WHERE genus_name IS NOT NULL AND species_name IS NOT NULL)
        SELECT genus_name, species_name FROM (SELECT *, row_number() OVER (PARTITION BY genus_name ORDER BY {_frac('species_name', 'species-1')}, species_name) AS r,
            count(*) OVER (PARTITION BY genus_name) AS n FROM p) WHERE r <= least(2, n - 1)""",
    "b_stratified": f"""WITH o AS (SELECT processid, min(species_name) AS species_name FROM {TR} WHERE processid IS NOT NULL AND species_name IS NOT NULL GROUP BY processid),
        p AS (SELECT *, (row_number() OVER (PARTITION BY species_name ORDER BY {_frac('processid', 'strat-1')}, processid) - 1) / count(*) OVER (PARTITION BY species_name) AS p FROM o)
        SELECT species_name, CASE WHEN p < 0.7 THEN 'train' WHEN p < 0.8 THEN 'validation' ELSE 'test' END AS split, count(*) AS n FROM p GROUP BY ALL""",
    "s_complete_group_sample": f"""WITH x AS (SELECT * FROM {TR}), g AS (SELECT species_name FROM (SELECT DISTINCT species_name FROM x WHERE species_name IS NOT NULL)
            ORDER BY {_frac('species_name', 'sample-1')}, species_name LIMIT 25)
        SELECT processid, epoch_us(loaded_at) AS loaded_us, species_name FROM x WHERE species_name IN (SELECT species_name FROM g)""",
    "j_anti_hide_reference": f"SELECT tree_label, genus_name FROM candidate_species WHERE genus_name NOT IN (SELECT genus_name FROM {UN} WHERE genus_name IS NOT NULL)",
    "j_semi_reference": f"SELECT tree_label, species_name FROM candidate_species WHERE species_name IN (SELECT species_name FROM {TR})",
    "j_outer_counts": "WITH t AS (" + " UNION ALL ".join(f"SELECT '{n}' AS split, species_name FROM {q} WHERE species_name IS NOT NULL" for n, q in zip(SPLITS, (TR, EV, UN))) + """)
        SELECT species_name, count(*) FILTER (split = 'supervised_train') AS n_supervised_train, count(*) FILTER (split = 'eval_c_unseen_species') AS n_eval_c_unseen_species,
            count(*) FILTER (split = 'unseen') AS n_unseen FROM t GROUP BY species_name""",
    "x_gap_fill": f"""WITH m AS (SELECT genus_name, max(family_name) AS family_name FROM candidate_species GROUP BY genus_name),
        a AS (SELECT genus_name, min(family_name) AS f FROM {TR} GROUP BY genus_name), b AS (SELECT genus_name, min(family_name) AS f FROM {UN} GROUP BY genus_name)
        SELECT m.genus_name, coalesce(m.family_name, a.f, b.f) AS family_name FROM m LEFT JOIN a USING (genus_name) LEFT JOIN b USING (genus_name)""",
}
