"""Queries of the operators for training text, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.llm.cluster_profiles import describe_clusters, pivot_groups
from rankforge.llm.encode import encode
from rankforge.llm.group_split import assign_splits, related_groups, split_report
from rankforge.llm.mixing import mix, mix_report, source_rates
from rankforge.llm.name_mapping import map_names, unmatched_values
from rankforge.llm.pivot_clusters import cluster_links
from rankforge.llm.segment_join import overlap_pairs, overlap_report, overlaps
from rankforge.llm.sentences import split_sentences
from rankforge.llm.top_bands import top_per_group
from rankforge.runtime import keep, table


def _p1_splits(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {t: table(spark, d, t) for t in ("eval_c_unseen_species", "unseen")}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap_pairs(_p1_splits(spark, d), table(spark, d, "supervised_train"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap_report(overlaps(_p1_splits(spark, d), table(spark, d, "supervised_train")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return cluster_links(table(spark, d, "supervised_train"))


def p2_clusters(spark: SparkSession, d: str) -> DataFrame:
    return describe_clusters(table(spark, d, "supervised_train"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return pivot_groups(table(spark, d, "supervised_train"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return map_names(table(spark, d, "zero_shot_queries"), table(spark, d, "candidate_species"))


def p3_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return unmatched_values(table(spark, d, "zero_shot_queries"), table(spark, d, "candidate_species"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "eco_phylo_candidate_features_top5")
    return top_per_group(rows, "query_processid", "candidate_tree_label", "candidate_score", "candidate_rank_num", 3)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return related_groups(table(spark, d, "zero_shot_queries"), table(spark, d, "candidate_species"))


def _p6_assigned(spark: SparkSession, d: str) -> DataFrame:
    return assign_splits(p6_found(spark, d), table(spark, d, "split_targets"))


def p6_assignment(spark: SparkSession, d: str) -> DataFrame:
    return _p6_assigned(spark, d)


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return split_report(keep(_p6_assigned(spark, d)), table(spark, d, "split_targets"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return source_rates(table(spark, d, "documents"), table(spark, d, "mix_targets")).where(~F.col("reachable")).select("source")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return mix(docs, keep(source_rates(docs, table(spark, d, "mix_targets"))))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return mix_report(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return split_sentences(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_report, p2_found, p2_clusters, p2_groups, p3_found, p3_unmatched, p5_found, p6_found, p6_assignment, p6_report, p7_ids, p8_found, p8_mix, p8_report, p9_found)
}

ORACLE = {
    "p5_found": """
        WITH v AS (SELECT query_processid, candidate_tree_label, candidate_score, candidate_rank_num,
                row_number() OVER (PARTITION BY query_processid, candidate_tree_label
                    ORDER BY candidate_score DESC, candidate_rank_num ASC NULLS LAST) AS k
            FROM eco_phylo_candidate_features_top5
            WHERE candidate_score IS NOT NULL AND NOT isnan(candidate_score)
              AND query_processid IS NOT NULL AND candidate_tree_label IS NOT NULL),
        r AS (SELECT query_processid, candidate_tree_label, row_number() OVER (PARTITION BY query_processid
                    ORDER BY candidate_score DESC, candidate_rank_num ASC NULLS LAST, candidate_tree_label ASC) AS p
            FROM v WHERE k = 1)
        SELECT query_processid, CAST(p AS INTEGER) AS place, candidate_tree_label FROM r WHERE p <= 3""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
