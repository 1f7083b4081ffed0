"""Queries of the heavy-key problem (p4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankforge.operators.tree_aggregate import heavy_values, per_value_profile, value_rows
from rankforge.runtime import table

FIELDS = ["species_name", "genus_name"]
HEAVY_SHARE = 0.02


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    train = table(spark, d, "supervised_train")
    n = train.count()  # read off the files' footers
    return heavy_values(value_rows(train, FIELDS, "processid", n), n, HEAVY_SHARE)


def p4_value_profile(spark: SparkSession, d: str) -> DataFrame:
    return per_value_profile(table(spark, d, "supervised_train"), FIELDS)


QUERIES = {"p4_found": p4_found, "p4_value_profile": p4_value_profile}

_LONG = """long AS (
  SELECT 'species_name' AS field, species_name AS key_value, processid, seq_len FROM supervised_train
  UNION ALL SELECT 'genus_name', genus_name, processid, seq_len FROM supervised_train)"""

ORACLE = {
    "p4_found": f"""WITH {_LONG}
        SELECT field, key_value FROM long WHERE key_value IS NOT NULL GROUP BY field, key_value
        HAVING count(*) >= 0.02 * (SELECT count(*) FROM supervised_train)""",
    "p4_value_profile": f"""WITH {_LONG}
        SELECT field, key_value, count(*) AS n_rows, count(DISTINCT processid) AS n_records,
               sum(CAST(seq_len AS DOUBLE)) / nullif(count(seq_len), 0) AS mean_seq_len
        FROM long GROUP BY field, key_value""",
}
