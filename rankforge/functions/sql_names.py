"""The functions under SQL names: scalar ones as SQL functions that stay in the JVM, the tree reader as a table function."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from rankforge.functions.exprs import BLANKS
from rankforge.functions.pairwise import best_ungapped, edit_identity
from rankforge.sources.formats import parse_newick

_DOT = "aggregate(zip_with({0}, {1}, (x, y) -> cast(x AS double) * cast(y AS double)), cast(0 AS double), (s, x) -> s + x)"
_PLAIN = "filter(zip_with(split(a, ''), split(b, ''), (x, y) -> CASE WHEN x IN ('A', 'C', 'G', 'T') AND y IN ('A', 'C', 'G', 'T') THEN cast(x <> y AS int) END), v -> v IS NOT NULL)"
_TRIMMED = r"regexp_replace(s, '^\\s+|\\s+$', '')"
FUNCTIONS = {
    "rf_cosine(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE": f"{_DOT.format('a', 'b')} / nullif(sqrt({_DOT.format('a', 'a')}) * sqrt({_DOT.format('b', 'b')}), 0)",
    "rf_p_distance(a STRING, b STRING) RETURNS DOUBLE": f"aggregate({_PLAIN}, 0, (s, v) -> s + v) / nullif(size({_PLAIN}), 0)",
    "rf_wilson_lower(k BIGINT, n BIGINT) RETURNS DOUBLE": "CASE WHEN n > 0 THEN greatest(0D, (k / n + 1.96D * 1.96D / (2 * n)) / (1 + 1.96D * 1.96D / n) - 1.96D * sqrt(k / n * (1 - k / n) / n + 1.96D * 1.96D / (4D * n * n)) / (1 + 1.96D * 1.96D / n)) END",
    "rf_kmers(s STRING, k INT) RETURNS ARRAY<STRING>": "array_distinct(filter(CASE WHEN length(s) >= k THEN transform(sequence(1, length(s) - k + 1), i -> substring(s, i, k)) ELSE array() END, x -> NOT contains(x, 'N')))",
    "rf_clean_taxon(s STRING) RETURNS STRING": f"CASE WHEN lower({_TRIMMED}) NOT IN ({', '.join(repr(b) for b in BLANKS)}) THEN {_TRIMMED} END",
}


@udtf(returnType="node long, parent long, name string, length double, edge long")
class NewickNodes:
    def eval(self, tree: str):
        yield from parse_newick(tree or "")


def register(spark: SparkSession) -> None:
    """All functions of this engine, for the session: rf_cosine, rf_p_distance, rf_wilson_lower, rf_kmers, rf_clean_taxon, rf_best_ungapped,
    rf_edit_identity and the table function rf_newick_nodes."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udf.register("rf_best_ungapped", best_ungapped)
    spark.udf.register("rf_edit_identity", edit_identity)
    spark.udtf.register("rf_newick_nodes", NewickNodes)
