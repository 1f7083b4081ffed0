"""Per-key aggregation in tree form, so that a hot key never meets in one task.

Chunk states are made where the rows lie, then merged in rounds of `fan_in`: a key with a third
of all rows costs each task of a round at most `fan_in` states of that key.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Rows of a chunk; with more rows there are more chunks, and by their logarithm more rounds.
CHUNK_ROWS = 65_536


def chunks_for(rows: int, chunk_rows: int = CHUNK_ROWS) -> int:
    """How many chunks of a fixed size the rows fill."""
    return max(1, math.ceil(rows / chunk_rows))


def tree_aggregate(
    df: DataFrame,
    keys: Sequence[str],
    sums: dict[str, Column],
    spread_by: Sequence[str],
    chunks: int,
    fan_in: int = 16,
) -> DataFrame:
    """Sums per key by logarithmic fan-in rounds.

    Each row falls into one of `chunks` chunks by the hash of `spread_by` (a hash, not a partition
    number, so that a task run again gives the same states); chunks_for gives the number that makes them of a fixed size. The first
    round combines the chunks of a key on the map side, later rounds merge `fan_in` neighbouring chunks until one is left.
    Null keys form a group of their own; null summands are ignored, a key whose summands are all
    null has a null sum; an empty input gives no rows.
    """
    rounds = max(1, math.ceil(math.log(max(chunks, 2), fan_in)))
    state = df.select(
        *keys,
        F.pmod(F.xxhash64(*[F.col(c) for c in spread_by]), F.lit(chunks)).cast("int").alias("__chunk"),
        *[v.alias(n) for n, v in sums.items()],
    )
    for _ in range(rounds):
        state = state.groupBy(*keys, "__chunk").agg(*[F.sum(n).alias(n) for n in sums])
        state = state.withColumn("__chunk", F.floor(F.col("__chunk") / fan_in).cast("int"))
    return state.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in sums])


def per_value_profile(
    df: DataFrame,
    fields: Sequence[str],
    record_id: str = "processid",
    measure: str = "seq_len",
    chunks: int | None = None,
    fan_in: int = 16,
) -> DataFrame:
    """Rows, distinct records and mean of `measure` for each value of each field.

    Result: field, key_value, n_rows, n_records, mean_<measure>. Values are taken as written; null is
    a value of its own (key_value null). n_records counts distinct non-null record ids. A null measure
    counts in n_rows but not in the mean. Column names of the input that clash with the result's do no
    harm, as only the named columns are read.

    Rows are first combined per (field, value, record), whose hash spreads a hot value over all
    tasks; the tree then works on records.
    """
    chunks = chunks or chunks_for(df.count() * len(fields))
    long = df.select(F.explode(_pairs(fields)).alias("__p"), F.col(record_id).alias("__rec"), F.col(measure).cast("double").alias("__m"))
    per_record = (
        long.select("__p.field", "__p.key_value", "__rec", "__m")
        .groupBy("field", "key_value", "__rec")
        .agg(F.count(F.lit(1)).alias("r"), F.sum("__m").alias("s"), F.count("__m").alias("c"))
    )
    merged = tree_aggregate(
        per_record,
        ["field", "key_value"],
        {"n_rows": F.col("r"), "n_records": F.when(F.col("__rec").isNotNull(), 1).otherwise(0).cast("long"), "s": F.col("s"), "c": F.col("c")},
        ["__rec"],
        chunks,
        fan_in,
    )
    return merged.select("field", "key_value", "n_rows", "n_records", (F.col("s") / F.when(F.col("c") > 0, F.col("c"))).alias(f"mean_{measure}"))


def _pairs(fields: Sequence[str]) -> Column:
    return F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("key_value")) for f in fields])


def value_rows(df: DataFrame, fields: Sequence[str], spread_by: str, total_rows: int, fan_in: int = 16) -> DataFrame:
    """(field, key_value, n_rows) of each value of each field, by the same tree without the records; only states are shuffled."""
    long = df.select(F.explode(_pairs(fields)).alias("__p"), F.col(spread_by).alias("__rec")).select("__p.field", "__p.key_value", "__rec")
    return tree_aggregate(long, ["field", "key_value"], {"n_rows": F.lit(1)}, ["__rec"], chunks_for(total_rows * len(fields)), fan_in)


def heavy_values(profile: DataFrame, total_rows: int, share: float) -> DataFrame:
    """Values, not null, that hold at least `share` of `total_rows`; none where there are no rows."""
    least = max(1, math.ceil(total_rows * share - 1e-9))
    return profile.where(F.col("key_value").isNotNull() & (F.col("n_rows") >= least)).select("field", "key_value")
