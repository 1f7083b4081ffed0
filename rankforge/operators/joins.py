"""Joins with a contract: by the shape of the predictions, many to one, by a derived key, in order, by priority, of sampled pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankforge.operators.ordering import global_places
from rankforge.runtime import keep


def shaped_join(left: DataFrame, predictions: DataFrame, keys: Sequence[str], suffix: str = "_pred") -> DataFrame:
    """`left` with the columns of predictions, joined by those of `keys` that the predictions have, so by sample and query or by query alone.

    Columns of both sides become one: the prediction's value, else the left one's. Null keys join nothing.
    """
    on = [k for k in keys if k in predictions.columns]
    if not on:
        raise ValueError(f"predictions have none of {list(keys)}")
    both = [c for c in predictions.columns if c in left.columns and c not in on]
    p = predictions.withColumnsRenamed({c: f"{c}{suffix}" for c in both})
    out = left.join(p, on, "left")
    for c in both:
        out = out.withColumn(c, F.coalesce(f"{c}{suffix}", c)).drop(f"{c}{suffix}")
    return out


def many_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on a right side that must have each key once; an error names a key that comes again."""
    again = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).first()
    if again is not None:
        raise ValueError(f"the right side has {[again[k] for k in keys]} {again['n']} times")
    return left.join(right, list(keys), "left")


def derived_key_join(a: DataFrame, b: DataFrame, source: str, pattern: str, key: str) -> DataFrame:
    """Inner join by the first group of a pattern in both sides' column `source`, which is read as `key`; rows without a match go."""
    part = lambda df: df.withColumn(key, F.regexp_extract(source, pattern, 1)).where(F.col(key) != "").drop(source)
    return part(a).join(part(b), key)


def ordered_lookup(ids: DataFrame, position: str, key: str, table: DataFrame) -> DataFrame:
    """The table's row of each id, with the position of the id; an id that the table lacks is an error, one that comes again is looked up again."""
    lost = ids.join(table.select(key), key, "left_anti").first()
    if lost is not None:
        raise KeyError(f"{key} {lost[key]!r} is not in the table")
    return ids.select(position, key).join(table, key)


def paired_first(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str], names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """First places of two sources side by side, the columns with each source's prefix; keys that one source lacks are left out."""
    one = lambda df, p: df.where("place = 1").select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in columns])
    return one(a, names[0]).join(one(b, names[1]), list(keys))


def _draw(text: Column, n: Column) -> Column:
    return F.conv(F.substring(F.sha1(text), 1, 12), 16, 10).cast("long") % n


def sampled_pairs(items: DataFrame, item: str, n_pairs: int, salt: str) -> DataFrame:
    """(a, b) with a < b: distinct pairs of distinct items, drawn by hash; no more than n_pairs, fewer where a pair is drawn twice.

    Items are numbered in order and the pairs are drawn as numbers, so that no pair is formed but those drawn.
    """
    p = keep(global_places(items.where(F.col(item).isNotNull()).select(item).distinct(), [F.asc(item)], "__i").select((F.col("__i") - 1).alias("__i"), item))
    n = p.count()
    if n < 2:
        return p.select(F.col(item).alias("a"), F.col(item).alias("b")).limit(0)
    i = F.col("id").cast("string")
    d = items.sparkSession.range(n_pairs).select(_draw(F.concat(F.lit(f"{salt}:a:"), i), F.lit(n)).alias("x"), _draw(F.concat(F.lit(f"{salt}:b:"), i), F.lit(n - 1)).alias("y"))
    d = d.select("x", ((F.col("x") + 1 + F.col("y")) % n).alias("y")).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    a, b = p.toDF("x", "a"), p.toDF("y", "b")
    return d.join(a, "x").join(b, "y").select("a", "b")


def prioritised_match(rows: DataFrame, forms: Sequence[Column], listed: DataFrame, fields: Sequence[Column], value: str) -> DataFrame:
    """`rows` with `match` and `matched_by` (from 1): the value of the first of `forms` that equals the same-numbered field of the list.

    A field that several entries bear gives the smallest value.
    """
    out, hits = rows, []
    for i, (form, field) in enumerate(zip(forms, fields), 1):
        side = listed.select(field.alias(f"__f{i}"), F.col(value).alias(f"__v{i}")).where(f"__f{i} is not null").groupBy(f"__f{i}").agg(F.min(f"__v{i}").alias(f"__v{i}"))
        out = out.withColumn(f"__k{i}", form).join(side, F.col(f"__k{i}") == F.col(f"__f{i}"), "left").drop(f"__f{i}", f"__k{i}")
        hits.append(f"__v{i}")
    by = F.coalesce(*[F.when(F.col(h).isNotNull(), F.lit(i)) for i, h in enumerate(hits, 1)])
    return out.withColumn("match", F.coalesce(*hits)).withColumn("matched_by", by).drop(*hits)
