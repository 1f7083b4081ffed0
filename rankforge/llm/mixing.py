"""Mixing sources to target weights (p8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankforge.llm.encode import token_counts
from rankforge.runtime import keep

#: Sources that a mix may name: its table of rates is broadcast.
MAX_SOURCES = 100_000


def source_tokens(docs: DataFrame) -> DataFrame:
    """(source, n_docs, n_tokens) of documents by their source as written."""
    return token_counts(docs).groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def source_rates(docs: DataFrame, targets: DataFrame, per: DataFrame | None = None) -> DataFrame:
    """(source, target_share, max_repeats, n_docs, n_tokens, wanted_tokens, rate, reachable) of each source of the mix.

    n_tokens counts the documents whose source is, as written, the target's; the size of the mix is the sum over all such
    documents. reachable is false where max_repeats times the tokens are less than wanted. rate is how often each document is used, never
    more than max_repeats; 0 for a source without tokens. What some sources cannot give is made up by the others in proportion to their
    targets, as far as their own max_repeats go, so that the mix has its size where it can. Documents of other sources,
    and of none, have no part. `per` is source_tokens, where it is known already.
    """
    if targets.count() > MAX_SOURCES:
        raise ValueError(f"a mix takes {MAX_SOURCES} sources")
    t = targets.where("source is not null").select("source", "target_share", "max_repeats")
    held = t.join(source_tokens(docs) if per is None else per, "source", "left").fillna(0, ["n_docs", "n_tokens"])
    # the table of sources is bounded, so that windows over all of it are
    every = Window.partitionBy(F.lit(1))
    out = held.withColumn("wanted_tokens", F.col("target_share") * F.sum("n_tokens").over(every))
    out = out.withColumn("__most", F.col("max_repeats").cast("double") * F.col("n_tokens"))
    # raise all by one factor until the mix is full: sources reach their limits in the order of limit over wanted
    before = every.orderBy((F.col("__most") / F.when(F.col("wanted_tokens") > 0, F.col("wanted_tokens"))).asc_nulls_last(), "source").rowsBetween(Window.unboundedPreceding, -1)
    spent, met = F.coalesce(F.sum("__most").over(before), F.lit(0.0)), F.coalesce(F.sum("wanted_tokens").over(before), F.lit(0.0))
    out = out.withColumn("__whole", F.sum("wanted_tokens").over(every)).withColumn("__left", F.col("__whole") - spent).withColumn("__open", F.col("__whole") - met)
    factor = F.col("__left") / F.when(F.col("__open") > 0, F.col("__open"))
    # it rises from source to source while these are at their limits and falls afterwards
    out = out.withColumn("__factor", F.max(factor).over(every))
    used = F.least(F.when(F.col("wanted_tokens") > 0, F.col("__factor") * F.col("wanted_tokens")).otherwise(0.0), F.col("__most"))
    rate = F.when(F.col("n_tokens") > 0, F.least(used / F.col("n_tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    out = out.withColumn("rate", rate).withColumn("reachable", ~(F.col("max_repeats") * F.col("n_tokens") < F.col("wanted_tokens")))
    return out.drop("__most", "__whole", "__left", "__open", "__factor")


def mix(docs: DataFrame, rates: DataFrame, key: str = "doc_id", seed: int = 11) -> DataFrame:
    """(doc_id, source, copy): each document floor(rate) times, and once more with the fraction as probability.

    The draw is a hash of seed and key, so a run again gives the same copies; rows with a null key share one draw.
    """
    small = F.broadcast(rates.select("source", "rate"))
    u = F.xxhash64(F.lit(seed), F.col(key)).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    n = F.floor("rate") + (u < F.col("rate") - F.floor("rate")).cast("int")
    used = docs.select(key, "source").join(small, "source").withColumn("n", n).where("n > 0")
    return used.select(key, "source", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))


def mix_report(docs: DataFrame, targets: DataFrame, seed: int = 11) -> DataFrame:
    """Shares that the mix really has: (source, target_share, max_repeats, n_docs, n_tokens, rate, reachable, used_tokens, actual_share)."""
    counts = keep(token_counts(docs, "doc_id").groupBy("doc_id").agg(F.max("n_tokens").alias("n")))
    held = docs.select("doc_id", "source").join(counts, "doc_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"))
    rates = keep(source_rates(docs, targets, held))
    used = mix(docs, rates, seed=seed).groupBy("doc_id", "source").agg(F.count(F.lit(1)).alias("c")).join(counts, "doc_id")
    per = used.groupBy("source").agg(F.sum(F.col("c") * F.col("n")).alias("used_tokens"))
    out = rates.join(per, "source", "left").fillna(0, ["used_tokens"])
    whole = F.sum("used_tokens").over(Window.partitionBy(F.lit(1)))
    return out.select("source", "target_share", "max_repeats", "n_docs", "n_tokens", "rate", "reachable", "used_tokens", (F.col("used_tokens") / F.when(whole > 0, whole)).alias("actual_share"))
