"""Cleaning, duplicate audits, hierarchy repair and splits of records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankforge.functions.exprs import clean_sequence, clean_taxon, count_of, first_value, genus_of_label, hash_fraction, n_fraction, tree_label
from rankforge.operators.ordering import running_sums
from rankforge.runtime import keep


def cleaned_records(df: DataFrame) -> DataFrame:
    """Records with canonical taxa and sequence: processid, nucleotides, the four ranks, source, seq_len, n_frac, loaded_at.

    A blank genus is the first word of the species. Nulls stay null.
    """
    seq = clean_sequence("nucleotides")
    species = F.regexp_replace(clean_taxon("species_name"), r"\s+", " ")
    return df.select(
        "processid",
        seq.alias("nucleotides"),
        species.alias("species_name"),
        first_value("genus_name", F.substring_index(species, " ", 1)).alias("genus_name"),
        clean_taxon("family_name").alias("family_name"),
        clean_taxon("order_name").alias("order_name"),
        clean_taxon("source").alias("source"),
        F.length(seq).alias("seq_len"),
        n_fraction(seq).alias("n_frac"),
        "loaded_at",
    )


def qc_steps(clean: DataFrame, least: int = 500, most: int = 700, max_n: float = 0.05) -> list[tuple[str, Column]]:
    """The quality filters in their order."""
    return [
        ("has_sequence", F.coalesce(F.col("seq_len") > 0, F.lit(False))),
        ("long_enough", F.col("seq_len") >= least),
        ("short_enough", F.col("seq_len") <= most),
        ("few_unknown", F.col("n_frac") <= max_n),
        ("binomial", F.coalesce(F.col("species_name").rlike(r"^\S+ \S+"), F.lit(False))),
    ]


def qc_counts(clean: DataFrame, **limits) -> DataFrame:
    """(step, n_left) after each filter, in one pass over the records; step 0 is all rows."""
    passed, aggs = F.lit(True), [F.count(F.lit(1)).alias("0_all")]
    for i, (name, ok) in enumerate(qc_steps(clean, **limits), 1):
        passed = passed & ok
        aggs.append(F.count(F.when(passed, 1)).alias(f"{i}_{name}"))
    row = clean.agg(*aggs)
    return row.unpivot([], row.columns, "step", "n_left")


def qc_passed(clean: DataFrame, **limits) -> DataFrame:
    ok = F.lit(True)
    for _, c in qc_steps(clean, **limits):
        ok = ok & c
    return clean.where(ok)


def conflict_audit(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """One row: rows in groups of equal key, such groups, and groups with more than one value of each field.

    A null key is a group. Counted distinct values are not null.
    """
    # the key may be a whole sequence: its digest is as good and short
    several = [(F.min(f) != F.max(f)).alias(f) for f in fields]
    g = df.groupBy(F.md5(F.col(key).cast("string")).alias("__k")).agg(F.count(F.lit(1)).alias("n"), *several)
    return g.agg(
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("rows_in_duplicate_groups"),
        F.count(F.when(F.col("n") > 1, 1)).alias("duplicate_groups"),
        *[F.count(F.when(F.col(f), 1)).alias(f"groups_with_several_{f}") for f in fields],
    )


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key, the first in the order given, which must be total for a defined result."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def drop_conflicting(df: DataFrame, key: str, field: str) -> DataFrame:
    """Rows whose key goes with one value of the field at most; rows with a null key stay."""
    g = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(field).alias("lo"), F.max(field).alias("hi"))
    return df.join(g.where("lo <> hi").select(key), key, "left_anti")


def majority_parent(df: DataFrame, child: str, parent: str) -> DataFrame:
    """Rows whose parent is their child value's most frequent one, ties to the smallest; rows with a null in either stay out of the vote and are kept."""
    votes = df.where(F.col(child).isNotNull() & F.col(parent).isNotNull()).groupBy(child, parent).agg(F.count(F.lit(1)).alias("n"))
    best = keep_first(votes, [child], [F.desc("n"), F.asc(parent)]).select(child, F.col(parent).alias("__best"))
    joined = df.join(best, child, "left")
    return joined.where(F.col("__best").isNull() | F.col(parent).isNull() | (F.col(parent) == F.col("__best"))).drop("__best")


def repaired_hierarchy(df: DataFrame, levels: Sequence[str] = ("species_name", "genus_name", "family_name", "order_name")) -> DataFrame:
    """Majority parents at each level, from the deepest up."""
    for child, parent in zip(levels, levels[1:]):
        df = majority_parent(df, child, parent)
    return df


def split_overlaps(splits: dict[str, DataFrame], key: str) -> DataFrame:
    """(split_a, split_b, n_common) for each pair of splits with common keys; one shuffle on the key."""
    tagged = None
    for name, df in splits.items():
        x = df.select(F.lit(name).alias("split"), F.col(key).alias("k")).where("k is not null")
        tagged = x if tagged is None else tagged.unionByName(x)
    sets = tagged.groupBy("k").agg(F.array_sort(F.collect_set("split")).alias("s")).where(F.size("s") > 1)
    pairs = sets.select(F.explode("s").alias("split_a"), "s").select("split_a", F.explode("s").alias("split_b")).where("split_a < split_b")
    return pairs.groupBy("split_a", "split_b").agg(F.count(F.lit(1)).alias("n_common"))


def require_disjoint(overlaps: DataFrame, allowed: Sequence[tuple[str, str]] = ()) -> None:
    """Fail the build where two splits share keys, but for the pairs allowed."""
    ok = {tuple(sorted(p)) for p in allowed}
    bad = [tuple(r) for r in overlaps.collect() if (r["split_a"], r["split_b"]) not in ok]
    if bad:
        raise ValueError(f"splits share keys: {bad}")


def unseen_groups(df: DataFrame, group: str, member: str, least: int, most: int, n_groups: int, salt: str) -> DataFrame:
    """Groups held out: those with least to most distinct members, the first n by hash."""
    g = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.countDistinct(member).alias("n_members"))
    return g.where(F.col("n_members").between(least, most)).orderBy(hash_fraction(group, salt), group).limit(n_groups)


def without_largest(df: DataFrame, group: str, n: int) -> DataFrame:
    """The rows whose group is not one of the n with most rows, ties to the smaller group; rows without a group are left out."""
    some = df.where(F.col(group).isNotNull())
    most = some.groupBy(group).agg(F.count(F.lit(1)).alias("__n")).orderBy(F.desc("__n"), F.asc(group)).limit(n)
    return some.join(most, group, "left_anti")


def unseen_groups_by_share(df: DataFrame, group: str, member: str, least: int, most: int, n_largest: int, share: float, salt: str, at_least: int = 20) -> DataFrame:
    """As unseen_groups, without the n_largest groups; max(at_least, share of the candidates) are held out."""
    rest = keep(without_largest(df, group, n_largest).select(group, member))
    n = rest.groupBy(group).agg(F.countDistinct(member).alias("m")).where(F.col("m").between(least, most)).count()
    return unseen_groups(rest, group, member, least, most, max(at_least, int(n * share)), salt)


def held_out_members(df: DataFrame, group: str, member: str, per_group: int, salt: str) -> DataFrame:
    """(group, member) held out: by hash, up to per_group of each group, while one member at least stays."""
    pairs = df.where(F.col(group).isNotNull() & F.col(member).isNotNull()).select(group, member).distinct()
    w = Window.partitionBy(group).orderBy(hash_fraction(member, salt), member)
    c = pairs.withColumn("r", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(group)))
    return c.where(F.col("r") <= F.least(F.lit(per_group), F.col("n") - 1)).select(group, member)


def stratified_split(df: DataFrame, key: str, stratum: str, shares: dict[str, float], salt: str) -> DataFrame:
    """(key, stratum, split): within each stratum, keys in hash order are cut at the shares' running sums."""
    one = df.where(F.col(key).isNotNull() & F.col(stratum).isNotNull()).groupBy(key).agg(F.min(stratum).alias(stratum))
    r = running_sums(one.select(key, stratum, F.struct(hash_fraction(key, salt).alias("h"), F.col(key).alias("k")).alias("__o"), F.lit(1).alias("n")), [stratum], "__o", ["n"])
    size = one.groupBy(F.col(stratum).alias("__s")).agg(F.count(F.lit(1)).alias("__n"))
    one = r.join(size, F.col(stratum) == F.col("__s")).withColumn("__p", (F.col("run_n") - 1) / F.col("__n"))
    out, at = F.lit(list(shares)[-1]), 0.0
    cuts = []
    for name, share in list(shares.items())[:-1]:
        at = round(at + share, 9)
        cuts.append((name, at))
    for name, c in reversed(cuts):
        out = F.when(F.col("__p") < c, name).otherwise(out)
    return one.select(key, stratum, out.alias("split"))


def complete_groups(df: DataFrame, group: str, n: int, salt: str) -> DataFrame:
    """All rows of n groups, chosen by hash; the rows are reduced by a semi join before anything wide is read."""
    chosen = df.where(F.col(group).isNotNull()).select(group).distinct().orderBy(hash_fraction(group, salt), group).limit(n)
    return df.join(chosen, group, "left_semi")


def hidden_reference(candidates: DataFrame, queries: DataFrame, rank: str) -> DataFrame:
    """Candidates whose value at the rank occurs in no query."""
    seen = queries.select(F.col(rank)).where(F.col(rank).isNotNull()).distinct()
    return candidates.join(seen, rank, "left_anti")


def exact_cluster_support(df: DataFrame, key: str, ranks: Sequence[str]) -> DataFrame:
    """(key, n_rows, supported_rank) of groups of equal sequence: the deepest rank with exactly one value that is not null."""
    # exactly one value: the least is the greatest
    g = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), *[(F.min(r) == F.max(r)).alias(r) for r in ranks])
    out = F.lit("unresolved")
    for r in reversed(list(ranks)):
        out = F.when(F.col(r), r.removesuffix("_name")).otherwise(out)
    return g.select(key, "n_rows", out.alias("supported_rank"))


def species_resolvability(df: DataFrame, key: str, ranks: Sequence[str]) -> DataFrame:
    """(species_name, n_clusters, best_rank, worst_rank, all_species) over the clusters that a species occurs in."""
    clusters = exact_cluster_support(df, key, ranks)
    names = [r.removesuffix("_name") for r in ranks] + ["unresolved"]
    level = F.coalesce(*[F.when(F.col("supported_rank") == n, i) for i, n in enumerate(names)])
    pairs = df.where(F.col("species_name").isNotNull() & F.col(key).isNotNull()).select("species_name", key).distinct()
    g = pairs.join(clusters, key).groupBy("species_name").agg(F.count(F.lit(1)).alias("n_clusters"), F.min(level).alias("lo"), F.max(level).alias("hi"))
    back = lambda c: F.element_at(F.array(*[F.lit(n) for n in names]), F.col(c) + 1)
    return g.select("species_name", "n_clusters", back("lo").alias("best_rank"), back("hi").alias("worst_rank"), (F.col("hi") == 0).alias("all_species"))


def reference_pick(df: DataFrame, group: str, seq: str, key: str) -> DataFrame:
    """(group, key, seq_len) of each group's best reference: most plain bases less unknown ones, then the longest, then the smallest key."""
    score = count_of(seq, "ACGT") - count_of(seq, "N")
    x = df.where(F.col(group).isNotNull() & F.col(seq).isNotNull()).select(group, key, score.alias("s"), F.length(seq).alias("seq_len"))
    return keep_first(x, [group], [F.desc("s"), F.desc("seq_len"), F.asc(key)]).select(group, key, "seq_len")


def label_form(df: DataFrame, species: str) -> DataFrame:
    return df.select(species, tree_label(species).alias("label"), genus_of_label(tree_label(species)).alias("label_genus"))


def filled_taxonomy(main: DataFrame, sources: Sequence[DataFrame], key: str, field: str) -> DataFrame:
    """Own value where it is not blank, else the first source's, in their order, that has one."""
    out = main.select(key, clean_taxon(field).alias(field))
    for i, s in enumerate(sources):
        one = s.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(clean_taxon(field)).alias(f"__{i}"))
        out = out.join(one, key, "left")
    return out.select(key, F.coalesce(field, *[f"__{i}" for i in range(len(sources))]).alias(field))
