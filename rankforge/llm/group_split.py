"""Splits that keep related records together (p6)."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.llm.components import connected
from rankforge.llm.name_mapping import latest_records, map_texts
from rankforge.operators.ordering import global_places
from rankforge.runtime import keep

FIELDS = ["species_name", "tree_label", "genus_name"]
READINGS = ("genus", "genus_if_met")


def record_genera(records: DataFrame, listed: DataFrame) -> DataFrame:
    """(processid, genus): each genus that a record names, once.

    Each distinct text is read once. Two words that may be an unlisted genus with its epithet, or just two words, count where
    another text surely names the genus.
    """
    rec = latest_records(records, "processid", ["processid", *FIELDS])
    # a letter before the text tells a genus field's from others, which are read otherwise
    texts = [F.when(F.col(f).isNotNull(), F.concat(F.lit("g" if f == "genus_name" else "s"), F.col(f))) for f in FIELDS]
    long = rec.select("processid", F.explode(F.array(*texts)).alias("text")).where(F.col("text").isNotNull())
    read = keep(map_texts(long.select("text"), listed, READINGS).where(F.coalesce(*READINGS).isNotNull()))
    named = keep(long.join(read, "text").select("processid", "genus", F.col("genus_if_met").alias("perhaps")))
    sure = named.select("processid", "genus").where("genus is not null").distinct()
    met = named.select("processid", F.col("perhaps").alias("genus")).where("genus is not null").distinct().join(sure.select("genus").distinct(), "genus", "left_semi")
    return sure.unionByName(met).distinct()


def related_groups(records: DataFrame, listed: DataFrame) -> DataFrame:
    """(group_label, processid): records that name a common genus, directly or through others, share the label.

    The label is the smallest genus of the group. Records that name no genus have no row; an empty input gives none.
    """
    named = keep(record_genera(records, listed))
    sets = named.groupBy("processid").agg(F.collect_set("genus").alias("g")).select("processid", F.array_sort("g").alias("g"))
    links = sets.select(F.explode("g").alias("b"), F.element_at("g", 1).alias("a")).distinct()
    roots = connected(links)
    first = sets.select("processid", F.element_at("g", 1).alias("node"))
    return first.join(roots, "node").select(F.col("root").alias("group_label"), "processid")


def placed_largest_first(sizes: Iterable[tuple[int, int]], want: dict[str, float]) -> dict[tuple[int, str], int]:
    """(size, split) -> how many groups of that size go to the split, by the largest first to the split furthest below its target.

    `sizes` are (size, number of groups), the largest size first. Of equal deficits the first split by name takes the group. The n
    groups of one size take the n smallest values of the splits' excess, excess + size, excess + 2 size and so on; a level found by
    bisection counts nearly all of them at once, and the few left are dealt one by one.
    """
    have, out = dict.fromkeys(want, 0), {}

    def give(size: int, s: str, n: int) -> None:
        have[s] += n * size
        out[size, s] = out.get((size, s), 0) + n

    for size, count in sizes:
        if count > 4 * len(want):
            over = {s: have[s] - want[s] for s in want}
            below = lambda level: {s: max(0, math.ceil((level - v) / size)) for s, v in over.items()}  # noqa: E731, B023
            low, high = min(over.values()), min(over.values()) + (count + 1) * size
            for _ in range(80):
                mid = (low + high) / 2
                low, high = (mid, high) if sum(below(mid).values()) <= count - len(want) else (low, mid)
            for s, n in below(low).items():
                give(size, s, n)
                count -= n
        heap = [(have[s] - want[s], s) for s in sorted(want)]
        heapq.heapify(heap)
        for _ in range(count):
            lack, s = heap[0]
            give(size, s, 1)
            heapq.heapreplace(heap, (lack + size, s))
    return {k: n for k, n in out.items() if n}


def assign_splits(groups: DataFrame, targets: DataFrame) -> DataFrame:
    """(group_label, n_records, split) so that the shares of `targets` (split, target_share) are met.

    Groups go, the largest first, to the split furthest below its target. Groups of one size are alike to that rule: only the number of groups
    of each size comes to the driver (of n records no more than the square root of 2 n sizes), and in each size the groups, by
    label, fill the numbers of the splits, by name. No target, or none above 0, leaves split null.
    """
    spark = groups.sparkSession
    sizes = keep(groups.groupBy("group_label").agg(F.count(F.lit(1)).alias("n_records")))
    by_size = [(r["n_records"], r["c"]) for r in sizes.groupBy("n_records").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("n_records")).toLocalIterator()]
    total = sum(n * c for n, c in by_size)
    want = {r["split"]: r["target_share"] * total for r in targets.where("target_share > 0").orderBy("split").collect()}
    if not want:
        return sizes.select("group_label", "n_records", F.lit(None).cast("string").alias("split"))
    number = placed_largest_first(by_size, want)
    ranges, at = [], 1
    for size, _ in by_size:
        for s in sorted(want):
            if n := number.get((size, s), 0):
                ranges.append((size, at, at + n - 1, s))
                at += n
    parts = F.broadcast(spark.createDataFrame(ranges, "n_records long, __from long, __to long, split string"))
    placed = global_places(sizes, [F.desc("n_records"), F.asc("group_label")], "__place")
    return placed.join(parts, "n_records").where("__place between __from and __to").select("group_label", "n_records", "split")


def split_report(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """(split, target_share, n_groups, n_records, actual_share) of every split, also of one that got nothing."""
    per = assigned.groupBy("split").agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n_records").alias("n_records"))
    total = per.agg(F.sum("n_records")).first()[0] or 0
    out = targets.join(per, "split", "left").fillna(0, ["n_groups", "n_records"])
    return out.select("split", "target_share", "n_groups", "n_records", (F.col("n_records") / F.lit(float(max(total, 1)))).alias("actual_share"))
