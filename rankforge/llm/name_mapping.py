"""Free-entered values to entries of a closed list (p3)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.llm.name_trie import GenusReader, Resolver
from rankforge.runtime import built_once, keep, shuffle_partitions

#: Entries of the list that one trie, and so one broadcast, may hold. A longer list is refused.
MAX_ENTRIES = 500_000
UNMATCHED = "unmatched"
_LIST = ["tree_label", "species_name", "genus_name", "genus_from_label"]


def list_entries(listed: DataFrame) -> list[tuple]:
    """The closed list, whose size is checked before it leaves the executors."""
    n = listed.count()
    if n > MAX_ENTRIES:
        raise ValueError(f"the list has {n} entries; a trie takes {MAX_ENTRIES}")
    return [tuple(r) for r in listed.select(*_LIST).distinct().collect()]


#: What map_texts can tell of a text: the entry it means; and of a text after a letter, g of a genus field and s of others, the genus it
#: names, surely or if it is met elsewhere.
READINGS = {
    "label": lambda r, t: r.of.species(t),
    "genus": lambda r, t: r.from_genus(t[1:]) if t[0] == "g" else r.from_name(t[1:]),
    "genus_if_met": lambda r, t: None if t[0] == "g" else r.from_name_if_met(t[1:]),
}


def map_texts(texts: DataFrame, listed: DataFrame, readings: tuple[str, ...] = ("label",)) -> DataFrame:
    """(text, *readings): each distinct text is resolved once, so that a value with a third of all rows costs as much as any other.

    A reading is null where the text tells nothing. Null texts give no row. The texts are spread by their hash over a fixed
    number of tasks: few and small they may be, but each costs a search.
    """
    spark = texts.sparkSession
    entries = spark.sparkContext.broadcast(list_entries(listed))
    token, n = uuid.uuid4().hex, max(shuffle_partitions(spark), spark.sparkContext.defaultParallelism)

    def resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = built_once(token, lambda: GenusReader(Resolver(entries.value)))
        for b in batches:
            yield pd.DataFrame({"text": b["text"], **{k: [READINGS[k](reader, t) for t in b["text"]] for k in readings}})

    one = texts.select(F.col(texts.columns[0]).alias("text")).where(F.col("text").isNotNull()).distinct()
    return one.repartition(n, F.xxhash64("text")).mapInPandas(resolve, "text string, " + ", ".join(f"{k} string" for k in readings))


def latest_records(rows: DataFrame, key: str, fields: list[str], loaded: str = "loaded_at") -> DataFrame:
    """One row per distinct non-null key: the one loaded last, of equals the greatest field values."""
    others = [f for f in fields if f != key]
    state = F.struct(F.col(loaded).alias("__at"), *[F.col(f) for f in others])
    one = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(state).alias("__s"))
    return one.select(key, *[F.col("__s")[f].alias(f) for f in others])


def map_names(records: DataFrame, listed: DataFrame) -> DataFrame:
    """(processid, candidate_label) of each record whose species_name is not, letter for letter, a listed one.

    Nulls, blanks, ties between entries and names of other things get `unmatched`. Records are distinct
    processids (see latest_records); null processids are no records.
    """
    rec = latest_records(records, "processid", ["processid", "species_name", "tree_label"])
    exact = listed.select(F.col("species_name")).where(F.col("species_name").isNotNull()).distinct()
    free = rec.join(exact, "species_name", "left_anti")
    texts = free.select(F.explode(F.array("species_name", "tree_label")).alias("text"))
    known = keep(map_texts(texts, listed).where(F.col("label").isNotNull()))
    out = free.join(known.select(F.col("text").alias("species_name"), F.col("label").alias("by_name")), "species_name", "left")
    out = out.join(known.select(F.col("text").alias("tree_label"), F.col("label").alias("by_label")), "tree_label", "left")
    return out.select("processid", F.coalesce("by_name", "by_label", F.lit(UNMATCHED)).alias("candidate_label"))


def unmatched_values(records: DataFrame, listed: DataFrame) -> DataFrame:
    """Values that mean no entry, with the number of records: (species_name, tree_label, n_records)."""
    rec = latest_records(records, "processid", ["processid", "species_name", "tree_label"])
    lost = map_names(records, listed).where(F.col("candidate_label") == UNMATCHED).select("processid")
    return rec.join(lost, "processid", "left_semi").groupBy("species_name", "tree_label").agg(F.count(F.lit(1)).alias("n_records"))
