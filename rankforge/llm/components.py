"""Connected groups by distributed union-find: local forests, merged round by round."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.runtime import cut, shuffle_partitions


class Forest:
    """Union-find over links met so far; a tree's root is its smallest node."""

    def __init__(self) -> None:
        self.parent: dict = {}

    def root(self, x):
        p = self.parent
        top = x
        while (up := p.setdefault(top, top)) != top:
            top = up
        while p[x] != top:
            p[x], x = top, p[x]
        return top

    def add(self, a, b) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def links(self) -> list[tuple]:
        """Links from each node to the root of its tree."""
        return [(x, r) for x in list(self.parent) if (r := self.root(x)) != x]


def _local(kind: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = Forest()
        for b in batches:
            for x, y in zip(b["a"].tolist(), b["b"].tolist()):
                f.add(x, y)
        kept = f.links()
        for at in range(0, len(kept), 1 << 16):
            out = pd.DataFrame(kept[at : at + (1 << 16)], columns=["a", "b"])
            yield out.astype({"a": np.int64, "b": np.int64}) if kind == "long" else out

    return run


def connected(links: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, root): the smallest node of each node's group, over links (a, b).

    Nodes are strings (ordered by code point) or longs. Null ends and self-links link nothing; a self-link's node is still a
    node. Isolated nodes come from `nodes` (its first column). No links give the nodes alone, each its own root.

    Each task grows the forest of its links. Trees with a common node are brought together by that node and merged in
    the next round, until every node has one parent; parents are then followed by doubling. A task never holds more than its share of
    the links, at any size.
    """
    long = dict(links.dtypes)["a"] in ("bigint", "int")
    type_ = "long" if long else "string"
    e = links.select(F.col("a").cast(type_).alias("a"), F.col("b").cast(type_).alias("b")).where("a is not null and b is not null")
    named = e.select(F.explode(F.array("a", "b")).alias("node"))
    if nodes is not None:
        named = named.unionByName(nodes.select(F.col(nodes.columns[0]).cast(type_).alias("node")).where("node is not null"))
    schema, parts = f"a {type_}, b {type_}", shuffle_partitions(links.sparkSession)
    local = _local(type_)
    trees = e.where("a <> b").mapInPandas(local, schema)
    while True:
        trees = cut(trees.repartition(parts, "a").mapInPandas(local, schema).distinct())
        if trees.groupBy("a").count().where("count > 1").isEmpty():
            break
    while True:
        up = trees.select(F.col("a").alias("b"), F.col("b").alias("__up"))
        step = cut(trees.join(up, "b", "left").select("a", F.coalesce("__up", "b").alias("b"), F.col("__up").isNotNull().alias("moved")))
        trees = step.select("a", "b")
        if step.where("moved").isEmpty():
            break
    lead = trees.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return named.distinct().join(lead, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
