"""Rooted trees as tables: ancestor closure, path distances, neighbourhoods, support, sampling, placements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankforge.functions.exprs import hash_fraction


def taxonomy_closure(df: DataFrame, levels: Sequence[str], lengths: Sequence[float]) -> DataFrame:
    """(tip, ancestor, hops, depth) of a tree whose levels, from the root down, are columns; the last level holds the tips.

    Nodes are named level=value and unique along the lineage; depth is the branch length from the root. Rows with a null level go.
    """
    ok = df.select(*levels).where(" and ".join(f"{c} is not null" for c in levels)).distinct()
    nodes, depth, path = [F.struct(F.lit("root").alias("ancestor"), F.lit(len(levels)).alias("hops"), F.lit(0.0).alias("depth"))], 0.0, []
    for i, (c, ln) in enumerate(zip(levels, lengths)):
        depth += ln
        path.append(c)
        nodes.append(F.struct(F.concat_ws("|", *path).alias("ancestor"), F.lit(len(levels) - 1 - i).alias("hops"), F.lit(depth).alias("depth")))
    return ok.select(F.col(levels[-1]).alias("tip"), F.explode(F.array(*nodes)).alias("n")).select("tip", "n.*")


def closure_from_nodes(nodes: DataFrame) -> DataFrame:
    """(tip, ancestor, hops, depth) from a node table (node, parent, name, length) by joining up one level at a time.

    As many joins as the tree is deep; the frontier shrinks as paths end at the root.
    """
    up = nodes.select(F.col("node").alias("n"), "parent", F.coalesce("length", F.lit(0.0)).alias("len"))
    kids = nodes.select(F.col("parent").alias("node")).distinct()
    tips = nodes.join(kids, "node", "left_anti").select(F.col("name").alias("tip"), F.col("node").alias("ancestor"))
    paths, front, hops = None, tips.withColumn("below", F.lit(0.0)), 0
    while True:
        step = front.withColumn("hops", F.lit(hops))
        paths = step if paths is None else paths.unionByName(step)
        front = front.join(up, F.col("ancestor") == F.col("n")).where("parent is not null").select("tip", F.col("parent").alias("ancestor"), (F.col("below") + F.col("len")).alias("below"))
        hops += 1
        if front.isEmpty():
            break
    top = paths.groupBy("tip").agg(F.max("below").alias("total"))
    return paths.join(top, "tip").select("tip", "ancestor", "hops", (F.col("total") - F.col("below")).alias("depth"))


def tip_depths(closure: DataFrame) -> DataFrame:
    return closure.where("hops = 0").select("tip", F.col("depth").alias("tip_depth"))


def path_distance(pairs: DataFrame, closure: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Pairs with `distance`, the path between two tips by their deepest common ancestor; 0 for equal tips, null for unknown ones."""
    d = tip_depths(closure)
    u = pairs.select(a, b).distinct()
    ca = closure.select(F.col("tip").alias(a), "ancestor", "depth")
    cb = closure.select(F.col("tip").alias(b), "ancestor")
    m = u.join(ca, a).join(cb, [b, "ancestor"]).groupBy(a, b).agg(F.max("depth").alias("m"))
    x = m.join(d.withColumnRenamed("tip", a).withColumnRenamed("tip_depth", "da"), a).join(d.withColumnRenamed("tip", b).withColumnRenamed("tip_depth", "db"), b)
    dist = x.select(a, b, (F.col("da") + F.col("db") - 2 * F.col("m")).alias("distance"))
    return pairs.join(dist, [a, b], "left")


def nearest_reference(tips: DataFrame, tip: str, closure: DataFrame, references: DataFrame, ref: str) -> DataFrame:
    """(tip, nearest, distance): the closest reference tip, ties to the smaller name, by the lowest ancestor that has one below it.

    References are first reduced to the best per ancestor, so a tip meets each of its ancestors once, not every reference.
    """
    d = tip_depths(closure)
    r = references.select(F.col(ref).alias("tip")).distinct().join(closure, "tip").join(d, "tip").groupBy("ancestor").agg(F.min(F.struct((F.col("tip_depth") - F.col("depth")).alias("below"), F.col("tip").alias("nearest"))).alias("b"))
    t = tips.select(F.col(tip).alias("tip")).distinct().join(closure, "tip").join(d, "tip").join(r, "ancestor")
    best = t.groupBy("tip").agg(F.min(F.struct((F.col("tip_depth") - F.col("depth") + F.col("b.below")).alias("distance"), F.col("b.nearest").alias("nearest"))).alias("x"))
    return best.select(F.col("tip").alias(tip), "x.nearest", "x.distance")


def neighbourhood(top: DataFrame, keys: Sequence[str], label: str, closure: DataFrame) -> DataFrame:
    """(keys, n_pairs, min, mean and max distance among the candidates of a key, mean to place 1). Candidates are few by construction (top k)."""
    x = top.select(*keys, F.col(label).alias("a"), F.col("place").alias("pa"))
    y = top.select(*keys, F.col(label).alias("b"), F.col("place").alias("pb"))
    pairs = x.join(y, list(keys)).where("pa < pb")
    d = path_distance(pairs.select("a", "b").distinct(), closure)
    j = pairs.join(d, ["a", "b"])
    return j.groupBy(*keys).agg(F.count("distance").alias("n_pairs"), F.min("distance").alias("min_distance"), F.avg("distance").alias("mean_distance"), F.max("distance").alias("max_distance"), F.avg(F.when(F.col("pa") == 1, F.col("distance"))).alias("mean_to_top"))


def sister_support(tips: DataFrame, tip: str, closure: DataFrame, represented: DataFrame, ref: str) -> DataFrame:
    """(tip, hops, ancestor, n_support): the lowest ancestor with represented tips other than the tip, and how many it has."""
    reps = represented.select(F.col(ref).alias("tip")).distinct().join(closure, "tip").select("tip", "ancestor")
    n = reps.groupBy("ancestor").agg(F.count(F.lit(1)).alias("n"))
    own = reps.select(F.col("tip").alias("t2"), F.col("ancestor").alias("a2"))
    x = tips.select(F.col(tip).alias("tip")).distinct().join(closure.where("hops > 0"), "tip").join(n, "ancestor")
    x = x.join(own, (F.col("tip") == F.col("t2")) & (F.col("ancestor") == F.col("a2")), "left").withColumn("m", F.col("n") - F.when(F.col("t2").isNotNull(), 1).otherwise(0)).where("m > 0")
    best = x.groupBy("tip").agg(F.min(F.struct("hops", "ancestor", "m")).alias("x"))
    return best.select(F.col("tip").alias(tip), F.col("x.hops").cast("long").alias("hops"), "x.ancestor", F.col("x.m").alias("n_support"))


def stratified_quota(df: DataFrame, key: str, stratum: str, share: float, salt: str) -> DataFrame:
    """(key, stratum) of a sample of `share` of all keys: strata get the whole part of their quota, then by largest remainder; keys by hash."""
    one = df.where(F.col(key).isNotNull() & F.col(stratum).isNotNull()).groupBy(key).agg(F.min(stratum).alias(stratum))
    g = one.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    total = g.agg(F.sum("n")).first()[0] or 0
    q = g.withColumn("want", F.col("n") * share).withColumn("base", F.floor(F.col("n") * share))
    left = int(round(total * share)) - (q.agg(F.sum("base")).first()[0] or 0)
    more = q.orderBy(F.desc(F.col("want") - F.col("base")), stratum).limit(max(0, left)).select(stratum, F.lit(1).alias("more"))
    quota = q.join(more, stratum, "left").select(stratum, (F.col("base") + F.coalesce("more", F.lit(0))).alias("quota"))
    w = Window.partitionBy(stratum).orderBy(hash_fraction(key, salt), key)
    return one.join(quota, stratum).withColumn("r", F.row_number().over(w)).where("r <= quota").select(key, stratum)


def best_placement(placements: DataFrame, query: str, edge: str, weight: str) -> DataFrame:
    """Each query's edge of the greatest likelihood weight, ties to the smaller edge, with the sum of all its weights."""
    g = placements.groupBy(query).agg(F.max(F.struct(F.col(weight).alias("w"), (-F.col(edge)).alias("e"))).alias("x"), F.sum(weight).alias("total"))
    return g.select(query, (-F.col("x.e")).alias(edge), F.col("x.w").alias(weight), "total")
