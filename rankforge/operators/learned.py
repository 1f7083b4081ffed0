"""Learned fusion of evidence, on MLlib."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.functions.exprs import finite, hash_fraction


def balanced(df: DataFrame, label: str, key: str, most: int, salt: str) -> DataFrame:
    """At most about `most` rows of each class, drawn by the hash of a key; the bound keeps a fit's time the same at any size."""
    n = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect() if r[label] is not None}
    share = F.coalesce(*[F.when(F.col(label) == k, F.lit(min(1.0, most / v))) for k, v in n.items()]) if n else F.lit(0.0)
    return df.where(F.col(label).isNotNull()).where(hash_fraction(key, salt) < share)


def _features(df: DataFrame, numeric: Sequence[str], categories: Sequence[str]):
    typed = df
    for c in numeric:
        typed = typed.withColumn(f"{c}__x", finite(c))
    for c in categories:
        typed = typed.withColumn(f"{c}__s", F.coalesce(F.col(c), F.lit("missing")))
    xs = [f"{c}__x" for c in numeric]
    stages = [
        Imputer(inputCols=xs, outputCols=[f"{x}i" for x in xs], strategy="median"),
        VectorAssembler(inputCols=[f"{x}i" for x in xs], outputCol="__n", handleInvalid="keep"),
        StandardScaler(inputCol="__n", outputCol="__z", withMean=True),
    ]
    parts = ["__z"]
    for c in categories:
        stages += [StringIndexer(inputCol=f"{c}__s", outputCol=f"{c}__k", handleInvalid="keep"), OneHotEncoder(inputCol=f"{c}__k", outputCol=f"{c}__h", handleInvalid="keep")]
        parts.append(f"{c}__h")
    stages.append(VectorAssembler(inputCols=parts, outputCol="features"))
    return typed, stages


def posterior(fit: DataFrame, apply: DataFrame, label: str, numeric: Sequence[str], categories: Sequence[str] = (), trees: bool = False) -> DataFrame:
    """`apply` with `probability` that the label holds, from a logistic model or boosted trees with classes of equal weight.

    Missing numbers are imputed by the median, unseen categories have a place of their own. Labels must not be among the features.
    """
    assert label not in numeric and label not in categories
    f, stages = _features(fit.where(F.col(label).isNotNull()), numeric, categories)
    f = f.withColumn("__y", F.col(label).cast("double"))
    share = f.agg(F.avg("__y")).first()[0] or 0.5
    f = f.withColumn("__w", F.when(F.col("__y") == 1, 0.5 / max(share, 1e-9)).otherwise(0.5 / max(1 - share, 1e-9)))
    model = GBTClassifier(labelCol="__y", weightCol="__w", maxIter=20, seed=3) if trees else LogisticRegression(labelCol="__y", weightCol="__w", maxIter=50, regParam=1e-4)
    fitted = Pipeline(stages=[*stages, model]).fit(f)
    a, _ = _features(apply, numeric, categories)
    return fitted.transform(a).withColumn("probability", vector_to_array("probability")[1]).select(*apply.columns, "probability")


def kmeans_clusters(df: DataFrame, key: str, vector: str, k: int, seed: int = 3) -> DataFrame:
    """(key, cluster) by k-means with the cosine distance."""
    x = df.where(F.col(vector).isNotNull()).select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    m = KMeans(k=k, seed=seed, distanceMeasure="cosine", maxIter=20).fit(x)
    return m.transform(x).select(key, F.col("prediction").alias("cluster"))
