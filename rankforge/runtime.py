"""Session helpers: table access, shared checkpoints, partition sizing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a lookup may be broadcast; larger ones take the shuffled way.
BROADCAST_BOUND = 16 * 1024 * 1024


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The parquet table `name` below `base`."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; in a local session without the setting a temporary one, removed when the driver ends."""
    sc = spark.sparkContext
    own = sc._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get()
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="rankforge-checkpoints-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    sc.setCheckpointDir(shared)
    return shared


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def keep(df: DataFrame) -> DataFrame:
    """Cache what is read more than once; a lost executor's share is computed again."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def bounded(df: DataFrame, wide: str) -> Callable[[DataFrame], DataFrame]:
    """What broadcasts a side drawn from `df` where its rows, with the lengths of column `wide`, are within BROADCAST_BOUND; else leaves it to a
    shuffled join. `df` must be cheap to read again."""
    n, size = df.agg(F.count(F.lit(1)), F.sum(F.length(wide))).first()
    return F.broadcast if (size or 0) + 64 * n <= BROADCAST_BOUND else lambda x: x


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, *keys: str, ordered: bool = False) -> DataFrame:
    """The rows over at least as many tasks as there are cores, for work that costs far more than moving them.

    Only an input of few partitions, so a small one, is shuffled; a large one stays as it is read. Work whose result depends on the order of
    rows asks for `ordered`: shuffled rows are sorted then, so that a task that runs again sees the same.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= n:
        return df
    moved = df.repartition(n, *keys)
    return moved.sortWithinPartitions(*df.columns) if ordered else moved


_BUILT: dict[str, Any] = {}


def built_once(token: str, make: Callable[[], Any]) -> Any:
    """What `make` gives, built once a worker process for a token, not once a task; only the last token's is held."""
    if token not in _BUILT:
        _BUILT.clear()
        _BUILT[token] = make()
    return _BUILT[token]


def forget_built() -> None:
    """Lets go what built_once holds in this worker process."""
    _BUILT.clear()
