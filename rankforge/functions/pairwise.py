"""Arrow functions on pairs of sequences for which Spark has no expression: ungapped offsets and infix edit identity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType


def ungapped(query: str | None, ref: str | None, least_fraction: float, least_bases: int) -> tuple | None:
    """(p_distance, overlap, offset) of the best ungapped placing: least distance, then longest overlap, then smallest offset."""
    if not query or not ref:
        return None
    q, r = np.frombuffer(query.upper().encode("ascii", "replace"), np.uint8), np.frombuffer(ref.upper().encode("ascii", "replace"), np.uint8)
    plain = np.isin(q, np.frombuffer(b"ACGT", np.uint8)), np.isin(r, np.frombuffer(b"ACGT", np.uint8))
    need, best = max(least_bases, int(np.ceil(least_fraction * min(len(q), len(r))))), None
    for off in range(need - len(q), len(r) - need + 1):
        a, b = max(0, -off), min(len(q), len(r) - off)
        if b - a < need:
            continue
        both = plain[0][a:b] & plain[1][a + off : b + off]
        n = int(both.sum())
        if n < least_bases:
            continue
        d = int((both & (q[a:b] != r[a + off : b + off])).sum()) / n
        key = (d, -(b - a), off)
        if best is None or key < best[0]:
            best = (key, (d, b - a, off))
    return None if best is None else best[1]


def infix_identity(a: str | None, b: str | None) -> float | None:
    """1 - edits / length of the shorter text, placed anywhere inside the longer; null for empty texts."""
    if not a or not b:
        return None
    if len(a) > len(b):
        a, b = b, a
    x, y = np.frombuffer(a.encode("utf-32-le"), np.uint32), np.frombuffer(b.encode("utf-32-le"), np.uint32)
    row, cols = np.zeros(len(y) + 1, np.int64), np.arange(len(y) + 1)
    for i, c in enumerate(x, 1):
        new = np.empty_like(row)
        new[0] = i
        np.minimum(row[:-1] + (y != c), row[1:] + 1, out=new[1:])
        row = np.minimum.accumulate(new - cols) + cols
    return 1.0 - float(row.min()) / len(x)


@F.pandas_udf(StructType([StructField("p_distance", DoubleType()), StructField("overlap", IntegerType()), StructField("offset", IntegerType())]))
def best_ungapped(q: pd.Series, r: pd.Series) -> pd.DataFrame:
    got = [ungapped(a, b, 0.8, 20) or (None, None, None) for a, b in zip(q, r)]
    return pd.DataFrame(got, columns=["p_distance", "overlap", "offset"]).astype({"p_distance": "float64", "overlap": "Int32", "offset": "Int32"})


@F.pandas_udf(DoubleType())
def edit_identity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([infix_identity(x, y) for x, y in zip(a, b)], dtype="float64")

