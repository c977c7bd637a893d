"""Linear recurrences along array columns, in Arrow batches: all rows of a batch are solved together by doubling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


@F.pandas_udf(ArrayType(DoubleType()))
def backward(add: pd.Series, keep: pd.Series) -> pd.Series:
    """``y[t] = add[t] + keep[t] * y[t+1]`` of every row, 0 behind the end; a null element counts as 0, a null array stays null."""
    sizes = np.array([0 if a is None else len(a) for a in add], dtype=np.int64)
    if not sizes.sum():
        return pd.Series([None if a is None else np.zeros(0) for a in add])
    flat = lambda s: np.nan_to_num(np.concatenate([np.asarray(a, dtype=float) for a in s if a is not None and len(a)]))
    y, c, ends = flat(add), flat(keep), np.cumsum(sizes)
    c[ends[sizes > 0] - 1] = 0.0  # nothing comes from the next row
    step = 1
    while step < sizes.max():
        y[:-step] += c[:-step] * y[step:].copy()
        c[:-step] *= c[step:].copy()
        c[-step:] = 0.0
        step *= 2
    parts = np.split(y, ends[:-1])
    return pd.Series([None if a is None else p for a, p in zip(add, parts, strict=True)])
