"""What both vector searches need to read an embedding table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """True for a vector without null or non-finite components; an empty vector is usable."""
    number = vector.cast("array<double>")
    bad = F.exists(number, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def matrix(column: pd.Series, dtype) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(dtype, copy=False) if len(column) else np.zeros((0, 0), dtype=dtype)

