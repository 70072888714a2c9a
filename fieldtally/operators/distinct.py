"""Distinct counts: exact by default, and sketches that are stored a period and merged.

A HyperLogLog sketch of 2**k cells is off by about 1.04 / sqrt(2**k) of the count
(one standard deviation), whatever the rows, and the union of two sketches is the
sketch of both their rows.  Small counts are exact.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS_LOG2 = 12


def count_distinct(column: str, approximate: float | None = None) -> Column:
    """Distinct values of a column: exact, or within ``approximate`` (relative, one standard deviation) in one pass."""
    return F.countDistinct(column) if approximate is None else F.approx_count_distinct(column, approximate)


def standard_error(cells_log2: int = CELLS_LOG2) -> float:
    return 1.04 / math.sqrt(2 ** cells_log2)


def sketches(df: DataFrame, keys: Sequence[str], column: str, *, cells_log2: int = CELLS_LOG2) -> DataFrame:
    """One sketch a key of the values of ``column``; missing values are left out, as by a count."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(column, cells_log2).alias("sketch"))


def merged(stored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sketches of coarser keys, from those of finer ones; the rows behind them are not read."""
    return stored.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"))


def estimates(stored: DataFrame, out: str = "approximate_distinct") -> DataFrame:
    return stored.withColumn(out, F.hll_sketch_estimate("sketch")).drop("sketch")
