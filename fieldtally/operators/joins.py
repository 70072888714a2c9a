"""Joins of facts on keys that a few values dominate.

A side is broadcast only behind a count of its rows.  Beyond that the large side's
heavy keys are measured: a key with more than one part in ``share`` of the rows is
heavy, so fewer than ``share`` exist.  Their rows are dealt over pieces by a hash of
the row, and the other side's rows of those keys are repeated once a piece; all other
rows meet as in a plain join.  No task depends on adaptive splitting.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A dimension of at most so many rows may be broadcast.
BROADCAST_ROWS = 100_000
#: A key with more than one part in so many of all rows is spread.
HEAVY_SHARE = 200
_PIECE, _PIECES = "_piece", "_pieces"
_ONE_SIDED = ("inner", "left", "left_semi", "left_anti")


def has_few_rows(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether a table has at most ``limit`` rows; it is not read further than that."""
    return df.select(F.lit(1)).limit(limit + 1).count() <= limit


def heavy_keys(df: DataFrame, keys: Sequence[str], share: int = HEAVY_SHARE) -> DataFrame:
    """Keys with more than rows / ``share`` rows and the pieces each needs; a local table of fewer than ``share`` rows.

    Rows are counted by key, combined before the shuffle.  A missing key counts as a key.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    found = counts.where(F.col("_n") * share > total).select(
        *keys, F.ceil(F.col("_n") * share / total).cast("int").alias(_PIECES))
    return df.sparkSession.createDataFrame(found.collect(), found.schema)


def spread_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", *,
                share: int = HEAVY_SHARE, heavy: DataFrame | None = None) -> DataFrame:
    """``left.join(right, keys, how)`` with the rows of the left side's heavy keys dealt over many tasks.

    ``heavy`` is a result of ``heavy_keys`` to use again; without one the left side's keys are
    counted now.  Only joins that keep no unmatched right row can repeat the right side.
    """
    if how not in _ONE_SIDED:
        raise ValueError(f"a {how} join cannot repeat its right side")
    keys = list(keys)
    heavy = heavy_keys(left, keys, share) if heavy is None else heavy
    if heavy.isEmpty():
        return left.join(right, keys, how)
    # A row's piece depends on the row alone, so a task that runs again deals it alike.
    dealt = [c for c in left.columns if not _has_map(left.schema[c].dataType)]
    piece = F.coalesce(F.pmod(F.xxhash64(*dealt), F.col(_PIECES)).cast("int"), F.lit(0))
    spread = _tagged(left, heavy, keys).withColumn(_PIECE, piece).drop(_PIECES)
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(_PIECES), F.lit(1)) - 1))
    repeated = _tagged(right, heavy, keys).withColumn(_PIECE, copies).drop(_PIECES)
    return spread.join(repeated, [*keys, _PIECE], how).drop(_PIECE)


def _tagged(df: DataFrame, heavy: DataFrame, keys: list[str]) -> DataFrame:
    marks = heavy.select(*[F.col(k).alias(f"_heavy_{i}") for i, k in enumerate(keys)], _PIECES)
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & df[k].eqNullSafe(marks[f"_heavy_{i}"])
    joined = df.join(F.broadcast(marks), same, "left")  # fewer rows than the share
    return joined.drop(*[f"_heavy_{i}" for i in range(len(keys))])


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and _has_map(kind.elementType)


def dimension_join(fact: DataFrame, dimension: DataFrame, keys: Sequence[str], how: str = "inner", *,
                   limit: int = BROADCAST_ROWS, share: int = HEAVY_SHARE) -> DataFrame:
    """A fact with a dimension: broadcast if that has at most ``limit`` rows, else joined with heavy keys spread."""
    if has_few_rows(dimension, limit):
        return fact.join(F.broadcast(dimension), list(keys), how)
    return spread_join(fact, dimension, keys, how, share=share)
