"""Sharding along a Hilbert curve through quantised metadata."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtally.operators.ordering import sequence_within

from .common import store


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the curve of each column of ``points`` (dimensions x points, values below 2**bits).

    Axes are turned into the transposed index by undoing the curve's exchanges and
    inversions from the highest bit down, then Gray-coded; the bits are interleaved last.
    """
    x = points.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, 0) ^ swap
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            index = index << 1 | (x[i] >> b) & 1
    return index


def comparable(column: Column, kind: T.DataType) -> Column:
    """Numbers and times as doubles, all else as whole strings."""
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return column.cast("double")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return column.cast("timestamp").cast("double")
    return column.cast("string")


def string_cuts(rows: DataFrame, name: str, parts: int) -> np.ndarray:
    """Values of a string column that begin a new cell: all of them where they are few, else at exact quantiles.

    Values are counted first, so a frequent one is one row; their order and running counts
    come from a sort over many tasks.  At most ``parts`` values come to the driver.
    """
    counts = store(rows.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("v")).agg(F.count("*").alias("n")), "shard-values")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    if distinct >= parts:
        running = sequence_within(counts.withColumn("all", F.lit(0)), ["all"], [F.col("v")], running={"end": "n"})
        cell = lambda at: F.floor(at * parts / total)
        counts = running.where(cell(F.col("end") - F.col("n")) < cell(F.col("end"))).where(F.col("end") > F.col("n"))
    return np.array(sorted(r.v for r in counts.select("v").collect()), object)


def hilbert_shards(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
                   dimensions: Sequence[str] = ("lang", "source", "n_chars"), bits: int = 8,
                   shards: int = 8) -> DataFrame:
    """For each row: ``size``, ``text_crc32``, ``hilbert``, ``shard`` and ``slot``.

    Every dimension is cut into up to 2**bits cells, numbers and times at approximate quantiles and
    strings at exact ones of their whole order (see string_cuts), the cells are put in the curve's order, and the order, ties by checksum and id, is cut into ``shards`` runs
    whose row counts differ by one at most; ``slot`` counts from 0 in each run.

    Texts are read once for size and checksum; only those and the dimensions are stored and
    sorted by range, so neither a hot value nor a group of copies meets in one task.  Null
    values of a dimension come first; a null text has size 1 and checksum 0; rows with null
    or repeated ids each get a slot; columns not named are not read.  The plan behind the
    result is cut by a stored table, which fixes ties.
    """
    kinds = {f.name: f.dataType for f in docs.schema}
    raw = F.coalesce(docs[text].cast("string").cast("binary"), F.lit("").cast("binary"))
    meta = store(docs.select(
        docs[doc_id].alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        *(comparable(docs[d], kinds[d]).alias(f"d{i}") for i, d in enumerate(dimensions))), "shard-meta")
    steps = [k / (1 << bits) for k in range(1, 1 << bits)]
    names = [f"d{i}" for i in range(len(dimensions))]
    texts = [n for n in names if isinstance(meta.schema[n].dataType, T.StringType)]
    cuts = meta.agg(F.count("*"), *(F.percentile_approx(n, steps, 10_000).alias(n) for n in names if n not in texts)).first()
    cells = [string_cuts(meta, n, (1 << bits) - 1) if n in texts else np.unique(np.array(cuts[n] or [], float)) for n in names]

    @F.pandas_udf("long")
    def curve(*values: pd.Series) -> pd.Series:
        points = [np.where(v.isna(), 0, np.searchsorted(c, v.fillna("" if c.dtype == object else 0).to_numpy(c.dtype), "right"))
                  for v, c in zip(values, cells, strict=True)]
        return pd.Series(hilbert_index(np.stack(points), bits))

    ordered = (meta.select("doc_id", "size", "text_crc32", curve(*names).alias("hilbert"))
               .repartitionByRange("hilbert", "text_crc32", "doc_id")
               .sortWithinPartitions("hilbert", "text_crc32", "doc_id")
               .select("*", F.spark_partition_id().alias("piece"),
                       F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place")))
    ordered = store(ordered, "shard-order")
    counts = sorted(tuple(r) for r in ordered.groupBy("piece").count().collect())  # one row a partition
    starts, total = [], 0
    for piece, n in counts:
        starts.append((piece, total))
        total += n
    offsets = docs.sparkSession.createDataFrame(starts, "piece int, start long")
    rank = F.col("start") + F.col("place")
    shard = F.expr(f"((start + place) * {shards}) div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return (ordered.join(F.broadcast(offsets), "piece")
            .select("doc_id", "size", "text_crc32", "hilbert", shard.cast("int").alias("shard"), rank.alias("rank"))
            .select("doc_id", "size", "text_crc32", "hilbert", "shard", (F.col("rank") - first).alias("slot")))


def write_shards(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text",
                 dimensions: Sequence[str] = ("lang", "source", "n_chars"), bits: int = 8, shards: int = 8) -> None:
    """Write ``docs`` as Parquet folders by shard, rows along the curve, so that files and row groups prune.

    Rows are met again by id, so null or repeated ids raise; ``shard`` must not be a column of ``docs``.
    An empty table gives a folder without shards.
    """
    placed = hilbert_shards(docs, doc_id=doc_id, text=text, dimensions=dimensions, bits=bits, shards=shards)
    own, slot = (next(n for n in map((base + "{}").format, range(len(docs.columns) + 1)) if n not in docs.columns)
                 for base in ("_doc", "_slot"))
    placed = placed.select(F.col("doc_id").alias(own), "shard", F.col("slot").alias(slot))
    rows, ids = placed.agg(F.count("*"), F.count_distinct(own)).first()
    if rows != ids:
        raise ValueError("ids must be unique and not null to write shards")
    (docs.join(placed, docs[doc_id] == placed[own]).drop(own)
     .repartitionByRange("shard", slot).sortWithinPartitions("shard", slot).drop(slot)
     .write.partitionBy("shard").parquet(path))
