"""Ranks, quantile buckets, exact quantiles and per-key sequences at scale.

A window with no partition key, or with one very large key, runs in a single
task.  The operators here spread that work:

* ``stamp_order`` range-partitions rows by a total order, so a value shared by
  a third of all rows is split over many tasks by its tie-break columns.
* Positions inside a partition come from the sort, positions of partitions
  from a table of one row per partition, which is all that is ever broadcast.

The stamped frame is checkpointed before use.  Range bounds come from a
sample, and the checkpoint makes both later reads see the same layout.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtally.session import cut_lineage

SLOT = "_slot"
SEGMENT = "_segment"
_SEGMENT_BITS = 33  # monotonically_increasing_id keeps the partition above bit 33


def stamp_order(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Rows sorted across the cluster with their place: ``_segment`` and ``_slot``.

    ``_slot`` increases with the order; ``_segment`` is the sorted partition.
    """
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn(SLOT, F.monotonically_increasing_id())
    )
    return cut_lineage(placed).withColumn(SEGMENT, F.shiftright(SLOT, _SEGMENT_BITS))


def _segment_starts(stamped: DataFrame, weight: Column) -> DataFrame:
    """Per segment: its total weight, the weight before it, and the grand total."""
    totals = stamped.groupBy(SEGMENT).agg(F.sum(weight).alias("_weight"))
    # One row per partition of the sort: a single-task window is right here.
    before = Window.partitionBy(F.lit(0)).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    return totals.select(
        SEGMENT,
        "_weight",
        F.coalesce(F.sum("_weight").over(before), F.lit(0)).alias("_before"),
        F.sum("_weight").over(everything).alias("_total"),
    )


def global_rank(df: DataFrame, order: Sequence[Column], *, rank: str = "rank", total: str = "total") -> DataFrame:
    """Row number over the whole table (1-based) and the number of rows.

    ``order`` has to be a total order: end it with a unique key.
    """
    stamped = stamp_order(df, order)
    starts = _segment_starts(stamped, F.lit(1))
    local = stamped[SLOT].bitwiseAND(F.lit((1 << _SEGMENT_BITS) - 1))
    return (
        stamped.withColumn("_local", local)
        .join(F.broadcast(starts), SEGMENT)  # one row per partition
        .withColumn(rank, F.col("_before") + F.col("_local") + F.lit(1))
        .withColumnRenamed("_total", total)
        .drop(SEGMENT, SLOT, "_local", "_before", "_weight")
    )


def ntile(df: DataFrame, buckets: int, order: Sequence[Column], out: str) -> DataFrame:
    """SQL ``ntile(buckets)`` over the whole table without a one-task window."""
    ranked = global_rank(df, order, rank="_rank", total="_rows")
    r, k = F.col("_rank"), F.lit(buckets)
    small = F.floor(F.col("_rows") / k)
    larger = F.col("_rows") % k  # this many buckets hold one row more
    edge = larger * (small + 1)
    bucket = F.when(r <= edge, F.ceil(r / (small + 1))).otherwise(larger + F.ceil((r - edge) / small))
    return ranked.withColumn(out, bucket.cast("int")).drop("_rank", "_rows")


def exact_quantiles(df: DataFrame, value: str, quantiles: Mapping[str, float]) -> DataFrame:
    """One row of exact, linearly interpolated quantiles of one column."""
    return quantiles_of_counts(stamped_counts(df, value), value, quantiles)


def stamped_counts(df: DataFrame, value: str, *extra: Column, count: str = "_n") -> DataFrame:
    """(value, occurrences, extra aggregates) in value order, missing values last.

    A repeated value costs one row however often it occurs, so neither a
    heavy value nor the length of the table decides what is sorted.
    """
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias(count), *extra)
    return stamp_order(counts, [F.col(value).asc_nulls_last()])


def quantiles_of_counts(stamped: DataFrame, value: str, quantiles: Mapping[str, float], *,
                        count: str = "_n") -> DataFrame:
    """Quantiles from ``stamped_counts``; only sorted pieces holding a wanted rank are looked into."""
    known = stamped.where(F.col(value).isNotNull())
    starts = _segment_starts(known, F.col(count))

    def place(q: float) -> Column:
        return F.lit(q) * (F.col("_total") - F.lit(1))

    needed = F.lit(False)
    for q in quantiles.values():
        for rank in (F.floor(place(q)), F.ceil(place(q))):
            needed = needed | ((rank >= F.col("_before")) & (rank < F.col("_before") + F.col("_weight")))
    candidates = known.join(F.broadcast(starts.where(needed)), SEGMENT)  # two pieces per quantile at most
    running = Window.partitionBy(SEGMENT).orderBy(SLOT).rowsBetween(Window.unboundedPreceding, 0)
    ranked = candidates.withColumn("_end", F.col("_before") + F.sum(count).over(running))
    begin = F.col("_end") - F.col(count)

    def value_at(rank: Column) -> Column:
        return F.max(F.when((rank >= begin) & (rank < F.col("_end")), F.col(value).cast("double")))

    parts = [F.max("_total").alias("_total")]
    for i, q in enumerate(quantiles.values()):
        parts.append(value_at(F.floor(place(q))).alias(f"_lo{i}"))
        parts.append(value_at(F.ceil(place(q))).alias(f"_hi{i}"))
    found = ranked.agg(*parts)
    out = []
    for i, (name, q) in enumerate(quantiles.items()):
        share = place(q) - F.floor(place(q))
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        out.append((lo + (hi - lo) * share).alias(name))
    return found.select(*out)


def sequence_within(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    *,
    number: str | None = None,
    previous: Mapping[str, str] | None = None,
    running: Mapping[str, str] | None = None,
    last: str | None = None,
) -> DataFrame:
    """Row number, previous value, running sum and last-row flag of each key in order.

    ``previous`` and ``running`` map a new column to its input column;
    ``order`` must be unique inside a key.  Rows are sorted by key and order over
    many tasks, so a key of any size is spread like all others.  Within a sorted
    segment plain windows count; only a segment's first key can go on from
    earlier ones, and what they add up to is one row a segment.
    """
    keys, previous, running = list(keys), dict(previous or {}), dict(running or {})
    stamped = stamp_order(df, [F.col(k).asc() for k in keys] + list(order))
    local = Window.partitionBy(SEGMENT, *keys).orderBy(SLOT)
    up_to_here = local.rowsBetween(Window.unboundedPreceding, 0)
    counted = stamped.withColumns({
        "_nth": F.row_number().over(local).cast("bigint"),
        "_more": F.lead(F.lit(True)).over(local).isNotNull(),
        **{f"_prev_{out}": F.lag(src).over(local) for out, src in previous.items()},
        **{f"_run_{out}": F.sum(src).over(up_to_here) for out, src in running.items()},
    })
    carried = _carried(counted, keys, previous, running)
    goes_on = F.col("_goes_on") & F.struct(*keys).eqNullSafe(F.col("_first_key"))
    joined = counted.join(F.broadcast(carried), SEGMENT)  # one row per sorted partition
    added = {}
    if number:
        added[number] = (F.col("_nth") + F.when(goes_on, F.col("_rows_before")).otherwise(0)).cast("int")
    for out in previous:
        added[out] = F.when(goes_on & (F.col("_nth") == 1), F.col(f"_last_{out}")).otherwise(F.col(f"_prev_{out}"))
    for out in running:
        before, here = F.when(goes_on, F.col(f"_sum_{out}")), F.col(f"_run_{out}")
        added[out] = F.when(before.isNull(), here).otherwise(before + F.coalesce(here, F.lit(0)))
    if last:
        added[last] = ~F.col("_more") & ~(F.col("_stays") & F.struct(*keys).eqNullSafe(F.col("_last_key")))
    return joined.withColumns(added).select(*df.columns, *added)


def _carried(counted: DataFrame, keys: list[str], previous: Mapping[str, str], running: Mapping[str, str]) -> DataFrame:
    """Per segment its first and last key, and what the first key's rows in earlier segments add up to."""
    key = F.struct(*keys)
    ends = counted.groupBy(SEGMENT).agg(
        F.min_by(key, SLOT).alias("_first_key"), F.max_by(key, SLOT).alias("_last_key"), F.max_by("_nth", SLOT).alias("_rows"),
        *[F.max_by(F.struct(F.col(src).alias("v")), SLOT).alias(f"_end_{out}") for out, src in previous.items()],
        *[F.max_by(F.struct(F.col(f"_run_{out}").alias("v")), SLOT).alias(f"_end_{out}") for out in running])
    # One row per segment: single-task windows are right here.  Segments that end with one key stand
    # side by side, so its rows up to a segment are those of the segments ending with it.
    same_end = Window.partitionBy("_last_key").orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, 0)
    in_order = Window.partitionBy(F.lit(0)).orderBy(SEGMENT)
    summed = ends.withColumns({"_rows": F.sum("_rows").over(same_end), **{
        f"_end_{out}": F.struct(F.sum(F.col(f"_end_{out}.v")).over(same_end).alias("v")) for out in running}})
    return summed.select(
        SEGMENT, "_first_key", "_last_key",
        F.coalesce(F.lag("_last_key").over(in_order).eqNullSafe(F.col("_first_key")) & F.lag(F.lit(True)).over(in_order),
                   F.lit(False)).alias("_goes_on"),
        F.coalesce(F.lead("_first_key").over(in_order).eqNullSafe(F.col("_last_key")) & F.lead(F.lit(True)).over(in_order),
                   F.lit(False)).alias("_stays"),
        F.lag("_rows").over(in_order).alias("_rows_before"),
        *[F.lag(f"_end_{out}").over(in_order).getField("v").alias(f"_last_{out}") for out in previous],
        *[F.lag(f"_end_{out}").over(in_order).getField("v").alias(f"_sum_{out}") for out in running])
