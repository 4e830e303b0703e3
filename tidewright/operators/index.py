"""Row positions in long series, and windows that never need a whole series in one task.

Row-based windows depend on order alone. A series is cut into chunks of consecutive
positions; each chunk also receives the last rows of the chunk before it (the halo),
so every window of its own rows is complete. Results equal those of one window over
the whole series, while no task holds more than a chunk and its halo.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidewright.session import materialize

# A series up to this many rows is numbered by one window; longer ones by ranges.
MAX_GROUP_ROWS = 1_000_000
# Rows of one range, and of one chunk.
RANGE_ROWS = 1_000_000
CHUNK_ROWS = 250_000


def group_sizes(df: DataFrame, keys: Sequence[str] = ()) -> tuple[int, int]:
    """(rows of the largest group, rows of all groups); counts are combined before the shuffle."""
    if not keys:
        total = df.count()
        return total, total
    row = df.groupBy(*keys).count().agg(
        F.max("count").alias("top"), F.sum("count").alias("total")).first()
    return row["top"] or 0, row["total"] or 0


def with_position(df: DataFrame, order: Sequence[str], keys: Sequence[str] = (),
                  pos: str = "pos", size: str = "n_rows",
                  max_group_rows: int | None = None, range_rows: int | None = None) -> DataFrame:
    """Add the 0-based position of each row in its series, and the length of the series.

    ``order`` must be unique within ``keys``. If the largest series is longer than
    ``max_group_rows``, rows are sorted into ranges instead of into one task per series.
    """
    max_group_rows = MAX_GROUP_ROWS if max_group_rows is None else max_group_rows
    largest, total = group_sizes(df, keys)
    if largest > max_group_rows:
        return _by_ranges(df, order, keys, pos, size, total, range_rows or RANGE_ROWS)
    series = Window.partitionBy(*keys)
    return df.select(
        "*",
        (F.row_number().over(series.orderBy(*order)) - 1).cast("long").alias(pos),
        F.count(F.lit(1)).over(series).alias(size),
    )


def _by_ranges(df, order, keys, pos, size, total, range_rows) -> DataFrame:
    """Sort into ranges, store them once, and add to each row the count of the ranges before it.

    The ranges are stored because range bounds come from a sample and would differ
    between two runs of the same plan.
    """
    columns = [*keys, *order]
    ranges = max(1, math.ceil(total / range_rows))
    placed = (
        df.repartitionByRange(ranges, *columns)
        .sortWithinPartitions(*columns)
        .select("*", F.spark_partition_id().alias("_range"),
                F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"))
    )
    placed = materialize(placed, "ranges")
    counts = placed.groupBy(*keys, "_range").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    # At most `ranges` rows per key, so this window stays small.
    by_key = Window.partitionBy(*keys)
    before = by_key.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_range").alias("_r"), "_first",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        F.sum("_rows").over(by_key).alias(size),
    )
    if not keys:
        # One row per range: bounded by the number of ranges chosen above.
        offsets = F.broadcast(offsets)
    match = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        match = match & placed[k].eqNullSafe(F.col(f"_k{i}"))
    return placed.join(offsets, match).select(
        *df.columns,
        (F.col("_at") - F.col("_first") + F.col("_before")).cast("long").alias(pos),
        F.col(size).cast("long").alias(size),
    )


def chunks_with_halo(df: DataFrame, pos: str, halo: int, chunk_rows: int | None = None) -> DataFrame:
    """Add ``_chunk`` and ``_own``; the last ``halo`` rows of a chunk appear in the next one too."""
    rows = max(chunk_rows or CHUNK_ROWS, halo, 1)
    own = F.expr(f"`{pos}` div {rows}")
    if halo == 0:
        return df.select("*", own.alias("_own"), own.alias("_chunk"))
    tail = (F.col(pos) % rows) >= rows - halo
    targets = F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))
    return df.select("*", own.alias("_own"), F.explode(targets).alias("_chunk"))


def over_chunks(df: DataFrame, build: Callable[[WindowSpec], list[Column]], pos: str,
                scope: Sequence[str] = (), halo: int = 0, chunk_rows: int | None = None,
                then: Callable[[DataFrame], DataFrame] = lambda staged: staged) -> DataFrame:
    """Add the columns ``build(window)`` makes, for windows that look back at most ``halo`` rows.

    ``pos`` counts from 0 within ``scope``. All columns share one sort; ``then`` may add others that see whole chunks.
    """
    staged = chunks_with_halo(df, pos, halo, chunk_rows)
    window = Window.partitionBy(*scope, "_chunk").orderBy(pos)
    added = then(staged.select("*", *build(window)))
    return added.where(F.col("_chunk") == F.col("_own")).drop("_chunk", "_own")
