"""Exact quantiles with linear interpolation, for columns of any length."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.session import materialize

# Up to this many values are held at once by `percentile` aggregates.
EXACT_ROWS = 200_000
# Longer columns: values that are sorted at once, and how many of them tell where the others lie.
CHUNK_VALUES, CHUNK_POINTS = 262_144, 8_192
# Resolution of the sketch that narrows longer columns down.
SKETCH_ACCURACY = 10_000


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
              exact_rows: int | None = None, at_most: int | None = None) -> dict[str, list[float | None]]:
    """Quantiles of each column without its missing values, as {column: [one per prob]}.
    ``at_most`` is a known bound of the row count and may spare the pass that counts.

    Short columns share aggregates. Long columns are narrowed, all at once, to the
    few values around each rank, which are then ranked exactly; no task ever holds
    all values of a long column.
    """
    limit = EXACT_ROWS if exact_rows is None else exact_rows
    if at_most:
        sizes = dict.fromkeys(columns, at_most)
    else:
        counts = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)]).first()
        sizes = {c: counts[f"n{i}"] for i, c in enumerate(columns)}
    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in columns}
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    for group in _groups(sizes, limit):
        row = df.agg(*[F.percentile(F.col(c).cast("double"), wanted).alias(f"q{i}")
                       for i, c in enumerate(group)]).first()
        for i, c in enumerate(group):
            out[c] = list(row[f"q{i}"] or out[c])
    long = [c for c in columns if sizes[c] > limit]
    if long:
        out |= _of_long_columns(df, long, probs)
    return out


def _groups(sizes: dict[str, int], limit: int) -> list[list[str]]:
    """Short columns in groups that hold at most ``limit`` values together."""
    out, held = [], limit + 1
    for column, size in sizes.items():
        if not 0 < size <= limit:
            continue
        if held + size > limit:
            out.append([])
            held = 0
        out[-1].append(column)
        held += size
    return out


def _places(n: int, probs: Sequence[float]) -> list[tuple[float, int, int]]:
    """Where the quantiles of ``n`` values lie, and the 0-based ranks on both sides."""
    at = [p * (n - 1) for p in probs]
    return [(x, math.floor(x), math.ceil(x)) for x in at]


def _of_long_columns(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Quantiles of all columns from two passes over the rows, whatever the number of columns.

    The first pass sorts chunks of each column and keeps evenly spaced values of them, which give for every rank two values it
    is certain to lie between. The second counts the rows between these stretches and the distinct values within; a column's meet
    in one task, which holds about two values of ``CHUNK_POINTS`` per rank.
    """
    values = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])

    def points(batches):
        for i, v in _chunks(batches, len(columns)):
            v = np.sort(v)
            step = -(-len(v) // CHUNK_POINTS)
            yield pa.RecordBatch.from_pydict({"c": [i], "n": [len(v)], "step": [step], "top": [v[-1]], "v": [v[::step].tobytes()]})

    def stretches(table: pa.Table) -> pa.Table:
        n, edges = _certain(table, probs)
        return pa.table({"c": table["c"][:1], "n": [n], "edges": [edges.tobytes()]})

    found = values.mapInArrow(points, "c long, n long, step long, top double, v binary").groupBy("c").applyInArrow(
        lambda t: stretches(t), "c long, n long, edges binary").collect()
    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in columns}
    if not found:
        return out
    sizes, edges = {r["c"]: r["n"] for r in found}, {r["c"]: np.frombuffer(r["edges"]).reshape(2, -1) for r in found}

    def within(batches):
        for i, v in _chunks(batches, len(columns)):
            low, high = edges[i]
            stretch = np.searchsorted(high, v, "left")
            inside = np.searchsorted(low, v, "right") - 1 == stretch
            regions = np.bincount(2 * stretch + inside, minlength=2 * len(low) + 1)
            some, counts = np.unique(v[inside], return_counts=True)
            yield pa.RecordBatch.from_pydict({"c": [i], "regions": [regions.tobytes()], "v": [some.tobytes()], "n": [counts.tobytes()]})

    def ranked(table: pa.Table) -> pa.Table:
        i = table["c"][0].as_py()
        regions = sum(np.frombuffer(b.as_buffer(), np.int64) for b in table["regions"])
        v, counts = (np.concatenate([np.frombuffer(b.as_buffer(), kind) for b in table[c]]) for c, kind in (("v", float), ("n", np.int64)))
        v, which = np.unique(v, return_inverse=True)
        counts = np.bincount(which, counts, len(v)).astype(np.int64)
        # The first rank of each value: those of its stretch are counted on from the rows before the stretch.
        stretch = np.searchsorted(edges[i][1], v, "left")
        before, own = np.cumsum(regions)[2 * stretch], np.cumsum(counts)
        at_first = np.searchsorted(stretch, stretch, "left")
        last = before + own - np.where(at_first > 0, own[at_first - 1], 0)
        value = lambda rank: v[np.searchsorted(last, rank, "right")]
        got = []
        for x, low, high in _places(sizes[i], probs):
            a, b = value(low), value(high)
            got.append(float(a) if low == high or a == b else float((high - x) * a + (x - low) * b))
        return pa.table({"c": table["c"][:1], "q": pa.array([got], pa.list_(pa.float64()))})

    for r in values.mapInArrow(within, "c long, regions binary, v binary, n binary").groupBy("c").applyInArrow(
            lambda t: ranked(t), "c long, q array<double>").collect():
        out[columns[r["c"]]] = list(r["q"])
    return out


def _chunks(batches, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(column, known values) of a task's rows, about ``CHUNK_VALUES`` rows at a time."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK_VALUES:
            yield from _columns(held, width)
            held, n = [], 0
    if held:
        yield from _columns(held, width)


def _columns(batches: list[pa.RecordBatch], width: int) -> Iterator[tuple[int, np.ndarray]]:
    for i in range(width):
        v = np.concatenate([b.column(i).drop_null().to_numpy(zero_copy_only=False) for b in batches])
        if len(v):
            yield i, v


def _certain(table: pa.Table, probs: Sequence[float]) -> tuple[int, np.ndarray]:
    """The number of values of a column, and ends of disjoint stretches that hold its ranks, both ends included.

    Where ``k`` of a chunk's points, each ``step`` values from the next, lie below a value, (k - 1) * step + 1 to k * step of its values do.
    """
    step, n = table["step"].to_numpy(), int(table["n"].to_numpy().sum())
    parts = [np.frombuffer(b.as_buffer()) for b in table["v"]]
    v, which = np.unique(np.concatenate(parts), return_inverse=True)
    upto = np.bincount(which, np.repeat(step, [len(p) for p in parts]), len(v)).cumsum()
    below, slack = np.concatenate([[0], upto[:-1]]), int((step - 1).sum())
    ranks = np.unique([r for _, *both in _places(n, probs) for r in both])
    first = np.searchsorted(below, ranks, "right") - 1
    last = np.searchsorted(upto - slack, ranks + 1, "left")
    top = np.sort(table["top"].to_numpy())[-1]
    low, high = v[first], np.append(v, top)[last]
    joined = [[low[0], high[0]]]
    for a, b in zip(low[1:], high[1:], strict=True):
        if np.searchsorted(joined[-1][1:], a, "left") == 0:  # not-a-number lies behind all others
            joined[-1][1] = b
        else:
            joined.append([a, b])
    return n, np.array(joined).T.copy()


def order_statistics(values: DataFrame, n: int, ranks: Sequence[int], limit: int) -> dict[int, float]:
    """Values of the column ``v`` at 0-based ranks, from two passes over the rows, whatever the number of ranks.

    The first pass sketches all ranks and gives a stretch of values around each. The second counts the rows between the stretches
    and the distinct values within them, which are put in order by ranges and written; there each rank is read at its position.
    Should a sketch have missed its rank, wider stretches are tried; ``limit`` is about how many values one range holds.
    """
    spark, slack, at = values.sparkSession, 2.0 / SKETCH_ACCURACY, {}
    while open_ := [r for r in ranks if r not in at]:
        edges = _stretches(values, n, open_, slack)
        counted = materialize(_counted(values, edges, n, limit), "ranked")
        # One row per stretch, or space between two, and range.
        sizes = sorted(map(tuple, counted.groupBy("region", "part").agg(F.sum("n")).collect()))
        wanted, below = [], 0
        for region, part, size in sizes:
            for rank in open_:
                if below <= rank < below + size and region % 2:
                    wanted.append((part, region, rank - below, rank))
            below += size
        if wanted:
            asked = F.broadcast(spark.createDataFrame(wanted, "part int, region int, offset long, rank long"))  # one row per rank
            upto = F.sum("n").over(Window.partitionBy("part", "region").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
            read = counted.join(F.broadcast(asked.select("part", "region").distinct()), ["part", "region"]).withColumn("upto", upto)
            found = read.join(asked, ["part", "region"]).where((F.col("offset") < F.col("upto")) & (F.col("offset") >= F.col("upto") - F.col("n")))
            at.update({r["rank"]: r["v"] for r in found.select("rank", "v").collect()})
        slack *= 8
    return at


def _stretches(values: DataFrame, n: int, ranks: Sequence[int], slack: float) -> np.ndarray:
    """Ends of disjoint stretches of values that hold the ranks, up to the error of the sketch: each one's first value, and the
    first one behind it."""
    shares = [min(1.0, max(0.0, r / max(n - 1, 1) + step)) for r in ranks for step in (-slack, slack)]
    found = values.agg(F.percentile_approx("v", shares, SKETCH_ACCURACY).alias("s")).first()["s"]
    out: list[list[float]] = []
    for low, high in sorted(zip(found[::2], found[1::2], strict=True)):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    # Not-a-number lies behind infinity, as nothing else does.
    return np.array([e for low, high in out for e in (low, np.nextafter(high, np.inf) if high < np.inf else np.nan)])


def _counted(values: DataFrame, edges: np.ndarray, n: int, limit: int) -> DataFrame:
    """(``region``, ``v``, ``n``, ``part``): how often each value of a stretch (odd regions) occurs, how many rows lie between them."""
    @F.arrow_udf("int")
    def region_of(v: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(edges, v.to_numpy(zero_copy_only=False), "right").astype(np.int32))

    placed = values.select(region_of("v").alias("region"), "v")
    counts = placed.select("region", F.when(F.col("region") % 2 == 1, F.col("v")).alias("v")).groupBy("region", "v").agg(F.count(F.lit(1)).alias("n"))
    # Stretches hold about this share of all values; ranges of equal values would hold fewer.
    parts = max(1, math.ceil(n * len(edges) * 4 / SKETCH_ACCURACY / max(limit, 1)))
    return counts.repartitionByRange(parts, "region", "v").select("*", F.spark_partition_id().alias("part"))
