"""Shards of nearly equal size by histogram sort (operator 12).

Rows are put in the order of a key; the hash of the text unless another is named, so equal texts are neighbours.
Rows of equal keys follow a second hash, of their place in the input, so that a key that fills a third of the table is
divided like any other. Shards are ranges of that order, and a shard of much data is several ranges, each the work of a task.

The ends of the ranges are found by counting. A round sends candidate boundaries to all partitions; each partition counts its exact
rows and bytes between them, and only these sums meet. Where the bytes below a boundary are not yet within the
tolerance of what they should be, the next round probes between the two nearest boundaries known: where even bytes would put it, and at
both ends of rows and groups of equal keys drawn from there, so one that holds most of the bytes is set apart at once. A range ends at the nearest boundary found when it is within the tolerance, or when one row alone lies between its neighbours. Then
the rows are exchanged once, each straight to the task of its range, and sorted there; the counts
already say how many rows of the shard lie before.

The rows are first written with their keys to the shared folder, so all rounds and the exchange see the same keys whatever
is lost on the way; the rounds read the keys only.

A missing text or size counts as no bytes, a missing key like any other value. Repeated rows are rows of their own. With fewer
rows than shards some shards are empty; an empty table gives none. Input columns named like those that are
added are replaced.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.arrowtext import U64, mix
from tidewright.session import materialize

#: Bytes of a range, and ranges of a shard at most: both bound what the driver holds, one row per probe.
RANGE_BYTES, RANGES = 16 << 20, 4096
#: How far from even the end of a shard may be, as a part of a shard; and rows drawn from each interval in a round.
TOLERANCE, PIVOTS = 0.001, 2
_TOP = (1 << 128) - 1


def _flipped(values: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the signed ones."""
    return values.view(U64) ^ U64(1 << 63)


def _below(first: np.ndarray, second: np.ndarray, p1: np.ndarray, p2: np.ndarray) -> np.ndarray:
    """How many of the sorted boundaries (``p1``, ``p2``) each key has reached."""
    begin, upto = np.searchsorted(p1, first, "left"), np.searchsorted(p1, first, "right")
    out, tied = begin.copy(), np.flatnonzero(begin < upto)
    for low in np.unique(begin[tied]):
        own = tied[begin[tied] == low]
        out[own] = low + np.searchsorted(p2[low:upto[own[0]]], second[own], "right")
    return out


def _halves(boundaries: list[int]) -> tuple[np.ndarray, np.ndarray]:
    return (np.array([b >> 64 for b in boundaries], U64), np.array([b & ((1 << 64) - 1) for b in boundaries], U64))


def _counted(keyed: DataFrame, boundaries: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Bytes and rows below each boundary, counted per partition, then added up; and keys from between the boundaries.

    Of each interval ``PIVOTS`` rows are drawn, a row as likely as it has bytes: the one of the least -log(u) / size, with u from its
    second hash. The least of partitions is the least of all, so this draws the same rows however they are dealt.
    """
    spark = keyed.sparkSession
    sent = spark.sparkContext.broadcast(_halves(boundaries))

    def run(batches):
        p1, p2 = sent.value
        total = np.zeros((2, len(p1) + 1), np.int64)
        score = np.full((PIVOTS, len(p1) + 1), np.inf)
        drawn = np.zeros((PIVOTS, 2, len(p1) + 1), np.int64)
        for batch in batches:
            first, second, size = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            where = _below(_flipped(first), _flipped(second), p1, p2)
            np.add.at(total[0], where, size)
            total[1] += np.bincount(where, minlength=len(p1) + 1)
            for pivot in range(PIVOTS):
                u = (mix(second.view(U64) + U64(pivot)) >> U64(11)).astype(float) * 2.0 ** -53 + 2.0 ** -54
                own = -np.log(u) / np.maximum(size, 1e-9)
                order = np.lexsort((own, where))
                least = order[np.flatnonzero(np.diff(where[order], prepend=-1))]
                least = least[own[least] < score[pivot, where[least]]]
                score[pivot, where[least]] = own[least]
                drawn[pivot, 0, where[least]], drawn[pivot, 1, where[least]] = first[least], second[least]
        some = np.flatnonzero(total[1])
        pivots = [x[some] for pivot in range(PIVOTS) for x in (score[pivot], *drawn[pivot])]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (some, *(total[:, some]), *pivots)], names=names)

    kinds = [("at", "long"), ("bytes", "long"), ("n", "long")] + [
        (f"{c}{pivot}", kind) for pivot in range(PIVOTS) for c, kind in (("score", "double"), ("first", "long"), ("second", "long"))]
    names = [c for c, _ in kinds]
    sums = keyed.select("first", "second", "size").mapInArrow(run, ", ".join(map(" ".join, kinds))).groupBy("at").agg(
        F.sum("bytes").alias("bytes"), F.sum("n").alias("n"),
        *[F.min_by(F.struct(f"first{pivot}", f"second{pivot}"), f"score{pivot}").alias(f"pivot{pivot}") for pivot in range(PIVOTS)])
    between, keys = np.zeros((2, len(boundaries) + 1), np.int64), []
    for at, size, n, *pivots in sums.collect():
        between[:, at] = size, n
        keys += [((first + (1 << 63)) << 64) + second + (1 << 63) for first, second in pivots]
    sent.unpersist()
    upto = between.cumsum(1)
    return upto[0][:-1].tolist(), upto[1][:-1].tolist(), sorted(set(keys))


def _around(key: int) -> tuple[int, ...]:
    """Boundaries that set a row apart, and all rows that share the first part of its key."""
    return key, key + 1, key >> 64 << 64, (key >> 64) + 1 << 64


def splitters(keyed: DataFrame, total: int, rows: int, ranges: int, tolerance: int) -> tuple[list[int], list[int], int]:
    """The ends of all ranges but the last, the rows below each, and the rounds it took."""
    wanted = [total * k // ranges for k in range(1, ranges)]
    known = {0: (0, 0), _TOP: (total, rows)}
    chosen: dict[int, int] = {}
    pivots: list[int] = []
    rounds = 0
    while True:
        places = sorted(known)
        sizes = np.array([known[p][0] for p in places])
        probes = set()
        for k, target in enumerate(wanted):
            if k in chosen:
                continue
            at = max(1, min(len(places) - 1, int(np.searchsorted(sizes, target, "left"))))
            low, high = places[at - 1], places[at]
            below, above = known[low][0], known[high][0]
            near = low if target - below <= above - target else high
            if abs(known[near][0] - target) <= tolerance or known[high][1] - known[low][1] <= 1 or high - low <= 1:
                chosen[k] = near
                continue
            drawn = pivots[bisect_left(pivots, low):bisect_left(pivots, high)][:2 * PIVOTS]
            even = low + (high - low) * (target - below) // (above - below)
            probes.update(p for p in (even, (low + high) // 2, *(p for key in drawn for p in _around(key))) if low < p < high)
        if not probes and len(chosen) == len(wanted):
            break
        asked = sorted(probes)
        sizes, counts, pivots = _counted(keyed, asked)
        known.update(zip(asked, zip(sizes, counts, strict=True), strict=True))
        rounds += 1
    ends = [chosen[k] for k in range(ranges - 1)]
    return ends, [known[e][1] for e in ends], rounds


def balanced(df: DataFrame, shards: int, size: Column | None = None, key: Column | None = None,
             tolerance: float = TOLERANCE) -> DataFrame:
    """The rows of ``df`` with ``shard`` (0 to ``shards`` - 1) and ``slot``, their place in it by key, without gaps.

    ``size`` is what shards share evenly, the bytes of ``text`` and one more if left out; ``key`` is a long, the hash of ``text``.
    """
    text = F.col("text").cast("string") if size is None or key is None else None
    size = F.coalesce(F.octet_length(text), F.lit(0)) + 1 if size is None else F.coalesce(size, F.lit(0))
    key = F.xxhash64(text) if key is None else F.coalesce(key, F.lit(-(1 << 63)))
    names = [c for c in df.columns if c not in ("shard", "slot")]
    keyed = materialize(df.select(
        key.cast("long").alias("first"), F.xxhash64(F.monotonically_increasing_id()).alias("second"), size.cast("long").alias("size"),
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")), "histogram")
    total, rows = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).collect()[0]
    each = max(1, min(RANGES, -(-total // (shards * RANGE_BYTES))))
    ends, before, _ = splitters(keyed, total, rows, shards * each, int(tolerance * total / shards))
    p1, p2 = _halves(ends)
    starts = [0, *before]
    # Rows of a range's shard that lie in the ranges before it.
    base = np.array([starts[r] - starts[r - r % each] for r in range(shards * each)], np.int64)

    @F.pandas_udf("part int, before long")
    def range_of(first: pd.Series, second: pd.Series) -> pd.DataFrame:
        where = _below(_flipped(first.to_numpy()), _flipped(second.to_numpy()), p1, p2)
        return pd.DataFrame({"part": where.astype(np.int32), "before": base[where]})

    dealt = keyed.select("row", "first", "second", range_of("first", "second").alias("range")) \
        .select("row", "first", "second", "range.part", "range.before").repartitionById(shards * each, "part")
    place = F.row_number().over(Window.partitionBy("part").orderBy("first", "second")) - 1
    return dealt.select("row.*", F.floor(F.col("part") / each).cast("int").alias("shard"), (F.col("before") + place).alias("slot"))


def report(df: DataFrame, shards: int = 16) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return balanced(df.select("doc_id", "text"), shards).select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
