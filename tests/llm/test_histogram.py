"""Operator 12 against one sort of all rows in Python."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import histogram
from tidewright.session import materialize


def documents(seed=1, n=900):
    rng = random.Random(seed)
    hot = "the same long text " * 4
    out = [(i, hot if i % 3 == 0 else "x" * int(rng.expovariate(1 / 120)) + str(i)) for i in range(n)]
    return out + [(None, "no id"), (5000, None), (5001, ""), (5002, "é" * 40), (5003, "twice"), (5003, "twice"), (5004, "y" * 3000)]


def size(text):
    return len((text or "").encode()) + 1


@pytest.fixture(scope="module")
def docs(spark):
    rows = documents()
    df = spark.createDataFrame([(i, t, "a", 7, 8) for i, t in rows], "doc_id long, text string, shard string, slot int, first int")
    return rows, df.repartition(5)


@pytest.mark.parametrize("range_bytes", [1 << 20, 1500])
def test_shards_are_even_ranges_of_the_order(docs, monkeypatch, range_bytes):
    monkeypatch.setattr(histogram, "RANGE_BYTES", range_bytes)
    rows, df = docs
    got = histogram.balanced(df, 16).withColumn("key", F.xxhash64("text")).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows) and {r["first"] for r in got} == {8}
    total, longest = sum(size(t) for _, t in rows), max(size(t) for _, t in rows)
    by = [sorted((r for r in got if r.shard == k), key=lambda r: r.slot) for k in range(16)]
    assert sum(map(len, by)) == len(got)
    assert all([r.slot for r in own] == list(range(len(own))) for own in by)
    keys = [r.key for own in by for r in own]
    assert keys == sorted(keys)
    ends = np.cumsum([sum(size(r.text) for r in own) for own in by])
    # An end may miss its place by half of the row that lies there; all rows but one are short.
    off = np.abs(ends - total * np.arange(1, 17) / 16)
    assert (off <= longest / 2 + total / 16 * histogram.TOLERANCE + 1).all() and np.sort(off)[-2] <= 400


def test_splitters_are_the_nearest_boundaries(spark):
    """With no tolerance, every end is where the bytes below come nearest to even."""
    rows = documents(4, 400)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    keyed = materialize(df.select(F.xxhash64("text").alias("first"), F.xxhash64(F.monotonically_increasing_id()).alias("second"),
                                  (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size")), "keys")
    own = sorted((r["first"], r["second"], r["size"]) for r in keyed.collect())
    upto = np.concatenate([[0], np.cumsum([s for _, _, s in own])])
    total = int(upto[-1])
    ends, below, rounds = histogram.splitters(keyed, total, len(own), 7, 0)
    whole = [((a + (1 << 63)) << 64) + b + (1 << 63) for a, b, _ in own]
    for k, (end, n) in enumerate(zip(ends, below, strict=True)):
        assert sum(x < end for x in whole) == n
        target = total * (k + 1) // 7
        assert abs(upto[n] - target) == np.abs(upto - target).min()
    assert rounds < 25


@pytest.mark.parametrize("rows", [[], [(1, "one")], [(3, "same")] * 40, [(1, None), (2, "")], [(1, "z" * 5000)] + [(i, "s") for i in range(20)]])
def test_small_tables(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = histogram.report(df).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    for k in range(16):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    if len(rows) == 40:
        assert sorted(Counter(r.shard for r in got).values()) == [2] * 8 + [3] * 8
    assert all(r.law == "bytes" and r.grown_shard is None for r in got)


def test_another_key_and_size(spark):
    df = spark.createDataFrame([(i, None if i % 10 == 0 else i // 4) for i in range(200)], "size long, k long").repartition(4)
    got = histogram.balanced(df, 4, size=F.lit(1), key=F.col("k")).orderBy("shard", "slot").collect()
    assert [r.shard for r in got] == [0] * 50 + [1] * 50 + [2] * 50 + [3] * 50
    assert [-1 if r.k is None else r.k for r in got] == sorted(-1 if r.k is None else r.k for r in got)
