"""Token ids as binary shards in training order (operator 9).

The ids of all texts, each text ended by a mark, are cut into sequences of equal length; the
last one of a partition is filled up. Sequence number n of N goes to the slot that a keyed
Feistel network gives it: four rounds over the least even number of bits that hold N, walked
again as long as the result is N or more, so the slots are a permutation of 0..N-1 that anyone with
the key can compute for any n, and undo. Slots are ranges of shards: shard k holds the slots from
k * S on, in order, every record as long as the other. Where a run stopped is a shard and
an offset, and reading goes on there without an index.

Shards are written by Spark's text writer, which commits a task's files at once when it succeeds: a record is the bytes of
its ids and one separator byte, written as the end of a line, so the stride is one byte
more than the record. ``read_shards`` gives the records back.

Sequences are numbered by partition and place, as ``zipWithIndex`` numbers rows: one job counts the ids per partition, the next
numbers them, and stops with an error should a partition have changed in between. The input should therefore be a
table, not the result of a shuffle.

A missing or empty text is an end mark alone. Order and repeats of rows do not matter; an empty table
gives no record and no shard.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.arrowtext import pieces
from tidewright.session import shared_folder

#: Byte ids: a UTF-8 byte is its own id; these two bytes never occur in UTF-8.
END, FILL = 0xFF, 0xFE
LENGTH = 2048
SHARD_RECORDS = 4096
ROUNDS = 4


def _round(half: np.ndarray, key: int, number: int, mask: int) -> np.ndarray:
    seed = int.from_bytes(hashlib.sha256(f"{key}:{number}".encode()).digest()[:8], "little")
    x = (half + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)) & np.uint64(mask)


def _network(values: np.ndarray, key: int, half_bits: int, back: bool) -> np.ndarray:
    shift, mask = np.uint64(half_bits), (1 << half_bits) - 1
    left, right = values >> shift, values & np.uint64(mask)
    for number in range(ROUNDS):
        if back:
            left, right = right ^ _round(left, key, ROUNDS - 1 - number, mask), left
        else:
            left, right = right, left ^ _round(right, key, number, mask)
    return (left << shift) | right


def permuted(numbers: np.ndarray, total: int, key: int, back: bool = False) -> np.ndarray:
    """The slot of each number below ``total``, or with ``back`` the number of each slot."""
    half_bits = max(1, -(-max(total - 1, 1).bit_length() // 2))
    out = _network(numbers.astype(np.uint64), key, half_bits, back)
    while (far := out >= total).any():  # at most four values share a walk's range on average
        out[far] = _network(out[far], key, half_bits, back)
    return out.astype(np.int64)


def byte_ids(df: DataFrame, text: str = "text") -> DataFrame:
    """``ids``: the bytes of a text as its ids, one byte each."""
    return df.select(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("ids"))


def sequences(tokens: DataFrame, key: int, length: int, width: int, end: int, fill: int,
              shard_records: int) -> tuple[DataFrame, int]:
    """(``shard``, ``slot``, ``record``) of all sequences of ``length`` ids of ``width`` bytes, and how many there are."""
    tokens = tokens.select("ids")
    counted = tokens.groupBy(F.spark_partition_id().alias("part")).agg(
        F.sum(F.coalesce(F.octet_length("ids"), F.lit(0)) / width + 1).cast("long").alias("n"))
    # One pair of numbers per partition: some megabytes even for a million partitions.
    parts = dict(map(tuple, counted.collect()))
    base, total = {}, 0
    for part in sorted(parts):
        base[part] = total
        total += -(-parts[part] // length)
    sent = tokens.sparkSession.sparkContext.broadcast((base, parts))
    stop, pad = end.to_bytes(width, "little"), fill.to_bytes(width, "little")
    size = length * width

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        number, wanted, seen, rest = sent.value[0].get(part, 0), sent.value[1].get(part, 0), 0, b""

        def cut(data: bytes, number: int):
            whole = len(data) // size
            slot = permuted(np.arange(number, number + whole), total, key)
            return pa.RecordBatch.from_arrays([
                pa.array(slot // shard_records), pa.array(slot), pa.array([data[k * size:(k + 1) * size] for k in range(whole)], pa.binary())],
                names=["shard", "slot", "record"]), whole

        for batch in pieces(batches):
            data = rest + b"".join((x or b"") + stop for x in batch.column(0).to_pylist())
            seen += (len(data) - len(rest)) // width
            out, whole = cut(data, number)
            number, rest = number + whole, data[whole * size:]
            yield out
        if seen != wanted:
            raise RuntimeError(f"partition {part} had {wanted} ids when they were counted and has {seen} now")
        if rest:
            yield cut(rest + pad * (length - len(rest) // width), number)[0]

    return tokens.mapInArrow(run, "shard long, slot long, record binary"), total


def write_shards(tokens: DataFrame, folder: str, key: int, length: int = LENGTH, width: int = 1, end: int = END,
                 fill: int = FILL, shard_records: int = SHARD_RECORDS) -> int:
    """Write the packed ``ids`` of all rows as shards below ``folder``; returns the number of records."""
    placed, total = sequences(tokens, key, length, width, end, fill, shard_records)
    if not total:
        return 0
    placed.repartition(-(-total // shard_records), "shard").sortWithinPartitions("shard", "slot") \
        .select("shard", F.col("record").cast("string").alias("value")) \
        .write.partitionBy("shard").option("lineSep", "\n").text(folder)
    return total


def read_shards(spark: SparkSession, folder: str, length: int = LENGTH, width: int = 1,
                shard_records: int = SHARD_RECORDS) -> DataFrame:
    """(``slot``, ``shard``, ``place``, ``record``) of every record below ``folder``."""
    stride = length * width + 1

    def run(batches):
        for batch in pieces(batches, 1):
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(content) % stride:
                    raise ValueError(f"shard {shard} is not a whole number of records")
                n = len(content) // stride
                yield pa.RecordBatch.from_arrays([
                    pa.array(shard * shard_records + np.arange(n)), pa.array(np.full(n, shard)), pa.array(np.arange(n)),
                    pa.array([content[k * stride:(k + 1) * stride - 1] for k in range(n)], pa.binary())],
                    names=["slot", "shard", "place", "record"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder)
    return files.select(F.regexp_extract("path", r"shard=(\d+)", 1).cast("long").alias("shard"), "content") \
        .mapInArrow(run, "slot long, shard long, place long, record binary")


def report(df: DataFrame, key: int = 20240229) -> DataFrame:
    """Write all of ``df`` (text) and read it back: one row per record with its digest."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    if not write_shards(byte_ids(df), folder, key):
        return spark.createDataFrame([], "slot long, shard long, place long, n_ids long, sha256 string")
    return read_shards(spark, folder).select(
        "slot", "shard", "place", F.octet_length("record").cast("long").alias("n_ids"), F.sha2("record", 256).alias("sha256"))
