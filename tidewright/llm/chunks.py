"""Chunks of texts that are asked about each other in bulk.

Operators on substrings first deal the documents to chunks of a few megabytes. A chunk
sums up its sorted distinct hashes and sends each bucket of hash values one packed row; the
task of a bucket sees the same hash from all chunks and answers with one bit or one number per hash, in the
order in which they came. So a string that fills the corpus costs each bucket one entry per
chunk, nothing is ever gathered per document or per key, and no position leaves its chunk.

The texts are dealt once: all steps read the same exchange, which Spark reuses.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.arrowtext import U64, give_back

#: Bytes of text in a chunk, and of all texts per bucket, roughly.
CHUNK_BYTES, BUCKET_BYTES = 4 << 20, 32 << 20
#: Id by which rows without an id are ordered: after all others.
LAST = np.iinfo(np.int64).max


def chunked(df: DataFrame, id: str = "doc_id", text: str = "text", chunk_bytes: int | None = None) -> tuple[DataFrame, int]:
    """(``chunk``, ``doc_id``, ``text``) dealt by chunk, and the number of buckets that suits the amount of text."""
    rows = df.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(least, -(-total // (chunk_bytes or CHUNK_BYTES)))
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("chunk")
    return rows.select(chunk, "doc_id", "text").repartition(n, "chunk"), max(least, -(-total // BUCKET_BYTES))


def ids(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").fill_null(LAST).to_numpy()


def bounds(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins among sorted hashes; buckets are equal ranges of the leading 32 bits."""
    of = ((hashes >> U64(32)) * U64(buckets)) >> U64(32)
    return np.searchsorted(of, np.arange(buckets + 1, dtype=U64))


def packed(chunk: int, edges: np.ndarray, **arrays: np.ndarray) -> pa.Table:
    """One row per bucket that has entries: ``bucket``, ``chunk`` and the bytes of each array's part; booleans as bits."""
    full = np.flatnonzero(np.diff(edges))
    columns = {"bucket": pa.array(full, pa.int32()), "chunk": pa.array(np.full(len(full), chunk), pa.int32())}
    for name, values in arrays.items():
        cut = [values[edges[b]:edges[b + 1]] for b in full]
        columns[name] = pa.array([(np.packbits(c) if c.dtype == bool else c).tobytes() for c in cut], pa.binary())
    return pa.table(columns)


def unpacked(column: pa.ChunkedArray, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """All entries of a packed column, and the number of entries in each row."""
    parts = [np.frombuffer(x, dtype) for x in column.to_pylist()]
    return (np.concatenate(parts) if parts else np.zeros(0, dtype)), np.array([len(p) for p in parts], np.int64)


def unpacked_bits(column: pa.ChunkedArray, sizes: np.ndarray) -> np.ndarray:
    parts = [np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool)
             for x, n in zip(column.to_pylist(), sizes, strict=True)]
    return np.concatenate(parts) if parts else np.zeros(0, bool)


ANSWER = "chunk int, bucket int, step int, answer binary"


def answers(table: pa.Table, step: int, sizes: np.ndarray, values: np.ndarray) -> pa.Table:
    """Give every row its part of ``values`` back, for the chunk that sent it."""
    edges = np.concatenate([[0], np.cumsum(sizes)])
    cut = [values[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return pa.table({
        "chunk": table.column("chunk"), "bucket": table.column("bucket"),
        "step": pa.array(np.full(len(cut), step), pa.int32()),
        "answer": pa.array([(np.packbits(c) if c.dtype == bool else c).tobytes() for c in cut], pa.binary())})


def answered(replies: pa.Table, step: int, edges: np.ndarray, dtype: str = "bool") -> np.ndarray:
    """The answers to one step's entries, in the order of the entries."""
    out = np.zeros(edges[-1], dtype)
    for own, bucket, answer in zip(*(replies.column(c).to_pylist() for c in ("step", "bucket", "answer")), strict=True):
        if own == step:
            a, b = edges[bucket], edges[bucket + 1]
            out[a:b] = (np.unpackbits(np.frombuffer(answer, np.uint8), count=b - a).astype(bool) if dtype == "bool"
                        else np.frombuffer(answer, dtype))
    return out


def _lean(function):
    """The function, which gives its memory back after every group."""
    def run(*tables):
        try:
            return function(*tables)
        finally:
            give_back()
    return run


def ask(texts: DataFrame, replies: DataFrame | None, function, schema: str) -> DataFrame:
    """Run ``function(texts, replies)`` on the Arrow tables of every chunk; the first step has no replies."""
    if replies is None:
        first = _lean(lambda t: function(t, None))
        return texts.groupBy("chunk").applyInArrow(lambda t: first(t), schema)
    both = _lean(function)
    return texts.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(lambda t, r: both(t, r), schema)


def meet(sent: DataFrame, function) -> DataFrame:
    """Run ``function`` on all rows of every bucket; it answers each."""
    lean = _lean(function)
    return sent.groupBy("bucket").applyInArrow(lambda t: lean(t), ANSWER)
