"""Vectors compressed to one byte a part by per-dimension value dictionaries (operator 13).

Vectors of integers are cut into ``PARTS`` equal parts, and each part is replaced by the number of its nearest
codebook entry. Lloyd's rounds fit the codebooks to all vectors, all in integers, so the result is the same however
the rows are dealt.

Vectors are packed once, some thousands to a row: per dimension the dictionary of the distinct integers that occur, and
for each vector the number of its integer in it. For a codebook, a task tabulates the squared differences of each
integer of a dictionary to all entries; the distances of a part to all entries are then sums of rows of these tables, taken by
the codes, and no difference is computed twice in a pack. A round reads the packs, adds up the parts of each
entry task by task, and the driver gets one row per part and entry.

Rows whose vector is missing, or holds a missing or non-finite component, are dropped. Shorter vectors, and lengths that
the parts do not divide, are filled up with zeros at the end. Components so large that a squared distance might not
fit 62 bits count as the largest that does. Entries start as the parts of the vectors with the smallest ids (missing ids
last, equal ones by the vector); fewer rows make a smaller codebook. Repeated rows repeat; an empty table gives an empty
result. Missing labels are one label. Other columns are passed over.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.arrowtext import give_back
from tidewright.session import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors of a pack; the codes of its dictionaries fit 16 bits.
PACK = 4096
#: Labels up to this number are sent to all tasks with their sums; more are joined, each in so many salted parts.
FEW_LABELS, SALTS = 100_000, 16


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component; null where the vector is missing or has a component that is not a finite number."""
    value, top = vector.cast("array<double>"), F.lit(2.0 ** 62)
    finite = F.forall(value, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))  # not-a-number is largest
    return F.when(finite, F.transform(value, lambda x: F.floor(F.greatest(F.least(x * float(scale), top), -top))))


def limit(width: int) -> int:
    """A magnitude of components up to which squared distances of vectors of ``width`` stay below 2^62."""
    return 1 << (60 - width.bit_length()) // 2


def _whole(vector: pa.ListArray, width: int) -> np.ndarray:
    """The vectors as rows of ``width`` integers, filled up with zeros."""
    lengths = np.diff(vector.offsets.to_numpy())
    out = np.zeros((len(vector), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = vector.flatten().to_numpy(zero_copy_only=False)
    most = limit(width)
    return np.clip(out, -most, most, out=out)


def _packed(rows: DataFrame, width: int) -> DataFrame:
    """Packs of the rows (``vec_id``, ``label``, ``vector``): ids, labels, and dictionaries and codes of every dimension."""
    kind = rows.schema["label"].dataType.simpleString()
    schema = f"vec_ids array<bigint>, labels array<{kind}>, sizes array<int>, dictionaries array<bigint>, codes binary"
    names = ["vec_ids", "labels", "sizes", "dictionaries", "codes"]

    def pack(batches):
        table = pa.Table.from_batches(batches).combine_chunks()
        ids, labels, vector = (c.chunk(0) for c in table.columns)
        whole = _whole(vector, width)
        found = [np.unique(whole[:, d], return_inverse=True) for d in range(width)]
        none = np.zeros(0, np.int64)
        lists = [ids, labels, pa.array([len(v) for v, _ in found], pa.int32()), pa.array(np.concatenate([none, *(v for v, _ in found)]))]
        codes = np.concatenate([none, *(c for _, c in found)]).astype("<u2").tobytes()
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists] + [pa.array([codes], pa.binary())], names=names)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, PACK):
                piece = batch.slice(at, PACK)
                if n + piece.num_rows > PACK:
                    yield pack(held)
                    held, n = [], 0
                held.append(piece)
                n += piece.num_rows
        if n:
            yield pack(held)
        give_back()

    return rows.select(F.col("vec_id").cast("long"), "label", "vector").mapInArrow(run, schema)


class _Pack:
    """One row of the packs: distances of its parts to codebook entries, from tables over its dictionaries."""

    def __init__(self, sizes: np.ndarray, dictionaries: np.ndarray, codes: bytes, n: int):
        edges = np.concatenate([[0], np.cumsum(sizes)])
        self.n, self.codes = n, np.frombuffer(codes, "<u2").reshape(-1, n)
        self.dictionary = [dictionaries[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def nearest(self, part: int, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each vector's part, the first of several, and the squared distance to it."""
        wide = entries.shape[1]
        dims = range(part * wide, (part + 1) * wide)
        reach = max([int(np.abs(self.dictionary[d]).max()) for d in dims], default=0) + int(np.abs(entries).max(initial=0))
        kind = np.int32 if reach * reach * wide < 1 << 31 else np.int64
        total, taken = np.zeros((self.n, len(entries)), kind), np.empty((self.n, len(entries)), kind)
        for at, d in enumerate(dims):
            table = self.dictionary[d].astype(kind)[:, None] - entries[:, at].astype(kind)
            table *= table
            total += np.take(table, self.codes[d], axis=0, out=taken, mode="clip")
        best = total.argmin(1)
        return best, total[np.arange(self.n), best].astype(np.int64)

    def sums(self, part: int, best: np.ndarray, entries: int, wide: int) -> np.ndarray:
        """Per entry the sum of its parts, dimension by dimension."""
        out = np.zeros((entries, wide), np.int64)
        for at in range(wide):
            d = part * wide + at
            np.add.at(out[:, at], best, self.dictionary[d][self.codes[d]])
        return out


def _packs(batch: pa.RecordBatch):
    """(row of the pack in the batch, pack) of a batch of packed rows."""
    for k in range(batch.num_rows):
        sizes, dictionaries = (batch.column(c)[k].values.to_numpy() for c in (2, 3))
        yield k, _Pack(sizes, dictionaries, batch.column(4)[k].as_py(), len(batch.column(0)[k]))


def _refined(packs: DataFrame, book: np.ndarray) -> np.ndarray:
    """The codebook after one round: each entry is the floor of the mean of the parts that are nearest to it."""
    parts, entries, wide = book.shape
    names = ["part", "entry", "n"] + [f"s{d}" for d in range(wide)]

    def run(batches):
        total, count = np.zeros((parts, entries, wide), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for _, pack in _packs(batch):
                for part in range(parts):
                    best, _ = pack.nearest(part, book[part])
                    total[part] += pack.sums(part, best, entries, wide)
                    count[part] += np.bincount(best, minlength=entries)
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part), pa.array(entry), pa.array(count[part, entry]), *(pa.array(total[part, entry, d]) for d in range(wide))], names=names)
        give_back()

    added = packs.mapInArrow(run, ", ".join(f"{c} long" for c in names)).groupBy("part", "entry").agg(
        *[F.sum(c).alias(c) for c in names[2:]])
    out = book.copy()
    for part, entry, n, *sums in added.collect():
        out[part, entry] = np.array(sums, np.int64) // n
    return out


@dataclass
class Compressed:
    """``vectors``: vec_id, label, code (a byte a part), error; ``book``: the entries by part."""

    vectors: DataFrame
    book: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.book.ravel().tolist())).encode()).hexdigest()


def compress(df: DataFrame, vector: str = "embedding", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES,
             rounds: int = ROUNDS) -> Compressed:
    """Fit codebooks to all vectors of ``df`` (``vec_id``, ``label`` and the vectors) and give each its codes."""
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    rows = df.select("vec_id", "label", scaled(F.col(vector), scale).alias("vector")).where("vector IS NOT NULL")
    width = rows.agg(F.max(F.size("vector"))).collect()[0][0] or 0
    width = -(-width // parts) * parts
    packs = materialize(_packed(rows, width), "packs")
    first = rows.select("vec_id", "vector").orderBy(F.col("vec_id").cast("long").asc_nulls_last(), "vector").limit(entries).collect()
    start = _whole(pa.array([r.vector for r in first], pa.list_(pa.int64())), width)
    book = start.reshape(len(first), parts, width // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds if len(first) else 0):
        book = _refined(packs, book)

    def run(batches):
        for batch in batches:
            for k, pack in _packs(batch):
                found = [pack.nearest(part, book[part]) for part in range(parts)]
                code = np.stack([best for best, _ in found], 1).astype(np.uint8)
                ids, labels = (batch.column(c)[k].values for c in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [ids, labels, pa.array([c.tobytes() for c in code], pa.binary()), pa.array(sum(d for _, d in found))],
                    names=["vec_id", "label", "code", "error"])
        give_back()

    kind = rows.schema["label"].dataType.simpleString()
    return Compressed(packs.mapInArrow(run, f"vec_id bigint, label {kind}, code binary, error bigint"), book)


def with_label_error(vectors: DataFrame) -> DataFrame:
    """``vectors``, written once, with the errors of all rows of the same label added up as ``label_error``."""
    vectors = materialize(vectors, "codes")
    sums = vectors.groupBy("label").agg(F.sum("error").alias("label_error"))
    if sums.count() <= FEW_LABELS:
        sums = F.broadcast(sums.withColumnRenamed("label", "of"))
        return vectors.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of")
    salted = sums.select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    own = F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS))
    return vectors.join(salted, F.col("label").eqNullSafe(F.col("of")) & (own == F.col("salt"))).drop("of", "salt")


def report(df: DataFrame) -> DataFrame:
    found = compress(df)
    return with_label_error(found.vectors).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(found.digest()).alias("codebooks_sha256"))
