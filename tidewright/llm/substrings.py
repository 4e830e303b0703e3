"""Exact repeats of 35 words removed with fixed-block anchors (operator 5).

Every text is cut into blocks of ``BLOCK`` words that do not overlap; these are the index. A
window of ``WINDOW`` words holds at least one whole block wherever it starts, so of two equal windows
one's block is found by probing the index with every rolling window of ``BLOCK`` words. Hits
are extended to all windows of ``WINDOW`` words around them, and those that occur
again, anywhere, make up the maximal exact repeats. Every word they cover goes.

Probes meet the index as 32-bit fingerprints within a bucket: a chance hit costs a look at
the windows around it and changes nothing. The windows themselves are compared by 64-bit hashes.

A missing text has no words. Repeated rows are repeats of each other like any other texts;
rows without an id are treated alike. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.arrowtext import covered, flat, gram_hashes, inside, marked, words
from tidewright.llm.chunks import answered, answers, ask, bounds, chunked, meet, packed, unpacked, unpacked_bits

WINDOW = 35
BLOCK = 18  # the longest blocks of which any 35 words hold a whole one
_PROBES = "bucket int, chunk int, prints binary, again binary, index binary"
_WINDOWS = "bucket int, chunk int, hashes binary, again binary"
RESULT = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,stop:long>>, kept string"


class _Chunk:
    """Words, probes and, once hits are known, candidate windows of one chunk."""

    def __init__(self, texts: pa.Table, buckets: int):
        self.column, self.buckets = texts.column("text"), buckets
        self.words = words(self.column)
        self.hashes, self.first = self.words.hashes(), self.words.first
        self.at = np.flatnonzero(inside(self.first, BLOCK))
        self.prints, self.where, n = np.unique(
            gram_hashes(self.hashes, BLOCK)[self.at], return_inverse=True, return_counts=True)
        self.again, self.edges = n > 1, bounds(self.prints, buckets)

    def index(self) -> np.ndarray:
        """Which of the distinct probes stand on a block of the index."""
        begins = np.repeat(self.first[:-1], np.diff(self.first))
        aligned = (self.at - begins[self.at]) % BLOCK == 0
        out = np.zeros(len(self.prints), bool)
        out[self.where[aligned]] = True
        return out

    def extend(self, hits: np.ndarray) -> None:
        """Distinct hashes of the windows that hold a hit."""
        total = len(self.hashes)
        back = np.maximum(self.at[hits[self.where]] - (WINDOW - BLOCK), 0)
        near = covered(marked(back, total), WINDOW - BLOCK + 1)
        valid = inside(self.first, WINDOW)
        self.starts = np.flatnonzero(near[:len(valid)] & valid)
        self.windows, self.of, n = np.unique(
            gram_hashes(self.hashes, WINDOW)[self.starts], return_inverse=True, return_counts=True)
        self.windows_again, self.window_edges = n > 1, bounds(self.windows, self.buckets)


def _probe(buckets: int):
    def run(texts, _):
        c = _Chunk(texts, buckets)
        return packed(texts.column("chunk")[0].as_py(), c.edges, prints=c.prints.astype("<u4"), again=c.again, index=c.index())
    return run


def _hits(rows: pa.Table) -> pa.Table:
    prints, sizes = unpacked(rows.column("prints"), "<u4")
    again, index = (unpacked_bits(rows.column(c), sizes) for c in ("again", "index"))
    _, where = np.unique(prints, return_inverse=True)
    seen = np.bincount(where, 1 + again)
    indexed = np.bincount(where, index) > 0
    return answers(rows, 1, sizes, (seen >= 2)[where] & indexed[where])


def _extend(buckets: int):
    def run(texts, replies):
        c = _Chunk(texts, buckets)
        c.extend(answered(replies, 1, c.edges))
        return packed(texts.column("chunk")[0].as_py(), c.window_edges, hashes=c.windows, again=c.windows_again)
    return run


def _repeated(rows: pa.Table) -> pa.Table:
    hashes, sizes = unpacked(rows.column("hashes"), "<u8")
    _, where = np.unique(hashes, return_inverse=True)
    seen = np.bincount(where, 1 + unpacked_bits(rows.column("again"), sizes))
    return answers(rows, 2, sizes, (seen >= 2)[where])


def runs(mask: np.ndarray) -> np.ndarray:
    """Pairs (start, stop) of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return edge.reshape(-1, 2)


def _cut(buckets: int):
    def run(texts, replies):
        c = _Chunk(texts, buckets)
        c.extend(answered(replies, 1, c.edges))
        again = answered(replies, 2, c.window_edges)
        gone = covered(marked(c.starts[again[c.of]], len(c.hashes)), WINDOW)
        data, offsets = flat(c.column)
        spans, kept, removed = [], [], []
        for d in range(texts.num_rows):
            own = gone[c.first[d]:c.first[d + 1]]
            parts = data[offsets[d]:offsets[d + 1]].tobytes().split()
            removed.append(int(own.sum()))
            spans.append([{"start": int(a), "stop": int(b)} for a, b in runs(own)] if removed[-1] else [])
            kept.append(b" ".join(compress(parts, ~own) if removed[-1] else parts))
        return pa.table({
            "doc_id": texts.column("doc_id"), "n_words": pa.array(c.words.counts(), pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
            "kept": pa.array(kept, pa.binary()).cast(pa.string())})
    return run


def remove_repeats(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: number of words, removed words and their ``spans``, and the ``kept`` words joined by one space."""
    texts, buckets = chunked(df, id, text)
    hits = meet(ask(texts, None, _probe(buckets), _PROBES), _hits)
    again = meet(ask(texts, hits, _extend(buckets), _WINDOWS), _repeated)
    return ask(texts, hits.unionByName(again), _cut(buckets), RESULT)


def report(df: DataFrame) -> DataFrame:
    return remove_repeats(df).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))

