"""Byte-level BPE encoding and decoding (operator 7).

Encoding runs the ``tokenizers`` library over Arrow batches. Byte-level BPE sees a text as
UTF-8 bytes, each shown as one printable character; the table of these characters, the
vocabulary and the merges are all derived from a rank file. Decoding looks every id up in
the table of its bytes and joins them, so a character split over several tokens comes back
whole, and ids that end within a character still decode to their exact bytes.

A missing or empty text gives no ids. Rows are independent, repeated rows give repeated
results, and other columns of the input are not looked at.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.arrowtext import kept, pieces, sized

#: Bytes of text that are handed to the library at once; bounds the memory of its results.
BLOCK_BYTES = 1 << 18
#: Splitting pattern of the byte-level vocabularies here, which the library has built in.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if it prints in Latin-1, else one from U+0100 on."""
    prints = [33 <= b <= 126 or 161 <= b <= 172 or 174 <= b for b in range(256)]
    spare = iter(range(256, 512))
    return [chr(b) if prints[b] else chr(next(spare)) for b in range(256)]


@lru_cache(2)
def token_bytes(path: str) -> list[bytes]:
    """Bytes of each id, from a file with a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    return [ranks[i] for i in range(len(ranks))]


def merges_of(tokens: list[bytes]) -> list[tuple[bytes, bytes]]:
    """The pair that each longer token is joined from: what merging by lower ranks leaves of it."""
    rank = {token: i for i, token in enumerate(tokens)}
    pairs = []
    for own, token in enumerate(tokens):
        parts = [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: rank.get(parts[i] + parts[i + 1], own))
            if rank.get(parts[best] + parts[best + 1], own) >= own:
                break
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        if len(parts) == 2:
            pairs.append((parts[0], parts[1]))
        elif len(parts) > 2:
            raise ValueError(f"rank {own} is not a merge of two tokens of lower rank")
    return pairs


def tokenizer(path: str):
    return kept("tokenizer", path, lambda: _made(path))


def _made(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer
    from tokenizers.models import BPE
    from tokenizers.pre_tokenizers import ByteLevel

    shown = byte_characters()
    name = lambda token: "".join(shown[b] for b in token)
    tokens = token_bytes(path)
    made = Tokenizer(BPE({name(t): i for i, t in enumerate(tokens)}, [(name(a), name(b)) for a, b in merges_of(tokens)]))
    made.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=True)
    return made


def _blocks(texts: list[str]):
    block, size = [], 0
    for text in texts:
        block.append(text)
        size += len(text)
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def _joined(table: np.ndarray, ids: bytes | None) -> bytes:
    """The bytes that packed ids stand for."""
    return b"".join(table[np.frombuffer(ids or b"", "<u4")].tolist())


def encode(df: DataFrame, ranks: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
           offsets: bool = False, decoded: bool = False) -> DataFrame:
    """``keep``, ``ids`` (little-endian unsigned 32-bit integers) and, if asked for, ``starts`` and ``stops``, and ``decoded``.

    ``starts``/``stops`` are the characters each token covers, packed likewise; the tokens
    of a split character all cover that character. ``decoded`` is what ``decode`` makes of the ids, in the same task.
    """
    packed = [("ids", pa.binary())] + [("starts", pa.binary()), ("stops", pa.binary())] * offsets + [("decoded", pa.binary())] * decoded
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [f"{n} binary" for n, _ in packed])

    def run(batches):
        made = tokenizer(ranks)
        many = made.encode_batch if offsets else made.encode_batch_fast
        table = np.array([*token_bytes(ranks)], object) if decoded else None
        for batch in sized(batches, len(keep), BLOCK_BYTES):
            columns = [[] for _ in packed]
            for block in _blocks([t or "" for t in batch.column(len(keep)).to_pylist()]):
                for got in many(block, add_special_tokens=False):
                    columns[0].append(np.array(got.ids, "<u4").tobytes())
                    if offsets:
                        spans = np.array(got.offsets, "<u4").reshape(-1, 2)
                        columns[1].append(spans[:, 0].tobytes())
                        columns[2].append(spans[:, 1].tobytes())
                    if decoded:
                        columns[-1].append(_joined(table, columns[0][-1]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], *(pa.array(c, kind) for c, (_, kind) in zip(columns, packed, strict=True))],
                names=[*keep, *(n for n, _ in packed)])

    return df.select(*keep, F.col(text).cast("string").alias("text to encode")).mapInArrow(run, schema)


def decode(df: DataFrame, ranks: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """All columns of ``df`` and the exact bytes that ``ids`` stand for; missing ids give no bytes."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{into}` binary"
    at = df.columns.index(ids)

    def run(batches):
        table = np.array([*token_bytes(ranks)], object)
        for batch in pieces(batches):
            joined = [_joined(table, x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(joined, pa.binary())], names=[*batch.schema.names, into])

    return df.mapInArrow(run, schema)


def encode_decode_report(df: DataFrame, ranks: str) -> DataFrame:
    """Per row of ``documents``: count and digest of its ids, and the digest of what they decode to."""
    back = encode(df, ranks, decoded=True)
    return back.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
