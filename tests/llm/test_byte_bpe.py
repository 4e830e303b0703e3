"""Operator 7 against tiktoken and by an exact round trip."""

import base64
import hashlib
import struct

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewright.llm import byte_bpe

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = ["", None, "Hello  world\n\n  x", "naïve 💩 café ½   \u0085y \x1c z", "'S 's don't", "a" * 3000, "0" * 500, " " * 400 + "x",
         "<|endoftext|> <|startoftext|>", "\x00\x01�퟿", "漢字かな 한국어 العربية", "\t\t\r\n\x0b\x0c  　x  "]


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_report_equals_tiktoken(spark, reference):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "x"), (3, "again"), (3, "again")]
    df = spark.createDataFrame([(i, t, b"x") for i, t in rows], "doc_id long, text string, ids binary")
    want = []
    for i, t in rows:
        ids = reference.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, byte_bpe.encode_decode_report(df, RANKS).collect()), key=key) == sorted(want, key=key)


def test_pattern_is_the_one_built_in():
    assert byte_bpe.PATTERN == public_tokenizers.PATTERN


def test_merges_give_the_vocabulary_back():
    tokens = byte_bpe.token_bytes(RANKS)
    assert sorted({a + b for a, b in byte_bpe.merges_of(tokens)} | {bytes([b]) for b in range(256)}) == sorted(tokens)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_ids_equal_tiktoken(reference, text):
    assert byte_bpe.tokenizer(RANKS).encode(text, add_special_tokens=False).ids == reference.encode_ordinary(text)


def test_offsets_cover_split_characters(spark):
    df = spark.createDataFrame([(1, "ab 💩 é")], "doc_id long, text string")
    row = byte_bpe.encode(df, RANKS, offsets=True).collect()[0]
    starts, stops = ([*struct.iter_unpack("<I", bytes(x))] for x in (row.starts, row.stops))
    assert len(starts) == len(row.ids) // 4
    covered = {c for (a,), (b,) in zip(starts, stops, strict=True) for c in range(a, b)}
    assert covered == set(range(6))
    assert sum(a <= (3,) < b for a, b in zip(starts, stops, strict=True)) > 1  # one character, several tokens


def test_decoding_may_end_within_a_character(spark):
    df = spark.createDataFrame([(1, "💩")], "doc_id long, text string")
    ids = bytes(byte_bpe.encode(df, RANKS).collect()[0].ids)
    parts = spark.createDataFrame([(ids[:4],), (ids[4:],), (None,), (b"",)], "ids binary")
    whole = b"".join(bytes(r.decoded) for r in byte_bpe.decode(parts, RANKS).collect())
    assert whole == "💩".encode()


def test_empty_table(spark):
    assert byte_bpe.encode_decode_report(spark.createDataFrame([], "doc_id long, text string"), RANKS).collect() == []
