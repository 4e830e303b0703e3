"""Operators 2 and 5 against plain dictionaries of windows."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import arrowtext, chunks, substrings, suffixes


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passages = [text(n) for n in (34, 35, 36, 50, 90, 150)]
    docs = []
    for i in range(120):
        parts = [text(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages).split()
            a = rng.randint(0, 5)
            parts += [rng.choice([" ".join(p), " ".join(p[a:]), "\n".join(p)]), text(rng.randint(0, 20))]
        docs.append((i * 3, " ".join(parts)))
    docs += [(401, None), (402, ""), (403, " \t\n"), (404, docs[5][1]), (405, docs[5][1]), (405, docs[5][1]), (None, docs[7][1]),
             (None, docs[7][1]), (406, "a" * 300), (407, "b" + "a" * 120), (408, "xy" * 90), (409, "é" * 60 + passages[3]),
             (410, "ab " * 200), (411, "x" * 49), (412, "x" * 50), (413, "x" * 50), (2, passages[5] + "\x0b" + passages[4]),
             (414, passages[4][:60]), (415, passages[4][:49] + "!"), (416, passages[4][:50] + "!")]
    rng.shuffle(docs)
    return docs


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, chunk int, `bucket` string")
    return rows, df.repartition(3)


def sorted_rows(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x) for x in r))


def known_bytes(rows):
    data = [(chunks.LAST if i is None else i, (t or "").encode()) for i, t in rows]
    least = defaultdict(lambda: chunks.LAST)
    for i, b in data:
        for s in range(len(b) - 49):
            least[b[s:s + 50]] = min(least[b[s:s + 50]], i)
    out = []
    for (shown, _), (i, b) in zip(rows, data, strict=True):
        gone = [False] * len(b)
        for s in range(len(b) - 49):
            if least[b[s:s + 50]] < i:
                gone[s:s + 50] = [True] * 50
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((shown, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_known_bytes(docs):
    rows, df = docs
    assert sorted_rows(suffixes.report(df).collect()) == sorted_rows(known_bytes(rows))


def test_spans_and_kept_bytes_fit_the_text(docs):
    rows, df = docs
    texts = {i: (t or "").encode() for i, t in rows if i is not None}
    for r in suffixes.remove_known_bytes(df).where("doc_id IS NOT NULL").collect():
        text, at, kept = texts[r.doc_id], 0, b""
        for s in r.spans:
            kept, at = kept + text[at:s.start], s.stop
        assert kept + text[at:] == bytes(r.kept)


def repeated_words(rows):
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    count = defaultdict(int)
    for _, w in texts:
        for s in range(len(w) - 34):
            count[tuple(w[s:s + 35])] += 1
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for s in range(len(w) - 34):
            if count[tuple(w[s:s + 35])] > 1:
                gone[s:s + 35] = [True] * 35
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeated_words(docs):
    rows, df = docs
    want = repeated_words(rows)
    assert sum(r[2] for r in want) > 1000
    assert sorted_rows(substrings.report(df).collect()) == sorted_rows(want)


def test_many_chunks_and_buckets_change_nothing(docs, monkeypatch):
    rows, df = docs
    monkeypatch.setattr(chunks, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(suffixes, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(suffixes, "BLOCK", 300)
    monkeypatch.setattr(suffixes, "ORDERED_ROWS", 7)
    monkeypatch.setattr(suffixes, "HASHED_ROWS", 3)
    monkeypatch.setattr(chunks, "BUCKET_BYTES", 5000)
    assert sorted_rows(substrings.report(df).collect()) == sorted_rows(repeated_words(rows))
    assert sorted_rows(suffixes.report(df).collect()) == sorted_rows(known_bytes(rows))


@pytest.mark.parametrize("most", [0, 1, 4])
def test_strings_around_common_triggers(docs, monkeypatch, most):
    rows, df = docs
    monkeypatch.setattr(suffixes, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(suffixes, "HOT_CHUNKS", most)
    assert sorted_rows(suffixes.report(df).collect()) == sorted_rows(known_bytes(rows))


def test_a_repeat_within_one_text_only(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, f"{passage} x {passage}"), (2, "y " * 30)], "doc_id long, text string")
    got = {r.doc_id: r for r in substrings.remove_repeats(df).collect()}
    assert got[1].n_removed == 80 and got[1].kept == "x" and [tuple(s) for s in got[1].spans] == [(0, 40), (41, 81)]
    assert got[2].n_removed == 0
    assert {r.doc_id: r.n_removed for r in suffixes.report(df).collect()} == {1: 0, 2: 0}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.report(df).collect() == [] and substrings.report(df).collect() == []


def test_long_words_that_differ_everywhere(spark):
    """Thue-Morse words and their complements: polynomials modulo 2**64 take them for equal."""
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    around = [f"p{i}" for i in range(17)], [f"q{i}" for i in range(17)]
    words = [word[:1024], word[1024:], word, word.translate(str.maketrans("ab", "ba")), "ab" * 600, "ba" * 600]
    rows = [(i, " ".join([*around[0], w, *around[1]])) for i, w in enumerate(words)]
    rows += [(20, " ".join(word)), (21, " ".join(word[1024:])), (22, " ".join("ba" * 40))]
    want = repeated_words(rows)
    assert [r[2] for r in want[:6]] == [0] * 6
    assert sorted_rows(substrings.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == sorted_rows(want)


def test_very_long_text(spark):
    rng = random.Random(3)
    long = " ".join(str(rng.randint(0, 10**6)) for _ in range(200_000))
    rows = [(1, long), (2, long[500_000:500_400] + " tail")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("other", F.lit(None).cast("int"))
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffixes.report(df).collect()}
    assert got == {1: (len(long), 0), 2: (405, got[2][1])} and got[2][1] >= 400


@pytest.mark.parametrize("block", [64, 300, suffixes.BLOCK])
def test_triggers_of_every_length(monkeypatch, block):
    """Short texts, and blocks of which few bytes are left, have the triggers they would have in one piece."""
    rng = np.random.default_rng(7)
    data = rng.integers(97, 123, block + 121).astype(np.uint8)
    for length in [*range(121), *range(block, block + 121)]:
        offsets = np.array([0, length // 3, length, length])
        monkeypatch.setattr(suffixes, "BLOCK", block)
        at, hashes = suffixes.all_triggers(data[:length], offsets)
        monkeypatch.setattr(suffixes, "BLOCK", 1 << 30)
        whole, same = suffixes.all_triggers(data[:length], offsets)
        assert at.tolist() == whole.tolist() and hashes.tolist() == same.tolist()
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            begins = np.arange(a, b - suffixes.LENGTH + 1)
            assert (np.searchsorted(at, begins + suffixes.OFFSETS) > np.searchsorted(at, begins)).all()


def test_texts_of_every_length(spark, monkeypatch):
    passage = corpus()[0][1] + " ".join(str(i) for i in range(100))
    rows = [(i, passage[:i]) for i in range(121)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (150, 4000):
        monkeypatch.setattr(suffixes, "CHUNK_BYTES", size)
        assert sorted_rows(suffixes.report(df).collect()) == sorted_rows(known_bytes(rows))


def test_words_like_split():
    import pyarrow as pa

    texts = ["a b", None, "", " \t", "x", "é ü a\x0bb", "c", "\x1fd e\r\n"]
    found = arrowtext.words(pa.array(texts))
    parts = [found.data[a:b].tobytes() for a, b in zip(found.start, found.stop, strict=True)]
    assert parts == [w for t in texts for w in (t or "").encode().split()]
    assert found.counts().tolist() == [len((t or "").encode().split()) for t in texts]
