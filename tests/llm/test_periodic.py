"""Operator 11 against a search over all periods of every text."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import arrowtext, periodic


def plain_runs(words):
    """Every stretch that a period q holds and no neighbour continues; of equal stretches the smallest period."""
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                out.setdefault((i, j + q), q)
            i = j
    return sorted((a, b - a, q) for (a, b), q in out.items())


def found(texts):
    ids = np.array([w for t in texts for w in t], np.int64)
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    begin, stop, period = periodic.runs_of(ids, arrowtext.mix(ids.astype(np.uint64) + np.uint64(9)), first)
    out = [[] for _ in texts]
    for a, b, q in zip(begin.tolist(), stop.tolist(), period.tolist(), strict=True):
        d = int(np.searchsorted(first, a, "right")) - 1
        out[d].append((a - int(first[d]), b - a, q))
    return out


def texts(seed):
    rng = random.Random(seed)
    out = [[], [1], [1] * 11, [1] * 12, [1] * 13, [1, 2] * 6, [1, 2] * 5 + [1], [1, 2, 3] * 40, [7] * 500]
    for letters in (1, 2, 3, 9, 200):
        for _ in range(12):
            own = [rng.randrange(letters) for _ in range(rng.randrange(120))]
            for _ in range(rng.randrange(4)):
                block = [rng.randrange(letters) for _ in range(rng.randint(1, 30))]
                stretch = (block * 20)[:rng.randint(1, 12 * len(block))]
                at = rng.randint(0, len(own))
                own[at:at] = stretch
            out += [own] * rng.choice([1, 1, 3])
    fibonacci = [[0], [0, 1]]
    while len(fibonacci[-1]) < 300:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    morse = [bin(i).count("1") % 2 for i in range(256)]
    return out + [fibonacci[-1], morse, morse + morse, [0, 0, 1] * 30 + [0, 0, 2] * 30]


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_every_text(seed):
    own = texts(seed)
    want = [plain_runs(t) for t in own]
    assert sum(map(len, want)) > 300
    assert found(own) == want
    assert [found([t])[0] for t in own] == want


@pytest.mark.parametrize("rounds, candidates", [(0, 1), (1, 50), (3, 1 << 18)])
def test_no_grammar_changes_the_runs(monkeypatch, rounds, candidates):
    monkeypatch.setattr(periodic, "ROUNDS", rounds)
    monkeypatch.setattr(periodic, "CANDIDATES", candidates)
    own = texts(9)
    assert found(own) == [plain_runs(t) for t in own]


def test_long_thue_morse_text():
    """Words whose stretches of 2,048 have equal sums in 64 bits."""
    morse = [bin(i).count("1") % 2 for i in range(1 << 13)]
    own = morse + [5] + morse[:4096] + morse[:4096] + [1 - w for w in morse[:4096]]
    got = found([own])[0]
    assert (len(morse) + 1, 8192, 4096) in got
    for a, size, q in got:
        assert own[a:a + size - q] == own[a + q:a + size]
        assert a == 0 or own[a - 1] != own[a - 1 + q]
        assert a + size == len(own) or own[a + size] != own[a + size - q]


def test_grammar_is_shared_by_copies():
    own = [random.Random(1).randrange(50) for _ in range(400)]
    one = len(np.unique(periodic.grammar(np.array(own * 2), np.array([0, 400, 800]))[0]))
    many = len(np.unique(periodic.grammar(np.array(own * 40), np.arange(0, 16001, 400))[0]))
    assert many == one


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(doc_id, text, planted=False):
    words = "".join(" " if c in " \t\n\x0b\f\r" else c for c in text or "").split(" ")
    words = [w for w in words if w]
    n = len(words)
    if planted and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for a, size, q in runs for i in range(a + q, a + size)}
    best = min(((-size, a, q) for a, size, q in runs), default=None)
    shown = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *shown, sha("".join(f"{a},{s},{q}\n" for a, s, q in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def rows():
    rng = random.Random(3)
    out = [(None, "a b " * 20), (1, None), (2, ""), (3, " \n\t "), (4, "x"), (5, "é\x0b" * 30), (6, "y z\n" * 9 + "y"), (6, "y z\n" * 9 + "y"),
           (7, "a\x85b\xa0c " * 15), (-8, "q " * 13)]
    for i in range(150):
        own = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(90))]
        block = [f"w{rng.randrange(40)}" for _ in range(rng.randint(1, 9))]
        out.append((i * 7 + 100, rng.choice([" ", "\n", "  "]).join(own + block * rng.randrange(9) + own[:5])))
    return out


def ordered(found):
    return sorted(map(tuple, found), key=lambda r: tuple((x is None, x) for x in r))


def test_report(spark):
    own = rows()
    df = spark.createDataFrame([(i, t, 1, "r") for i, t in own], "doc_id long, text string, n_words int, runs string").repartition(3)
    assert ordered(periodic.report(df).collect()) == ordered(expected(*r) for r in own)


def test_replayed_texts(spark):
    own = rows()
    df = spark.createDataFrame([(i, t, "r") for i, t in own], "doc_id long, text string, words string")
    assert ordered(periodic.report(periodic.replayed(df)).collect()) == ordered(expected(*r, planted=True) for r in own)


def test_spans_and_collapsed_text(spark):
    df = spark.createDataFrame([(1, "s " + "a b c " * 10 + "e")], "doc_id long, text string")
    [row] = periodic.periodic_runs(df).collect()
    assert row.n_words == 32 and [tuple(r) for r in row.runs] == [(1, 30, 3)] and row.collapsed == "s a b c e"


def test_pieces_of_long_texts(spark, monkeypatch):
    own = rows() + [(9001, "m n o " * 40_000 + "end")]
    df = spark.createDataFrame(own, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in periodic.periodic_runs(df.where(F.col("doc_id") > 8)).collect()}
    assert [tuple(r) for r in got[9001].runs] == [(0, 120_000, 3)] and got[9001].collapsed == "m n o end"


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.report(periodic.replayed(df)).collect() == []
