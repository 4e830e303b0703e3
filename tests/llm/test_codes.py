"""Operator 13 against Lloyd's rounds written with plain integers."""

import hashlib
import math
import random
from collections import defaultdict

import pytest

from tidewright.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def single(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


def plain(rows, entries=256, rounds=4, parts=4):
    kept = [(i, [math.floor(1024 * single(x)) for x in v], lab) for i, v, lab in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v, _ in kept), default=0)
    w = -(-width // parts)
    kept = [(i, v + [0] * (w * parts - len(v)), lab) for i, v, lab in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = [[v[p * w:(p + 1) * w] for p in range(parts)] for _, v, _ in kept]
    book = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(book[p]))

    for _ in range(rounds):
        groups = defaultdict(list)
        for c in cut:
            for p in range(parts):
                groups[p, nearest(c[p], p)[1]].append(c[p])
        for (p, k), members in groups.items():
            book[p][k] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    out, by_label = [], defaultdict(int)
    for (i, _, lab), c in zip(kept, cut, strict=True):
        found = [nearest(c[p], p) for p in range(parts)]
        error = sum(d for d, _ in found)
        by_label[lab] += error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, lab))
    digest = hashlib.sha256(",".join(str(x) for part in book for e in part for x in e).encode()).hexdigest()
    return [(i, c, e, by_label[lab], digest) for i, c, e, lab in out]


def vectors(n, width, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        v = [rng.choice([rng.gauss(0, 0.2), 0.0, 0.25, -0.0009]) for _ in range(width)]
        out.append((i * 3 - 50, v, rng.choice([None, 1, 1, 2, 7])))
    return out


def shown(df):
    return sorted(map(tuple, df.collect()), key=lambda r: tuple((x is None, x) for x in r))


def expected(rows, **how):
    return sorted(plain(rows, **how), key=lambda r: tuple((x is None, x) for x in r))


def test_codes_of_all_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(400, 8) + [(None, [0.5] * 8, 3), (None, [0.25] * 8, None), (-60, None, 1), (-61, [0.1] * 7 + [None], 1), (-62, [nan] * 8, 1),
                              (-63, [inf] + [0.0] * 7, 2), (-64, [0.0] * 7 + [-inf], 2), (-45, [0.0] * 8, 2), (-45, [0.0] * 8, 2), (-45, [0.125] * 8, 2)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", code string, error int").repartition(3)
    got = shown(codes.report(df))
    assert len(got) == 405 and got == expected(rows)


@pytest.mark.parametrize("pack", [1, 7, 64])
def test_packs_change_nothing(spark, monkeypatch, pack):
    monkeypatch.setattr(codes, "PACK", pack)
    rows = vectors(80, 12, seed=5)
    assert shown(codes.report(spark.createDataFrame(rows, SCHEMA).repartition(2))) == expected(rows)


def test_lengths_that_the_parts_do_not_divide(spark):
    rows = [(i, v[:random.Random(i).choice([0, 3, 6])], lab) for i, v, lab in vectors(50, 6, seed=8)]
    assert shown(codes.report(spark.createDataFrame(rows, SCHEMA))) == expected(rows)


def test_large_components(spark):
    rows = [(i, [x * 2000 for x in v], lab) for i, v, lab in vectors(60, 8, seed=3)]
    assert shown(codes.report(spark.createDataFrame(rows, SCHEMA))) == expected(rows)
    far = spark.createDataFrame([(1, [3e38, -3e38, 1e30, 0.0], 1), (2, [0.0] * 4, 1)], SCHEMA)
    assert {r.vec_id for r in codes.report(far).collect()} == {1, 2}


def test_fewer_entries_and_many_labels(spark, monkeypatch):
    monkeypatch.setattr(codes, "FEW_LABELS", 2)
    rows = vectors(90, 8, seed=11)
    found = codes.compress(spark.createDataFrame(rows, SCHEMA), entries=5, rounds=2)
    got = codes.with_label_error(found.vectors).collect()
    want = expected(rows, entries=5, rounds=2)
    assert sorted((r.vec_id, bytes(r.code).hex(), r.error, r.label_error, found.digest()) for r in got) == want
    with pytest.raises(ValueError):
        codes.compress(spark.createDataFrame(rows, SCHEMA), entries=257)


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(5, [], None)], [(1, [0.5] * 4, None)] * 3])
def test_small_tables(spark, rows):
    assert shown(codes.report(spark.createDataFrame(rows, SCHEMA))) == expected(rows)
