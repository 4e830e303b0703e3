"""Operator 10 against all pairs, its components against union-find."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewright.llm import minhash
from tidewright.llm.components import components


def corpus(seed=5):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghi") for _ in range(rng.randint(2, 6))) for _ in range(900)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    docs, n = [], 0
    for _ in range(25):
        base = text(rng.randint(20, 200))
        for _ in range(rng.choice([1, 2, 3, 30])):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            docs.append((n, rng.choice([" ", "\n"]).join(words)))
            n += 1
    docs += [(9000, None), (9001, ""), (9002, " \n"), (9003, "one two"), (9004, "One  TWO"), (9005, "two one"), (9006, "one"),
             (9007, docs[0][1].upper()), (9007, docs[0][1].upper()), (None, docs[1][1]), (None, "nowhere else at all"), (9008, "one two three"),
             (9009, "ONE two three one two three")]
    rng.shuffle(docs)
    return docs


def brute(rows, size, percent):
    sets = []
    for _, t in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = lowered.encode().split()
        sets.append({tuple(w[k:k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[top(i)] = top(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[top(i)] = min(least.get(top(i), doc), doc)
    return [(doc, len(sets[i]), least.get(top(i)), doc == least.get(top(i))) for i, (doc, _) in enumerate(rows)]


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize("region", [128, 8])
def test_components_equal_all_pairs(spark, monkeypatch, region):
    monkeypatch.setattr(minhash, "REGION", region)
    rows = corpus()
    df = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, node string").repartition(3)
    assert ordered(minhash.report(df).collect()) == ordered(brute(rows, 3, 85))


def test_one_row_of_each_group_stays(spark):
    rows = corpus(6)
    df = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, row string")
    kept = minhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    got = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    want = sorted({r[0] for r in brute(rows, 5, 80) if r[3] and r[0] is not None})
    assert got == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.report(df).collect() == [] and minhash.drop_near_duplicates(df).collect() == []


def test_nothing_in_common(spark):
    df = spark.createDataFrame([(i, f"a{i} b{i} c{i} d{i}") for i in range(20)], "doc_id long, text string")
    assert all(r.kept and r.component_id == r.doc_id for r in minhash.report(df).collect())


def test_components_of_chains_stars_and_loops(spark):
    pairs = [(f"{i:03d}", f"{i + 1:03d}") for i in range(60)] + [("900", f"9{i:02d}") for i in range(1, 50)] + [("x", "x"), ("y", "z"), ("z", "y")]
    df = spark.createDataFrame(pairs, "a string, b string").select(F.col("a").cast("binary"), F.col("b").cast("binary"))
    got = {r.node.decode(): r.root.decode() for r in components(df).collect()}
    want = {f"{i:03d}": "000" for i in range(61)} | {f"9{i:02d}": "900" for i in range(50)} | {"y": "y", "z": "y"}
    assert got == want
    assert components(df.where("a = b")).collect() == []


def test_links_within_a_crowd_of_one_template(spark, monkeypatch):
    """Texts of a template just under the threshold, and pairs of them above it: no hash parts these from the others."""
    monkeypatch.setattr(minhash, "REGION", 24)
    rng = random.Random(5)
    template, rows, pairs = [f"t{i}" for i in range(150)], [], []
    for i in range(1500):
        rows.append((i, " ".join(template + [f"o{i}x{j}" for j in range(15)])))
    for k in range(60):
        a = rng.randrange(1500)
        rows.append((1500 + k, " ".join(template + [f"o{a}x{j}" for j in range(4)] + [f"p{k}x{j}" for j in range(11)])))
        pairs.append((a, 1500 + k))
    got = {r.doc_id: r.component_id for r in minhash.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[a] == got[b] for a, b in pairs)
    linked = {x for pair in pairs for x in pair}
    assert all(got[i] == i for i in range(1500) if i not in linked)


def frequent_crowd(slots, n_words):
    """Texts of a template whose other words stand in 19 texts each; those of a pair share two of them, others one at most."""
    p, rows, pairs = 19, [], []

    def text(chosen):
        words = [f"t{i}" for i in range(n_words)]
        for j, slot in enumerate(chosen):
            words[10 + 28 * j] = f"{j}s{slot}"
        return " ".join(words)

    for i in range(p * p):
        rows.append((i, text([(i // p + j * (i % p)) % p for j in range(slots)])))
    for k in range(30):
        a = 12 * k
        rows.append((1000 + k, text([a // p, (a // p + a % p) % p] + [f"p{k}"] * (slots - 2))))
        pairs.append((a, 1000 + k))
    return rows, pairs


def test_links_within_a_crowd_that_shares_frequent_shingles_only(spark, monkeypatch):
    monkeypatch.setattr(minhash, "REGION", 8)
    rows, pairs = frequent_crowd(8, 242)
    got = {r.doc_id: r.component_id for r in minhash.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i for i, _ in rows} | {b: a for a, b in pairs}


def test_stage_drops_all_of_such_a_crowd(spark, monkeypatch):
    monkeypatch.setattr(minhash, "REGION", 8)
    rows, pairs = frequent_crowd(7, 244)
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(r.doc_id for r in kept) == sorted({i for i, _ in rows} - {b for _, b in pairs})


def test_a_group_of_several_regions_is_compared_once():
    """Two groups in one region, and one of them again in another: each asks for its sets once, by one key."""
    rng = np.random.default_rng(2)
    first, second = rng.integers(0, 256, (2, minhash.HASHES)).astype(np.uint8)
    node = {name: name.encode() * 16 for name in "abcd"}
    member = lambda name, sig: {"node": node[name], "sig": sig.tobytes(), "root": node[name]}
    regions = [[member("a", first), member("c", second), member("b", first), member("d", second)],
               [member("b", first), member("a", first)], [member("a", first), member("c", second)]]
    kind = pa.list_(pa.struct([("node", pa.binary()), ("sig", pa.binary()), ("root", pa.binary())]))
    batch = pa.RecordBatch.from_arrays([pa.array(regions, kind)], names=["members"])
    out = pa.Table.from_batches(minhash._candidates(0.85)([batch])).to_pylist()
    groups = {}
    for r in out:
        groups.setdefault(r["key"], set()).add(r["node"])
    assert len(out) == 6 and sorted(map(sorted, groups.values())) == [[node["a"], node["b"]], [node["c"], node["d"]]]


def test_groups_of_a_chain():
    near = np.zeros((40, 40), bool)
    order = np.random.default_rng(3).permutation(30)
    near[order[1:], order[:-1]] = near[order[:-1], order[1:]] = True
    near[35, 38] = near[38, 35] = True
    assert minhash._groups(near).tolist() == [0] * 30 + [30, 31, 32, 33, 34, 35, 36, 37, 35, 39]
