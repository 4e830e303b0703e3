"""Operator 1: distances against the textbook recurrence, recall on changed passages."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewright.llm import decontaminate
from tidewright.llm.decontaminate import drop_contaminated, find_items, infix_distance


def infix(item, text):
    row, best = list(range(len(item) + 1)), len(item)
    for c in text:
        new = [0]
        for i, x in enumerate(item, 1):
            new.append(min(new[-1] + 1, row[i] + 1, row[i - 1] + (x != c)))
        row, best = new, min(best, new[-1])
    return best


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", min_size=1, max_size=30), st.text("abc ", max_size=60))
def test_infix_distance(item, text):
    distance, end = infix_distance(item, text)
    assert distance == infix(item, text) and infix_distance(item, text[:end])[0] == distance


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.randint(9, 70))) for i in range(40)] + [(90, None), (91, ""), (92, "too short"), (93, text(200))]
    docs, truth = [], set()
    for i in range(400):
        parts, item = [text(rng.randint(0, 300))], rng.choice(items)
        if i % 3 and item[1] and len(item[1].split()) >= 8:
            passage = item[1].split()
            for _ in range(int(len(passage) * 0.08 * (i % 3 - 1))):
                k = rng.randrange(len(passage))
                passage[k:k + 1] = rng.choice([[], ["changed"], [passage[k], "added"], [passage[k] + "x"]])
            parts += [rng.choice(["{}", "\n\n{}.", '"{}!"']).format(" ".join(passage).upper() if i % 5 == 0 else " ".join(passage)), text(rng.randint(0, 50))]
            truth.add((i, item[0]))
        docs.append((i, " ".join(parts)))
    return items, docs, truth


def test_planted_passages_are_found(spark, planted):
    items, docs, truth = planted
    rows = docs + [(1000, None), (1001, ""), (None, docs[1][1]), (1, docs[1][1])]
    got = find_items(spark.createDataFrame([(*d, 3) for d in rows], "doc_id long, text string, distance int").repartition(3),
                     spark.createDataFrame(items, "item_id long, text string")).collect()
    pairs = {(r.doc_id, r.item_id) for r in got if r.doc_id is not None}
    assert pairs <= truth and len(pairs) >= 0.99 * len(truth)
    assert {(None, i) for d, i in truth if d == 1} == {(None, r.item_id) for r in got if r.doc_id is None}
    text = dict(docs)
    for r in got:
        assert r.distance <= 0.2 * r.item_chars
        if r.doc_id is not None and r.distance == 0:
            plain = " ".join("".join(c if c.isalnum() else " " for c in text[r.doc_id][r.start:r.stop].lower()).split())
            assert plain == " ".join(dict(items)[r.item_id].split())


@pytest.mark.parametrize("n", [8, 11, 23, 31, 47, 62])
@pytest.mark.parametrize("percent, least", [(10, 0.99), (20, 0.95)])
def test_items_of_any_length_are_met_up_to_the_share(n, percent, least):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvw") for _ in range(7))
    items, texts = [], []
    for i in range(200):
        item = [word() for _ in range(n)]
        passage = list(item)
        for k in rng.sample(range(n), n * percent // 100):
            passage[k] = word()
        items.append((i, " ".join(item)))
        texts.append(" ".join([word() for _ in range(rng.randint(0, 150))] + passage + [word() for _ in range(80)]))
    met = decontaminate.ItemIndex(items).probe(decontaminate.plain_words(pa.array(texts)))
    assert sum(any(item == i for item, _ in met.get(i, ())) for i in range(200)) >= least * 200


def test_stage_drops_those_rows_only(spark, planted):
    items, docs, truth = planted
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, row string")
    out = decontaminate.drop_contaminated(df, spark.createDataFrame(items, "item_id long, text string"))
    ids = {r.doc_id for r in out.collect()}
    assert out.columns == df.columns and ids >= {i for i, _ in docs} - {i for i, _ in truth}
    assert len(ids & {i for i, _ in truth}) <= 0.01 * len(truth)


def test_blocks_of_items_change_nothing(spark, planted, monkeypatch):
    items, docs, _ = planted
    d, i = spark.createDataFrame(docs[:100], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, find_items(d, i).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 3000)
    assert len(decontaminate.blocks(i)) > 2
    assert sorted(map(tuple, find_items(d, i).collect())) == whole
    assert decontaminate.drop_contaminated(d, i).count() == 100 - len({r[0] for r in whole})


def test_empty_tables(spark, planted):
    items, docs, _ = planted
    d, i = spark.createDataFrame(docs[:5], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert find_items(d.limit(0), i).collect() == [] and find_items(d, i.limit(0)).collect() == []
    assert decontaminate.drop_contaminated(d, i.limit(0)).count() == 5


def test_words_of_a_slice():
    column = pa.array(["zz", "A b, c!", None, "d"]).slice(1)
    found = decontaminate.plain_words(column)
    assert [found.data[a:b].tobytes() for a, b in zip(found.start, found.stop, strict=True)] == [b"a", b"b", b"c", b"d"]


def test_items_of_few_words_are_found_as_they_are(spark):
    cjk = "人工智能模型在训练之前需要清理数据集"
    items = [(1, "Who wrote the Principia Mathematica?"), (2, cjk), (3, "too short"), (4, "who wrote  the principia mathematica"), (5, "x" * 40)]
    texts = {10: f"Question: WHO wrote, the Principia\nMathematica! Newton.", 11: f"前言{cjk}后记 end", 12: "who wrote the principia mathematicas",
             13: "somebody who wrote the principia", 14: "too short", 15: "a " + "x" * 40, 16: "é who wrote the principia mathematica", 17: None}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)
    got = find_items(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(10, 1), (10, 4), (11, 2), (15, 5), (16, 1), (16, 4)}
    shown = {(r.doc_id, r.item_id): texts[r.doc_id][r.start:r.stop] for r in got}
    assert shown[10, 1] == "WHO wrote, the Principia\nMathematica" and shown[16, 1] == "who wrote the principia mathematica"
    assert cjk in shown[11, 2] and {r.distance for r in got} == {0}
    kept = {r.doc_id for r in drop_contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert kept == {12, 13, 14, 17}


def test_keys_are_met_as_if_all_were_formed():
    rng = random.Random(8)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(4000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.choice([9, 12, 30, 60, 130, 210]))) for i in range(60)] + [(60, "la " * 40), (61, "la li " * 9)]
    texts = [text(rng.randint(0, 600)) for _ in range(40)] + ["la " * 300, "", items[3][1], items[7][1] + " la la", "li la " * 40]
    index, found = decontaminate.ItemIndex(items), decontaminate.plain_words(pa.array(texts))
    hashes, first = found.hashes(), found.first
    want = {}
    for size in index.sizes:
        for t in range(len(texts)):
            at = np.arange(first[t], first[t + 1] - size + 1, max(1, size // 8))
            for walk in range(decontaminate.WALKS) if len(at) else ():
                for sample, column in enumerate(decontaminate.keys(decontaminate.seeded(hashes, size, walk), at, size, walk)):
                    key, owner, offset, _ = index.tables[size, walk, sample]
                    low, high = np.searchsorted(key, column, "left"), np.searchsorted(key, column, "right")
                    for k in np.flatnonzero(low < high):
                        want.setdefault(t, set()).update((int(owner[m]), int(at[k] - first[t] - offset[m])) for m in range(low[k], high[k]))
    assert index.sizes == [4, 8, 16, 32, 64, 128] and dict(index.probe(found)) == want and len(want) > 30


@settings(max_examples=300, deadline=None)
@given(st.text("ab ", min_size=15, max_size=400), st.text("ab ", max_size=60), st.data())
def test_no_near_passage_is_ruled_out(item, around, data):
    passage = list(item)
    for _ in range(data.draw(st.integers(0, len(item) // 4))):
        k = data.draw(st.integers(0, len(passage)))
        passage[k:k + data.draw(st.integers(0, 1))] = data.draw(st.sampled_from(["", "a", "b", "c"]))
    text = around + "".join(passage) + around[::-1]
    codes = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in (item, text)]
    own, other = (decontaminate.grams(c) if len(c) > 2 else np.zeros(0, np.uint16) for c in codes)
    held = decontaminate.may_hold([own, own[:20]], np.array([1, 0, 0]), [other[:5], other, other], 0.2)
    assert held[1] == held[2] and (held[1] or infix(item, text) > 0.2 * len(item))


def test_few_distances_are_found_for_nothing(monkeypatch):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(60)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.randint(9, 70))) for i in range(40)]
    texts = [text(500) for _ in range(100)] + [text(50) + " " + t for _, t in items]
    found = []
    one, many = decontaminate.infix_distance, decontaminate.infix_distances
    monkeypatch.setattr(decontaminate, "infix_distance", lambda a, b: found.append(1) or one(a, b))
    monkeypatch.setattr(decontaminate, "infix_distances", lambda a, b: found.extend(a) or many(a, b))
    index = decontaminate.ItemIndex(items)
    out = index.matches(pa.array(texts), 0.2)
    assert {(t, i) for t, rows in out.items() for i, *_ in rows} == {(100 + i, i) for i in range(40)}
    assert sum(map(len, index.probe(decontaminate.plain_words(pa.array(texts))).values())) > 1000 and len(found) < 400
