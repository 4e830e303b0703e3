"""Operator 4: the automaton against plain edit distance, the scores by held-out accuracy."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewright.llm import toxicity
from tidewright.llm.toxicity import LexiconAutomaton, Matcher, edits_allowed


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=1, max_size=10), st.floats(0.5, 9), min_size=1, max_size=8),
       st.lists(st.text("abcz", max_size=12), min_size=1, max_size=12))
def test_automaton_equals_edit_distance(weights, words):
    automaton = LexiconAutomaton(weights)
    for word in words:
        near = [(distance(word, t), -w) for t, w in weights.items() if distance(word, t) <= edits_allowed(len(t))]
        best = min(near, default=None)
        assert automaton.match(word) == (best and (best[0], -best[1]))


def swap_distance(a, b):
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                row[-1] = min(row[-1], rows[-2][j - 2] + 1)
        rows.append(row)
    return rows[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=1, max_size=10), st.floats(0.5, 9), min_size=1, max_size=8),
       st.lists(st.text("abcz", max_size=12), min_size=1, max_size=12))
def test_swapped_neighbours_are_one_edit(weights, words):
    automaton = LexiconAutomaton(weights, swaps=True)
    for word in words:
        near = [(swap_distance(word, t), -w) for t, w in weights.items() if swap_distance(word, t) <= edits_allowed(len(t))]
        best = min(near, default=None)
        assert automaton.match(word) == (best and (best[0], -best[1]))


def test_misspellings_that_the_query_matches():
    match = toxicity.LexiconAutomaton({"worthless": 3.0, "idiot": 2.0, "scum": 1.0}, swaps=True).match
    assert match("w0rthles5") == (2, 3.0) and match("wrothlses") == (2, 3.0)
    assert match("idoit") == (1, 2.0) and match("idito") == (1, 2.0) and match("idoti") is None
    assert match("scum") == (0, 1.0) and match("scm") is None


def test_quotation_counts_apart():
    figures = lambda t: dict(zip(toxicity.FEATURES, Matcher(LexiconAutomaton({"moron": 4.0, "worthless": 3.0})).figures(t), strict=True))
    assert figures("nothing here") == dict.fromkeys(toxicity.FEATURES, 0.0)
    assert figures("you moron")["plain_best"] == 4.0 and figures("you m0ron!")["misspelt_best"] == 4.0
    assert figures("wort-less wortless wrthles")["misspelt_best"] == 3.0
    quoted = figures('he wrote "you moron" and left')
    assert quoted["plain"] == quoted["burst"] == 0.0 and quoted["quoted"] > 0
    near, far = figures("moron worthless"), figures("moron " + "word " * 30 + "worthless")
    assert near["burst"] > far["burst"] and near["plain"] == far["plain"]


@pytest.mark.parametrize("begin, end", ['""', "“”", "„“", "„”", "«»"])
def test_quotations_of_any_length(begin, end):
    figures = lambda t: dict(zip(toxicity.FEATURES, Matcher(LexiconAutomaton({"moron": 4.0})).figures(t), strict=True))
    far = "word " * 200
    long = begin + far + "moron " + far + end
    for quoted in (long, f"{long} and {long}", f"{begin}you\nmoron{end}"):
        assert figures(quoted)["plain"] == 0.0 < figures(quoted)["quoted"]
    between = figures(f"{begin}{far}{end} moron {begin}{far}{end}")
    assert between["quoted"] == 0.0 < between["plain"]


def test_unpaired_marks_quote_nothing():
    assert toxicity.quotations('a “b "c" d') == [(5, 8)] and toxicity.quotations('"a" "b') == [(0, 3)]
    assert toxicity.quotations("”a“ »b« „c") == [] and toxicity.quotations("«a “b» c”") == [(0, 6)]


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(500)]
    insults = ["stupid", "idiot", "worthless", "pathetic", "scum"]
    docs, labels = [], []
    for i in range(800):
        text, toxic = [rng.choice(words) for _ in range(rng.randint(10, 120))], int(rng.random() < 0.3)
        for _ in range(3 * toxic):
            insult = rng.choice(insults)
            if rng.random() < 0.25:
                k = rng.randrange(1, len(insult))
                insult = insult[:k] + rng.choice("xyz") + insult[k + 1:]
            text.insert(rng.randrange(len(text)), insult)
        docs.append((i, " ".join(text)))
        labels.append((i, toxic))
    docs += [(2000, None), (2001, ""), (None, "idiot stupid scum"), (3, docs[3][1])]
    labels += [(5, None), (None, 1), (7, labels[7][1])]
    return (spark.createDataFrame([(*d, 0.5) for d in docs], "doc_id long, text string, score double").repartition(4),
            spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels))


def test_held_out_accuracy(planted):
    docs, labels, truth = planted
    rows = toxicity.report(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[2000].score == by_id[2001].score == min(r.score for r in rows) and by_id[None].predicted == 1


def test_labels_of_held_out_rows_are_never_used(planted):
    docs, labels, _ = planted
    other = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    key = lambda df, ls: sorted((r.doc_id or -1, r.text or "", round(r.score, 9))
                                for r in toxicity.fit(docs, ls).score(docs, keep=("doc_id", "text")).collect())
    assert key(docs, labels) == key(docs, other)


def test_stage_drops_toxic_rows_and_keeps_columns(planted):
    docs, labels, truth = planted
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sum(truth.get(i) or 0 for i in ids) <= 0.02 * sum(v or 0 for v in truth.values()) + 1
    assert sum(truth.get(i) == 0 for i in ids) >= 0.99 * sum(v == 0 for v in truth.values())


@pytest.mark.parametrize("hint", ["mild", "w3"])
def test_the_bound_on_labels_keeps_their_shares(spark, monkeypatch, hint):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(2000):
        toxic = int(i % 10 == 0)
        words = [f"w{rng.randrange(9)}" for _ in range(20)] + ["mild"] * (rng.random() < (0.6 if toxic else 0.1)) * (hint == "mild")
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    text = spark.createDataFrame([(1, "w1 " * 20 + hint)], "doc_id long, text string")
    whole = toxicity.fit(docs, labels).score(text).first().score
    monkeypatch.setattr(toxicity, "SAMPLE", 120)
    bounded = toxicity.fit(docs, labels).score(text).first().score
    assert 0.05 < whole < 0.5 and abs(bounded - whole) < 0.15


@pytest.mark.parametrize("labels, predicted", [([], 0), ([(0, 0), (1, 0)], 0), ([(0, 1), (1, 1)], 1)])
def test_labels_of_one_kind(spark, labels, predicted):
    docs = spark.createDataFrame([(i, "words and more") for i in range(4)] + [(9, None)], "doc_id long, text string")
    rows = toxicity.report(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(rows) == 5 and {r.predicted for r in rows} == {predicted}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert toxicity.report(docs, labels).collect() == [] and toxicity.drop_toxic(docs, labels).collect() == []
