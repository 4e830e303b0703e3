"""Operator 3: counts against loops, and what the adaptive fences reject."""

import random
import re

from tidewright.llm import quality


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    starts = {}
    for i in range(len(words) - 7):
        starts.setdefault(tuple(words[i:i + 8]), []).append(i)
    covered = {k for at in starts.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def corpus():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8))) for _ in range(60)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [text(rng.randint(0, 80)) for _ in range(150)]
    texts += [None, "", " \n\t", "a b c d e f g h\n" * 4, "one\none\n one\n\n\none", "💩 # * < >", "x\x0b#\x0cy\x1fz", "a " * 400,
              "\n".join([text(9)] * 3 + [text(12)]), text(20000)]
    return [(i, t, rng.choice(["en", "de", None]), rng.choice(["big", "big", "s", None])) for i, t in enumerate(texts)] + [(3, "again", "en", "big")] * 2


def test_counts(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, n_words int").repartition(3)
    want = [(i, *counts(t)) for i, t, _, _ in rows]
    got = quality.apply_rules(df)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.drop("base_failed", "kept").collect()), key=key) == sorted(want, key=key)
    failed = {(r.doc_id, r.n_words): r.base_failed for r in got.collect()}
    for i, n, _, _, _, r in want:
        assert failed[i, n] == (n < 20 or 100 * r > 30 * n)


def test_fences_follow_the_source(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    plain = [(i, " ".join(word(rng.randint(3, 7)) for _ in range(60)), "en", "prose") for i in range(200)]
    code = [(1000 + i, " ".join(word(rng.randint(3, 7)) + " #" for _ in range(60)), "en", "code") for i in range(200)]
    odd = [(5000, " ".join(word(5) + " #" for _ in range(60)), "en", "prose"), (5001, " ".join(word(40) for _ in range(60)), "en", "prose")]
    df = spark.createDataFrame(plain + code + odd, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality.apply_rules(df).collect()}
    assert not kept[5000] and not kept[5001]
    assert all(kept[r[0]] for r in plain + code)


def test_fences_come_from_the_corpus_alone(spark):
    """The same text is judged by what its source is like: no cutoff is the same everywhere."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7)))
    text = lambda share: " ".join(word() + (" %" if rng.random() < share else "") for _ in range(80))
    rows = [(i, text(0), "en", "clean") for i in range(300)] + [(1000 + i, text(rng.uniform(0.1, 0.4)), "en", "prices") for i in range(300)]
    tenth, half, few = text(0.12), text(1.0), " ".join(["%"] * 3 + [word() for _ in range(80)])
    rows += [(5000, tenth, "en", "clean"), (5001, tenth, "en", "prices"), (5002, few, "en", "clean"), (5003, half, "en", "clean")]
    junk = [(6000 + i, " ".join("#$%&"[rng.randrange(4)] * 3 for _ in range(50)), "en", "clean") for i in range(45)]
    df = spark.createDataFrame(rows + junk, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality.apply_rules(df).collect()}
    assert not kept[5000] and kept[5001] and kept[5002] and not kept[5003]
    assert not any(kept[i] for i, _, _, _ in junk)  # more than a tenth of the source
    assert all(kept[i] for i, _, _, _ in rows[:600])


def test_sketches_merge(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    own = quality.sketch(quality.measure(df))
    whole = quality.sketch(quality.measure(df.selectExpr("doc_id", "text", "'x' AS lang", "'x' AS source")))
    merged = own.groupBy("measure", "bucket").agg({"n": "sum"})
    assert sorted(map(tuple, merged.collect())) == sorted((r.measure, r.bucket, r.n) for r in whole.collect())


def test_empty_table(spark):
    assert quality.apply_rules(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).collect() == []
