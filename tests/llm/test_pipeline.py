"""The pipeline against its stages done in plain Python, and every query on the smallest tables."""

import hashlib
import random
import struct

import duckdb
import pytest

import corpus_pipeline
from tidewright.llm import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plain(value):
    return "~" if value is None else repr(value + 0.0) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got
    if name in ORACLES:
        duck = duckdb.connect()
        for table in ("documents", "embeddings"):
            duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
        cursor = duck.execute(ORACLES[name])
        at = {d[0]: i for i, d in enumerate(cursor.description)}
        assert sorted(at) == columns
        assert got == sorted(tuple(plain(r[at[c]]) for c in columns) for r in cursor.fetchall())


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Documents of which it is known by construction what every stage does to them."""
    rng = random.Random(77)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(700)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    item, docs, labels, fate = text(30), [], [], {}

    def add(tokens, what, toxic=0, label=True):
        n = len(docs)
        docs.append((n, " ".join(tokens), "en", "s", None))
        fate[n] = what
        if label:
            labels.append((n, 1, toxic))
        return n

    for i in range(260):
        tokens = text(rng.randint(30, 90))
        if i % 4 == 0:
            for w in ("stupid", "idiot", "scum"):
                tokens.insert(rng.randrange(len(tokens)), w)
            add(tokens, "toxic", 1)
        elif i % 10 == 1:
            add(tokens, "kept")
            for _ in range(3):
                near = list(tokens)
                near[rng.randrange(len(near))] = "changed"
                add(near if rng.random() < 0.5 else tokens, "copy" if len(tokens) > 60 else "either")
        elif i % 10 == 3:
            add(tokens[:20] + item + tokens[20:], "benchmark")
        elif i % 10 == 7:
            add([*tokens, "password=abcdefghijkl0123", "end"], "secret")
        else:
            add(tokens, "kept")
    docs += [(9000, None, None, None, None), (9001, "", "en", None, 0)]
    fate |= {9000: "kept", 9001: "kept"}
    folder = str(tmp_path_factory.mktemp("sf"))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, {d[0]: d[1] for d in docs}, fate


def test_pipeline_does_what_its_stages_promise(spark, planted):
    from tidewright.llm.byte_bpe import tokenizer
    import public_tokenizers

    folder, texts, fate = planted
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert not [i for i, f in fate.items() if f in ("toxic", "copy", "benchmark") and i in rows]
    assert not [i for i, f in fate.items() if f in ("kept", "secret") and i not in rows]
    made = tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for i, r in rows.items():
        text = (texts[i] or "").replace("password=abcdefghijkl0123", "[secret]")
        ids = made.encode(text, add_special_tokens=False).ids
        assert bytes(r.ids) == struct.pack(f"<{len(ids)}I", *ids) and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_stages_keep_the_columns(spark, planted):
    folder, _, _ = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "doc_id AS t", "text AS row", "1 AS node", "'x' AS spans", "2 AS score")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name


def test_stages_pass_empty_tables(spark, planted):
    folder, _, _ = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).collect() == []


def test_lengths_follow_hidden_secrets(spark, planted):
    folder, _, _ = planted
    docs = spark.createDataFrame([(1, "token: abcdefghijklmnop", 23), (2, None, None)], "doc_id long, text string, n_chars long")
    assert sorted(map(tuple, corpus_pipeline.hide_secrets(spark, docs, folder).collect())) == [(1, "[secret]", 8), (2, None, None)]
