"""Operator 9: the permutation, and whether the shards hold every id in the order it gives."""

import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import shards
from tidewright.session import materialize


@pytest.mark.parametrize("total", [1, 2, 3, 5, 17, 64, 65, 1000, 4097])
def test_permutation(total):
    numbers = np.arange(total)
    slots = shards.permuted(numbers, total, key=9)
    assert sorted(slots.tolist()) == numbers.tolist()
    assert (shards.permuted(slots, total, 9, back=True) == numbers).all()
    if total > 60:
        assert (slots != shards.permuted(numbers, total, key=10)).mean() > 0.9
        assert abs(np.corrcoef(numbers, slots)[0, 1]) < 0.3


def stream(texts, length):
    data = b"".join((t or "").encode() + b"\xff" for t in texts)
    return data + b"\xfe" * (-len(data) % length)


def test_every_id_is_in_its_slot(spark, tmp_path):
    texts = ["line\nline", None, "", "é💩" * 30, "x" * 1000] + [f"text {i}" for i in range(300)]
    df = materialize(spark.createDataFrame([(t, "r") for t in texts], "text string, record string").coalesce(1), "texts")
    total = shards.write_shards(shards.byte_ids(df), str(tmp_path / "s"), key=5, length=64, shard_records=10)
    rows = shards.read_shards(spark, str(tmp_path / "s"), 64, shard_records=10).orderBy("slot").collect()
    assert [r.slot for r in rows] == list(range(total)) and all(r.shard == r.slot // 10 and r.place == r.slot % 10 for r in rows)
    data = b"".join(bytes(rows[s].record) for s in shards.permuted(np.arange(total), total, 5))
    assert data == stream([r.text for r in df.collect()], 64)


def test_resume_within_a_shard(spark, tmp_path):
    df = materialize(spark.createDataFrame([(f"text {i}",) for i in range(200)], "text string").coalesce(1), "texts")
    shards.write_shards(shards.byte_ids(df), str(tmp_path / "s"), key=5, length=32, shard_records=16)
    want = {r.slot: bytes(r.record) for r in shards.read_shards(spark, str(tmp_path / "s"), 32, shard_records=16).collect()}
    [path] = glob.glob(str(tmp_path / "s" / "shard=1" / "*.txt"))
    with open(path, "rb") as f:
        f.seek(3 * 33)
        assert f.read(32) == want[16 + 3]


def test_several_partitions_and_wider_ids(spark, tmp_path):
    ids = [np.arange(i, i + i % 7, dtype="<u4").tobytes() for i in range(500)] + [None]
    df = materialize(spark.createDataFrame([(x,) for x in ids], "ids binary").repartition(3), "ids")
    total = shards.write_shards(df, str(tmp_path / "s"), key=1, length=16, width=4, end=99999, fill=77777, shard_records=8)
    rows = shards.read_shards(spark, str(tmp_path / "s"), 16, 4, shard_records=8).collect()
    assert sorted(r.slot for r in rows) == list(range(total))
    got = np.concatenate([np.frombuffer(r.record, "<u4") for r in rows])
    want = np.concatenate([np.frombuffer((x or b""), "<u4") for x in ids])
    assert (got == 99999).sum() == len(ids)
    rest = np.sort(got[(got != 99999) & (got != 77777)])
    assert (rest == np.sort(want)).all()


def test_report_and_empty_table(spark):
    df = materialize(spark.createDataFrame([(f"some text {i}" * 50,) for i in range(100)], "text string"), "texts")
    rows = shards.report(df).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows))) and {r.n_ids for r in rows} == {shards.LENGTH}
    empty = shards.report(spark.createDataFrame([], "text string"))
    assert empty.collect() == [] and empty.columns == shards.report(df.where(F.lit(True))).columns
