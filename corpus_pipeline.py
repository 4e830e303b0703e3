"""The corpus pipeline: documents in, token ids of the documents worth training on out.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as
Parquet to the shared folder and reads again as the next stage's documents. All stages but
the last return the columns they were given. Each handles missing values, empty texts, repeated
rows, empty tables and further columns as its operator does.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import byte_bpe, decontaminate, minhash, secrets, toxicity
from tidewright.llm.arrowtext import small_batches
from tidewright.session import materialize, ship_package


def _ready(spark: SparkSession) -> None:
    """Workers that can import the package, and batches of few texts."""
    ship_package(spark)
    small_batches(spark)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the toxicity model accepts; it learns from the labels that are not held out."""
    _ready(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.drop_toxic(docs, labels)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 80 % of their five-word shingles: the one with the least id."""
    _ready(spark)
    return minhash.drop_near_duplicates(docs, size=5, percent=80, trees=24)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark, nor one within a fifth of its length in edits."""
    _ready(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontaminate.drop_contaminated(docs, items)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their text replaced by a mark; ``n_chars`` follows the text."""
    return secrets.redact(docs, length="n_chars" if "n_chars" in docs.columns else None)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, the packed ``ids`` of the text, their number, and digests of the ids and of the bytes they decode to."""
    _ready(spark)
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    back = byte_bpe.encode(docs, ranks, decoded=True)
    return back.select("doc_id", "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("near-duplicates", drop_near_duplicates), ("benchmark decontamination", drop_benchmark),
          ("secrets", hide_secrets), ("byte-level BPE", tokens)]

#: A fitted model, MinHash, edit distance and BPE are beyond SQL; the stages are tested against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
