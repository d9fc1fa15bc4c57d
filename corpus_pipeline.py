"""Corpus pipeline over ``documents``: five stages of the operators of ``marginalia.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's ``docs``. All stages but the last return the
columns of ``documents``:

1. ``quality_rules``: documents that fail the base rules or the bands of tokeniser
   fertility go.
2. ``near_duplicates``: of each group linked by 5-word shingles at a Jaccard similarity
   of 0.8 or more, the document with the smallest doc_id stays. Documents without a
   word are no duplicates of one another.
3. ``secret_scan``: secrets are replaced by a mark, ``n_chars`` is renewed; every
   document stays.
4. ``mixing``: each document is repeated as often as the mix of its source takes it.
5. ``byte_bpe``: doc_id, lang, source, number of tokens, token ids.

Rows are told apart by all their columns, not by doc_id: rows with a null or repeated
doc_id are documents like any other. Columns beyond those of ``documents`` may have any
name and are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marginalia.llm.byte_bpe import encode
from marginalia.llm.jaccard_join import drop_near_copies
from marginalia.llm.mixing import resample
from marginalia.llm.public_vocab import default_path
from marginalia.llm.quality_rules import keep_good
from marginalia.llm.secret_scan import redact
from marginalia.plans.scratch import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return drop_near_copies(docs, k=5, num=80, den=100)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as the mix takes them."""
    return resample(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row."""
    return encode(docs, default_path("byte_bpe_multi_50k.tiktoken"), keep=("doc_id", "lang", "source"))


STAGES = [("quality_rules", quality), ("near_duplicates", near_duplicates), ("secret_scan", secrets), ("mixing", mixing), ("byte_bpe", tokens)]
#: The mix is drawn by a fold over hashes and the tokens by merges: not for SQL. Tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
