"""From raw documents to tokens: every stage reads what the one before it kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pagesmelt.llm.common import written
from pagesmelt.llm.decontaminate import remove_leaks
from pagesmelt.llm.ngram_join import drop_near_copies
from pagesmelt.llm.secrets import redact
from pagesmelt.llm.site_quality import keep_good
from pagesmelt.llm.trie_bpe import encode_decode

#: Rows that an executor packs for a Python worker at a time: both hold a portion whole, the executor
#: with twice the room and in memory it does not give back.
PORTION = ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def in_portions(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The stage, in a session with portions of ``PORTION``; a size the session has set itself stays."""
    @wraps(stage)
    def portioned(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(PORTION[0], spark.conf.get(*PORTION))
        return stage(spark, docs, sf_dir)

    return portioned


@in_portions
def judge(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents of low quality and toxic ones go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@in_portions
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: one document of each group stays, by five words and a similarity of 0.8."""
    return drop_near_copies(docs)


@in_portions
def clean_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: benchmark passages are cut out; documents that are little else go."""
    return remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@in_portions
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: secrets become a mark."""
    return redact(docs)


@in_portions
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: ids and decoded text of every document left."""
    return encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", judge),
    ("ngram_jaccard_join", one_of_each),
    ("benchmark_decontamination", clean_benchmarks),
    ("secret_scan", mask_secrets),
    ("bpe", encode),
]

#: Learned filters and merges have no SQL; the tests run the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``, each stage written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
