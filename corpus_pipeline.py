"""Documents to training tokens: language, near-duplicates, benchmark passages, personal data, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and returns the documents that go on, with the columns
they came with; the last one returns token ids. A stage reads what the one before has written.

Defined cases are those of the operators: a document without any letter has no language and goes;
rows with one id are one document and stay or go together as near-duplicates; null texts are
empty; other columns are carried along.

The stages set the session's Arrow batches to ``BATCH_ROWS`` rows and ``BATCH_BYTES``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressdesk.llm import bpe, decontaminate, language, neardup, pii
from pressdesk.llm.common import keep, packed, table, unpacked

RANK_FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

BATCH_ROWS = 500
BATCH_BYTES = 4 << 20
# The last stage's workers share an executor with all that the stages before have left in its JVM.
TOKEN_ROOM = 0.25

# Not expressible in SQL: cosines of random vectors decide the first stage, merges the last.
ORACLE_SQL = None


def _small_batches(spark: SparkSession) -> None:
    """Python workers get a few megabytes of text at once: a stage's kernels hold a batch as lists of words."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; prototypes are learnt from the given language names."""
    _small_batches(spark)
    profiles = language.prototypes(docs.select("text", "lang"), F.lit(True))
    judged = language.predict(packed(docs, "text"), profiles)
    return unpacked(judged.filter(F.col("lang_pred") != language.UNKNOWN), docs, "text")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per group of near-duplicates the document with the smallest id."""
    _small_batches(spark)
    judged = neardup.near_duplicates(docs.select("doc_id", "text"))
    some = judged.groupBy("doc_id").agg(F.max("kept").alias("kept"))
    gone = keep(some.filter(~F.col("kept")).select(F.col("doc_id").alias("_key")), "gone")
    keyed = packed(docs, "doc_id").withColumn("_key", F.col("doc_id").cast("bigint"))
    return unpacked(decontaminate.without(keyed, gone), docs, "doc_id")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, re-parameterised or not."""
    _small_batches(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with labels in place of personal data and of terms that give it away."""
    _small_batches(spark)
    return pii.sanitise(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids``."""
    _small_batches(spark)
    return bpe.encode(docs, bpe.load_ranks(RANK_FILE), TOKEN_ROOM)


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
