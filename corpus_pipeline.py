"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

A stage begins when its predecessor's rows are written, so that the predecessor's working tables can go.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshframe.llm import queries as own
from meshframe.llm import scratch
from meshframe.llm.jaccard import one_of_each
from meshframe.llm.packing import pack
from meshframe.llm.pii import replace_entities
from meshframe.llm.quality import fit
from meshframe.llm.substring import remove_repeats


def stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """Working tables of a stage are the pipeline's own and are deleted when the next one begins."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        scratch.release(spark, "stage")
        with scratch.owned_by("stage"):
            return f(spark, docs, sf_dir)

    return run_stage


def _alone(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and one column with all others, so that none of their names is an operator's."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *others).alias("__row"))


def _back(changed: DataFrame, docs: DataFrame, counted: bool = True) -> DataFrame:
    """The columns of ``docs`` again, in their order; ``n_chars`` is counted anew if the text may have changed."""
    at = lambda c: F.col(c) if c in ("doc_id", "text") else F.col("__row").getField(c).alias(c)
    length = F.char_length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars") if counted and "n_chars" in docs.columns else None
    return changed.select(*[length if c == "n_chars" and length is not None else at(c) for c in docs.columns])


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier, learned from ``labels``: documents that it rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _back(fit(docs, labels).score(_alone(docs)).where("predicted = 1"), docs, counted=False)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (5 words, 0.8): one document, that of the smallest doc_id, of each group stays."""
    return one_of_each(docs, k=5, num=80, den=100)


@stage
def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup: windows of 50 words are removed from all documents but the first; emptied ones go."""
    return _back(remove_repeats(_alone(docs), width=50).where("n_removed < n_words or n_words = 0"), docs)


@stage
def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: detected entities become surrogates."""
    return _back(replace_entities(_alone(docs), own.PII_SECRET), docs)


@stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: every remaining document's tokens in sequences of 4096."""
    return pack(docs, own._vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", substrings),
    ("pii", private_data),
    ("packing", packing),
]

#: Learned scores, components and tokenizer ids are not expressible in SQL; a test holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; what a stage keeps is written to the shared folder and reread by the next.

    Of two runs in one session, read the first one's result before the second begins: its working tables go then."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *firsts, (_, last) = STAGES
    before = None
    for name, f in firsts:
        out = f(spark, docs, sf_dir)
        with scratch.owned_by(name):
            docs = scratch.written(out, name)
        if before:
            scratch.release(spark, before)
        before = name
    packed = last(spark, docs, sf_dir)  # it has read docs: what it returns reads its own tables
    scratch.release(spark, before)
    return packed
