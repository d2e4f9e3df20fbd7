"""A training-data pipeline of the operators in bibliospark.llm, each stage written and read again.

Stages, in order: language ID (rejected documents go), n-gram Jaccard join (one document of each group stays), PII
pseudonyms, mixing sources to target weights (rows as often as they are taken), packing into sequences.

Defined cases: a null text is kept by nothing but tables without any labelled document, as language ID rejects texts
without letters; null lang becomes the one found, null source is a source of its own, null doc_id stays null; of rows
that repeat one stays, of copies the one with the smallest doc_id; texts of any length are used whole; extra columns are
handed on; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bibliospark.llm import jaccard, language, mixing, packing, pseudonyms
from bibliospark.llm.common import stored
from bibliospark.llm.queries import KEY, tokenizer_path

#: Documents are rejected when they have no letter or no language reaches this share.
LEAST_SCORE = 0.5


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; a null lang becomes the one found. Without labelled documents all are kept."""
    net = language.fit(docs)
    if net is None:
        return docs
    found = language.identify(docs, net).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return jaccard.one_of_each(docs, n=5, num=80, den=100)


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(docs, KEY).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences with their ids. Executors have filled their heaps in the stages before, so workers take little."""
    return packing.pack_documents(docs, tokenizer_path(), end_id=0, bundle_bytes=2 << 20, remembered=80_000)


STAGES = [
    ("language id", keep_languages),
    ("ngram jaccard join", keep_one_of_each),
    ("pii", replace_pii),
    ("mixing", mix_sources),
    ("packing", pack),
]
#: A trained network, keyed hashes and a tokenizer are beyond SQL; the tests hold the stages' operators against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
