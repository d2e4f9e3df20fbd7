"""Each stage of the pipeline acts on its own input and hands on the columns of documents."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from bibliospark.llm import pseudonyms


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language id", "ngram jaccard join", "pii", "mixing", "packing"]
    junk = docs.limit(3).withColumn("doc_id", F.col("doc_id") + 10**6).withColumn("text", F.lit("12345 !!! 678"))
    copy = docs.limit(5).withColumn("doc_id", F.col("doc_id") + 10**7)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language id"](spark, docs.unionByName(junk).unionByName(copy), sf_dir)
    assert kept.columns == columns and kept.where("text like '12345 !!!%'").count() == 0
    assert kept.where("doc_id < 1000000").count() >= 0.99 * docs.count()
    single = stages["ngram jaccard join"](spark, kept, sf_dir).cache()
    assert single.columns == columns and single.where("doc_id >= 10000000").count() == 0 and single.count() < kept.count()
    plain = stages["pii"](spark, single, sf_dir)
    assert plain.columns == columns and plain.count() == single.count()
    assert plain.where(F.length("text") != F.col("n_chars")).count() == 0
    mixed = stages["mixing"](spark, plain, sf_dir).cache()
    assert mixed.columns == columns and mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    packed = stages["packing"](spark, mixed, sf_dir).cache()
    assert packed.select("doc_id").distinct().count() == mixed.select("doc_id").distinct().count()
    assert packed.where("length(ids) <> 4 * length").count() == 0


def test_null_columns(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "a b c", None, "s", 5), (2, "", "en", "s", 0)], schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
    corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "")
    assert empty.collect() == [] and pseudonyms.ROUNDS >= 8
