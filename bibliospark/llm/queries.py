"""The registered queries of the training-data operators: thin readers of whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import covertree, exact, hardneg, jaccard, language, licenses, mixing, mtree, packing, pseudonyms, resample, sstable, substrings


def op9_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), mtree.integers(F.col("embedding")).alias("v"))
    return mtree.top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: The registered query's key; a real one is a secret that the caller passes.
KEY = "registered query"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = sstable.write_shards(_table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)
    return sstable.read_shards(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pseudonyms.pseudonymise(docs, KEY)
    return found.select("doc_id", "text", F.size("pii_found").cast("long").alias("n_found"), F.array_join("pii_found.kind", ",").alias("kinds"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.near_duplicates(_table(spark, sf_dir, "documents"), n=3, num=90, den=100)
    return found.select("doc_id", "n_shingles", "component_id")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = language.held_out(F.col("doc_id"))
    net = language.fit(docs, ~out)
    return language.identify(docs.select("doc_id", "text"), net).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op6_covertree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_duplicates(_table(spark, sf_dir, "embeddings"), cosine=0.93)


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path(), end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length", "step")


def op11_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.groups(_table(spark, sf_dir, "documents"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_hardneg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh row's label is moved by one, so that anchors have negatives close by."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), mtree.integers(F.col("embedding")).alias("v"))
    return hardneg.mine(rows, F.col("vec_id") % 50 == 0)


QUERIES = {"op1_sstable": op1_sstable, "op2_pseudonyms": op2_pseudonyms, "op3_jaccard": op3_jaccard, "op4_mixing": op4_mixing, "op5_language": op5_language, "op6_covertree": op6_covertree, "op7_substrings": op7_substrings, "op8_packing": op8_packing, "op9_mtree": op9_mtree, "op10_licenses": op10_licenses, "op11_exact": op11_exact, "op12_resample": op12_resample, "op13_hardneg": op13_hardneg}
ORACLES = {"op3_jaccard": jaccard.SQL, "op4_mixing": mixing.SQL, "op6_covertree": covertree.SQL, "op7_substrings": substrings.SQL, "op9_mtree": mtree.SQL, "op11_exact": exact.SQL, "op12_resample": resample.SQL, "op13_hardneg": hardneg.SQL}
