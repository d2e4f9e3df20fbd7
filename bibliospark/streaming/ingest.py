"""Documents as they arrive: file streams of bodies and entries through the detector and the quick check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import extract, parse
from ..plans import process

#: Folders into which arrivals are dealt by document, so that a batch reads only those of the documents it touches.
PARTS = 256


def documents(spark: SparkSession, path: str) -> DataFrame:
    """A stream of new Parquet files with doc_id and body."""
    return spark.readStream.schema("doc_id long, body string").parquet(path)


def entries(spark: SparkSession, path: str) -> DataFrame:
    """A stream of new Parquet files with doc_id, ref_ord and raw_text."""
    return spark.readStream.schema("doc_id long, ref_ord int, raw_text string").parquet(path)


def detected(stream: DataFrame, path: str, checkpoint: str):
    """Citations of each micro-batch, appended as Parquet; exactly once by the batch's own folder."""

    def batch(df: DataFrame, number: int) -> None:
        extract.detect(df).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def checked(bodies: DataFrame, listed: DataFrame, path: str, checkpoint: str):
    """The quick check of documents whose bodies and entries arrive in any order: a new row for each document that a batch
    touches, once a batch, below path/report. ``current`` gives the newest.

    Arrivals are kept below path/arrived, by batch and part of the documents; a batch reads all earlier arrivals of its
    own documents. Of several bodies, or entries with one number, the last batch's counts, in a batch the greatest text.
    A batch that is repeated overwrites its folders and reads none after itself, so it gives the same rows again.
    """
    none = lambda kind: F.lit(None).cast(kind)
    rows = bodies.select("doc_id", "body", none("int").alias("ref_ord"), none("string").alias("raw_text"))
    rows = rows.unionByName(listed.select("doc_id", none("string").alias("body"), "ref_ord", "raw_text"))
    schema = "doc_id long, body string, ref_ord int, raw_text string, batch long, part int"

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        dealt = df.where("doc_id is not null").withColumn("part", F.pmod(F.hash("doc_id"), F.lit(PARTS)))
        dealt.write.mode("overwrite").partitionBy("part").parquet(f"{path}/arrived/batch={number}")
        arrived = spark.read.schema(schema).parquet(f"{path}/arrived").where(F.col("batch") <= number)
        touched = arrived.where(F.col("batch") == number).select("part", "doc_id").distinct()
        own = arrived.join(touched, ["part", "doc_id"], "left_semi")
        last = lambda c: F.max(F.struct("batch", c))[c].alias(c)
        texts = own.where("ref_ord is null").groupBy("doc_id").agg(last("body"))
        lists = own.where("ref_ord is not null").groupBy("doc_id", "ref_ord").agg(last("raw_text"))
        found = process.quick_check(extract.detect(texts), parse.parse(lists))
        found.write.mode("overwrite").parquet(f"{path}/report/batch={number}")

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of each document of ``checked``, with its batch."""
    reports = spark.read.parquet(f"{path}/report")
    row = F.struct("batch", *[c for c in reports.columns if c not in ("doc_id", "batch")])
    return reports.groupBy("doc_id").agg(F.max(row).alias("r")).select("doc_id", "r.*")
