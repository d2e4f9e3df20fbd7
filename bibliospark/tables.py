"""Intermediate tables that several later steps read, written once to the folder that the whole cluster shares.

Tables of documents are written in buckets by doc_id, as many as there are shuffle partitions: windows, aggregates and
joins that begin with doc_id read them where they lie, and nothing is dealt anew for each step.
"""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
import weakref
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows of a document beyond which it is large: its rows meet on all keys of a join, not on doc_id alone.
MANY = 300

_BUCKETED: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and everything runs in one process, as in tests, a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _own_folder()


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table, written as Parquet and read again: later steps neither plan nor compute it anew, and lost executors lose
    nothing of it."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """The table as a side of a join that is never sent whole to the driver and from there to all tasks. Spark would send
    one that it takes for small by the size of its files, and a few MB of Parquet may be hundreds in memory."""
    return df.hint("merge")


def dealt(df: DataFrame) -> DataFrame:
    """The rows by document; no shuffle where they are dealt so already."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")


def by_document(df: DataFrame, name: str) -> DataFrame:
    """``stored`` in buckets by doc_id, unless the table is one of these. Only tables of a catalog have buckets, so it is one
    while it is written and read first; the catalog forgets it then, and its files stay as those of others do.

    Not to be united as they are: Spark 4.1 takes the union of two such scans for one in buckets, but does not read it so.
    What is handed to others is therefore ``plain``.
    """
    if df in _BUCKETED:
        return df
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = f"spark_catalog.default.{table}"
    path = f"{shared_folder(spark)}/{table}"
    dealt(df).write.format("parquet").bucketBy(n, "doc_id").option("path", path).saveAsTable(named)
    rows = spark.table(named)
    spark.sql(f"DROP TABLE {named}")
    _BUCKETED[rows] = path
    return rows


def plain(df: DataFrame) -> DataFrame:
    """A table of ``by_document`` without its buckets."""
    return df.sparkSession.read.schema(df.schema).parquet(_BUCKETED[df])


@dataclass(frozen=True)
class Large:
    """The documents (doc_id) of more than MANY rows, and whether there are any."""

    rows: DataFrame
    some: bool


def large_documents(*tables: DataFrame, most: int = MANY) -> Large:
    """Of tables by document: those that have more than ``most`` rows in all of them."""
    counts = [t.groupBy("doc_id").agg(F.count("*").alias(f"n{i}")) for i, t in enumerate(tables)]
    every = functools.reduce(lambda x, y: x.join(y, "doc_id", "full"), counts)
    n = sum((F.coalesce(f"n{i}", F.lit(0)) for i in range(len(tables))), F.lit(0))
    rows = stored(every.where(n > most).select("doc_id"), "large")
    return Large(rows, not rows.isEmpty())


def within(left: DataFrame, right: DataFrame, key: str, how: str, large: Large | None) -> DataFrame:
    """``left.join(right, ["doc_id", key], how)``, inner, left or left_anti, of tables by document.

    Spark deals both sides anew where a join has more keys than they are dealt by. So rows of one document meet, and the
    key is compared as a range, which no planner takes for a key of the join; in large documents it is one. Where large
    is not given, both are keys for all.
    """
    if large is None:
        return left.join(kept(right), ["doc_id", key], how)

    def met(x: DataFrame, y: DataFrame) -> DataFrame:
        own = [F.col(f"r.{c}") for c in right.columns if c not in ("doc_id", key)]
        on = (F.col("l.doc_id") == F.col("r.doc_id")) & (F.col(f"l.{key}") >= F.col(f"r.{key}")) & (F.col(f"l.{key}") <= F.col(f"r.{key}"))
        return x.alias("l").join(kept(y.alias("r")), on, how).select("l.*", *(own if how != "left_anti" else []))

    if not large.some:
        return met(left, right)
    few, many = ([t.join(large.rows, "doc_id", kind) for t in (left, right)] for kind in ("left_anti", "left_semi"))
    return met(*few).unionByName(many[0].join(kept(many[1]), ["doc_id", key], how))
