"""Mixing sources to target weights by hash-threshold histograms.

Sizes are summed by source and hash bucket; a running sum finds the bucket in which a source's budget ends; only
that bucket is looked at again, with finer buckets, until its hashes are single values. A document is taken when its
hash lies below its source's threshold, so the mix is a filter: no sort of documents, and reruns agree. Thresholds
of smaller budgets are smaller, so mixes of several budgets are nested.

Defined cases: null and empty sources are sources of their own, null last; null text has size 0; repeated
identifiers share a hash and are taken or left together; sources without words get target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import fresh, stored

#: Levels of the histogram and bits of the hash that each resolves: 60 bits in all.
LEVELS, BITS = 5, 12
WORD = r"[^\x20\x09-\x0D]+"


def hash60(doc_id: Column) -> Column:
    """Sixty bits of the MD5 of the identifier's text ("" for null)."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def word_count(text: Column) -> Column:
    """Number of runs of characters other than the six ASCII blanks: blanks made one character, then counted."""
    plain = F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "), F.lit(" "))
    return F.when(plain == "", F.lit(0)).otherwise(F.length(plain) - F.length(F.replace(plain, F.lit(" "), F.lit(""))) + 1).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target): weights by code point order of the source, null last; targets share ``share`` of
    all sizes, none above ``most`` times its source's size, the excess reshared by weight. The shares are
    min(most * size, level * weight); the level comes from running sums over the sources in order of size / weight."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    by = by.withColumn("weight", w)
    total = F.sum("source_size").over(Window.partitionBy())
    ratio = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    below = ratio.rowsBetween(Window.unboundedPreceding, -1)
    capped = F.coalesce(F.sum("source_size").over(below), F.lit(0)) * most
    free = F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(below), F.lit(0.0))
    by = by.withColumn("level", (total * share - capped) / free)  # the level, were all sources before this one capped
    by = by.withColumn("free", F.col("level") * F.col("weight") < F.col("source_size") * most)
    first = F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    limit = F.col("source_size") * F.lit(float(most))
    return by.select("source", "source_size", F.when(first.isNull(), limit).otherwise(F.least(limit, first * F.col("weight"))).alias("target"))


def thresholds(sizes: DataFrame, budgets: DataFrame, name: str = "mix") -> DataFrame:
    """(source, budget_no, threshold): the largest hash bound below which a source's sizes sum to its budget at most,
    or to the next document when that is nearer. ``budgets``: (source, budget_no, budget); several may be given for a source."""
    edge = budgets.select("source", "budget_no", F.col("budget").cast("double").alias("left"), F.lit(0).cast("long").alias("prefix"))
    final = None
    for level in range(1, LEVELS + 1):
        shift = (LEVELS - level) * BITS
        here = sizes.withColumn("prefix", F.shiftright("h", shift + BITS))
        held = here.join(edge.select("source", "prefix").distinct(), here.source.eqNullSafe(edge.source) & (here.prefix == edge.prefix), "left_semi")
        buckets = held.groupBy("source", "prefix", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("size"))
        b, e = buckets.alias("b"), edge.alias("e")
        sums = b.join(e, F.col("b.source").eqNullSafe(F.col("e.source")) & (F.col("b.prefix") == F.col("e.prefix")))
        until = F.sum("b.size").over(Window.partitionBy("e.source", "e.budget_no").orderBy("b.bucket"))
        sums = sums.select("e.source", "e.budget_no", "e.left", "b.bucket", "b.size", until.alias("until"))
        # the bucket in which the budget ends; where it ends in none, all are below it
        sums = stored(sums.groupBy("source", "budget_no").agg(
            F.first("left").alias("left"), F.max("bucket").alias("last"),
            F.min(F.when(F.col("until") > F.col("left"), F.struct("bucket", "size", "until"))).alias("at")), name)
        done = sums.where("at is null").select("source", "budget_no", F.shiftleft(F.col("last") + 1, shift).alias("threshold"))
        if level == LEVELS:
            near = F.when(F.col("left") - (F.col("at.until") - F.col("at.size")) >= F.col("at.until") - F.col("left"), 1).otherwise(0)
            done = done.unionByName(sums.where("at is not null").select("source", "budget_no", (F.col("at.bucket") + near).alias("threshold")))
        final = done if final is None else final.unionByName(done)
        edge = sums.where("at is not null").select("source", "budget_no", (F.col("left") - (F.col("at.until") - F.col("at.size"))).alias("left"), F.col("at.bucket").alias("prefix"))
    return final


def _sizes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"), hash60(F.col("doc_id")).alias("h"))


def plan(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target, whole, threshold), a row a source: whole epochs, and the hashes below which a document is taken once more."""
    targets = stored(source_targets(sizes, weights, share, most), "targets")
    epochs = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    limits = thresholds(sizes, epochs.select("source", F.lit(0).alias("budget_no"), rest.alias("budget")))
    e, t = epochs.alias("e"), limits.alias("t")
    return stored(e.join(t, F.col("e.source").eqNullSafe(F.col("t.source")), "left").select("e.*", F.coalesce("t.threshold", F.lit(0)).cast("long").alias("threshold")), "plan")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """All documents with (doc_id, source, size, source_size, target, copies, taken): a document is taken as often as
    its source's whole epochs and once more when its hash lies below the threshold of the rest."""
    sizes = stored(_sizes(docs), "sizes")
    s, p = sizes.alias("s"), plan(sizes, weights, share, most).alias("p")
    mixed = s.join(p, F.col("s.source").eqNullSafe(F.col("p.source")))
    copies = F.col("p.whole") + F.when(F.col("s.h") < F.col("p.threshold"), 1).otherwise(0)
    return mixed.select("s.doc_id", "s.source", "s.size", "p.source_size", "p.target", copies.alias("copies"), (F.col("s.size") * copies).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The documents with all their columns, each row as often as the mix takes it. Texts are not shuffled where the plan is small."""
    p = plan(stored(_sizes(docs), "sizes"), weights, share, most).alias("p")
    d = docs.alias("d")
    copies = F.col("p.whole") + F.when(hash60(F.col("d.doc_id")) < F.col("p.threshold"), 1).otherwise(0)
    each, one = fresh(docs, "_copies", "_copy")
    taken = d.join(p, F.col("d.source").cast("string").eqNullSafe(F.col("p.source"))).select("d.*", F.array_repeat(F.lit(0), copies.cast("int")).alias(each))
    return taken.withColumn(one, F.explode(each)).drop(each, one)


#: The same mix for DuckDB: documents of a source by hash, whole hashes below the rest of the target or nearest to it.
SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
by_source AS (SELECT source, sum(size) AS source_size FROM sizes GROUP BY source),
weighted AS (SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight FROM by_source),
levels AS (
  SELECT *, (1.5 * sum(source_size) OVER () - 2 * coalesce(sum(source_size) OVER prior, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER prior, 0)) AS level
  FROM weighted WINDOW prior AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (SELECT first(level ORDER BY source_size / weight, source NULLS LAST) AS level FROM levels WHERE level * weight < 2 * source_size),
targets AS (SELECT l.source, l.source_size, CASE WHEN c.level IS NULL THEN 2.0 * l.source_size ELSE least(2.0 * l.source_size, c.level * l.weight) END AS target
  FROM levels l LEFT JOIN chosen c ON true),
epochs AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets),
hashes AS (SELECT source, h, sum(size) AS size, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS until FROM sizes GROUP BY source, h),
cuts AS (SELECT h.source, h.h, h.until, h.until - h.size AS before, e.target - e.whole * e.source_size AS rest,
  min(CASE WHEN h.until > e.target - e.whole * e.source_size THEN h.h END) OVER (PARTITION BY h.source) AS edge
  FROM hashes h JOIN epochs e ON h.source IS NOT DISTINCT FROM e.source),
taken AS (SELECT source, h, CASE WHEN edge IS NULL OR h < edge OR (h = edge AND rest - before >= until - rest) THEN 1 ELSE 0 END AS more FROM cuts)
SELECT s.doc_id, s.size, CAST(e.source_size AS BIGINT) AS source_size, CAST(e.target AS DOUBLE) AS target, CAST(s.size * (e.whole + t.more) AS BIGINT) AS taken
FROM sizes s JOIN epochs e ON s.source IS NOT DISTINCT FROM e.source JOIN taken t ON s.source IS NOT DISTINCT FROM t.source AND s.h = t.h
"""
