"""Exact deduplication: groups by a 128-bit hash of the normalised text, bytes compared inside groups.

Texts are equal when they are identical after each run of the six ASCII blanks has become one space. One pass hashes
every text and writes (identifier, hash, SHA-256); groups are a count and a smallest identifier a hash, summed in each
task before the shuffle, so a group of a third of all rows is one row a task. A second pass reads only the texts whose
hash repeats - a bitmap of the repeated hashes, of a size set beforehand, lets all others go before any shuffle - and
compares them: a group's texts are equal if its smallest and its largest text, in order of bytes, are the same, which
again is summed in each task. Where they differ, a collision, that group alone is split by its texts.

Defined cases: a null text is empty; texts of any length are compared whole; of equal texts the row with the smallest
identifier stays, null identifiers last; rows that repeat both identifier and text stay or go together; extra columns
play no part; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh, stored

#: Bits of the bitmap for each repeated hash, and the most bits (32 MB to broadcast).
BITS_EACH, MOST_BITS = 16, 1 << 28
#: Bits of one of Spark's bitmaps.
PAGE = 1 << 15


def normalised(text: Column) -> Column:
    """Each run of blanks as one space; single spaces are left alone."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def _bitmap(hashes: DataFrame, bits: int) -> DataFrame:
    """(page, bitmap) of the hashes' places: at most bits / PAGE rows of 4 KB."""
    place = F.pmod(F.xxhash64("h"), F.lit(bits)) + 1
    return hashes.groupBy(F.bitmap_bucket_number(place).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap"))


def _may_repeat(rows: DataFrame, pages: DataFrame, bits: int) -> DataFrame:
    """The rows whose hash has its bit set: none that repeats is lost."""
    place = F.pmod(F.xxhash64("h"), F.lit(bits)) + 1
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substr("bitmap", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (at % 8).cast("int") + 1))
    joined = rows.join(F.broadcast(pages), F.bitmap_bucket_number(place) == F.col("page"))
    return joined.where(bit != 0).select(*rows.columns)


def groups(docs: DataFrame, digest: Callable[[Column], Column] = F.md5) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of docs (doc_id, text).

    digest gives a text's hash as hexadecimal digits: 128 bits, unless a test wants collisions.
    """
    rows = docs.select("doc_id", normalised(F.col("text")).alias("text"))
    hashed = rows.select("doc_id", F.unhex(digest(F.col("text"))).alias("h"), "text")
    keys = stored(hashed.select("doc_id", "h", F.unhex(F.sha2("text", 256)).alias("sha")), "hashes")
    grouped = keys.groupBy("h").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    repeated = stored(grouped.where("group_size > 1"), "repeated")
    bits = min(MOST_BITS, max(PAGE, 1 << (BITS_EACH * repeated.count()).bit_length()))
    suspects = _may_repeat(hashed, _bitmap(repeated, bits), bits)
    ends = suspects.groupBy("h").agg(F.min("text").alias("low"), F.max("text").alias("high"))
    collided = stored(ends.where("low <> high").select("h"), "collided")

    shown = ["doc_id", F.coalesce("keep_id", "doc_id").alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), "sha"]
    plain = keys.join(repeated, "h", "left")
    if collided.isEmpty():
        out = plain.select(*shown)
    else:
        apart = suspects.join(collided, "h").select("doc_id", "text")
        texts = apart.groupBy("text").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        apart = apart.join(texts, "text").withColumn("sha", F.unhex(F.sha2("text", 256)))
        out = plain.join(collided, "h", "left_anti").select(*shown).unionAll(apart.select(*shown))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns; only identifiers and hashes of those that go are shuffled beside them."""
    doc, sha, own = fresh(docs, "gone_id", "gone_sha", "own_sha")
    gone = groups(docs).where("not kept").select(F.col("doc_id").alias(doc), F.col("text_sha256").alias(sha)).distinct()
    named = docs.withColumn(own, F.sha2(normalised(F.col("text")), 256))
    same = named["doc_id"].eqNullSafe(gone[doc]) & (named[own] == gone[sha])
    return named.join(gone, same, "left_anti").drop(own)


SQL = r"""
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents) WINDOW w AS (PARTITION BY t)
"""
