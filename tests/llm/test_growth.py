"""What grows with the number of partitions or batches, not with the input, stays small."""

from __future__ import annotations

import uuid

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from bibliospark.llm import common, countmin, jaccard, packing, tokens


def test_jobs_do_not_grow_with_the_partitions(spark):
    keys = spark.range(1000).select(F.xxhash64("id").alias("text_key"))

    def jobs(partitions):
        group = uuid.uuid4().hex
        before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.sparkContext.setJobGroup(group, "")
        try:
            bitmap = countmin.members(keys)
            counts = jaccard._bin_counts(spark.createDataFrame([("a b c d a b c",)], "text string"), 3, False)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
            for k, v in before.items():
                spark.conf.set(k, v)
        assert counts.sum() == 5 and bitmap.of(np.array([r.text_key for r in keys.collect()], np.int64).view(np.uint64)).all()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(40) <= jobs(4) + 4


def test_members_are_counted_by_task_not_by_batch(spark, monkeypatch):
    common.small_batches(spark)
    made = []

    class Seen(countmin.Repeated):
        def __init__(self, spark, sketches, bits, many=False):
            made.append((sketches.count(), bits))

    monkeypatch.setattr(countmin, "Repeated", Seen)
    countmin.members(spark.range(0, 600_000, 1, 2).select(F.xxhash64("id").alias("text_key")))
    (rows, bits), = made
    assert rows <= 4 * countmin.ROWS << bits - countmin.RANGE_BITS


def test_classes_without_a_size_near_enough_leave_the_bucket(spark):
    join = object.__new__(jaccard.Join)
    join.num, join.den = 90, 100
    sizes = {1: 100, 2: 100, 3: 110, 4: 111, 5: 50, 6: 51, 7: 20, 8: 122}
    index = spark.createDataFrame([(t, c, n, 0, t, 8) for t in (1, 2) for c, n in sizes.items()], "token long, c long, size long, pos int, prev long, n long")
    part = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5)], "c long, component long")
    left = join._left(index, part).collect()
    assert sorted((r.token, r.c) for r in left) == [(t, c) for t in (1, 2) for c in (1, 2, 3, 4, 8)]
    assert {r.c: r.component for r in left} == {1: 1, 2: 1, 3: 3, 4: 4, 8: 8}
def test_long_texts_are_not_remembered():
    seen = []
    memory = tokens.Memory(lambda t: seen.append(t) or b"x", 10)
    assert [memory["a" * n] for n in (3, 3, 500, 500)] == [b"x"] * 4
    assert seen == ["aaa", "a" * 500, "a" * 500] and list(memory) == ["aaa"]


def test_the_pipeline_packs_with_a_small_memory(spark, monkeypatch):
    bounds = {}
    monkeypatch.setattr(packing, "pack_documents", lambda docs, path, **bound: bounds.update(bound))
    corpus_pipeline.pack(spark, None, "")
    small = tokens.encoder(corpus_pipeline.tokenizer_path(), bounds["remembered"])
    assert small.pieces.bound + small.words.bound < (tokens.Encoder.PIECES + tokens.Encoder.WORDS) / 4 and bounds["bundle_bytes"] <= 2 << 20
    texts = ["A few words, again: a few words.", "", "x" * 300]
    assert small.packed(texts) == tokens.encoder(corpus_pipeline.tokenizer_path()).packed(texts)


def test_plain_blobs():
    values = np.array([5, 9, 70_000, 1, 2])
    blobs = common.plain_blobs(values, np.array([0, 3]), np.array([3, 5]))
    assert [common.unpacked_gaps(b).tolist() for b in blobs] == [[5, 9, 70_000], [1, 2]]
    assert sorted(np.concatenate(common.joined_blobs([*blobs, common.packed_gaps(np.array([3, 4]))])).tolist()) == [1, 2, 3, 4, 5, 9, 70_000]
