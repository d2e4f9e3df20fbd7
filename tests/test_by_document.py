"""Tables in buckets by document: joins that deal nothing anew, and the documents that are too large for them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from bibliospark import tables
from bibliospark.operators import duplicates, titles, works as lookup
from bibliospark.plans import corpus, process

REFS = "doc_id long, ref_ord int, ref_id string, raw_text string, authors array<string>, title string, year int, journal string, doi string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
def test_joins_within_documents_are_joins_on_both_keys(spark, how):
    left = tables.by_document(spark.createDataFrame([(d, k, f"l{i}") for i, (d, k) in enumerate([(1, "a"), (1, "a"), (1, None), (2, "b"), (3, "c"), (3, "a"), (None, "a")] + [(4, f"k{i}") for i in range(20)])], "doc_id long, k string, x string"), "left")
    right = tables.by_document(spark.createDataFrame([(d, k, f"r{i}") for i, (d, k) in enumerate([(1, "a"), (1, "b"), (1, None), (2, "b"), (2, "b"), (3, "C"), (None, "a")] + [(4, f"k{i}") for i in range(0, 20, 3)])], "doc_id long, k string, y string"), "right")
    want = sorted(map(tuple, left.join(right, ["doc_id", "k"], how).collect()), key=str)
    for most, some in ((100, False), (10, True)):
        large = tables.large_documents(left, right, most=most)
        got = tables.within(left, right, "k", how, large)
        assert large.some == some and sorted(map(tuple, got.collect()), key=str) == want
        assert some or "Exchange" not in plan(got)


def test_a_table_is_written_in_buckets_once_and_leaves_no_name(spark):
    before = spark.catalog.listTables()
    rows = tables.by_document(spark.range(50).select((F.col("id") % 7).alias("doc_id"), "id"), "rows")
    assert tables.by_document(rows, "again") is rows and spark.catalog.listTables() == before
    assert "Exchange" not in plan(rows.groupBy("doc_id", "id").count()) and rows.count() == 50


def test_tables_for_others_may_be_united(spark):
    rows = [tables.plain(tables.by_document(spark.range(50).select((F.col("id") % 7).alias("doc_id"), "id"), "rows")) for _ in range(2)]
    assert rows[0].select("doc_id").union(rows[1].select("doc_id")).distinct().count() == 7


def test_references_are_not_dealt_anew_for_every_stream_of_issues(spark, sf_dir):
    cites, refs = corpus.cites(spark, sf_dir, by_document=True), corpus.refs(spark, sf_dir, by_document=True)
    for found in (process.issues(cites, refs), process.checked(cites, refs)[1]):
        assert plan(found).count("Exchange hashpartitioning") <= 4  # of pairs and groups of duplicates only


def test_differences_read_references_where_they_lie(spark, sf_dir):
    refs = tables.by_document(corpus.refs(spark, sf_dir), "refs")
    found = plan(duplicates.differences(refs, duplicates.groups(refs)))
    assert found.count("Exchange hashpartitioning") <= 4 and "SortMergeJoin [doc_id" in found


def test_large_documents_have_the_same_pairs_of_authors(spark, monkeypatch):
    people = [["Smith, A."], ["Smith, A.", "Lee, K."], ["Lee, K.", "Smith, B."], ["Smith, A.", "Lee, K.", "Ito, C."], [], None, ["Ito, C.", None]]
    rows = [(d, i, f"r{i}", f"t{d}{i}", people[(i * (d + 1)) % 7], None, [2001, 2002, 2004, None][(i + d) % 4], None, None) for d in (1, 2) for i in range(9 * d)]
    keyed = duplicates._numbered(spark.createDataFrame(rows, REFS))
    got = []
    for tile in (titles.TILE, 10, 1):
        monkeypatch.setattr(titles, "TILE", tile)
        got.append(sorted(map(tuple, duplicates._peopled(keyed, 0.6).collect())))
    assert got[0] == got[1] == got[2] and len(got[0]) > 10


def test_parts_and_works_are_never_sent_to_the_driver(spark, sf_dir):
    refs, works = corpus.refs(spark, sf_dir), corpus.works(spark, sf_dir)
    for found in (refs.select("doc_id"), works.select("doi"), lookup.verified(refs, works), lookup.backfilled(refs, works), lookup.resolved(refs, works)):
        assert "BroadcastExchange" not in plan(found)
