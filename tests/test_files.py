"""Files in and out: RIS cut while it is read, libraries and Word documents written all or not at all, whole jobs from files."""

from __future__ import annotations

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from bibliospark.operators import library, match
from bibliospark.plans import process
from bibliospark.sources import files, formats
from test_citations import CITE, REF, ref

RECORD = "TY  - JOUR\r\nAU  - Smith, J.\r\nAU  - Lee, K.\r\nTI  - Title {i}\r\nPY  - 2020/01\r\nJO  - Sleep\r\nSP  - 1\r\nEP  - {i}\r\nDO  - 10.1/{i}\r\nER  - \r\n\r\n"
ROW = ("item", "ref_id", "authors", "title", "year", "journal", "pages", "doi")


def test_ris_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "a.ris").write_bytes("".join(RECORD.format(i=i) for i in range(1, 3001)).encode())
    (tmp_path / "b.ris").write_text("preamble\n  TY  - BOOK\nT1  - Sole\nEP  - 9\nTI  - First\nTI  - Last\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = formats.read_library(spark, str(tmp_path), "endnote").cache()
        assert got.select(F.spark_partition_id()).distinct().count() > 1
        rows = {lib: sorted(tuple(r[c] for c in ROW) for r in got.where(F.col("lib_id") == lib).collect()) for (lib,) in got.select("lib_id").distinct().collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    long, short = sorted(rows.values(), key=len, reverse=True)
    assert long == [(i, f"ris_{i}", ["Smith, J.", "Lee, K."], f"Title {i}", 2020, "Sleep", f"1-{i}", f"10.1/{i}") for i in range(1, 3001)]
    assert short == [(1, "ris_1", [], "Last", None, None, None, None)]
    whole = formats.ris(formats.library_files(spark, str(tmp_path)))
    assert {tuple(map(str, r)) for r in whole.collect()} == {tuple(map(str, r)) for r in got.collect()}
    assert "Exchange" not in whole._jdf.queryExecution().executedPlan().toString()


def test_unreadable_libraries(spark):
    rows = [(1, "not json"), (2, '[{"title": "T"}, 5, {"other": 1}]'), (3, " "), (4, None), (5, "[1, 2]"), (6, '{"items": []}')]
    table = spark.createDataFrame(rows, "lib_id long, content string")
    found = formats.zotero(table)
    assert [(r.lib_id, r.item, r.ref_id, r.title) for r in found.collect()] == [(2, 1, "zotero_0", "T")]
    assert {tuple(r) for r in formats.unread(table, found, "zotero").collect()} == {(1, "no zotero entry"), (5, "no zotero entry"), (6, "no zotero entry")}
    assert formats.ris(table).count() == 0 == formats.bibtex(table).count()


@pytest.mark.parametrize("suffix,write,read", [("ris", formats.ris_entries, "ris"), ("bib", formats.bibtex_entries, "mendeley")])
def test_one_file_a_library(spark, tmp_path, suffix, write, read):
    refs = spark.createDataFrame([ref(), ref(n=2, title="Second"), ref(doc=2, title="Other", doi="10.1/x")], REF)
    out = str(tmp_path / "out")
    formats.write_library(write(refs), out, suffix)
    assert sorted(os.listdir(out)) == [f"1.{suffix}", f"2.{suffix}", "_SUCCESS"]
    back = formats.read_library(spark, f"{out}/*.{suffix}", read)
    assert sorted((r.title, r.year, r.pages, r.doi) for r in back.collect()) == [("Other", 2020, "85-93", "10.1/x"), ("Second", 2020, "85-93", None), ("Sleep and memory", 2020, "85-93", None)]
    formats.write_library(write(refs.where("doc_id = 2")), out, suffix, "overwrite")
    assert sorted(os.listdir(out)) == [f"2.{suffix}", "_SUCCESS"]


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    good = [(f"f{i}.txt", b"x") for i in range(20)]
    for bad in [("a/b", b"x"), (None, b"x"), ("f3.txt", b"y")]:
        rows = spark.createDataFrame([*good, bad], "name string, content binary").repartition(4)
        with pytest.raises(Exception):
            files.write_named(rows, out)
        assert not os.path.exists(out) or [n for n in os.listdir(out) if not n.startswith("_staging")] == []
    files.write_named(spark.createDataFrame(good, "name string, content binary").repartition(4), out)
    assert len([n for n in os.listdir(out) if not n.startswith("_staging")]) == 21


def docx(path, lines, extra=""):
    body = "".join(f"<w:p><w:pPr/><w:r><w:t>{t}</w:t></w:r></w:p>" for t in lines)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{files.WORD}" xmlns:x="urn:x" x:kept="1"><w:body>{body}{extra}<w:sectPr><w:cols/></w:sectPr></w:body></w:document>')
        z.writestr("word/styles.xml", "<styles/>")


def test_word_documents_are_rewritten(spark, tmp_path):
    (tmp_path / "in").mkdir()
    docx(tmp_path / "in" / "a.docx", ["Body é.", "References", "Old, A. (1999). One.", "Appendix"], "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>in a table</w:t></w:r></w:p></w:tc></w:tr></w:tbl>")
    docx(tmp_path / "in" / "b.docx", ["Body only."])
    docx(tmp_path / "in" / "c.docx", ["No entries for it."])
    (tmp_path / "in" / "bad.docx").write_bytes(b"no archive")
    (tmp_path / "in" / "d.txt").write_text("left alone")
    read = formats.read_docx(spark, str(tmp_path / "in")).select("path", F.xxhash64("path").alias("doc_id")).distinct()
    new = read.where("path like '%/a.docx' or path like '%/b.docx' or path like '%/bad.docx'").select("doc_id", F.expr("inline(array(named_struct('ref_ord', 2, 'formatted', 'Two & <three>.'), named_struct('ref_ord', 1, 'formatted', 'One.')))"))
    formats.write_docx(spark, str(tmp_path / "in"), str(tmp_path / "out"), new)
    assert sorted(os.listdir(tmp_path / "out")) == ["_SUCCESS", "a.docx", "b.docx", "bad.docx", "c.docx"]
    texts = {}
    for r in formats.read_docx(spark, str(tmp_path / "out")).orderBy("path", "ord").collect():
        texts.setdefault(os.path.basename(r.path), []).append(r.text)
    assert texts == {"a.docx": ["Body é.", "References", "One.", "Two & <three>."], "b.docx": ["Body only.", "References", "One.", "Two & <three>."], "c.docx": ["No entries for it."], "bad.docx": [None]}
    whole = zipfile.ZipFile(tmp_path / "out" / "a.docx")
    part = whole.read("word/document.xml").decode()
    assert whole.read("word/styles.xml") == b"<styles/>" and 'x:kept="1"' in part and "in a table" in part and part.endswith("<w:sectPr><w:cols/></w:sectPr></w:body></w:document>")


def test_whole_job_from_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    docx(tmp_path / "in" / "a.docx", ["As (Smith, 2020) and (Nobody, 1999) say.", "References", "Smith, J. A. (2020). Article title here. Journal of Testing, 10(2), 45-67."])
    (tmp_path / "in" / "bad.docx").write_bytes(b"no archive")
    works = spark.createDataFrame([("10.5/w", "Article title here", [("J.", "Smith")], 2020, "journal-article", None, None, None)], "doi string, title string, authors array<struct<given:string,family:string>>, year int, type string, update_types array<string>, retracted_by string, updated array<int>")
    out = process.process_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), works)
    assert [(r.citations_found, r.dois_resolved) for r in out["result"].collect()] == [(2, 1)]
    assert {r.readable for r in out["documents"].collect()} == {True, False}
    assert [(r.n_citations, r.n_matched, r.is_valid) for r in out["report"].collect()] == [(2, 1, False)]
    assert "missing_reference" in {r.issue_type for r in out["issues"].collect()}
    last = formats.read_docx(spark, str(tmp_path / "out")).where("path like '%/a.docx'").orderBy(F.col("ord").desc()).first().text
    assert "10.5/w" in last and "Article title here" in last
    assert set(process.process(*[spark.createDataFrame([(1, "x")], f"doc_id long, {c} string") for c in ("body",)], spark.createDataFrame([(1, 1, "Smith, J. (2020). T.")], "doc_id long, ref_ord int, raw_text string"), validate=False, format_=False)) == {"citations", "references", "result"}


def test_occurrences_are_counted(spark):
    cites = spark.createDataFrame([(1, i, t, "author_year", [], "") for i, t in enumerate(["(Nobody, 1999)"] * 3 + ["(Smith, 2020)"] * 2)], CITE)
    refs = spark.createDataFrame([ref()], REF)
    r = match.counts(cites, refs, match.matches(cites, refs)).first()
    assert (r.n_citations, r.n_matched, r.n_unmatched, r.seconds, r.estimate) == (5, 2, 3, 24, "~24 seconds")


def test_duplicates_by_the_plain_rule(spark):
    refs = spark.createDataFrame([ref(), ref(n=2, ref_id="smith_2020b", title="Sleep and memory again"), ref(n=3, title="Other")], REF)
    cites = spark.createDataFrame([], CITE)
    got = [(r.issue_type, r.citation_text, r.related_references) for r in process.issues(cites, refs, duplicates_=False).collect() if r.stage == 4]
    assert got == [("duplicate_reference", "smith_2020; smith_2020b", [])]
    got = [(r.issue_type, r.related_references) for r in process.issues(cites, refs).collect() if r.stage == 4]
    assert ("potential_duplicate", ["smith_2020", "smith_2020b", "smith_2020"]) in got


def test_import_result(spark):
    refs = spark.createDataFrame([ref(doi="10.1/a"), ref(n=2, title="Left over here", doi=None)], REF)
    imported = spark.createDataFrame([(1, 1, "Whatever", "10.1/A", "k1", ["Smith, J.", "Lee, K."], 2020), (1, 2, None, None, "k2", [], None), (2, 1, "Alone", None, "k3", ["Doe"], 1990)], "doc_id long, item int, title string, doi string, ref_id string, authors array<string>, year int")
    rows = {r.doc_id: r for r in library.result(imported, refs).collect()}
    one, two = rows[1], rows[2]
    assert (one.imported_count, one.matched_count, one.unmatched_document_refs, one.unmatched_import_refs) == (2, 1, ['Smith (2020) "Left over here"'], ["k2"])
    assert one.suggestions == ["1 reference(s) in document not found in your library", "1 reference(s) in library not cited in document"]
    assert (two.imported_count, two.matched_count, two.unmatched_import_refs, two.suggestions) == (1, 0, ['Doe (1990) "Alone"'], ["1 reference(s) in library not cited in document"])
