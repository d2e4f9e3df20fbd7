"""Citation operators on hand-made rows."""

from __future__ import annotations

import zipfile

import pytest
from pyspark.sql import functions as F

from bibliospark.functions import names, similarity, text as tx
from bibliospark.operators import duplicates, extract, library, match, parse, quality, render
from bibliospark.plans import process
from bibliospark.sources import formats

REF = "doc_id long, ref_ord int, ref_id string, raw_text string, authors array<string>, title string, year int, journal string, volume string, issue string, pages string, doi string, doi_url string"
CITE = "doc_id long, cit_ord int, text string, citation_type string, reference_ids array<string>, context string"


def ref(doc=1, n=1, ref_id="smith_2020", raw="Smith 2020", authors=("Smith, J.",), title="Sleep and memory", year=2020, journal="Sleep", volume="29", issue="1", pages="85-93", doi=None):
    return (doc, n, ref_id, raw, list(authors), title, year, journal, volume, issue, pages, doi, f"https://doi.org/{doi}" if doi else None)


def found(spark, body):
    return [(r.text, r.start_pos, r.end_pos, r.citation_type, list(r.reference_ids)) for r in extract.detect(spark.createDataFrame([(1, body)], "doc_id long, body string")).orderBy("cit_ord").collect()]


@pytest.mark.parametrize("body,expected", [
    ("As (Smith, 2020) said", [("(Smith, 2020)", 3, 16, "author_year", ["smith_2020"])]),
    ("é😀 (Smith & Jones, 2020; Lee et al., 2019a)", [("(Smith & Jones, 2020)", 3, 43, "author_year", ["smith_2020"]), ("(Lee et al., 2019a)", 3, 43, "author_year", ["lee_2019a"])]),
    ("x (ABC; Stone et al., 2005) y", [("(Stone et al., 2005)", 2, 27, "author_year", ["stone_2005"])]),
    ("Stone and colleagues (2005) and [1]", [("Stone and colleagues (2005)", 0, 27, "author_inline", ["stone_2005"])]),
    ("[1] and [2, 3] and [4-6] and [3-1]", [("[1]", 0, 3, "numeric", ["1"]), ("[2, 3]", 8, 14, "numeric", ["2", "3"]), ("[4-6]", 19, 24, "numeric", ["4", "5", "6"]), ("[3-1]", 29, 34, "numeric", [])]),
    ("plain text", []), ("", []), (None, []),
])
def test_detection(spark, body, expected):
    assert found(spark, body) == expected


@pytest.mark.parametrize("raw,expected", [
    ("Smith, J. A. (2020). Article title here. Journal of Testing, 10(2), 45-67.", ("apa", "smith_2020", ["Smith, J. A"], "Article title here", 2020, None, None, None, None)),
    ("Smith J, Jones B. Sleep and memory. Sleep 2006;29(1):85-93.", ("vancouver", "smith_2006", ["Smith J", "Jones B"], "Sleep and memory.", 2006, "Sleep", "29", "1", "85-93")),
    ("Hart, T.A., Cole, R.L., 1991. Mapping adult age differences. Dev. Psychol. 27(5), 763-776.", ("harvard", "hart_1991", ["Hart, T.A.", "Cole, R.L"], "Mapping adult age differences.", 1991, "Dev. Psychol", "27", "5", "763-776")),
    ("3. Lee K, Park S. Short note. Brain. 2011;7(4):41.", ("vancouver", "3", ["Lee K", "Park S"], "Short note.", 2011, "Brain", "7", "4", "41")),
    ("no form at all", ("fallback", "ref_", [], None, None, None, None, None, None)),
])
def test_parsing(spark, raw, expected):
    r = parse.parse(spark.createDataFrame([(1, 1, raw)], "doc_id long, ref_ord int, raw_text string")).first()
    assert (r.rule, r.ref_id, r.authors, r.title, r.year, r.journal, r.volume, r.issue, r.pages) == expected


def test_doi(spark):
    r = parse.parse(spark.createDataFrame([(1, 1, "Smith, J. (2020). T. J. https://doi.org/10.1000/xyz.")], "doc_id long, ref_ord int, raw_text string")).first()
    assert (r.doi, r.doi_url) == ("10.1000/xyz", "https://doi.org/10.1000/xyz")


@pytest.mark.parametrize("cited,year_ref,author,kind", [("(Smith, 2020)", 2020, "Smith, J.", "exact"), ("(Smyth, 2020)", 2020, "Smith, J.", "fuzzy"), ("(Smith, 2019)", 2020, "Smith J", "fuzzy"), ("(Smith, 2018)", 2020, "Smith, J.", None), ("(Li, 2020)", 2020, "Williams, B.", "exact"), ("(Smith & Brown, 2020)", 2020, "Smith, J.", "exact"), ("(Smith, 2020)", None, "John Smith", "exact")])
def test_matching(spark, cited, year_ref, author, kind):
    c = spark.createDataFrame([(1, 1, cited, "author_year", [], "")], CITE)
    r = spark.createDataFrame([ref(authors=(author,), year=year_ref), ref(doc=2)], REF)
    assert [m.match_type for m in match.matches(c, r).collect()] == ([kind] if kind else [])


def test_report_of_a_clean_and_a_bad_document(spark):
    cites = spark.createDataFrame([(1, 1, "(Smith, 2020)", "author_year", [], "sleep"), (2, 1, "(Nobody, 1999)", "author_year", [], None), (2, 2, "(Smyth and Lee, 2020)", "author_year", [], "")], CITE)
    refs = spark.createDataFrame([ref(doi="10.1/a"), ref(doc=2), ref(doc=2, n=2, raw="Smith 2020 ", ref_id="other_2001", authors=("Other, A.",), year=2001, title=None, pages=None)], REF)
    issues = process.issues(cites, refs)
    assert {r.doc_id for r in issues.collect()} == {2}
    kinds = {r.issue_type for r in issues.collect()}
    assert {"missing_reference", "spelling_mismatch", "uncited_reference", "potential_duplicate", "style_warning", "incomplete_reference"} <= kinds
    reports = {r.doc_id: (r.n_citations, r.n_references, r.n_matched, r.is_valid) for r in process.report(cites, refs, issues).collect()}
    assert reports == {1: (1, 1, 1, True), 2: (2, 2, 1, False)}


def test_duplicate_tiers(spark):
    refs = spark.createDataFrame([ref(n=1, doi="10.1/A"), ref(n=2, raw="SMITH 2020", doi="10.1/a"), ref(n=3, raw="c", doi="10.1/z", title="Other work", authors=("Z, A.",)), ref(n=4, raw="d", doi="10.1/Z", title="Different", authors=("Y, A.",), year=1990),
                                  ref(n=5, raw="e", title="A study of long sleep in cats", authors=("Q, A.",), year=1980), ref(n=6, raw="f", title="A study of long sleep in cat", authors=("R, A.",), year=1970)], REF)
    got = {(r.match_type, tuple(r.ords)) for r in duplicates.groups(refs).collect()}
    assert got == {("exact_duplicate", (1, 2)), ("doi_match", (3, 4)), ("title_fuzzy", (5, 6))}


def test_completeness_and_journals(spark):
    refs = spark.createDataFrame([ref(doi="10.1/a"), ref(n=2, authors=(), journal="sleep med"), ref(n=3, journal="Sleep Medicine", pages=None, volume=None, issue=None), ref(n=4, authors=(), title=None, year=None, journal=None, pages=None)], REF)
    assert [r.score for r in quality.scores(refs).orderBy("ref_ord").collect()] == [1.0, 0.75, 0.85, 0.0]
    assert [(r.canonical, r.names) for r in quality.inconsistent(refs).collect()] == [("Sleep Medicine", ["Sleep Medicine", "sleep med"])]
    named = spark.createDataFrame([("J Neurosci",), ("Cerebral Cortexx",), ("Mol Psychiatri",), ("Nothing Like It",), (None,)], "journal string")
    got = {r.journal: r.canonical for r in quality.normalised(named).collect()}
    assert got["J Neurosci"] == "Journal of Neuroscience" and got["Cerebral Cortexx"] == "Cerebral Cortex" and got["Nothing Like It"] == "Nothing Like It"


@pytest.mark.parametrize("style,expected", [("apa", "Smith, J.A. (2020). Article title here. Journal of Testing. 10(2). 45-67."), ("vancouver", "Smith J.A. Article title here. Journal of Testing 2020;10(2):45-67."), ("mla", 'Smith, John A. 2020. "Article Title Here". Journal of Testing. vol. 10, no. 2. pp. 45-67.')])
def test_rendering(spark, style, expected):
    r = spark.createDataFrame([ref(authors=("Smith, John A.",), title="Article title here", journal="Journal of Testing", volume="10", issue="2", pages="45-67")], REF)
    assert render.rendered(r, render.style(style)).first().formatted == expected


def test_learned_style(spark):
    examples = spark.createDataFrame([(1, "Smith J, Lee K. A title. Sleep 2006;29(1):85-93."), (2, "Stone B. More. Brain 2011;7(4):41-44.")], "example_ord int, example string")
    got = render.learned_style(examples)
    assert got["grouped"] and got["author"] == "{last} {first_init}" and got["year_place"] == "after_journal" and render.learned_style(examples.limit(0))["year"] == "({year})"


@pytest.mark.parametrize("kind", ["bibtex", "ris"])
def test_export_and_import_agree(spark, kind):
    refs = spark.createDataFrame([ref(title="Sleep {and} memory"[:5]), ref(n=2, authors=("Smith, J.", "Lee, K."), year=2020, doi="10.1/x"), ref(n=3, authors=(), title=None, year=None, journal=None, volume=None, issue=None, pages=None)], REF)
    rows = formats.bibtex_entries(refs) if kind == "bibtex" else formats.ris_entries(refs)
    back = (formats.bibtex if kind == "bibtex" else formats.ris)(formats.exported(rows).select(F.col("doc_id").alias("lib_id"), "content")).orderBy("item").collect()
    assert [(r.authors, r.title or None, r.year, r.pages, r.doi) for r in back] == [(["Smith, J."], "Sleep", 2020, "85-93", None), (["Smith, J.", "Lee, K."], "Sleep and memory", 2020, "85-93", "10.1/x"), ([], None, None, None, None)]
    if kind == "bibtex":
        assert [r.key for r in rows.orderBy("ref_ord").collect()] == ["smith2020", "smith2020a", ""]


def test_bibtex_with_nested_braces_and_quotes(spark):
    content = '@comment{x}\n@article{key1,\n title = {The {DNA} of {Sleep}}, author = "Smith, J. and Lee, K.", year = 2020, pages = {45--67}\n}'
    r = formats.bibtex(spark.createDataFrame([(1, content), (2, ""), (3, None)], "lib_id long, content string")).collect()
    assert [(x.ref_id, x.title, x.authors, x.year, x.pages) for x in r] == [("key1", "The DNA of Sleep", ["Smith, J.", "Lee, K."], 2020, "45-67")]


def test_zotero(spark):
    item = '{"key":"K","title":"T","creators":[{"creatorType":"author","lastName":"Smith","firstName":"J."},{"creatorType":"editor","lastName":"E"}],"date":"May 2020","extra":"DOI: 10.1/x"}'
    files = spark.createDataFrame([(1, f"[{item}]"), (2, f'{{"items":[{item}]}}'), (3, item)], "lib_id long, content string")
    assert [(r.authors, r.year, r.doi) for r in formats.zotero(files).collect()] == [(["Smith, J."], 2020, "10.1/x")] * 3


def test_word_documents_and_sections(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    lines = ["Body (Smith, 2020).", "", "References", "Smith, J. (2020). One", "goes on.", "Lee, K. (2019). Two.", "Figure 1 ends", "After"]
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>' + "".join(f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for t in lines) + "</w:body></w:document>")
    (tmp_path / "b.txt").write_text("not read")
    p = formats.read_docx(spark, str(tmp_path)).withColumn("doc_id", F.lit(1))
    assert [r.raw_text for r in formats.entries(p).orderBy("ref_ord").collect()] == ["Smith, J. (2020). One goes on.", "Lee, K. (2019). Two."]
    assert formats.bodies(p).first().body == "Body (Smith, 2020)."
    new = formats.rewritten(p, spark.createDataFrame([(1, 1, "New.")], "doc_id int, ref_ord int, formatted string"))
    assert [r.text for r in new.orderBy("ord").collect()] == ["Body (Smith, 2020).", "References", "New."]


@pytest.mark.parametrize("header,last", [("Reference", "Conflict of Interest None declared."), ("Works  Cited", "Fig. 2 shows"), ("Sources", "Supporting Information"), ("citation", "Data Availability"), ("Work cited", "Author Contributions")])
def test_headers_ends_and_particles(spark, header, last):
    lines = ["Body.", header, "van der de la Berg, J. (2020). One", " ", "goes on.", "Fernandez\u2010Mendoza J. Two.", last, "Smith, J. (1999). Not a reference."]
    p = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "doc_id int, ord int, text string")
    assert [r.raw_text for r in formats.entries(p).orderBy("ref_ord").collect()] == ["van der de la Berg, J. (2020). One goes on.", "Fernandez\u2010Mendoza J. Two."]


def test_odd_word_documents(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/><w:t>c</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "bad.docx").write_bytes(b"no archive")
    got = {(r.path.rpartition("/")[2], r.ord, r.text) for r in formats.read_docx(spark, str(tmp_path)).collect()}
    assert got == {("a.docx", 0, "a\tb\nc"), ("bad.docx", None, None)}


WORK = "doi string, title string, authors array<struct<given:string,family:string>>, year int, type string, update_types array<string>, retracted_by string, updated array<int>"


def work(doi, title="Sleep and memory", family="Smith", year=2020, kind="journal-article", updates=None, by=None, updated=None):
    return (doi, title, [("J.", family)] if family else [], year, kind, updates, by, updated)


def test_years_of_works(spark):
    from bibliospark.operators import works as lookup

    rows = [([2001, 5], [2000], [1999]), (None, [2000], [1999]), ([], None, [1999]), (None, None, None)]
    got = spark.createDataFrame(rows, "p array<int>, o array<int>, i array<int>").select(lookup.item_year(F.col("p"), F.col("o"), F.col("i")).alias("y")).collect()
    assert [r.y for r in got] == [2001, 2000, 1999, None]


def test_references_are_verified_or_searched(spark):
    from bibliospark.operators import works as lookup

    works = spark.createDataFrame([work("10.1/a"), work("10.1/b", "Sleap and memory in cats"), work("10.1/c", "Other things", "Lee", 1990), work("10.1/d", "A wholly different title", None, None)], WORK)
    refs = spark.createDataFrame([ref(n=1, doi="https://doi.org/10.1/C"), ref(n=2, doi="10.9/none"), ref(n=3), ref(n=4, title="A wholly different title", authors=(), year=None), ref(n=5, title="nothing alike", authors=("Lee, K.",), year=2001), ref(n=6, title=None), ref(doc=2, n=1)], REF)
    got = {(r.doc_id, r.ref_ord): (r.how, r.doi, r.authors) for r in lookup.resolved(refs, works).collect()}
    assert got == {(1, 1): ("verified", "10.1/c", ["J. Lee"]), (1, 3): ("searched", "10.1/a", ["J. Smith"]), (1, 4): ("searched", "10.1/d", []), (2, 1): ("searched", "10.1/a", ["J. Smith"])}
    assert [r.rank for r in lookup.candidates(refs, works).where("doc_id = 2").orderBy("rank").collect()] == [1, 2]


def test_retractions_of_one_doi_do_not_depend_on_order(spark):
    from bibliospark.operators import works as lookup

    rows = [work("10.1/a"), work("10.1/A", kind="retraction", updated=[2021, 3]), work("10.1/a", updates=["Retraction"], updated=[2022]), work("10.1/b")]
    refs = spark.createDataFrame([ref(n=1, doi="10.1/a"), ref(n=2, doi="10.1/b"), ref(n=3, doi="10.1/c"), ref(n=4)], REF)
    for order in (rows, rows[::-1]):
        got = [tuple(r)[3:] for r in lookup.retractions(refs, spark.createDataFrame(order, WORK)).orderBy("ref_ord").collect()]
        assert got == [("10.1/a", True, "update", "2022", None), ("10.1/b", False, None, None, None), ("10.1/c", False, None, None, "DOI not found")]


def test_web_searches_follow_each_other(spark):
    from bibliospark.operators import works as lookup

    works = spark.createDataFrame([work("10.1/a", "Cats"), work("10.1/b", "Sleep of cats"), work("10.1/c", "Brain of dogs"), work("10.1/d", "Insomnia and hippocampus"), work("10.1/e", "Insomnia", year=2022)], WORK)
    missing = spark.createDataFrame([(1, 1, "(Smith, 2020)", "the hippocampus in insomnia of cats"), (1, 2, "(Smith, 2020)", "about cats")], "doc_id long, cit_ord int, text string, context string")
    got = {r.cit_ord: r.found.split("\n") for r in lookup.web_suggestions(missing, works).collect()}
    head = "[WEB SEARCH] Possible matches:"
    assert got[1] == [head, "  1. Smith J (2020). Insomnia and hippocampus https://doi.org/10.1/d", "  2. Smith J (2020). Sleep of cats https://doi.org/10.1/b", "  3. Smith J (2020). Brain of dogs https://doi.org/10.1/c"]
    assert [line.rpartition("/")[2] for line in got[2][1:]] == ["a", "b", "c"]
    longest = spark.range(1).select(lookup.longest_keywords(F.lit("the cats of insomnia and a hippocampus with dogs and bees")).alias("k")).first().k
    assert longest == ["hippocampus", "insomnia", "bees", "cats"]


def test_reports_list_every_issue(spark):
    cites = spark.createDataFrame([(1, 1, "(Smith, 2020)", "author_year", [], "sleep"), (2, 1, "(Nobody, 1999)", "author_year", [], None)], CITE)
    refs = spark.createDataFrame([ref(doi="10.1/a")], REF)
    issues = process.issues(cites, refs)
    got = {r.doc_id: r.summary.split("\n") for r in process.summaries(process.report(cites, refs, issues), issues).collect()}
    assert got[1][7:9] == ["", "Status: VALID - All citations match references"][-2:] and got[1][4] == "Total in-text citations: 1"
    assert got[2][8] == "Status: ISSUES FOUND - 1 issue(s)" and got[2][11:] == ["MISSING REFERENCE (1):", "-" * 40, "  - In-text citation has no matching reference", "    Citation: (Nobody, 1999)", "    Suggestion: Add a corresponding reference to the bibliography", "", "=" * 50]


def test_library_greedy_titles(spark):
    refs = spark.createDataFrame([ref(n=1), ref(n=2, title="Sleep and memories"), ref(n=3, doi="10.1/x", title="Z")], REF)
    lib = spark.createDataFrame([(1, 1, "SLEEP AND MEMORY", None), (1, 2, "sleep and memory", None), (1, 3, None, "https://doi.org/10.1/X")], "doc_id long, item int, title string, doi string")
    both, imports, left = library.compare(lib, refs)
    assert sorted((r.item, r.ref_ord, r.how) for r in both.collect()) == [(1, 1, "title"), (2, 2, "title"), (3, 3, "doi")] and imports.count() == left.count() == 0


def test_small_functions(spark):
    one = spark.range(1)
    row = one.select(tx.title_case(F.lit("o'connor-smith 3rd")).alias("t"), tx.sentence_case(F.lit("DNA of iPS and RNA Cells")).alias("s"), tx.shorten(F.lit("abcdef"), 5).alias("c"), tx.duration_text(F.lit(61)).alias("d"), tx.escape_latex(F.lit("a&b_c")).alias("l"),
                     names.last_name(F.lit("Van der Berg JA")).alias("n"), names.suggested_last_name(F.lit("Fernandez–Mendoza J")).alias("m"), similarity.word_jaccard(F.lit("a b"), F.lit("b c")).alias("j"), tx.date_text(F.array(F.lit(2020), F.lit(3))).alias("y")).first()
    assert tuple(row) == ("O'Connor-Smith 3Rd", "Dna of iPS and RNA Cells".replace("iPS", "ips"), "ab...", "~1-2 minutes", "a\\&b\\_c", "Van der Berg", "fernandez-mendoza", pytest.approx(1 / 3), "2020-03")


@pytest.mark.parametrize("a,b,common", [("kitten", "sitting", 4), ("", "x", 0), ("abc", "abc", 3), ("axbxc", "abc", 3), ("é😀z", "😀z", 2)])
def test_lcs(a, b, common):
    assert similarity.lcs(a, b) == common


def test_streamed_documents(spark, tmp_path):
    from bibliospark.streaming import ingest

    spark.createDataFrame([(1, "As (Smith, 2020) said")], "doc_id long, body string").write.parquet(str(tmp_path / "in"))
    ingest.detected(ingest.documents(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert [r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["(Smith, 2020)"]


def test_unknown_library_kind(spark):
    with pytest.raises(ValueError):
        formats.read_library(spark, "x", "unknown")


def test_works_has_every_part_once(spark, tmp_path):
    from bibliospark.plans import corpus

    spark.range(0, 2501).selectExpr("id AS p_partkey", "'part ' || id AS p_name", "'TYPE' AS p_type", "1 AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(0, 2501).selectExpr("id AS l_orderkey", "id AS l_partkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    w = corpus.works(spark, str(tmp_path)).collect()
    assert len(w) == len({r.doi for r in w}) == 2501


def test_web_suggestions_find_every_contained_name(spark):
    import re

    from bibliospark.operators import works as lookup

    families, cited = ["van Gogh", "Lindqvist", "Li", "Smith", "Smithson", "Ito", None], ["Gogh", "Li", "Smith", "Smithson", "Vito", "Lindqvist"]
    w = spark.createDataFrame([(f"10.1/{i}{y}", "A title", [("A.", f)], y) for i, f in enumerate(families) for y in (2018, 2020, 2024, None)], "doi string, title string, authors array<struct<given string, family string>>, year int")
    missing = spark.createDataFrame([(1, i, f"({c}, 2020)", "a context") for i, c in enumerate(cited)], "doc_id long, cit_ord int, text string, context string")
    got = {r.cit_ord: set(re.findall(r"10\.1/\w+", r.found)) for r in lookup.web_suggestions(missing, w, most=99).collect()}
    agree = lambda c, f: f is not None and (c.lower() in f.lower() or f.lower() in c.lower())
    assert got == {i: {f"10.1/{k}{y}" for k, f in enumerate(families) if agree(c, f) for y in (2020, None)} for i, c in enumerate(cited)}  # years are one apart at most
