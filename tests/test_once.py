"""Costly expressions stand once in the optimized plans: neither a condition nor a generator computes them again."""

from bibliospark.functions import text as tx
from bibliospark.operators import match, render
from bibliospark.plans import corpus
from bibliospark.sources import formats


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_keywords_are_found_once_a_citation_and_once_a_reference(spark):
    missing = spark.createDataFrame([(1, 1, "(Smyth, 2001)", "sleep and memory in mice")], "doc_id long, cit_ord int, text string, context string")
    rows = [(1, 1, "Smith, A. 2001", "Memory in mice", 2001, ["Smith, A."]), (1, 2, "Doe, J.", "", 1990, ["Doe, J."]), (2, 1, "Smyth, B.", "Sleep", 2001, ["Smyth, B."])]
    refs = spark.createDataFrame(rows, "doc_id long, ref_ord int, raw_text string, title string, year int, authors array<string>")
    found = match.scored(missing, refs)
    assert plan(found).count("regexp_extract_all") == 2
    assert [(r.doc_id, r.ref_ord, r.score) for r in found.collect()] == [(1, 1, 0.966667)]


def test_ris_lines_are_read_once(spark):
    files = spark.createDataFrame([(1, "TY  - JOUR\nAU  - A, B.\nAU  - C, D.\nTI  - old \nTI  -  New one\nSP  - 3\nEP  - 9\nPY  - 2001\nER  - \n")], "lib_id long, content string")
    found = formats.ris(files)
    assert plan(found).count("split(record") == 1 and plan(found).count("(?m)^(?=") == 1
    row = found.first()
    assert (row.item, row.authors, row.title, row.year, row.pages, row.doi) == (1, ["A, B.", "C, D."], "New one", 2001, "3-9", None)


def test_signs_of_the_year_are_looked_for_once(spark):
    examples = spark.createDataFrame([("x", 1, "Smith, J. (2001). Title. Journal.")], "style string, example_ord int, example string")
    sign = r"\)\.\s*[0-9]{4}\."
    found = render.learned(examples)
    assert plan(found).count(sign) == 1
    assert {r.feature: r.value for r in found.collect()} == {"author": "{last}, {first_init}.", "year": "({year})", "year_place": "after_authors"}


def test_a_rendered_text_is_made_once(spark):
    refs = spark.createDataFrame([(1, 1, ["Smith, Jane"], 2001, "On sleep?", "Sleep \t\n Med", "3", None, None, None)], "doc_id long, ref_ord int, authors array<string>, year int, title string, journal string, volume string, issue string, pages string, doi string")
    found = render.rendered(refs, render.style("apa"))
    assert plan(found).count(r"\.\.+") == 1
    assert found.first().formatted == "Smith, J. (2001). On sleep? Sleep Med. 3."


def test_white_space_is_stripped_without_regular_expressions(spark):
    df = spark.createDataFrame([(" \t\x0b\f\r\n a  b \n",), ("\n ",), (None,)], "c string")
    stripped = df.select(tx.strip(df.c).alias("c"))
    assert "regexp" not in plan(stripped) and [r.c for r in stripped.collect()] == ["a  b", "", None]


def test_words_of_the_corpus_are_picked_from_arrays():
    assert corpus._listed("x" + corpus._pick("A|B-c", "k * 7")) == "xelement_at(array('A', 'B-c'), CAST(1 + (k * 7) % 2 AS INT))"
