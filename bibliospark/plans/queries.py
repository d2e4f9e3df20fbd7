"""Registered queries of the citation operators over the derived corpus, with their DuckDB counterparts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import journals, names, similarity, text as tx
from ..operators import duplicates, extract, library, match, parse, quality, render, works as lookup
from ..sources import formats
from ..tables import by_document, shared_folder
from . import corpus, process
from .corpus import oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, plain: bool = False):
    """Registers a query under its function's name; sql stands on refs and cites unless plain."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql if plain else oracle(sql)
        return f

    return add


_L = lambda c: F.col(c).cast("long").alias(c)
_CITE_NAMES = """
, cut AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[()]', '', 'g'), ',?\\s*[0-9]{4}[a-z]?', '', 'g'), '\\s+et\\s+al\\.?', '', 'g'), '^\\s+|\\s+$', '', 'g') AS who FROM cites),
named AS (SELECT *, list_transform(string_split(replace(lower(who), ' & ', ' and '), ' and '), lambda x: trim(x)) AS ca, TRY_CAST(regexp_extract(text, '((?:19|20)[0-9]{2})', 1) AS INT) AS cy FROM cut),
people AS (SELECT *, CASE WHEN authors = '' THEN [] ELSE list_transform(string_split(authors, '|'), lambda a: lower(split_part(a, ',', 1))) END AS ra FROM refs),
numeric_ids AS (SELECT doc_id, text, unnest(CASE WHEN text = '[1-3]' THEN ['1', '2', '3'] WHEN text = '[1, 3]' THEN ['1', '3'] ELSE [regexp_extract(text, '[0-9]+')] END) AS ref_id FROM (SELECT DISTINCT doc_id, text FROM cites WHERE citation_type = 'numeric')),
pairs AS (SELECT DISTINCT c.doc_id, c.text, r.ref_ord, r.ref_id, c.ca, r.ra, c.cy, r.year AS ry FROM named c JOIN people r ON c.doc_id = r.doc_id WHERE c.citation_type <> 'numeric' AND len(r.ra) > 0 AND (r.year IS NULL OR abs(c.cy - r.year) <= 1)),
agreed AS (SELECT *, CASE WHEN ca[1] = ra[1] THEN 'exact' WHEN contains(ra[1], ca[1]) OR contains(ca[1], ra[1]) THEN CASE WHEN abs(length(ca[1]) - length(ra[1])) <= 2 THEN 'fuzzy' ELSE 'exact' END
    WHEN levenshtein(ca[1], ra[1]) <= CASE WHEN length(ca[1]) <= 6 THEN 1 ELSE 2 END THEN 'fuzzy' ELSE 'none' END AS f,
  CASE WHEN NOT (len(ca) = 2 AND len(ra) >= 2) THEN 'exact' WHEN ca[2] = ra[2] THEN 'exact' WHEN contains(ra[2], ca[2]) OR contains(ca[2], ra[2]) THEN CASE WHEN abs(length(ca[2]) - length(ra[2])) <= 2 THEN 'fuzzy' ELSE 'exact' END
    WHEN levenshtein(ca[2], ra[2]) <= CASE WHEN length(ca[2]) <= 6 THEN 1 ELSE 2 END THEN 'fuzzy' ELSE 'none' END AS s FROM pairs),
matches AS (SELECT doc_id, text, ref_ord, ref_id, f = 'fuzzy' OR s = 'fuzzy' AS author_is_fuzzy, coalesce(abs(cy - ry) > 0, false) AS year_is_fuzzy, CASE WHEN f <> 'fuzzy' AND s = 'fuzzy' THEN ca[2] ELSE ca[1] END AS citation_author, CASE WHEN f <> 'fuzzy' AND s = 'fuzzy' THEN ra[2] ELSE ra[1] END AS ref_author, cy, ry
    FROM agreed WHERE f <> 'none' AND s <> 'none'
  UNION ALL SELECT n.doc_id, n.text, r.ref_ord, r.ref_id, false, false, NULL, NULL, NULL, NULL FROM numeric_ids n JOIN refs r ON n.doc_id = r.doc_id AND n.ref_id = r.ref_id)"""


def _match(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c, r = corpus.cites(spark, sf_dir), corpus.refs(spark, sf_dir)
    return c, r, match.matches(c, r)


def _by_document(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return corpus.cites(spark, sf_dir, by_document=True), corpus.refs(spark, sf_dir, by_document=True)


@query("""
, placed AS (SELECT *, sum(length(sentence) + 1) OVER (PARTITION BY doc_id ORDER BY cit_ord) - length(sentence) - 1 AS before FROM cites)
SELECT doc_id, cit_ord, text, CAST(before + strpos(sentence, text) - 1 AS BIGINT) AS start_pos, CAST(before + strpos(sentence, text) - 1 + length(text) AS BIGINT) AS end_pos, citation_type FROM placed""")
def citations_detected(spark, sf_dir):
    return extract.detect(corpus.bodies(spark, sf_dir)).select("doc_id", "cit_ord", "text", _L("start_pos"), _L("end_pos"), "citation_type")


@query("""
SELECT doc_id, CASE WHEN count(CASE WHEN citation_type = 'numeric' THEN 1 END) > 0 THEN 'numeric' ELSE 'author_year' END AS detected_type, count(CASE WHEN citation_type = 'numeric' THEN 1 END) AS n_numeric, count(CASE WHEN citation_type = 'author_year' THEN 1 END) AS n_author_year, count(CASE WHEN citation_type = 'author_inline' THEN 1 END) AS n_narrative FROM cites GROUP BY doc_id""")
def citation_type_by_doc(spark, sf_dir):
    return extract.kinds(corpus.bodies(spark, sf_dir)).select("doc_id", "detected_type", *map(_L, ("n_numeric", "n_author_year", "n_narrative")))


@query()
def context_window(spark, sf_dir):
    return extract.detect(corpus.bodies(spark, sf_dir)).select("doc_id", "cit_ord", "context")


ORACLES["context_window"] = oracle("""
, bodies AS (SELECT doc_id, string_agg(sentence, ' ' ORDER BY cit_ord) AS body FROM cites GROUP BY doc_id),
placed AS (SELECT *, CAST(sum(length(sentence) + 1) OVER (PARTITION BY doc_id ORDER BY cit_ord) - length(sentence) - 1 + strpos(sentence, text) - 1 AS INT) AS s FROM cites),
wide AS (SELECT p.*, b.body, greatest(0, s - 150) AS a, least(length(body), s + length(text) + 150) AS z FROM placed p JOIN bodies b USING (doc_id)),
edged AS (SELECT *, CASE WHEN a > 0 THEN a + 1 - length(regexp_extract(substr(body, 1, a + 1), '[^ ]*$')) ELSE 0 END AS b0, z + length(regexp_extract(substr(body, z + 1), '^[^ ]*')) AS z1 FROM wide)
SELECT doc_id, cit_ord, trim(substr(body, b0 + 1, z1 - b0)) AS context FROM edged""")


@query("""
SELECT doc_id, cit_ord, CASE WHEN text = '[1-3]' THEN '1|2|3' WHEN text = '[1, 3]' THEN '1|3' ELSE regexp_extract(text, '[0-9]+') END AS ids FROM cites WHERE citation_type = 'numeric'""")
def numeric_refs_expanded(spark, sf_dir):
    return corpus.cites(spark, sf_dir).where("citation_type = 'numeric'").select("doc_id", "cit_ord", F.array_join("reference_ids", "|").alias("ids"))


@query("""
SELECT doc_id, ref_ord, CASE style WHEN 0 THEN 'apa' WHEN 1 THEN 'harvard' ELSE 'vancouver' END AS rule, y AS year,
  CASE style WHEN 0 THEN last1 || ', ' || first1 WHEN 1 THEN last1 || ', ' || first1 || '.|' || last2 || ', ' || first2 WHEN 2 THEN last1 || ' ' || first1 || '|' || last2 || ' ' || first2 ELSE last1 || ' ' || first1 END AS authors,
  full_title || CASE WHEN style = 0 THEN '' ELSE '.' END AS title, CASE WHEN style > 0 THEN full_journal END AS journal, CASE WHEN style > 0 THEN volume END AS volume, CASE WHEN style > 0 THEN full_issue END AS issue, CASE WHEN style > 0 THEN full_pages END AS pages,
  CASE WHEN style = 0 THEN doi END AS doi FROM refs""")
def refs_parsed(spark, sf_dir):
    p = parse.parse(corpus.entries(spark, sf_dir))
    return p.select("doc_id", "ref_ord", "rule", "year", F.array_join("authors", "|").alias("authors"), "title", "journal", "volume", "issue", "pages", "doi")


@query("SELECT doc_id, ref_ord, CASE WHEN style = 3 THEN CAST(ref_ord AS VARCHAR) ELSE lower(last1) || '_' || y END AS ref_id FROM refs")
def ref_ids(spark, sf_dir):
    return parse.parse(corpus.entries(spark, sf_dir)).select("doc_id", "ref_ord", "ref_id")


@query(_CITE_NAMES + "\nSELECT doc_id, text, ref_ord, ref_id, CASE WHEN author_is_fuzzy OR year_is_fuzzy THEN 'fuzzy' ELSE 'exact' END AS match_type, author_is_fuzzy, year_is_fuzzy, citation_author, ref_author FROM matches")
def matches_all(spark, sf_dir):
    return _match(spark, sf_dir)[2].select("doc_id", "text", "ref_ord", "ref_id", "match_type", "author_is_fuzzy", "year_is_fuzzy", "citation_author", "ref_author")


@query(_CITE_NAMES + "\nSELECT doc_id, min(cit_ord) AS cit_ord, text FROM cites c WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.doc_id = c.doc_id AND m.text = c.text) GROUP BY doc_id, text")
def citations_unmatched(spark, sf_dir):
    c, _, m = _match(spark, sf_dir)
    return match.unmatched(c, m).select("doc_id", "cit_ord", "text")


@query(_CITE_NAMES + "\nSELECT doc_id, ref_ord, ref_id FROM refs r WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.doc_id = r.doc_id AND m.ref_id = r.ref_id)")
def references_uncited(spark, sf_dir):
    _, r, m = _match(spark, sf_dir)
    return match.uncited(r, m).select("doc_id", "ref_ord", "ref_id")


_COUNTS = _CITE_NAMES + """
, hits AS (SELECT DISTINCT doc_id, text FROM matches),
per AS (SELECT c.doc_id, count(*) AS n_citations, count(h.text) AS n_matched, count(*) - count(h.text) AS n_unmatched FROM cites c LEFT JOIN hits h ON c.doc_id = h.doc_id AND c.text = h.text GROUP BY c.doc_id),
totals AS (SELECT coalesce(p.doc_id, r.doc_id) AS doc_id, coalesce(n_citations, 0) AS n_citations, coalesce(n_references, 0) AS n_references, coalesce(n_matched, 0) AS n_matched, coalesce(n_unmatched, 0) AS n_unmatched FROM per p FULL JOIN (SELECT doc_id, count(*) AS n_references FROM refs GROUP BY doc_id) r ON p.doc_id = r.doc_id)"""


@query(_COUNTS + """
SELECT *, n_unmatched * 8 AS seconds, CASE WHEN n_unmatched * 8 < 60 THEN '~' || (n_unmatched * 8) || ' seconds' ELSE '~' || (n_unmatched * 8 // 60) || '-' || (n_unmatched * 8 // 60 + 1) || ' minutes' END AS estimate, n_unmatched > 0 AS needs_search FROM totals""")
def quick_check(spark, sf_dir):
    return process.quick_check(corpus.cites(spark, sf_dir), corpus.refs(spark, sf_dir))


_TITLED = "list_reduce(list_transform(regexp_extract_all({0}, '[a-z]+|[^a-z]+'), lambda p: upper(substr(p, 1, 1)) || substr(p, 2)), lambda a, b: a || b)"


@query(_CITE_NAMES + f"""
SELECT doc_id, text, ref_ord, 'Citation uses ''' || {_TITLED.format('citation_author')} || ''' but reference has ''' || {_TITLED.format('ref_author')} || '''. Verify correct spelling.' AS suggestion FROM matches WHERE author_is_fuzzy""")
def spelling_issues(spark, sf_dir):
    return match.spelling_issues(_match(spark, sf_dir)[2])


@query(_CITE_NAMES + "\nSELECT doc_id, text, ref_ord, 'Citation says ' || cy || ' but reference has ' || ry || '. Verify correct year.' AS suggestion FROM matches WHERE year_is_fuzzy AND NOT author_is_fuzzy")
def year_issues(spark, sf_dir):
    return match.year_issues(_match(spark, sf_dir)[2])


@query()
def suggestions_top1(spark, sf_dir):
    c, r, m = _match(spark, sf_dir)
    return match.suggestions(match.unmatched(c, m), r)


@query()
def typo_suggestions(spark, sf_dir):
    c, r, m = _match(spark, sf_dir)
    return match.typo_suggestions(match.uncited(r, m), match.unmatched(c, m))


_ords = lambda df: df.select("doc_id", F.array_join(F.transform("ords", lambda x: x.cast("string")), "|").alias("ords"))
_EXACT = ", exact AS (SELECT doc_id, lower(trim(raw_text)) AS key, list(ref_ord ORDER BY ref_ord) AS ords FROM refs GROUP BY ALL HAVING count(*) > 1)"
_DOI = _EXACT + """, dois AS (SELECT doc_id, lower(trim(doi)) AS key, list(ref_ord ORDER BY ref_ord) AS ords FROM refs WHERE doi <> '' GROUP BY ALL HAVING count(*) > 1),
by_doi AS (SELECT * FROM dois d WHERE NOT EXISTS (SELECT 1 FROM exact e WHERE e.doc_id = d.doc_id AND list_contains(e.ords, d.ords[1]) AND list_contains(e.ords, d.ords[2])))"""


@query(_EXACT + " SELECT doc_id, array_to_string(ords, '|') AS ords FROM exact")
def dup_exact(spark, sf_dir):
    return _ords(duplicates.exact(corpus.refs(spark, sf_dir)))


@query(_DOI + " SELECT doc_id, array_to_string(ords, '|') AS ords FROM by_doi")
def dup_doi(spark, sf_dir):
    return _ords(duplicates.by_doi(corpus.refs(spark, sf_dir)))


@query()
def dup_title(spark, sf_dir):
    return duplicates.by_title(corpus.refs(spark, sf_dir)).select("doc_id", "a", "b", "ratio")


@query()
def dup_author_year(spark, sf_dir):
    return duplicates.by_authors(corpus.refs(spark, sf_dir))


@query("""
, keys AS (SELECT doc_id, ref_ord, concat_ws('|', CASE WHEN authors <> '' THEN substr(lower(last1), 1, 10) END, CAST(year AS VARCHAR), CASE WHEN title <> '' THEN array_to_string(string_split(lower(title), ' ')[1:3], '_') END) AS key FROM refs)
SELECT doc_id, string_agg(ref_ord, '|' ORDER BY ref_ord) AS ords FROM keys GROUP BY doc_id, key HAVING count(*) > 1""")
def dup_legacy(spark, sf_dir):
    return _ords(duplicates.by_key(corpus.refs(spark, sf_dir)))


@query()
def dup_differences(spark, sf_dir):
    r = by_document(corpus.refs(spark, sf_dir, by_document=True), "refs")
    d = duplicates.differences(r, duplicates.groups(r))
    return d.select("doc_id", "match_type", F.array_join(F.transform("ords", lambda x: x.cast("string")), "|").alias("ords"), F.round("confidence", 6).alias("confidence"), "differences", F.array_join("ids", "|").alias("ids"))


@query(_DOI + """
, members AS (SELECT d.doc_id, array_to_string(d.ords, '|') AS ords, r.* EXCLUDE (doc_id) FROM by_doi d JOIN refs r ON r.doc_id = d.doc_id AND list_contains(d.ords, r.ref_ord)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, ords ORDER BY (coalesce(doi, '') <> '')::INT DESC, (authors <> '')::INT + (year IS NOT NULL)::INT + (title IS NOT NULL)::INT + (journal IS NOT NULL)::INT + (volume IS NOT NULL)::INT + (pages IS NOT NULL)::INT DESC, ref_ord) AS n FROM members)
SELECT doc_id, ords, first(ref_ord ORDER BY n) AS ref_ord, first(title ORDER BY n) AS title, CAST(first(year ORDER BY n) AS VARCHAR) AS year, first(authors ORDER BY n) AS authors, first(journal ORDER BY n) FILTER (journal IS NOT NULL) AS journal, first(volume ORDER BY n) FILTER (volume IS NOT NULL) AS volume,
  first(issue ORDER BY n) FILTER (issue IS NOT NULL) AS issue, first(pages ORDER BY n) FILTER (pages IS NOT NULL) AS pages, first(doi ORDER BY n) FILTER (doi IS NOT NULL) AS doi FROM ranked GROUP BY doc_id, ords""")
def dup_merged(spark, sf_dir):
    r = corpus.refs(spark, sf_dir)
    g = duplicates.by_doi(r).select("doc_id", F.lit("doi_match").alias("match_type"), "ords")
    m = duplicates.merged(r, g).withColumn("ords", F.array_join(F.transform("ords", lambda x: x.cast("string")), "|"))
    return m.select("doc_id", "ords", "ref_ord", "title", F.col("year").cast("string").alias("year"), "authors", "journal", "volume", "issue", "pages", "doi")


_SCORE = "round((authors <> '')::INT * 0.25 + (year IS NOT NULL)::INT * 0.2 + (title IS NOT NULL)::INT * 0.25 + (journal IS NOT NULL)::INT * 0.15 + (doi IS NOT NULL OR pages IS NOT NULL)::INT * 0.15, 6)::DOUBLE"


@query(f"SELECT doc_id, ref_ord, {_SCORE} AS score FROM refs")
def completeness_scores(spark, sf_dir):
    return quality.scores(corpus.refs(spark, sf_dir)).select("doc_id", "ref_ord", "score")


@query(f"""
, s AS (SELECT *, {_SCORE} AS score FROM refs)
SELECT doc_id, count(*) AS total, count(CASE WHEN score < 1 THEN 1 END) AS incomplete, avg(score) AS average_score, count(CASE WHEN score < 1 AND authors = '' THEN 1 END) AS missing_authors, count(CASE WHEN score < 1 AND year IS NULL THEN 1 END) AS missing_year, count(CASE WHEN score < 1 AND title IS NULL THEN 1 END) AS missing_title,
  count(CASE WHEN score < 1 AND journal IS NULL THEN 1 END) AS missing_journal, count(CASE WHEN score < 1 AND doi IS NULL AND pages IS NULL THEN 1 END) AS missing_identifier FROM s GROUP BY doc_id""".replace("avg(score)", "floor(sum(CAST(round(score * 100) AS INT)) / count(*) + 0.5) / 100"))
def completeness_report(spark, sf_dir):
    return quality.report(corpus.refs(spark, sf_dir))


@query("""
, m AS (SELECT *, concat_ws(', ', CASE WHEN authors = '' THEN 'authors' END, CASE WHEN year IS NULL THEN 'year' END, CASE WHEN title IS NULL THEN 'title' END, CASE WHEN doi IS NULL AND pages IS NULL THEN 'pages or DOI' END, CASE WHEN journal IS NULL THEN 'journal' END) AS missing FROM refs)
SELECT doc_id, ref_ord, 'Reference missing: ' || missing AS description, CASE WHEN length(raw_text) > 100 THEN substr(raw_text, 1, 97) || '...' ELSE raw_text END AS citation_text, 'Add missing fields: ' || missing AS suggestion,
  CASE WHEN authors = '' OR year IS NULL OR title IS NULL THEN 'warning' ELSE 'info' END AS severity FROM m WHERE missing <> ''""")
def completeness_issues(spark, sf_dir):
    return quality.completeness_issues(corpus.refs(spark, sf_dir))


_CANON = """
, canon(journal, canonical, confidence) AS (VALUES ('Sleep', 'Sleep', 1.0), ('J Neurosci', 'Journal of Neuroscience', 1.0), ('Journal of Neuroscience', 'Journal of Neuroscience', 1.0), ('Brain', 'Brain', 1.0), ('Nature', 'Nature', 1.0), ('Sleep Med', 'Sleep Medicine', 1.0),
  ('Sleep medicine', 'Sleep Medicine', 1.0), ('Unknown Letters', 'Unknown Letters', 0.0), ('Lancet Neurol', 'The Lancet Neurology', 1.0), ('Cerebral Cortexx', 'Cerebral Cortex', round(2.0 * 15 / 31, 6)))"""


@query(_CANON + " SELECT DISTINCT r.journal, c.canonical, CAST(c.confidence AS DOUBLE) AS confidence FROM refs r JOIN canon c ON r.journal = c.journal")
def journal_normalized(spark, sf_dir):
    return quality.normalised(corpus.refs(spark, sf_dir).where(F.col("journal").isNotNull()))


@query(_CANON + """ SELECT r.doc_id, min(c.canonical) AS canonical, array_to_string(list_sort(list(DISTINCT r.journal)), '|') AS names, count(*) AS n_references FROM refs r JOIN canon c ON r.journal = c.journal WHERE c.confidence > 0
GROUP BY r.doc_id, lower(c.canonical) HAVING count(DISTINCT r.journal) > 1""")
def journal_inconsistent(spark, sf_dir):
    return quality.inconsistent(corpus.refs(spark, sf_dir)).drop("ids").withColumn("names", F.array_join("names", "|"))


@query(_CANON + " SELECT r.doc_id, r.ref_ord, r.journal, c.canonical FROM refs r JOIN canon c ON r.journal = c.journal WHERE c.confidence > 0 AND lower(c.canonical) <> lower(r.journal)")
def journal_changed(spark, sf_dir):
    return quality.changed(corpus.refs(spark, sf_dir)).drop("confidence")


@query()
def known_journals(spark, sf_dir):
    return journals.dictionary(spark).select("canonical").distinct().orderBy("canonical")


@query("""
, both AS (SELECT doc_id, cit_ord, text, CASE WHEN k % 6 = 0 THEN 'numeric' ELSE 'author_year' END AS family FROM cites),
counts AS (SELECT doc_id, family, count(*) AS n, min(cit_ord) AS f FROM both GROUP BY ALL),
best AS (SELECT doc_id, arg_max(family, (n, -f)) AS dominant FROM counts GROUP BY doc_id HAVING count(*) > 1),
texts AS (SELECT b.doc_id, b.family, b.text, min(b.cit_ord) AS cit_ord, any_value(dominant) AS dominant FROM both b JOIN best USING (doc_id) WHERE b.family <> dominant GROUP BY ALL)
SELECT doc_id, cit_ord, text, family, dominant FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, family ORDER BY cit_ord) AS n FROM texts) WHERE n <= 3""".replace("both", "kinds").replace("dominant GROUP BY ALL", "dominant GROUP BY b.doc_id, b.family, b.text"))
def format_family(spark, sf_dir):
    c = corpus.sentences(spark, sf_dir)
    return extract.format_issues(c.withColumn("citation_type", F.when(F.col("k") % 6 == 0, "numeric").otherwise("author_year")))


@query("SELECT doc_id, cit_ord, text, replace(text, ' and ', ' & ') AS suggestion FROM cites WHERE citation_type = 'author_year' AND text LIKE '(% and %'")
def ampersand_issues(spark, sf_dir):
    return extract.ampersand_issues(corpus.cites(spark, sf_dir))


_INIT = "regexp_replace(a, ',\\s*(.).*$', ', \\1.')"
_STYLES = {
    "apa": ("list_transform(ra, lambda a: a)", ", & ", "'(' || year || ')'", False, "volume || CASE WHEN issue IS NULL THEN '' ELSE '(' || issue || ')' END", "pages", "'https://doi.org/' || doi"),
    "mla": ("list_transform(ra, lambda a: a)", ", and ", "CAST(year AS VARCHAR)", True, "'vol. ' || volume || CASE WHEN issue IS NULL THEN '' ELSE ', no. ' || issue END", "'pp. ' || pages", "'doi:' || doi"),
    "chicago": ("list_transform(ra, lambda a: a)", ", and ", "CAST(year AS VARCHAR)", True, "volume || CASE WHEN issue IS NULL THEN '' ELSE ', no. ' || issue END", "pages", "'https://doi.org/' || doi"),
    "ieee": ("list_transform(ra, lambda a: split_part(a, ', ', 2) || '. ' || split_part(a, ', ', 1))", ", and ", "CAST(year AS VARCHAR)", True, "'vol. ' || volume || CASE WHEN issue IS NULL THEN '' ELSE ', no. ' || issue END", "'pp. ' || pages", "'doi: ' || doi"),
    "vancouver": ("list_transform(ra, lambda a: replace(a, ', ', ' '))", ", ", "CAST(year AS VARCHAR)", False, "", "", "'https://doi.org/' || doi"),
}


def _style_sql(name: str) -> str:
    who, sep, year, quotes, volume, pages, doi = _STYLES[name]
    big = "list_reduce(list_transform(regexp_extract_all(title, '[A-Za-z]+|[^A-Za-z]+'), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), lambda x, y: x || y)"
    title = big if name in ("mla", "chicago") else "title"
    title = f"'\"' || {title} || '\"'" if quotes else title
    middle = f"journal, {volume}, {pages}"
    if name == "vancouver":
        tail = "';' || volume || CASE WHEN issue IS NULL THEN '' ELSE '(' || issue || ')' END || CASE WHEN pages IS NULL THEN '' ELSE ':' || pages END"
        middle = f"CASE WHEN journal IS NOT NULL THEN journal || CASE WHEN year IS NULL THEN '' ELSE ' ' || year END || {tail} END, CASE WHEN journal IS NULL THEN CAST(year AS VARCHAR) END, CASE WHEN journal IS NULL THEN volume || CASE WHEN issue IS NULL THEN '' ELSE '(' || issue || ')' END END, CASE WHEN journal IS NULL THEN pages END"
    early = year if name != "vancouver" else "NULL"
    return oracle(f"""
, p AS (SELECT *, CASE WHEN authors = '' THEN [] ELSE string_split(authors, '|') END AS ra FROM refs), w AS (SELECT *, {who} AS who FROM p),
j AS (SELECT doc_id, ref_ord, concat_ws('. ', CASE WHEN len(who) > 0 THEN array_to_string(who, '{sep}') END, {early}, {title}, {middle}, {doi}) AS t FROM w)
SELECT doc_id, ref_ord, regexp_replace(t, '\\.\\.+', '.', 'g') || CASE WHEN t LIKE '%.' THEN '' ELSE '.' END AS formatted FROM j""")


def _styled(name: str):
    return lambda spark, sf_dir: render.rendered(corpus.refs(spark, sf_dir), render.style(name))


for _name in _STYLES:
    QUERIES[f"style_{_name}"], ORACLES[f"style_{_name}"] = _styled(_name), _style_sql(_name)


@query()
def styles(spark, sf_dir):
    return render.styles(spark)


@query(" UNION ALL ".join(f"SELECT * FROM ({_style_sql(name)}) WHERE doc_id % 6 IN ({rests})" for name, rests in (("apa", "0, 5"), ("mla", "1"), ("chicago", "2"), ("vancouver", "3"), ("ieee", "4"))), plain=True)
def style_by_doc(spark, sf_dir):
    """Each document in a style of its own; harvard has no pattern."""
    refs = corpus.refs(spark, sf_dir)
    name = F.get(F.array(*map(F.lit, ("apa", "mla", "chicago", "vancouver", "ieee", "harvard"))), (F.col("doc_id") % 6).cast("int"))
    return render.rendered_each(refs, refs.select("doc_id", name.alias("style")), render.styles(spark))


# What the forms of entries show: names with a hyphen nothing, form 0 a year in parentheses, form 2 all in one group.
_SHOWN = """
, shown AS (SELECT {group} AS g, {ord} AS ord, style AS form, last1 LIKE '%-%' AS hyphen FROM refs),
signs AS (SELECT g, ord, unnest(['author', 'year', 'year_place', 'grouped']) AS feature, unnest([CASE WHEN hyphen OR form = 3 THEN NULL WHEN form = 2 THEN '{{last}} {{first_init}}' ELSE '{{last}}, {{first_init}}.' END,
  CASE WHEN form = 0 THEN '({{year}})' ELSE '{{year}}' END, CASE WHEN form < 2 THEN 'after_authors' ELSE 'after_journal' END, CASE WHEN form = 2 THEN 'yes' END]) AS value FROM shown),
counted AS (SELECT g, feature, value, count(*) AS n, min(ord) AS seen FROM signs WHERE value IS NOT NULL GROUP BY ALL),
best AS (SELECT g, feature, value FROM counted QUALIFY row_number() OVER (PARTITION BY g, feature ORDER BY n DESC, seen) = 1)"""


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = corpus.entries(spark, sf_dir)
    return r.select(F.col("doc_id").cast("string").alias("style"), (F.col("doc_id") * 100 + F.col("ref_ord")).alias("example_ord"), F.col("raw_text").alias("example"))


@query(_SHOWN.format(group="0", ord="doc_id * 100 + ref_ord") + " SELECT feature, value FROM best")
def learned_style(spark, sf_dir):
    return render.learned(_examples(spark, sf_dir))


@query(_SHOWN.format(group="CAST(doc_id AS VARCHAR)", ord="ref_ord") + """
SELECT g AS style, coalesce(max(value) FILTER (feature = 'author'), '{last}, {first_init}.') AS author, ', & ' AS last_sep, max(value) FILTER (feature = 'year_place') AS year_place, max(value) FILTER (feature = 'year') AS year,
  'sentence' AS title, false AS quotes, coalesce(max(value) FILTER (feature = 'grouped') = 'yes', false) AS grouped, '{volume}({issue})' AS volume, '{pages}' AS pages, 'https://doi.org/{doi}' AS doi FROM best GROUP BY g""")
def learned_by_doc(spark, sf_dir):
    """The style of each document's own entries."""
    return render.learned_styles(_examples(spark, sf_dir))


_BIB_KEYS = ", b AS (SELECT *, CASE WHEN authors = '' THEN '' ELSE lower(regexp_replace(last1, '[^a-zA-Z]', '', 'g')) END || coalesce(CAST(year AS VARCHAR), '') AS base FROM refs), kd AS (SELECT *, base || CASE WHEN n > 1 THEN chr(CAST(95 + n AS INT)) ELSE '' END AS key FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY ref_ord) AS n FROM b))"


@query(_BIB_KEYS + """
SELECT doc_id, ref_ord, key, concat_ws(chr(10), '@article{' || key || ',', CASE WHEN authors <> '' THEN '  author = {' || replace(authors, '|', ' and ') || '},' END, '  title = {{' || title || '}},', '  year = {' || year || '},', '  journal = {' || journal || '},', '  volume = {' || volume || '},',
  '  number = {' || issue || '},', '  pages = {' || replace(pages, '-', '--') || '},', '  doi = {' || doi || '},', '}') AS entry,
  concat_ws('; ', CASE WHEN authors = '' THEN key || ': missing authors' END, CASE WHEN title IS NULL THEN key || ': missing title' END, CASE WHEN year IS NULL THEN key || ': missing year' END) AS warnings FROM kd""")
def bibtex_entries(spark, sf_dir):
    return formats.bibtex_entries(corpus.refs(spark, sf_dir))


@query("""
SELECT doc_id, ref_ord, concat_ws(chr(10), 'TY  - JOUR', CASE WHEN authors <> '' THEN 'AU  - ' || replace(authors, '|', chr(10) || 'AU  - ') END, 'TI  - ' || title, 'PY  - ' || year, 'JO  - ' || journal, 'VL  - ' || volume, 'IS  - ' || issue, 'SP  - ' || split_part(pages, '-', 1), 'EP  - ' || split_part(pages, '-', 2), 'DO  - ' || doi, 'UR  - https://doi.org/' || doi, 'ER  - ', '') AS entry FROM refs""")
def ris_entries(spark, sf_dir):
    return formats.ris_entries(corpus.refs(spark, sf_dir)).drop("warnings")


_ROWS = "SELECT doc_id AS lib_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ref_ord) AS INT) AS item, authors, {title} AS title, CAST(year AS VARCHAR) AS year, journal, volume, issue, pages, doi FROM refs"
_flat = lambda df: df.select("lib_id", "item", F.array_join("authors", "|").alias("authors"), "title", F.col("year").cast("string").alias("year"), "journal", "volume", "issue", "pages", "doi")


@query(_ROWS.format(title="coalesce(title, '')"))
def bibtex_rows(spark, sf_dir):
    files = formats.exported(formats.bibtex_entries(corpus.refs(spark, sf_dir))).select(F.col("doc_id").alias("lib_id"), "content")
    return _flat(formats.bibtex(files))


@query(_ROWS.format(title="title"))
def ris_rows(spark, sf_dir):
    files = formats.exported(formats.ris_entries(corpus.refs(spark, sf_dir))).select(F.col("doc_id").alias("lib_id"), "content")
    return _flat(formats.ris(files))


@query(_ROWS.format(title="title"))
def zotero_rows(spark, sf_dir):
    return _flat(formats.zotero(_zotero_files(corpus.refs(spark, sf_dir))))


def _zotero_files(refs: DataFrame) -> DataFrame:
    person = lambda a: F.struct(F.lit("author").alias("creatorType"), F.split(a, ", ")[0].alias("lastName"), F.split(a, ", ")[1].alias("firstName"))
    item = F.struct(F.col("ref_id").alias("key"), "title", F.transform("authors", person).alias("creators"), F.col("year").cast("string").alias("date"), F.col("journal").alias("publicationTitle"), "volume", "issue", "pages", F.when(F.col("ref_ord") % 2 == 0, F.col("doi")).alias("DOI"), F.when(F.col("ref_ord") % 2 == 1, F.concat(F.lit("note\nDOI: "), "doi")).alias("extra"))
    boxed = refs.groupBy(F.col("doc_id").alias("lib_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ref_ord", item.alias("i")))), lambda s: s["i"]).alias("items"))
    return boxed.select("lib_id", F.to_json("items").alias("content"))


_LIB = ", lib AS (SELECT doc_id, ref_ord AS item, CASE WHEN ref_ord % 3 = 0 THEN NULL ELSE doi END AS doi FROM refs WHERE ref_ord % 4 <> 0), hit AS (SELECT l.doc_id, l.item, min(r.ref_ord) AS ref_ord FROM lib l JOIN refs r ON l.doc_id = r.doc_id AND l.doi = r.doi WHERE l.doi IS NOT NULL GROUP BY ALL)"


def _library(refs: DataFrame) -> DataFrame:
    return refs.where("ref_ord % 4 <> 0").select("doc_id", F.col("ref_ord").alias("item"), F.upper("title").alias("title"), F.when(F.col("ref_ord") % 3 != 0, F.col("doi")).alias("doi"), "ref_id", "authors", "year")


@query(_LIB + " SELECT * FROM hit")
def library_doi_match(spark, sf_dir):
    r = corpus.refs(spark, sf_dir)
    return library.doi_matches(_library(r), r)


@query()
def library_title_match(spark, sf_dir):
    r = corpus.refs(spark, sf_dir)
    return library.title_matches(_library(r), r, library.doi_matches(_library(r), r))


@query()
def library_leftovers(spark, sf_dir):
    r = corpus.refs(spark, sf_dir)
    _, imports, left = library.compare(_library(r), r)
    return library.summary(imports.select("doc_id", F.lit("import").alias("side"), F.col("item").alias("ord"), "ref_id", "authors", "year", "title").unionByName(left.select("doc_id", F.lit("document").alias("side"), F.col("ref_ord").alias("ord"), "ref_id", "authors", "year", "title"))).select("doc_id", "side", "ord", "summary")


#: The works, as of corpus.works, and the best one of each (title, authors, year) that is asked for, every pair scored.
_WORKS = """
, works AS (SELECT DISTINCT k, '10.1000/x' || k AS doi, CASE WHEN k % 41 = 0 AND (k // 41) % 4 = 3 THEN 'RETRACTED: ' ELSE '' END || upper(substr(words, 1, 1)) || substr(words, 2) AS title, last1, first1 || '. ' || last1 AS who, CASE WHEN k % 43 <> 0 THEN y END AS wy FROM (""" + corpus._BASE.format(lineitem="lineitem", part="part") + """) w)"""
_BEST = _WORKS + """
, asked AS (SELECT doc_id, ref_ord, lower(title) AS t, CASE WHEN authors = '' THEN [] ELSE list_transform(string_split(lower(authors), '|'), lambda a: split_part(a, ',', 1)) END AS ra, year AS ry FROM refs WHERE doi IS NULL AND title <> ''),
keys AS (SELECT t, ra, ry, list_distinct(string_split(t, ' ')) AS rw FROM asked GROUP BY ALL),
told AS (SELECT doi, lower(title) AS wt, list_distinct(string_split(lower(title), ' ')) AS ww, [lower(last1)] AS wa, wy FROM works),
parts AS (SELECT t, ra, ry, doi, CASE WHEN t = wt THEN 1.0::DOUBLE ELSE len(list_intersect(rw, ww)) / (len(rw) + len(ww) - len(list_intersect(rw, ww))) END * 0.5::DOUBLE AS pt,
  CASE WHEN len(ra) > 0 THEN len(list_filter(ra, lambda a: list_contains(wa, a))) / greatest(len(ra), len(wa)) * 0.3::DOUBLE END AS pa, CASE WHEN ry - wy = 0 THEN 0.2::DOUBLE WHEN abs(ry - wy) <= 1 THEN 0.1::DOUBLE WHEN ry - wy IS NOT NULL THEN 0::DOUBLE END AS py FROM keys CROSS JOIN told),
scores AS (SELECT t, ra, ry, doi, round((pt + coalesce(pa, 0) + coalesce(py, 0)) / (0.5::DOUBLE + CASE WHEN pa IS NULL THEN 0 ELSE 0.3::DOUBLE END + CASE WHEN py IS NULL THEN 0 ELSE 0.2::DOUBLE END), 6) AS score FROM parts),
top AS (SELECT * FROM scores WHERE score >= 0.5 QUALIFY row_number() OVER (PARTITION BY t, ra, ry ORDER BY score DESC, doi) = 1),
best AS (SELECT a.doc_id, a.ref_ord, p.doi, p.score FROM asked a JOIN top p ON a.t = p.t AND a.ra = p.ra AND a.ry IS NOT DISTINCT FROM p.ry)"""


@query(_BEST + " SELECT doc_id, ref_ord, doi, score FROM best")
def doi_best_match(spark, sf_dir):
    return lookup.best(corpus.refs(spark, sf_dir), corpus.works(spark, sf_dir))


@query(_BEST + " SELECT r.doc_id, r.ref_ord, coalesce(r.doi, b.doi) AS doi, 'https://doi.org/' || coalesce(r.doi, b.doi) AS doi_url FROM refs r LEFT JOIN best b ON r.doc_id = b.doc_id AND r.ref_ord = b.ref_ord")
def doi_backfill(spark, sf_dir):
    return lookup.backfilled(corpus.refs(spark, sf_dir), corpus.works(spark, sf_dir)).select("doc_id", "ref_ord", "doi", "doi_url")


@query(_BEST + """
, both AS (SELECT doc_id, ref_ord, 'verified' AS how, CAST(1 AS DOUBLE) AS score, doi FROM refs WHERE doi IN (SELECT doi FROM works) UNION ALL SELECT doc_id, ref_ord, 'searched', score, doi FROM best)
SELECT b.*, 'https://doi.org/' || b.doi AS doi_url, w.title, w.who AS authors, w.wy AS year FROM both b JOIN works w ON b.doi = w.doi""".replace("both", "found"))
def doi_resolved(spark, sf_dir):
    return lookup.resolved(corpus.refs(spark, sf_dir), corpus.works(spark, sf_dir)).withColumn("authors", F.array_join("authors", "|"))


@query(ORACLES["doi_resolved"], plain=True)
def doi_resolved_remembered(spark, sf_dir):
    """A first run looks all up; a second one, to which no work is given, has it from memory."""
    refs, known, path = corpus.refs(spark, sf_dir), corpus.works(spark, sf_dir), f"{shared_folder(spark)}/memo-{uuid.uuid4().hex}"
    lookup.resolved_remembered(refs, known, path)
    return lookup.resolved_remembered(refs, known.where("false"), path).withColumn("authors", F.array_join("authors", "|"))


_RETRACT = """
, w AS (SELECT '10.1000/x' || p_partkey AS doi, CASE WHEN p_partkey % 41 = 0 THEN CASE (p_partkey // 41) % 4 WHEN 0 THEN 'update' WHEN 1 THEN 'relation' WHEN 2 THEN 'type' ELSE 'title' END END AS method, '2021-' || lpad(CAST(1 + p_partkey % 12 AS VARCHAR), 2, '0') AS at FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)),
status AS (SELECT r.doc_id, r.ref_ord, r.doi, w.method IS NOT NULL AS is_retracted, w.method, CASE WHEN w.method IS NOT NULL THEN w.at END AS date, CASE WHEN w.doi IS NULL THEN 'DOI not found' END AS error FROM refs r LEFT JOIN w ON r.doi = w.doi WHERE r.doi IS NOT NULL)"""


@query(_RETRACT + " SELECT * FROM status")
def retraction_status(spark, sf_dir):
    return lookup.retractions(corpus.refs(spark, sf_dir), corpus.works(spark, sf_dir)).drop("ref_id")


@query(_RETRACT + """
, s AS (SELECT doc_id, count(*) AS checked, count(CASE WHEN is_retracted THEN 1 END) AS retracted, count(error) AS errors FROM status GROUP BY doc_id)
SELECT t.doc_id, t.total, coalesce(checked, 0) AS checked, coalesce(retracted, 0) AS retracted, coalesce(checked - retracted - errors, 0) AS ok, coalesce(errors, 0) AS errors FROM (SELECT doc_id, count(*) AS total FROM refs GROUP BY doc_id) t LEFT JOIN s ON t.doc_id = s.doc_id""")
def retraction_stats(spark, sf_dir):
    r = corpus.refs(spark, sf_dir)
    return lookup.retraction_counts(r, lookup.retractions(r, corpus.works(spark, sf_dir)))


@query()
def web_suggestions(spark, sf_dir):
    c, _, m = _match(spark, sf_dir)
    return lookup.web_suggestions(match.unmatched(c, m), corpus.works(spark, sf_dir))


_related = lambda df: df.withColumn("related_references", F.array_join("related_references", "|"))


@query()
def issues_all(spark, sf_dir):
    c, r, w = *_by_document(spark, sf_dir), corpus.works(spark, sf_dir)
    return _related(process.issues(c, r, w, search=False, retractions=True))


@query()
def issues_plain_duplicates(spark, sf_dir):
    """What the plain rule for duplicates gives in place of the tiers."""
    c, r = _by_document(spark, sf_dir)
    return _related(process.issues(c, r, duplicates_=False, completeness=False, journals=False)).where("issue_type = 'duplicate_reference'")


@query(_CANON + """
, changed AS (SELECT r.doc_id, r.ref_ord, r.ref_id, r.journal, c.canonical, c.confidence FROM refs r JOIN canon c ON r.journal = c.journal WHERE c.confidence > 0 AND lower(c.canonical) <> lower(r.journal)),
last AS (SELECT doc_id, ref_id, min(ref_ord) AS ord, arg_max(journal, ref_ord) AS journal, arg_max(canonical, ref_ord) AS canonical, arg_max(confidence, ref_ord) AS confidence FROM changed GROUP BY ALL)
SELECT doc_id, ord, 'Journal name can be standardized' AS description, ref_id || ': ''' || journal || '''' AS citation_text,
  'Consider using canonical name: ''' || canonical || ''' (confidence: ' || CAST(round_even(confidence * 100, 0) AS INT) || '%)' AS suggestion FROM last""")
def journal_normalization_issues(spark, sf_dir):
    return quality.normalisation_issues(corpus.refs(spark, sf_dir))


@query()
def import_results(spark, sf_dir):
    r = corpus.refs(spark, sf_dir)
    found = library.result(_library(r), r)
    return found.select("doc_id", _L("imported_count"), _L("matched_count"), *[F.array_join(c, "; ").alias(c) for c in ("unmatched_document_refs", "unmatched_import_refs", "suggestions")])


@query()
def report_by_doc(spark, sf_dir):
    return process.checked(*_by_document(spark, sf_dir))[1]


@query()
def summary_text(spark, sf_dir):
    return process.checked(*_by_document(spark, sf_dir))[2]


_STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)


@query(f"""
WITH w AS (SELECT conv_id, turn, list_filter(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')), lambda x: regexp_full_match(x, '[a-z]{{3,}}') AND NOT list_contains([{_STOP}], x)) AS ws FROM conversations),
p AS (SELECT a.conv_id, a.turn, a.ws AS x, b.ws AS y, len(list_intersect(a.ws, b.ws)) AS hits FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, CAST(CASE WHEN len(x) > 0 AND len(y) > 0 THEN round((hits / len(y) + least(hits / 3.0, 1.0)) / 2, 6) ELSE 0 END AS DOUBLE) AS overlap FROM p""", plain=True)
def keyword_overlap(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    a, b = c.alias("a"), c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next")).alias("b")
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(similarity.keyword_overlap(F.col("text"), F.col("next")), 6).alias("overlap"))


@query(f"""
, t AS (SELECT doc_id, ref_ord, title, lead(title) OVER (PARTITION BY doc_id ORDER BY ref_ord) AS other FROM refs WHERE title IS NOT NULL),
s AS (SELECT *, list_distinct(string_split(lower(title), ' ')) AS x, list_distinct(string_split(lower(other), ' ')) AS y FROM t WHERE other IS NOT NULL)
SELECT doc_id, ref_ord, CAST(round(CASE WHEN lower(title) = lower(other) THEN 1.0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END, 6) AS DOUBLE) AS jaccard FROM s""")
def token_jaccard(spark, sf_dir):
    from pyspark.sql import Window

    r = corpus.refs(spark, sf_dir).where(F.col("title").isNotNull())
    t = r.withColumn("other", F.lead("title").over(Window.partitionBy("doc_id").orderBy("ref_ord"))).where(F.col("other").isNotNull())
    return t.select("doc_id", "ref_ord", F.round(similarity.word_jaccard(F.col("title"), F.col("other")), 6).alias("jaccard"))


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's body, a header, its entries each broken in two lines, an end line and what follows it."""
    r = corpus.entries(spark, sf_dir).withColumn("raw_text", F.regexp_replace("raw_text", " in ", "\nin "))
    lines = r.select("doc_id", (F.col("ref_ord") * 10 + 10).alias("o"), F.posexplode(F.split("raw_text", "\n")).alias("i", "text")).select("doc_id", (F.col("o") + F.col("i")).alias("ord"), "text")
    docs = r.select("doc_id").distinct()
    fixed = [(0, "Some body text."), (1, "References"), (1_000_000, "Figure 1 shows more."), (1_000_001, "Smith, J. (2001). After the end.")]
    for at, line in fixed:
        lines = lines.unionByName(docs.select("doc_id", F.lit(at).alias("ord"), F.lit(line).alias("text")))
    return lines


@query("SELECT doc_id, ref_ord, raw_text FROM refs")
def paragraphs_to_entries(spark, sf_dir):
    return formats.entries(_paragraphs(spark, sf_dir))


@query("""
, p AS (SELECT doc_id, ref_ord, raw_text, lag(1) OVER (PARTITION BY doc_id ORDER BY ref_ord) AS l FROM refs)
SELECT doc_id, ref_ord AS ord, CAST(sum(length(raw_text) + 2) OVER (PARTITION BY doc_id ORDER BY ref_ord) - length(raw_text) - 2 AS INT) AS start_pos, CAST(sum(length(raw_text) + 2) OVER (PARTITION BY doc_id ORDER BY ref_ord) - 2 AS INT) AS end_pos FROM p""")
def paragraph_offsets(spark, sf_dir):
    return formats.offsets(corpus.entries(spark, sf_dir).select("doc_id", F.col("ref_ord").alias("ord"), F.col("raw_text").alias("text")))


@query()
def document_rewritten(spark, sf_dir):
    return formats.rewritten(_paragraphs(spark, sf_dir), render.rendered(corpus.refs(spark, sf_dir), render.style("apa")))


_canonical = ", ".join(f"('{line.split(' = ', 1)[1]}')" for line in journals.JOURNALS.strip().splitlines())
ORACLES["known_journals"] = f"SELECT DISTINCT canonical FROM (VALUES {_canonical}) t(canonical)"

_quoted = lambda v: str(v).lower() if isinstance(v, bool) else f"'{v}'"
ORACLES["styles"] = "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_quoted, row)) + ")" for row in render.STYLES) + ") t(style, author, last_sep, year_place, year, title, quotes, grouped, volume, pages, doi)"
ORACLES["typo_suggestions"] = oracle(_CITE_NAMES + """
, missing AS (SELECT doc_id, min(cit_ord) AS cit_ord, text, any_value(ca[1]) AS ca, any_value(cy) AS cy FROM named c WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.doc_id = c.doc_id AND m.text = c.text) GROUP BY doc_id, text),
unused AS (SELECT *, lower(last1) AS ra FROM refs r WHERE authors <> '' AND NOT EXISTS (SELECT 1 FROM matches m WHERE m.doc_id = r.doc_id AND m.ref_id = r.ref_id)),
near AS (SELECT u.doc_id, u.ref_ord, m.cit_ord, 'Possible typo match: ' || m.text || ' (possible typo: ''' || u.ra || ''' not ''' || m.ca || '''' || CASE WHEN abs(m.cy - u.year) > 0 THEN '; year differs: ' || u.year || ' vs ' || m.cy ELSE '' END || ')' AS s
  FROM unused u JOIN missing m ON u.doc_id = m.doc_id WHERE u.ra <> m.ca AND coalesce(abs(m.cy - u.year) <= 2, true) AND CASE WHEN contains(u.ra, m.ca) OR contains(m.ca, u.ra) THEN abs(length(u.ra) - length(m.ca)) <= 2 ELSE levenshtein(m.ca, u.ra) <= CASE WHEN length(m.ca) <= 6 THEN 1 ELSE 2 END END),
best AS (SELECT doc_id, ref_ord, arg_min(s, cit_ord) AS s FROM near GROUP BY ALL),
every AS (SELECT doc_id, ref_ord FROM refs r WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.doc_id = r.doc_id AND m.ref_id = r.ref_id))
SELECT e.doc_id, e.ref_ord, coalesce(b.s, 'Consider removing this reference or adding a citation') AS suggestion FROM every e LEFT JOIN best b ON e.doc_id = b.doc_id AND e.ref_ord = b.ref_ord""")

# Titles by the bit-parallel longest common subsequence over whole numbers; a and b are lower-case titles.
_LCS = """length(a) - bit_count(list_reduce(list_transform(string_split(b, ''), lambda c: list_sum(list_transform(range(length(a)), lambda i: CASE WHEN substr(a, i + 1, 1) = c THEN 1::HUGEINT << i::INT ELSE 0::HUGEINT END))::HUGEINT),
  lambda v, p: ((v + (v & p)) | (v - (v & p))) & ((1::HUGEINT << length(a)::INT) - 1), (1::HUGEINT << length(a)::INT) - 1))"""
_RATIO = f"""ratios AS (SELECT a, b, common, length(a) + length(b) AS total FROM (SELECT a, b, {_LCS} AS common FROM asked_titles))"""
_DUP = _DOI + f"""
, held AS (SELECT doc_id, list_sort(ords) AS ords FROM exact UNION SELECT doc_id, list_sort(ords) FROM by_doi),
shut AS (SELECT DISTINCT doc_id, x.a, y.b FROM held, unnest(ords) AS x(a), unnest(ords) AS y(b) WHERE x.a < y.b),
every AS (SELECT p.doc_id, p.ref_ord AS a, q.ref_ord AS b, lower(p.title) AS ta, lower(q.title) AS tb, p.year AS ya, q.year AS yb, CASE WHEN p.authors = '' THEN [] ELSE list_distinct(list_transform(string_split(lower(p.authors), '|'), lambda s: split_part(s, ',', 1))) END AS na,
  CASE WHEN q.authors = '' THEN [] ELSE list_distinct(list_transform(string_split(lower(q.authors), '|'), lambda s: split_part(s, ',', 1))) END AS nb FROM refs p JOIN refs q ON p.doc_id = q.doc_id AND p.ref_ord < q.ref_ord),
free AS (SELECT e.* FROM every e WHERE NOT EXISTS (SELECT 1 FROM shut s WHERE s.doc_id = e.doc_id AND s.a = e.a AND s.b = e.b)),
asked_titles AS (SELECT DISTINCT ta AS a, tb AS b FROM free WHERE ta <> '' AND tb <> '' AND least(length(ta), length(tb)) * 200 >= (length(ta) + length(tb)) * 85), {_RATIO},
by_title AS (SELECT f.doc_id, f.a, f.b, round(common * 200.0::DOUBLE / total, 6) AS ratio FROM free f JOIN ratios r ON f.ta = r.a AND f.tb = r.b WHERE common * 200 >= total * 85),
by_people AS (SELECT doc_id, a, b FROM free f WHERE coalesce(abs(ya - yb) <= 1, ya IS NULL AND yb IS NULL) AND len(na) > 0 AND len(nb) > 0 AND len(list_intersect(na, nb)) * 10 >= greatest(len(na), len(nb)) * 6
  AND NOT EXISTS (SELECT 1 FROM by_title t WHERE t.doc_id = f.doc_id AND t.a = f.a AND t.b = f.b))"""
ORACLES["dup_title"] = oracle(_DUP + " SELECT * FROM by_title")
ORACLES["dup_author_year"] = oracle(_DUP + " SELECT * FROM by_people")
_DIFFS = _DUP + """
, grouped AS (SELECT doc_id, 'exact_duplicate' AS match_type, ords, 1.0::DOUBLE AS confidence FROM exact UNION ALL SELECT doc_id, 'doi_match', ords, 1.0::DOUBLE FROM by_doi UNION ALL SELECT doc_id, 'title_fuzzy', [a, b], ratio / 100 FROM by_title UNION ALL SELECT doc_id, 'author_year', [a, b], 0.7::DOUBLE FROM by_people),
wide AS (SELECT g.doc_id, g.match_type, g.ords, g.confidence, count(DISTINCT r.authors) AS n_a, count(DISTINCT r.year) AS n_y, string_agg(r.year, ', ' ORDER BY r.ref_ord) AS years, count(DISTINCT lower(r.title)) AS n_t, count(DISTINCT lower(r.journal)) AS n_j, count(r.doi) AS n_d, count(*) AS n, list(r.ref_id ORDER BY r.ref_ord) AS ids, first(r.raw_text ORDER BY r.ref_ord) AS first_text
  FROM grouped g JOIN refs r ON r.doc_id = g.doc_id AND list_contains(g.ords, r.ref_ord) GROUP BY ALL),
diffs AS (SELECT *, CASE WHEN match_type = 'exact_duplicate' THEN '' ELSE concat_ws('; ', CASE WHEN n_a > 1 THEN 'author formatting' END, CASE WHEN n_y > 1 THEN 'years differ (' || years || ')' END, CASE WHEN n_t > 1 THEN 'titles differ slightly' END, CASE WHEN n_j > 1 THEN 'journal names differ' END, CASE WHEN n_d > 0 AND n_d < n THEN 'only some have DOI' END) END AS differences FROM wide)"""
ORACLES["dup_differences"] = oracle(_DIFFS + " SELECT doc_id, match_type, array_to_string(ords, '|') AS ords, round(confidence, 6) AS confidence, differences, array_to_string(ids, '|') AS ids FROM diffs")
ORACLES["document_rewritten"] = _style_sql("apa").replace("SELECT doc_id, ref_ord, regexp_replace", "SELECT doc_id, CAST(ref_ord + 1 AS INT) AS ord, regexp_replace").replace("AS formatted FROM j", "AS text FROM j UNION ALL SELECT DISTINCT doc_id, 0, 'Some body text.' FROM j UNION ALL SELECT DISTINCT doc_id, 1, 'References' FROM j")

_TITLED_LIB = _LIB + f"""
, imports AS (SELECT doc_id, ref_ord AS item, lower(title) AS ti FROM refs l WHERE ref_ord % 4 <> 0 AND title <> '' AND NOT EXISTS (SELECT 1 FROM hit h WHERE h.doc_id = l.doc_id AND h.item = l.ref_ord)),
own AS (SELECT doc_id, ref_ord, lower(title) AS tr FROM refs r WHERE title <> '' AND NOT EXISTS (SELECT 1 FROM hit h WHERE h.doc_id = r.doc_id AND h.ref_ord = r.ref_ord)),
asked_titles AS (SELECT DISTINCT ti AS a, tr AS b FROM imports i JOIN own o ON i.doc_id = o.doc_id WHERE least(length(ti), length(tr)) * 200 >= (length(ti) + length(tr)) * 85), {_RATIO},
may AS (SELECT i.doc_id, i.item, list(o.ref_ord ORDER BY o.ref_ord) AS refs_of, row_number() OVER (PARTITION BY i.doc_id ORDER BY i.item) AS n FROM imports i JOIN own o ON i.doc_id = o.doc_id JOIN ratios r ON r.a = i.ti AND r.b = o.tr WHERE common * 200 >= total * 85 GROUP BY i.doc_id, i.item),
steps AS (SELECT doc_id, n, item, refs_of[1] AS ref_ord, [refs_of[1]] AS taken FROM may WHERE n = 1
  UNION ALL SELECT m.doc_id, m.n, m.item, list_filter(m.refs_of, lambda r: NOT list_contains(s.taken, r))[1], list_append(s.taken, list_filter(m.refs_of, lambda r: NOT list_contains(s.taken, r))[1]) FROM steps s JOIN may m ON m.doc_id = s.doc_id AND m.n = s.n + 1),
titled AS (SELECT doc_id, item, ref_ord FROM steps WHERE ref_ord IS NOT NULL)"""
ORACLES["library_title_match"] = oracle(_TITLED_LIB + " SELECT * FROM titled")
ORACLES["library_leftovers"] = oracle(_TITLED_LIB + """
, matched AS (SELECT doc_id, item, ref_ord FROM hit UNION ALL SELECT * FROM titled),
sides AS (SELECT doc_id, 'import' AS side, ref_ord AS ord, ref_id, authors, year, upper(title) AS title FROM refs r WHERE ref_ord % 4 <> 0 AND NOT EXISTS (SELECT 1 FROM matched m WHERE m.doc_id = r.doc_id AND m.item = r.ref_ord)
  UNION ALL SELECT doc_id, 'document', ref_ord, ref_id, authors, year, title FROM refs r WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.doc_id = r.doc_id AND m.ref_ord = r.ref_ord)),
told AS (SELECT *, concat_ws(' ', CASE WHEN authors <> '' THEN split_part(split_part(authors, '|', 1), ',', 1) || CASE WHEN contains(authors, '|') THEN ' et al.' ELSE '' END END, '(' || year || ')', CASE WHEN title <> '' THEN '"' || CASE WHEN length(title) > 50 THEN substr(title, 1, 50) || '...' ELSE title END || '"' END) AS s FROM sides)
SELECT doc_id, side, ord, CASE WHEN s = '' THEN ref_id ELSE s END AS summary FROM told""")

ORACLES["import_results"] = ORACLES["library_leftovers"].replace("SELECT doc_id, side, ord, CASE WHEN s = '' THEN ref_id ELSE s END AS summary FROM told", """, texts AS (SELECT doc_id, string_agg(CASE WHEN s = '' THEN ref_id ELSE s END, '; ' ORDER BY ord) FILTER (side = 'document') AS d, string_agg(CASE WHEN s = '' THEN ref_id ELSE s END, '; ' ORDER BY ord) FILTER (side = 'import') AS i,
  count(*) FILTER (side = 'document') AS nd, count(*) FILTER (side = 'import') AS ni FROM told GROUP BY doc_id),
per AS (SELECT doc_id, count(CASE WHEN ref_ord % 4 <> 0 THEN 1 END) AS imported_count FROM refs GROUP BY doc_id), pairs_of AS (SELECT doc_id, count(*) AS n FROM matched GROUP BY doc_id)
SELECT p.doc_id, p.imported_count, coalesce(m.n, 0) AS matched_count, coalesce(d, '') AS unmatched_document_refs, coalesce(i, '') AS unmatched_import_refs,
  concat_ws('; ', CASE WHEN nd > 0 THEN nd || ' reference(s) in document not found in your library' END, CASE WHEN ni > 0 THEN ni || ' reference(s) in library not cited in document' END) AS suggestions
FROM per p LEFT JOIN pairs_of m USING (doc_id) LEFT JOIN texts t USING (doc_id)""".removeprefix(""))

_MISSING = _CITE_NAMES + f"""
, missing AS (SELECT doc_id, text, min(cit_ord) AS cit_ord, arg_min(context, cit_ord) AS context, any_value(ca) AS ca, any_value(cy) AS cy FROM named c WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.doc_id = c.doc_id AND m.text = c.text) GROUP BY doc_id, text),
keyed AS (SELECT *, list_filter(list_distinct(regexp_extract_all(lower(context), '[a-z]+')), lambda x: length(x) >= 3 AND NOT list_contains([{_STOP}], x)) AS kw FROM missing),
agree(a, b, hit) AS (SELECT a, b, CASE WHEN a = b OR (contains(b, a) OR contains(a, b)) AND abs(length(a) - length(b)) > 2 THEN '' WHEN contains(b, a) OR contains(a, b) OR levenshtein(a, b) <= CASE WHEN length(a) <= 6 THEN 1 ELSE 2 END THEN 'possible typo: ''' || b || ''' not ''' || a || '''' END
  FROM (SELECT DISTINCT unnest(ca) AS a FROM missing) CROSS JOIN (SELECT DISTINCT unnest(ra) AS b FROM people)),
both_sides AS (SELECT m.doc_id, m.cit_ord, m.text, r.ref_ord, r.raw_text, m.ca, r.ra, m.cy, r.year AS ry, m.kw, CASE WHEN r.title <> '' THEN list_filter(list_distinct(regexp_extract_all(lower(r.title), '[a-z]+')), lambda x: length(x) >= 3 AND NOT list_contains([{_STOP}], x)) ELSE [] END AS tw FROM keyed m JOIN people r ON m.doc_id = r.doc_id),
reasons AS (SELECT DISTINCT b.doc_id, b.cit_ord, b.ref_ord, first(g.hit ORDER BY list_position(b.ca, g.a), list_position(b.ra, g.b)) AS hit FROM both_sides b JOIN agree g ON list_contains(b.ca, g.a) AND list_contains(b.ra, g.b) AND g.hit IS NOT NULL GROUP BY b.doc_id, b.cit_ord, b.ref_ord),
rated AS (SELECT b.*, h.hit, abs(cy - ry) AS gap, CASE WHEN len(kw) > 0 AND len(tw) > 0 THEN (len(list_intersect(kw, tw)) / len(tw) + least(len(list_intersect(kw, tw)) / 3.0::DOUBLE, 1.0::DOUBLE)) / 2 ELSE 0::DOUBLE END AS k FROM both_sides b LEFT JOIN reasons h USING (doc_id, cit_ord, ref_ord)),
scored AS (SELECT *, round(CASE WHEN hit IS NOT NULL THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN gap = 0 THEN 0.3::DOUBLE WHEN gap = 1 THEN 0.25 WHEN gap = 2 THEN 0.2 WHEN gap <= 5 THEN 0.1 ELSE 0 END + k * 0.2::DOUBLE, 6) AS score, concat_ws('; ', nullif(hit, ''), CASE WHEN gap BETWEEN 1 AND 5 THEN 'year is ' || ry || ', not ' || cy END, CASE WHEN k > 0.3 AND hit IS NULL THEN 'title keywords match context' END) AS reason,
  coalesce(contains(ca[1], ra[1]) OR contains(ra[1], ca[1]), false) AS lead_name FROM rated),
chosen AS (SELECT * FROM scored WHERE hit IS NOT NULL AND score > 0 OR score >= 0.15 QUALIFY row_number() OVER (PARTITION BY doc_id, cit_ord ORDER BY score DESC, ref_ord) = 1),
shown AS (SELECT m.doc_id, m.cit_ord, m.text, CASE WHEN length(c.raw_text) > 80 THEN substr(c.raw_text, 1, 80) || '...' ELSE c.raw_text END AS t, c.score, c.reason, c.lead_name FROM missing m LEFT JOIN chosen c ON m.doc_id = c.doc_id AND m.cit_ord = c.cit_ord),
suggested AS (SELECT doc_id, cit_ord, text, CASE WHEN lead_name AND score >= 0.4 THEN 'Did you mean: ' || t || CASE WHEN reason <> '' THEN ' (' || reason || ')' ELSE '' END WHEN score IS NOT NULL THEN 'Weak match (co-author?): ' || t ELSE 'Add a corresponding reference to the bibliography' END AS suggestion FROM shown)"""
ORACLES["suggestions_top1"] = oracle(_MISSING + " SELECT * FROM suggested")
_topic = ", ".join(f"'{t}'" for t in lookup.TOPIC)
ORACLES["web_suggestions"] = oracle(_MISSING + _WORKS + f"""
, asked AS (SELECT doc_id, cit_ord, ca[1] AS ca, cy, context, list_filter(list_distinct(regexp_extract_all(lower(context), '[a-z]+')), lambda x: length(x) >= 4 AND NOT list_contains([{_STOP}], x)) AS kw FROM missing WHERE cy IS NOT NULL AND ca[1] <> ''),
looked AS (SELECT ca, cy, context, list_transform(list_sort(list_transform(kw, lambda x: {{'n': -length(x), 'x': x}})), lambda s: s.x)[1:4] AS top FROM asked GROUP BY ALL),
met AS (SELECT l.*, w.doi, w.title, w.wy, w.last1 || ' ' || substr(w.who, 1, 1) AS who, list_distinct(regexp_extract_all(lower(w.title), '[a-z]+')) AS tw FROM looked l JOIN works w ON (contains(lower(w.last1), l.ca) OR contains(l.ca, lower(w.last1))) AND (w.wy IS NULL OR abs(w.wy - l.cy) <= 1)
  WHERE len(list_filter([{_topic}], lambda t: contains(lower(l.context), t))) = 0 OR len(list_filter([{_topic}], lambda t: contains(lower(w.title), t))) > 0),
searches AS (SELECT *, unnest([0, 1, 2, 3]) AS search, unnest([len(list_intersect(tw, top[1:3])), len(list_intersect(tw, top[1:2])), len(list_intersect(tw, ['brain'])), 0]) AS hits FROM met),
first15 AS (SELECT *, row_number() OVER (PARTITION BY ca, cy, context, search ORDER BY hits DESC, doi) AS place FROM searches QUALIFY row_number() OVER (PARTITION BY ca, cy, context, search ORDER BY hits DESC, doi) <= 15),
once AS (SELECT * FROM first15 QUALIFY row_number() OVER (PARTITION BY ca, cy, context, doi ORDER BY search, place) = 1),
three AS (SELECT *, row_number() OVER (PARTITION BY ca, cy, context ORDER BY search, place) AS r FROM once QUALIFY row_number() OVER (PARTITION BY ca, cy, context ORDER BY search, place) <= 3),
lines AS (SELECT ca, cy, context, string_agg('  ' || r || '. ' || who || ' (' || coalesce(CAST(wy AS VARCHAR), 'None') || '). ' || CASE WHEN length(title) > 60 THEN substr(title, 1, 60) || '...' ELSE title END || CASE WHEN wy <> cy THEN ' [year: ' || wy || ']' ELSE '' END || ' https://doi.org/' || doi, chr(10) ORDER BY r) AS t FROM three GROUP BY ALL)
SELECT a.doc_id, a.cit_ord, '[WEB SEARCH] Possible matches:' || chr(10) || t AS found FROM asked a JOIN lines l ON a.ca = l.ca AND a.cy = l.cy AND a.context = l.context""")

_ISSUE = "SELECT doc_id, {stage} AS stage, CAST({ord} AS INT) AS ord, '{kind}' AS issue_type, {description} AS description, {cited} AS citation_text, {suggestion} AS suggestion, {severity} AS severity, {related} AS related_references FROM ({rows})"
_RAW = "SELECT t.*, r.raw_text FROM ({rows}) t JOIN ({refs}) r ON t.doc_id = r.doc_id AND t.ref_ord = r.ref_ord"
_DUP_ISSUES = oracle(_DIFFS + """
, placed AS (SELECT *, array_to_string(list_transform(ords, lambda o: '#' || o), ', ') AS places FROM diffs)
SELECT doc_id, ords[1] AS ord, CASE WHEN match_type = 'exact_duplicate' THEN 'Identical reference appears multiple times in reference list' ELSE 'Possible duplicate references (' || match_type || ', ' || CAST(round_even(confidence * 100, 0) AS INT) || '% confidence)' || CASE WHEN differences <> '' THEN ' Differences: ' || differences ELSE '' END END AS description,
  'Refs ' || places || CASE WHEN len(list_distinct(ids)) = 1 THEN ': ' || substr(first_text, 1, 80) || '...' ELSE ' (' || array_to_string(ids, ', ') || ')' END AS citation_text, CASE WHEN confidence >= 0.9 THEN 'warning' ELSE 'info' END AS severity, array_to_string(ids, '|') AS related FROM placed""")
_SPELT = oracle(_CANON + """ SELECT r.doc_id, min(c.canonical) AS canonical, array_to_string(list_sort(list(DISTINCT r.journal)), '|') AS names, string_agg(r.ref_id, '|' ORDER BY r.ref_ord) AS related FROM refs r JOIN canon c ON r.journal = c.journal WHERE c.confidence > 0
GROUP BY r.doc_id, lower(c.canonical) HAVING count(DISTINCT r.journal) > 1""")


def _issues_sql(retractions: bool) -> str:
    """The union of the oracles of the single findings."""
    raw = lambda name: _RAW.format(rows=ORACLES[name], refs=oracle(" SELECT doc_id, ref_ord, raw_text FROM refs"))
    same = {"cited": "text", "suggestion": "suggestion", "severity": "'warning'"}
    parts = [
        dict(same, stage=0, ord="cit_ord", kind="missing_reference", description="'In-text citation has no matching reference'", rows=ORACLES["suggestions_top1"]),
        dict(same, stage=1, ord="ref_ord", kind="spelling_mismatch", description="'Possible author name spelling mismatch'", rows=ORACLES["spelling_issues"]),
        dict(same, stage=2, ord="ref_ord", kind="year_mismatch", description="'Year differs between citation and reference'", rows=ORACLES["year_issues"]),
        dict(same, stage=3, ord="ref_ord", kind="uncited_reference", description="'Reference is not cited in the text'", cited="CASE WHEN length(raw_text) > 100 THEN substr(raw_text, 1, 100) || '...' ELSE raw_text END", rows=raw("typo_suggestions")),
        dict(stage=4, ord="ord", kind="potential_duplicate", description="description", cited="citation_text", suggestion="'Remove the duplicate entry from your reference list'", severity="severity", related="related", rows=_DUP_ISSUES),
        dict(same, stage=6, ord="cit_ord", kind="style_warning", description="'Use ''&'' instead of ''and'' inside parenthetical citations'", rows=ORACLES["ampersand_issues"]),
        dict(stage=7, ord="ref_ord", kind="incomplete_reference", description="description", cited="citation_text", suggestion="suggestion", severity="severity", rows=ORACLES["completeness_issues"]),
        dict(stage=8, ord="0", kind="inconsistent_journal_name", description="'Journal name spelled in several ways: ' || replace(names, '|', ', ')", cited="CAST(NULL AS VARCHAR)", suggestion="'Use ''' || canonical || ''' throughout'", severity="'warning'", related="related", rows=_SPELT),
    ]
    if retractions:
        parts.append(dict(stage=9, ord="ref_ord", kind="retracted_reference", description="'Retracted paper' || coalesce(' (retracted: ' || date || ')', '')", cited="CASE WHEN length(raw_text) > 100 THEN substr(raw_text, 1, 97) || '...' ELSE raw_text END", suggestion="'Remove or replace this reference'", severity="'error'", rows=raw("retraction_status") + " WHERE is_retracted"))
    return " UNION ALL ".join(_ISSUE.format(**{"related": "''"} | p) for p in parts)


ORACLES["issues_all"] = _issues_sql(True)
ORACLES["issues_plain_duplicates"] = _ISSUE.format(stage=4, ord="ord", kind="duplicate_reference", description="'Possible duplicate references found'", cited="ids", suggestion="'Review and merge these references if they are duplicates'", severity="'warning'", related="''", rows=oracle("""
, keys AS (SELECT doc_id, ref_ord, ref_id, concat_ws('|', CASE WHEN authors <> '' THEN substr(lower(last1), 1, 10) END, CAST(year AS VARCHAR), CASE WHEN title <> '' THEN array_to_string(string_split(lower(title), ' ')[1:3], '_') END) AS key FROM refs)
SELECT doc_id, min(ref_ord) AS ord, string_agg(ref_id, '; ' ORDER BY ref_ord) AS ids FROM keys GROUP BY doc_id, key HAVING count(*) > 1"""))
_REPORT = f"""
SELECT c.doc_id, c.n_citations, c.n_references, c.n_matched, coalesce(i.n, 0) AS n_issues, coalesce(i.n, 0) = 0 AS is_valid FROM ({ORACLES['quick_check']}) c LEFT JOIN (SELECT doc_id, count(*) AS n FROM found GROUP BY doc_id) i ON c.doc_id = i.doc_id"""
ORACLES["report_by_doc"] = f"WITH found AS ({_issues_sql(False)}) {_REPORT}"
ORACLES["summary_text"] = f"""WITH found AS ({_issues_sql(False)}), report AS ({_REPORT}),
lines AS (SELECT doc_id, stage, issue_type, ord, concat_ws(chr(10), '  - ' || description, '    Citation: ' || nullif(citation_text, ''), '    Suggestion: ' || nullif(suggestion, '')) AS t FROM found),
kinds AS (SELECT doc_id, stage, chr(10) || upper(replace(issue_type, '_', ' ')) || ' (' || count(*) || '):' || chr(10) || repeat('-', 40) || chr(10) || string_agg(t, chr(10) ORDER BY ord, t) AS t FROM lines GROUP BY doc_id, stage, issue_type),
texts AS (SELECT doc_id, string_agg(t, chr(10) ORDER BY stage) AS t FROM kinds GROUP BY doc_id)
SELECT r.doc_id, concat_ws(chr(10), repeat('=', 50), 'CITATION VALIDATION REPORT', repeat('=', 50), '', 'Total in-text citations: ' || n_citations, 'Total references: ' || n_references, 'Matched citations: ' || n_matched, '',
  CASE WHEN is_valid THEN 'Status: VALID - All citations match references' ELSE 'Status: ISSUES FOUND - ' || n_issues || ' issue(s)' || chr(10) || chr(10) || t END, '', repeat('=', 50)) AS summary FROM report r LEFT JOIN texts t ON r.doc_id = t.doc_id"""
