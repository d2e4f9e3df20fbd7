"""Bibliography entries to structured references: an ordered cascade, the first form that matches wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import names, text as tx

# The entry forms, in the order in which they are tried.
APA = r"^([^(]+)\(([0-9]{4}[a-z]?)\)\.\s*([^.]+)\."
HARVARD = r"^(.+?),\s*((?:19|20)[0-9]{2}[a-z]?)\.\s*(.+)$"
VANCOUVER = r"^(.+?[A-Z]{1,4})\.\s+([A-Z][^.?!]+[.?!])"
NUMBERED = r"^(?:\[?[0-9]+\]?\.?\s*)([^.]+)\.\s*([^.]+)\."
_LINKS = (r"(?i)\s*(?:doi[:\s]*)?(?:https?://)?(?:dx\.)?doi\.org/\S+", r"\s*https?://\S+")
_PAGES = r"[eS]?[0-9]+(?:[-–][eS]?[0-9]+)?"
# Volume, issue and pages at the end of a Vancouver and of a Harvard entry, in order.
_VOLUME = (rf"([0-9]+)\s*\(([^)]+)\)\s*[:.]?\s*({_PAGES})", rf";([0-9]+)\s*()(?::\s*)({_PAGES})", rf";([0-9]+)\s*\(([^)]+)\)\s*[:.]?\s*({_PAGES})?")
_TAILS = (r"[,.\s]\s*([0-9]+)\s*\(([^)]+)\)\s*,?\s*([0-9]+[-–][0-9]+|[0-9]+)\s*\.?\s*$", r"[,.\s]\s*([0-9]+)\s*()(?:,\s*)([0-9]+[-–][0-9]+|[0-9]+)\s*\.?\s*$", r"()(),\s*([0-9]+[-–][0-9]+)\s*\.?\s*$", r"[,.\s]\s*([0-9]+)\s*\.?\s*()()$")

_YEAR = r"\b(?:19|20)[0-9]{2}\b"
_DATE_END = r"\b(19|20)[0-9]{2}(?:\s+[A-Z][a-z]{2,8}(?:\s+[0-9]{1,2})?)?[;.\s]*$"
# A leading number of an entry; names at the head of an entry of no known form.
_NUMBER = r"^(?:\[([0-9]+)\]\.?|([0-9]+)\.)\s+"
_NAMES = r"[A-Z][a-z]+\s+[A-Z]"
# Points of a split into title and journal, by what the journal, the journal in small letters and the title hold.
_JOURNAL_POINTS = ((r"\b[A-Z][a-z]*\.", 2), ("^[a-z]", -3))
_LOWER_POINTS = (("^(the|a|an) ", -2), (" the | of ", -1))
_TITLE_POINTS = ((r"\s[A-Z]\.$", -4), (r"\s(J|Int|Am|Br|Eur|Ann|Arch|Proc|Trans)\.$", -5))


def _without_links(c: Column) -> Column:
    for pattern in _LINKS:
        c = F.regexp_replace(c, pattern, "")
    return c


def _first(c: Column, patterns: tuple[str, ...]) -> Column:
    """(at, volume, issue, pages) of the first pattern found; at: where it begins, null if none is."""
    out = F
    for p in patterns:
        part = lambda g, p=p: F.nullif(F.regexp_extract(c, p, g), F.lit(""))
        out = out.when(c.rlike(p), F.struct(F.length(F.split(c, p, 2)[0]).alias("at"), part(1).alias("volume"), part(2).alias("issue"), F.translate(part(3), "–", "-").alias("pages")))
    return out.otherwise(F.lit(None).cast("struct<at:int,volume:string,issue:string,pages:string>"))


def _trim(c: Column, marks: str) -> Column:
    return F.regexp_replace(c, f"^[{marks}]+|[{marks}]+$", "")


def vancouver_tail(rest: Column) -> Column:
    """(journal, volume, issue, pages) of what follows the title."""

    def within(rest: Column, found: Column) -> Column:
        before = _trim(F.regexp_replace(F.substr(rest, F.lit(1), found["at"]), _DATE_END, ""), " .;")
        early = _trim(F.split(rest, _YEAR, 2)[0], " .;")
        early = F.when(rest.rlike(_YEAR) & (F.length(early) > 2), early)
        return F.struct(F.coalesce(F.nullif(before, F.lit("")), early).alias("journal"), found["volume"].alias("volume"), found["issue"].alias("issue"), found["pages"].alias("pages"))

    return tx.let(_without_links(tx.strip(rest)), lambda r: tx.let(_first(r, _VOLUME), lambda found: within(r, found)))


def _split_score(title: Column, journal: Column) -> Column:
    low = F.lower(journal)
    score = F.when(F.length(journal) < 40, 3).when(F.length(journal) < 60, 1).otherwise(0)
    for text, pattern, points in [(journal, p, n) for p, n in _JOURNAL_POINTS] + [(low, p, n) for p, n in _LOWER_POINTS] + [(title, p, n) for p, n in _TITLE_POINTS]:
        score = score + F.when(text.rlike(pattern), points).otherwise(0)
    return score + F.when(F.length(title) > F.length(journal), 1).otherwise(0)


def harvard_tail(rest: Column) -> Column:
    """(title, journal, volume, issue, pages): the tail is cut off, the remainder split where the score is best, late on ties."""

    def candidate(before: Column, s: Column) -> Column:
        both = F.struct(tx.strip(F.substr(before, F.lit(1), s["s"] + 1)).alias("title"), _trim(F.substr(before, s["e"] + 1, F.length(before)), " .").alias("journal"))
        return tx.let(both, lambda b: F.struct(_split_score(b["title"], b["journal"]).alias("score"), s["s"].alias("at"), b["title"].alias("title"), b["journal"].alias("journal")))

    def split(before: Column, found: Column) -> Column:
        best = F.array_max(F.filter(F.transform(tx.spans(before, r"\.\s+"), lambda s: candidate(before, s)), lambda c: c["journal"] != ""))
        parts = lambda b: F.struct(F.coalesce(b["title"], F.nullif(before, F.lit(""))).alias("title"), b["journal"].alias("journal"), found["volume"].alias("volume"), found["issue"].alias("issue"), found["pages"].alias("pages"))
        return tx.let(best, parts)

    def within(rest: Column, found: Column) -> Column:
        return tx.let(_trim(F.substr(rest, F.lit(1), F.coalesce(found["at"], F.length(rest))), " ,."), lambda before: split(before, found))

    return tx.let(tx.strip(_without_links(rest)), lambda r: tx.let(_first(r, _TAILS), lambda found: within(r, found)))


def parse(entries: DataFrame) -> DataFrame:
    """(doc_id, ref_ord, raw_text) to (…, rule, ref_number, ref_id, authors, title, year, journal, volume, issue, pages, doi, doi_url).

    A leading number ("3." or "[3]") is taken off first and is the id of the entry's numeric citations.
    """
    e = entries.withColumn("raw_text", tx.strip(F.col("raw_text")))
    e = e.withColumn("ref_number", F.regexp_extract("raw_text", _NUMBER, 0)).withColumn("ref_number", F.nullif(F.regexp_replace("ref_number", "[^0-9]", ""), F.lit("")))
    e = e.withColumn("t", F.when(F.col("ref_number").isNotNull(), F.regexp_replace("raw_text", _NUMBER, "")).otherwise(F.col("raw_text")))
    t = F.col("t")
    rule = F.when(t.rlike(APA), "apa").when(t.rlike(HARVARD), "harvard").when(t.rlike(VANCOUVER), "vancouver").when(F.col("raw_text").rlike(NUMBERED), "numbered").otherwise("fallback")
    e = e.withColumn("rule", rule)
    is_ = lambda r: F.col("rule") == r
    group = lambda p, g: F.regexp_extract(t, p, g)
    head = group(r"^([^.]+)\.", 1)
    fallback = F.when((F.length(head) < 100) & head.rlike(_NAMES), names.comma_list(head)).otherwise(F.array().cast("array<string>"))
    authors = F.when(is_("apa"), names.author_list(group(APA, 1))).when(is_("harvard"), names.author_list(group(HARVARD, 1))).when(is_("vancouver"), names.comma_list(group(VANCOUVER, 1))).when(is_("numbered"), names.author_list(F.regexp_extract("raw_text", NUMBERED, 1))).otherwise(fallback)
    any_year = tx.year_in(t)
    year = F.when(is_("apa"), F.substring(group(APA, 2), 1, 4).cast("int")).when(is_("harvard"), F.substring(group(HARVARD, 2), 1, 4).cast("int")).otherwise(any_year)
    harvard = harvard_tail(group(HARVARD, 3))
    van = vancouver_tail(F.substr(t, F.length(group(VANCOUVER, 0)) + 1, F.length(t)))
    e = e.select("*", authors.alias("authors"), year.alias("year"), F.when(is_("harvard"), harvard).alias("h"), F.when(is_("vancouver"), van).alias("v"), tx.doi_in(F.col("raw_text")).alias("doi"))
    title = F.when(is_("apa"), tx.strip(group(APA, 3))).when(is_("harvard"), F.col("h.title")).when(is_("vancouver"), tx.strip(group(VANCOUVER, 2))).when(is_("numbered"), tx.strip(F.regexp_extract("raw_text", NUMBERED, 2)))
    key = names.make_ref_id(F.coalesce(F.get("authors", F.lit(0)), F.lit("ref")), F.coalesce(F.col("year").cast("string"), F.lit("")))
    ref_id = F.coalesce("ref_number", F.when(is_("numbered"), F.col("ref_ord").cast("string")).otherwise(key))
    tail = lambda f: F.coalesce(F.col(f"h.{f}"), F.col(f"v.{f}"))
    return e.select("doc_id", "ref_ord", "raw_text", "rule", "ref_number", ref_id.alias("ref_id"), "authors", title.alias("title"), "year", tail("journal").alias("journal"), tail("volume").alias("volume"), tail("issue").alias("issue"), tail("pages").alias("pages"), "doi", F.concat(F.lit("https://doi.org/"), "doi").alias("doi_url"))
