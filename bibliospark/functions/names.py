"""Author names: lists, last names, identifiers, and the rules by which two names agree."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import fold, fold_dashes, let, split_words, strip

# A last name with particles and the initials after a comma.
PAIR = r"([A-Z][a-zA-Z'-]+(?:\s+[a-z]+)?(?:\s+[A-Z][a-zA-Z'-]+)*),\s*([A-Z]\.?\s*(?:[A-Z]\.?\s*)*)"

# What is taken out of an in-text citation, what ends an author, initials at the end of a name, and a
# name before capitals.
YEAR, CITED_ET_AL, COLLEAGUES, AND = r",?\s*[0-9]{4}[a-z]?", r"(?i)\s+et\s+al\.?", r"(?i)\s+and\s+colleagues", r"(?i)\s+and\s+"
ET_AL, INITIALS = r"(?i)\s+et al\.$", "^[A-Z]{1,4}$"
BEFORE_CAPITALS = "^([A-Za-z][a-zA-Z\\-‐-—]+(?:\\s+[A-Za-z][a-zA-Z\\-‐-—]+)*)\\s+[A-Z]+"


def trimmed(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def make_ref_id(author: Column, year: Column) -> Column:
    """Letters, apostrophes and hyphens of the part before a comma, else of the first word; underscore; year."""
    first = F.when(F.contains(author, F.lit(",")), F.split(author, ",")[0]).otherwise(F.coalesce(F.get(split_words(author), F.lit(0)), F.lit("")))
    return F.concat(F.lower(F.regexp_replace(first, "[^a-zA-Z'-]", "")), F.lit("_"), F.regexp_replace(F.coalesce(year, F.lit("")), "[^0-9a-z]", ""))


def initials_pairs(text: Column) -> Column:
    """"Last, Initials" pairs of each part between ampersands."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(strip(text), "[,.]+$", ""), r"\s*&\s*"), lambda p: F.regexp_replace(strip(p), ",+$", "")), lambda p: p != "")

    def pairs(p: Column) -> Column:
        last, first = F.regexp_extract_all(p, F.lit(PAIR), F.lit(1)), F.regexp_extract_all(p, F.lit(PAIR), F.lit(2))
        return F.zip_with(last, first, lambda x, y: F.concat(x, F.lit(", "), strip(y)))

    return F.flatten(F.transform(parts, pairs))


def author_list(text: Column) -> Column:
    """Names of an author string: "Last, Initials" pairs, else at ampersands, else at "and", else at commas."""
    def within(text: Column) -> Column:
        commas = F.length(text) - F.length(F.replace(text, F.lit(","), F.lit("")))
        parts = F.when(F.contains(text, F.lit(" & ")), F.split(text, " & ")).when(F.lower(text).contains(" and "), F.split(text, AND)).when(F.contains(text, F.lit(", ")) & (commas > 1), F.split(text, ", ")).otherwise(F.array(text))
        return let(initials_pairs(text), lambda pairs: F.when(F.size(pairs) > 0, pairs).otherwise(trimmed(parts)))

    return let(F.regexp_replace(strip(text), ",+$", ""), within)


def comma_list(text: Column) -> Column:
    return trimmed(F.split(F.regexp_replace(strip(text), "[,.]+$", ""), ","))


def cited_authors(citation: Column, folded=fold) -> Column:
    """Lower-cased names of an in-text citation."""
    text = F.regexp_replace(citation, "[()]", "")
    text = strip(F.regexp_replace(text, YEAR, ""))
    text = F.regexp_replace(F.regexp_replace(text, CITED_ET_AL, ""), COLLEAGUES, "")
    parts = F.when(F.contains(text, F.lit(" & ")), F.split(text, " & ")).when(F.lower(text).contains(" and "), F.split(text, AND)).otherwise(F.array(text))
    return F.transform(trimmed(parts), lambda a: folded(F.lower(a)))


def last_name(author: Column) -> Column:
    """For matching: before the comma; without the initials at the end; else the last word."""
    a = F.regexp_replace(strip(author), ET_AL, "")
    words = split_words(a)
    last = F.element_at(words, -1)
    bare = F.replace(last, F.lit("."), F.lit(""))
    several = F.when(bare.rlike(INITIALS), F.array_join(F.slice(words, 1, F.size(words) - 1), " ")).otherwise(last)
    return F.when(F.contains(a, F.lit(",")), strip(F.split(a, ",")[0])).when(F.size(words) >= 2, several).when(F.size(words) == 1, words[0]).otherwise(a)


def suggested_last_name(author: Column) -> Column:
    """For suggestions: before the comma; the words before capitals; else the first or last word. Lower case."""
    a = strip(author)
    head = F.regexp_extract(a, BEFORE_CAPITALS, 1)
    words = split_words(a)
    by_word = F.when((F.size(words) > 1) & F.element_at(words, -1).rlike(r"^[A-Z]+\.?$"), words[0]).when(F.size(words) > 0, F.element_at(words, -1)).otherwise(a)
    return fold_dashes(F.lower(F.when(F.contains(a, F.lit(",")), strip(F.split(a, ",")[0])).when(head != "", head).otherwise(by_word)))


def plain_last_name(author: Column) -> Column:
    """For duplicates: before the comma, else the last word. Lower case."""
    a = F.lower(strip(author))
    words = split_words(a)
    return F.when(F.contains(a, F.lit(",")), strip(F.split(a, ",")[0])).when(F.size(words) > 0, F.element_at(words, -1)).otherwise(a)


def name_agreement(cited: Column, ref: Column) -> Column:
    """exact, fuzzy or none for two folded lower-case names."""
    inside = F.contains(ref, cited) | F.contains(cited, ref)
    gap = F.abs(F.length(cited) - F.length(ref))
    most = F.when(F.length(cited) <= 6, 1).otherwise(2)
    near = F.levenshtein(cited, ref, 2)
    return F.when(cited == ref, "exact").when(inside, F.when(gap <= 2, "fuzzy").otherwise("exact")).when((near >= 0) & (near <= most), "fuzzy").otherwise("none")


def typo_reason(cited: Column, ref: Column) -> Column:
    """Null where the names do not agree, empty where exactly, else what to check."""
    text = F.concat(F.lit("possible typo: '"), ref, F.lit("' not '"), cited, F.lit("'"))
    return let(name_agreement(cited, ref), lambda kind: F.when(kind == "fuzzy", text).when(kind == "exact", ""))


def numeric_ids(text: Column) -> Column:
    """Identifiers of a bracketed list; ranges expanded, descending ones empty."""
    parts = F.split(F.regexp_replace(text, r"[\[\]\s]", ""), ",")

    def one(p: Column) -> Column:
        a, b = F.split(p, "-")[0].try_cast("int"), F.get(F.split(p, "-"), F.lit(1)).try_cast("int")
        is_range = (F.size(F.split(p, "-")) == 2) & a.isNotNull() & b.isNotNull()
        run = F.when(a <= b, F.transform(F.sequence(a, F.greatest(a, b)), lambda x: x.cast("string"))).otherwise(F.array().cast("array<string>"))
        return F.when(is_range, run).otherwise(F.array(p))

    return F.flatten(F.transform(parts, one))


def bibtex_author(author: Column) -> Column:
    a = strip(author)
    words = split_words(a)
    last, rest = F.element_at(words, -1), F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), " ")
    initials = (F.length(last) <= 3) & F.replace(last, F.lit("."), F.lit("")).rlike("^[^a-z]*[A-Z][^a-z]*$")
    return F.when(F.contains(a, F.lit(",")), a).when((F.size(words) >= 2) & initials, F.concat(rest, F.lit(", "), last)).when(F.size(words) >= 2, F.concat(last, F.lit(", "), rest)).otherwise(a)
