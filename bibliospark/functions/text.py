"""Column expressions over text: folding, truncation, contexts, keywords, names. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Dashes and apostrophes that word processors put into names.
DASHES, APOSTROPHES = "‐‑‒–—", "’ʼ"
# Words that never count as keywords.
STOP_WORDS = """
a an the and or but in on at to for of with by from as is was are were been be have has had do does did will would
could should may might must shall can need dare ought used it its this that these those i you he she we they what
which who whom when where why how all each every both few more most other some such no nor not only own same so than
too very just also now into over after before between under again further then once here there about above below
during through
""".split()


def let(value: Column, body) -> Column:
    """body(value), the value evaluated once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def filled(c: Column) -> Column:
    """Neither null nor empty: the reference model treats both as absent."""
    return F.coalesce(c != "", F.lit(False))


def strip(c: Column) -> Column:
    """Without white space at both ends; no regular expression, which would be tried at every blank."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def fold_dashes(c: Column) -> Column:
    return F.translate(c, DASHES, "-" * len(DASHES))


def fold_apostrophes(c: Column) -> Column:
    return F.translate(c, APOSTROPHES, "'" * len(APOSTROPHES))


def fold(c: Column) -> Column:
    return fold_apostrophes(fold_dashes(c))


def shorten(c: Column, n: int) -> Column:
    """At most n characters, the dots included."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 3), F.lit("..."))).otherwise(c)


def preview(c: Column, n: int) -> Column:
    """The first n characters, with dots after them if there were more."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def split_words(c: Column) -> Column:
    return F.filter(F.split(strip(c), r"\s+"), lambda w: w != "")


def keywords(c: Column) -> Column:
    found = F.regexp_extract_all(F.lower(c), F.lit(r"(?<![\p{L}\p{N}_])[a-z]{3,}(?![\p{L}\p{N}_])"), F.lit(0))
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, STOP_WORDS)))


def year_in(c: Column) -> Column:
    return F.regexp_extract(c, r"\b((?:19|20)[0-9]{2})\b", 1).try_cast("int")


def doi_in(c: Column) -> Column:
    found = F.regexp_extract(c, r"(10\.[0-9]{4,}/[^\s\]>]+)", 1)
    return F.nullif(F.regexp_replace(found, "[.,;]+$", ""), F.lit(""))


def bare_doi(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"^https?://(?:dx\.)?doi\.org/", "")


def escape_latex(c: Column) -> Column:
    # Characters and their escapes, in the order in which they are replaced.
    pairs = [("&", "\\&"), ("%", "\\%"), ("$", "\\$"), ("#", "\\#"), ("_", "\\_"), ("{", "\\{"), ("}", "\\}"), ("~", "\\textasciitilde{}"), ("^", "\\textasciicircum{}")]
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def title_case(c: Column) -> Column:
    """Every run of letters with a capital first, also after an apostrophe or hyphen."""
    parts = F.regexp_extract_all(c, F.lit(r"[A-Za-z]+|[^A-Za-z]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substr(p, F.lit(2), F.length(p))))), "")


def sentence_case(c: Column) -> Column:
    """The first word capitalised, capitalised words kept, others lower-cased."""

    def word(w: Column, i: Column) -> Column:
        first, rest = F.substring(w, 1, 1), F.substr(w, F.lit(2), F.length(w))
        capital = (first != F.lower(first)) & ((F.length(w) > 1) | w.rlike("[A-Z]"))
        upper = (w == F.upper(w)) & (w != F.lower(w))
        return F.when(i == 0, F.concat(F.upper(first), F.lower(rest))).when(upper | capital, w).otherwise(F.lower(w))

    return F.array_join(F.transform(split_words(c), word), " ")


def date_text(parts: Column) -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD of an array of numbers."""
    return F.array_join(F.transform(F.slice(parts, 1, 3), lambda x, i: F.when(i == 0, x.cast("string")).otherwise(F.lpad(x.cast("string"), 2, "0"))), "-")


def duration_text(seconds: Column) -> Column:
    low = F.floor(seconds / 60)
    return F.when(seconds < 60, F.concat(F.lit("~"), seconds.cast("string"), F.lit(" seconds"))).otherwise(F.concat(F.lit("~"), low.cast("string"), F.lit("-"), (low + 1).cast("string"), F.lit(" minutes")))


def percent_text(c: Column) -> Column:
    return F.concat(F.bround(c * 100, 0).cast("int").cast("string"), F.lit("%"))


def spans(text: Column, pattern: str) -> Column:
    """All matches as structs (s, e, m): 0-based start, end after the last character, text; from the gaps between them."""
    empty = F.array().cast("array<struct<s:int,e:int,m:string>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc: Column, p: Column) -> Column:
        s = acc["at"] + F.length(p["gap"])
        e = s + F.coalesce(F.length(p["m"]), F.lit(0))
        one = F.when(p["m"].isNotNull(), F.array(F.struct(s.alias("s"), e.alias("e"), p["m"].alias("m")))).otherwise(empty)
        return F.struct(e.alias("at"), F.concat(acc["out"], one).alias("out"))

    def within(found: Column) -> Column:
        pairs = F.zip_with(F.split(text, pattern, -1), found, lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")))
        return F.when(F.size(found) > 0, F.aggregate(pairs, start, step, lambda a: a["out"])).otherwise(empty)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), within)
