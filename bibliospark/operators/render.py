"""References rendered in a style; styles built in or learned from examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import names, text as tx

_FIELDS = ("style", "author", "last_sep", "year_place", "year", "title", "quotes", "grouped", "volume", "pages", "doi")
# The built-in styles, in the order of _FIELDS.
STYLES = [
    ("apa", "{last}, {first_init}.", ", & ", "after_authors", "({year})", "sentence", False, False, "{volume}({issue})", "{pages}", "https://doi.org/{doi}"),
    ("mla", "{last}, {first}", ", and ", "after_authors", "{year}", "title", True, False, "vol. {volume}, no. {issue}", "pp. {pages}", "doi:{doi}"),
    ("chicago", "{last}, {first}", ", and ", "after_authors", "{year}", "title", True, False, "{volume}, no. {issue}", "{pages}", "https://doi.org/{doi}"),
    ("vancouver", "{last} {first_init}", ", ", "after_journal", "{year}", "sentence", False, True, "{volume}({issue})", "{pages}", "https://doi.org/{doi}"),
    ("ieee", "{first_init}. {last}", ", and ", "after_authors", "{year}", "sentence", True, False, "vol. {volume}, no. {issue}", "pp. {pages}", "doi: {doi}"),
]


def styles(spark: SparkSession) -> DataFrame:
    kinds = ", ".join(f"{f} {'boolean' if f in ('quotes', 'grouped') else 'string'}" for f in _FIELDS)
    return spark.createDataFrame(STYLES, kinds)


def style(name: str) -> dict:
    """A style's fields; names without a row of their own, such as harvard, are apa."""
    rows = {s[0]: dict(zip(_FIELDS, s)) for s in STYLES}
    return rows.get(name, rows["apa"])


def _put(template: Column, **values: Column) -> Column:
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def _author(author: Column, template: Column) -> Column:
    return tx.let(tx.strip(author), lambda a: tx.let(tx.split_words(a), lambda words: _name(a, words, template)))


def _name(a: Column, words: Column, template: Column) -> Column:
    comma, tail = F.contains(a, F.lit(",")), F.element_at(words, -1)
    bare = F.replace(tail, F.lit("."), F.lit(""))
    initials = (F.length(tail) <= 4) & bare.rlike("[A-Z]") & ~bare.rlike("[a-z]")
    several = F.size(words) >= 2
    front = F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), " ")
    after = F.regexp_extract(a, "^[^,]*,(.*)$", 1)
    last = F.when(comma, tx.strip(F.split(a, ",")[0])).when(several & initials, front).when(several, tail).otherwise(a)
    first = F.when(comma, tx.strip(after)).when(several & ~initials, front).otherwise("")
    letters = F.array_join(F.transform(tx.split_words(first), lambda w: F.concat(F.substring(w, 1, 1), F.lit("."))), "")
    dotted = F.concat(F.array_join(F.filter(F.split(bare, ""), lambda c: c != ""), "."), F.lit("."))
    return _put(template, last=last, first_init=F.when((first == "") & several & initials, dotted).otherwise(letters), first=first)


def _formatted(refs: DataFrame, p: dict[str, Column]) -> DataFrame:
    """(doc_id, ref_ord, formatted): a reference's text by the fields of a pattern, which may be literals or columns. Names
    and the text are columns of their own before they are read more than once."""
    refs = refs.withColumn("_who", F.transform("authors", lambda a: _author(a, p["author"])))
    who, n = F.col("_who"), F.size("authors")
    authors = F.when(n == 1, who[0]).when(n > 1, F.concat(F.array_join(F.slice(who, 1, F.greatest(n - 1, F.lit(0))), ", "), p["last_sep"], F.element_at(who, -1)))
    year = F.when(F.col("year") != 0, _put(p["year"], year=F.col("year").cast("string")))
    title = F.when(p["title"] == "sentence", tx.sentence_case(F.col("title"))).otherwise(tx.title_case(F.col("title")))
    title = F.when(tx.filled(F.col("title")), F.when(p["quotes"], F.concat(F.lit('"'), title, F.lit('"'))).otherwise(title))
    has = lambda c: tx.filled(F.col(c))
    volume = _put(p["volume"], volume=F.col("volume"), issue=F.col("issue"))
    volume = F.when(has("volume"), F.regexp_replace(F.regexp_replace(volume, r"\(\)", ""), r", no\. $", ""))
    pages = F.when(has("pages"), _put(p["pages"], pages=F.col("pages")))
    journal = F.when(has("journal"), F.col("journal"))
    early = p["year_place"] == "after_authors"
    some = lambda c, t: F.when(has(c), t).otherwise("")
    tail = F.when(has("volume") | has("pages"), F.concat(F.lit(";"), some("volume", F.concat("volume", some("issue", F.concat(F.lit("("), "issue", F.lit(")"))))), some("pages", F.concat(some("volume", F.lit(":")), "pages")))).otherwise("")
    group = F.concat("journal", F.when(F.col("year") != 0, F.concat(F.lit(" "), F.col("year").cast("string"))).otherwise(""), tail)
    parts = F.when(p["grouped"] & has("journal"), F.array(group)).otherwise(F.array(journal, F.when(~early, year), volume, pages))
    doi = F.when(has("doi"), _put(p["doi"], doi=F.col("doi")))
    out = F.array_join(F.concat(F.array(authors, F.when(early, year), title), parts, F.array(doi)), ". ")
    for old, new in ((r"\.\.+", "."), (r"\?\.\s*", "? "), (r"!\.\s*", "! "), (r"\s\s+|[\t\n\x0B\f\r]", " ")):
        out = F.regexp_replace(out, old, new)
    out, text = refs.select("doc_id", "ref_ord", out.alias("_text")), F.col("_text")
    return out.select("doc_id", "ref_ord", F.when(F.endswith(text, F.lit(".")), text).otherwise(F.concat(text, F.lit("."))).alias("formatted"))


def rendered(refs: DataFrame, pattern: dict) -> DataFrame:
    """(doc_id, ref_ord, formatted) in the style's pattern."""
    return _formatted(refs, {f: F.lit(v) for f, v in pattern.items()})


def rendered_each(refs: DataFrame, choices: DataFrame, patterns: DataFrame) -> DataFrame:
    """(doc_id, ref_ord, formatted), each document in the style that it has chosen: one plan for any number of styles.

    choices: (doc_id, style), of several rows for a document the first style by name counts; patterns: a row a style, as
    ``styles`` and ``learned_styles`` give. A document without a choice, and a style without a pattern, are apa.
    """
    rows = patterns.select("style", F.struct(*_FIELDS).alias("_pattern"))
    chosen = choices.groupBy("doc_id").agg(F.min("style").alias("style")).join(rows, "style", "left").select("doc_id", "_pattern")
    apa = F.struct(*[F.lit(v).alias(f) for f, v in style("apa").items()])
    r = refs.join(chosen, "doc_id", "left").withColumn("_pattern", F.coalesce("_pattern", apa))
    return _formatted(r, {f: F.col("_pattern")[f] for f in _FIELDS})


# Signs of a style in an example entry, in the order in which they are tried.
_AUTHOR_SIGNS = [(r"^[A-Z][a-z]+,\s+[A-Z]\.\s*[A-Z]?\.?", "{last}, {first_init}."), (r"^[A-Z][a-z]+\s+[A-Z][A-Z]?\.?", "{last} {first_init}"), (r"^[A-Z]\.\s*[A-Z]?\.?\s+[A-Z][a-z]+", "{first_init}. {last}")]
_YEAR_SIGNS = [
    (r"\.\s*\([0-9]{4}\)\.\s*[A-Z]", "({year})", "after_authors"), (r"\.\s+[A-Za-z\s]+[0-9]{4};[0-9]+", "{year}", "after_journal"), (r"[0-9]{4};", "{year}", "after_journal"),
    (r"\)\.\s*[0-9]{4}\.", "{year}.", "after_authors"), (r"\([0-9]{4}\)", "({year})", "after_authors"), (r"[0-9]{4}\.", "{year}", "after_authors"), (r",\s*[0-9]{4}", ", {year}", "after_authors")]
_GROUP_SIGNS = [(r"[A-Za-z]\s+[0-9]{4};[0-9]+\([^)]+\):[0-9]+[-–][0-9]+", "yes"), (r"[A-Za-z]\s+[0-9]{4};[0-9]+:[0-9]+[-–][0-9]+", "yes"), (r"[A-Za-z]\s+[0-9]{4};[0-9]+\.", "yes"), (r"\.\s+[0-9]{4};[0-9]+:e[0-9]+", "yes")]
_JOIN_SIGNS = [(", & ", ", & "), ("(?i), and ", ", and "), (" & ", " & "), ("(?i) and ", " and ")]


def _features(example: Column) -> dict[str, Column]:
    def first(signs: list[tuple]) -> Column:
        out = F
        for sign in signs:
            out = out.when(example.rlike(sign[0]), sign[1])
        return out

    year = [(pattern, i) for i, (pattern, *_) in enumerate(_YEAR_SIGNS)]
    return {"author": first(_AUTHOR_SIGNS), "year": first(year), "grouped": first(_GROUP_SIGNS), "last_sep": first(_JOIN_SIGNS)}


def _shown(signs: Column) -> Column:
    """The features as a map, of (author, the number of the year's sign, grouped, last_sep)."""
    year = lambda place: F.get(F.array(*[F.lit(sign[place]) for sign in _YEAR_SIGNS]), signs["year"])
    values = {"author": signs["author"], "year": year(1), "year_place": year(2), "grouped": signs["grouped"], "last_sep": signs["last_sep"]}
    return F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*values.values()))


def learned(examples: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(feature, value) of (example_ord, example): each feature's commonest value, on ties the one seen first; for each
    value of the columns by, which come first."""
    f = F.struct(*[sign.alias(name) for name, sign in _features(F.col("example")).items()])
    # each exploded: signs are looked for once an example; outer, as Spark tests the size of others first
    signs = examples.select(*by, "example_ord", F.explode_outer(F.array(f)).alias("signs"))
    rows = signs.select(*by, "example_ord", F.explode_outer(_shown(F.col("signs"))).alias("feature", "value")).where("value is not null")
    counted = rows.groupBy(*by, "feature", "value").agg(F.count("*").alias("n"), F.min("example_ord").alias("first"))
    best = counted.groupBy(*by, "feature").agg(F.max_by("value", F.struct("n", -F.col("first"))).alias("value"))
    quotes = examples.groupBy(*by).agg(F.bool_or(F.contains("example", F.lit('"'))).alias("q")).where("q").select(*by, F.lit("quotes").alias("feature"), F.lit("yes").alias("value"))
    return best.unionByName(quotes)


def learned_styles(examples: DataFrame) -> DataFrame:
    """Patterns as rows, in the columns of ``styles``, learned from (style, example_ord, example): one a style whose
    examples show something; what they do not show is as in apa."""
    found = learned(examples.where("style is not null"), ("style",)).groupBy("style").agg(F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("f"))
    base = style("apa")

    def field(name: str) -> Column:
        value = F.try_element_at("f", F.lit(name))
        return F.coalesce(value == "yes" if name in ("quotes", "grouped") else value, F.lit(base[name])).alias(name)

    return found.select("style", *[field(name) for name in _FIELDS[1:]])


def learned_style(examples: DataFrame) -> dict:
    """The style as a pattern; at most six rows are read."""
    found = {r.feature: r.value for r in learned(examples).collect()}
    base = style("apa")
    return base | {k: (v == "yes" if k in ("quotes", "grouped") else v) for k, v in found.items()} | {"style": "custom"}
