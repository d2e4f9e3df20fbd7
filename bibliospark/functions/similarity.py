"""Similarity measures. The Indel ratio is the one measure that no built-in gives: a bit-parallel Arrow UDF."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence (bit-parallel, after Hyyro)."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & places.get(c, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


@F.pandas_udf(T.IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs(x or "", y or "") for x, y in zip(a, b)], dtype="int32")


def ratio_may_reach(a: Column, b: Column, least: int) -> Column:
    """No pair of these lengths beyond it has a ratio of ``least`` or more: 2 min / (m + n)."""
    return F.least(F.length(a), F.length(b)) * 200 >= (F.length(a) + F.length(b)) * least


def edits_allow(a: str, b: str, least: int) -> Column:
    """Whether two columns' ratio may be ``least`` or more by their edit distance, which stops early: a replaced character
    counts once there and twice in the ratio, so the distance is at most the share of both lengths that may differ."""
    return F.expr(f"levenshtein({a}, {b}, cast((length({a}) + length({b})) * {100 - least} div 100 as int)) >= 0")


def ratio_reaches(common: Column, a: Column, b: Column, least: int) -> Column:
    """In integers, so both engines agree at the edge."""
    return common * 200 >= (F.length(a) + F.length(b)) * least


def ratio(common: Column, a: Column, b: Column) -> Column:
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).otherwise(common * F.lit(200.0) / total)


def word_jaccard(a: Column, b: Column) -> Column:
    """1 for equal texts, 0 when either has no words, else shared by all words."""
    from .text import split_words

    x, y = F.array_distinct(split_words(F.lower(a))), F.array_distinct(split_words(F.lower(b)))
    return F.when(F.lower(a) == F.lower(b), 1.0).otherwise(jaccard(x, y))


def jaccard(x: Column, y: Column) -> Column:
    """Of arrays of distinct values; 0 when either is empty."""
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(both / (F.size(x) + F.size(y) - both))


def author_overlap(a: Column, b: Column) -> Column:
    """Names of a found in b, by the longer list."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most > 0, F.size(F.filter(a, lambda x: F.array_contains(b, x))) / most).otherwise(0.0)


def weighted_match(title: Column, authors: Column, year_gap: Column) -> Column:
    """Scores of title (.5), authors (.3) and year (.2, .1 beside), each null where unknown, by the weights known."""
    parts = [(title * 0.5, F.when(title.isNotNull(), 0.5)), (authors * 0.3, F.when(authors.isNotNull(), 0.3)),
             (F.when(year_gap == 0, 0.2).when(year_gap <= 1, 0.1).when(year_gap.isNotNull(), 0.0), F.when(year_gap.isNotNull(), 0.2))]
    got = sum((F.coalesce(p, F.lit(0.0)) for p, _ in parts), F.lit(0.0))
    weight = sum((F.coalesce(w, F.lit(0.0)) for _, w in parts), F.lit(0.0))
    return F.when(weight > 0, got / weight).otherwise(0.0)


def keyword_overlap(context: Column, title: Column) -> Column:
    """Mean of the share of the title's keywords found and of up to three hits."""
    from .text import keywords

    return words_overlap(keywords(context), keywords(title))


def words_overlap(asked: Column, own: Column) -> Column:
    """``keyword_overlap`` of the keywords of both; null where either is."""
    hits = F.size(F.array_intersect(asked, own))
    some = F.when(asked.isNotNull() & own.isNotNull(), 0.0)
    return F.when((F.size(own) > 0) & (F.size(asked) > 0), (hits / F.size(own) + F.least(hits / F.lit(3), F.lit(1.0))) / 2).otherwise(some)


def completeness(authors: Column, year: Column, title: Column, journal: Column, doi: Column, pages: Column) -> Column:
    from .text import filled

    def points(has: Column, n: float) -> Column:
        return F.when(has, n).otherwise(0.0)

    return F.round(points(F.coalesce(F.size(authors) > 0, F.lit(False)), 0.25) + points(F.coalesce(year != 0, F.lit(False)), 0.20) + points(filled(title), 0.25) + points(filled(journal), 0.15) + points(filled(doi) | filled(pages), 0.15), 6)
