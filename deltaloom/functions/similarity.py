"""Similarities of strings and rows, all from built-in functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """One less the edit distance over the longer length; 1 for two empty strings."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longer)


def within_distance(a: Column, b: Column, least: float) -> Column:
    """Whether the edit similarity can be ``least`` or more; the distance is followed no further than that allows."""
    most = F.floor((1 - least) * F.greatest(F.length(a), F.length(b)) + 1e-9).cast("int")
    return (F.abs(F.length(a) - F.length(b)) <= most) & (F.call_function("levenshtein", a, b, most) >= 0)


def bigrams(c: Column) -> Column:
    """The set of two-character substrings."""
    last = F.length(c) - 1
    return F.when(last < 1, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(c, i, F.lit(2)))))


def bigram_jaccard(a: Column, b: Column) -> Column:
    """Common bigrams over all; 1 if neither string has any."""
    x, y = bigrams(a), bigrams(b)
    all_of = F.size(F.array_union(x, y))
    return F.when(all_of == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / all_of)


def bigram_codes(c: Column) -> Column:
    """:func:`bigrams` as numbers, two code points each: made once a row, and cheap to compare with those of many others."""
    return F.transform(bigrams(c), lambda g: F.shiftleft(F.ascii(g).cast("long"), 21).bitwiseOR(F.ascii(F.substr(g, F.lit(2))).cast("long")))


def jaccard(x: Column, y: Column) -> Column:
    """Common elements of two sets over all; 1 if both are empty."""
    common = F.size(F.array_intersect(x, y))
    all_of = F.size(x) + F.size(y) - common
    return F.when(all_of == 0, F.lit(1.0)).otherwise(common / all_of)


def blended(a: Column, b: Column) -> Column:
    """0.7 edit similarity and 0.3 bigram similarity; 1 for equal strings, 0 if one is empty."""
    return blend(a, b, levenshtein_similarity(a, b), bigram_jaccard(a, b))


def blend(a: Column, b: Column, edit: Column, grams: Column) -> Column:
    """:func:`blended` of similarities that are known already."""
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(0.7 * edit + 0.3 * grams)


def row_similarity(pairs: list[tuple[Column, Column]]) -> Column:
    """Share of equal fields."""
    return reduce(Column.__add__, (F.when(a.eqNullSafe(b), 1).otherwise(0) for a, b in pairs)) / F.lit(len(pairs))


def mean_similarity(pairs: list[tuple[Column, Column]]) -> Column:
    """Mean blended similarity of text fields; fields empty on both sides don't count, and nothing left is 1."""
    text = [(F.coalesce(a.cast("string"), F.lit("")), F.coalesce(b.cast("string"), F.lit(""))) for a, b in pairs]
    counted = [F.when((a == "") & (b == ""), 0).otherwise(1) for a, b in text]
    n = reduce(Column.__add__, counted)
    total = reduce(Column.__add__, (F.when(k == 0, 0.0).otherwise(blended(a, b)) for (a, b), k in zip(text, counted, strict=True)))
    return F.when(n == 0, F.lit(1.0)).otherwise(total / n)
