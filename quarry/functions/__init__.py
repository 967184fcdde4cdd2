"""Scalar functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FNV_START, FNV_PRIME, MASK = 2166136261, 16777619, 4294967295


def normalize_name(c: Column) -> Column:
    """Names are equal without white space and case."""
    return F.lower(F.regexp_replace(c, r"\s+", ""))


def simple_type_name(c: Column) -> Column:
    """The last dotted part, without type arguments and array brackets."""
    return F.element_at(F.split(F.regexp_replace(F.regexp_replace(c, r"<.*>", ""), r"\[\]", ""), r"\."), -1)


def portable_path(c: Column) -> Column:
    """Forward slashes, and no leading ./"""
    return F.regexp_replace(F.regexp_replace(c, r"\\", "/"), r"^(\./)+", "")


def prefixes(c: Column) -> Column:
    """What an expression reads from: a.b[0].c reads from a, a.b, a.b[0] and a.b[0].c. Names, without white space and case."""
    flat = normalize_name(c)
    ends = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(flat))), lambda i: (i >= F.length(flat)) | F.substr(flat, i + 1, F.lit(1)).isin(".", "["))
    return F.transform(ends, lambda i: F.substr(flat, F.lit(1), i))


def percent(part: Column, whole: Column) -> Column:
    """Two decimals, halves up; 0 if there is no whole."""
    share = part.cast("double") / F.when(whole == 0, F.lit(None)).otherwise(whole).cast("double")
    return F.coalesce(F.floor(share * 10000 + 0.5) / 100, F.lit(0.0))


def utf16_length(c: Column) -> Column:
    """UTF-16 code units: a character beyond the basic plane counts twice."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("long")


def fnv1a32(c: Column) -> Column:
    """32-bit FNV-1a over code points, without leaving the JVM. For long texts use operators.shingles."""
    points = F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, ""))
    step = lambda h, x: (h.bitwiseXOR(F.ascii(x).cast("long")) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(MASK))
    return F.aggregate(points, F.lit(FNV_START).cast("long"), step)


def stable_hash(c: Column) -> Column:
    """FNV-1a as eight hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fnv1a32(c)), 8, "0"))


def normalize_fragment(c: Column) -> Column:
    """A query's shape: literals and numbers as ?, binds as :bind, no white space, lower case."""
    c = F.regexp_replace(c, r"'(?:[^'\\]|\\.)*'", "?")
    c = F.regexp_replace(c, r"(?<![A-Za-z0-9_])\d+(?:\.\d+)?(?![A-Za-z0-9_])", "?")
    c = F.regexp_replace(c, r":\s*[A-Za-z_][A-Za-z0-9_.]*", ":bind")
    return F.lower(F.regexp_replace(c, r"\s+", ""))


def jaccard(left: Column, right: Column) -> Column:
    """Of two arrays as sets; 1 if both are empty."""
    union = F.size(F.array_union(left, right))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(left, right)) / union)


def dice(left: Column, right: Column) -> Column:
    total = F.size(F.array_distinct(left)) + F.size(F.array_distinct(right))
    return F.when(total == 0, F.lit(1.0)).otherwise(2 * F.size(F.array_intersect(left, right)) / total)


def pair_key(left: Column, right: Column) -> Column:
    """The same for (a, b) and (b, a)."""
    return F.struct(F.least(left, right).alias("left"), F.greatest(left, right).alias("right"))
