"""Projections and cleaning: column expressions and schema-driven selections."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number(c: Column) -> Column:
    """B1: a finite number, or null."""
    x = c.try_cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x)


def norm_key(c: Column) -> Column:
    """B2: upper case, letters and digits only."""
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def parents(c: Column, sep: str = "/") -> tuple[Column, Column]:
    """The two parts of a pedigree; the second null if there is none."""
    parts = F.split(c, re.escape(sep), 2)
    return F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))


def location_of(group: Column) -> Column:
    """What stands before the last underscore."""
    return F.regexp_extract(group, r"^(.*)_[^_]*$", 1)


def period_of(group: Column) -> Column:
    return F.substring_index(group, "_", -1).try_cast("int")


def code_number(c: Column, pattern: str) -> Column:
    """The number that a pattern's group finds in a code, or null."""
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")).try_cast("int")


def line_key(c: Column) -> Column:
    """Canonical key of a pedigree: bracketed remarks and blanks out, upper case, dashes for other signs."""
    return F.regexp_replace(F.regexp_replace(F.upper(F.regexp_replace(c, r"\([^)]*\)|\s+", "")), r"[^A-Z0-9]+", "-"), r"^-|-$", "")


def matching(df: DataFrame, pattern: str) -> list[str]:
    """Columns whose name matches."""
    return [c for c in df.columns if re.search(pattern, c)]


def any_date(c: Column, *formats: str) -> Column:
    """The first of the formats that fits."""
    return F.coalesce(*(F.to_date(F.try_to_timestamp(c, F.lit(f))) for f in formats))


def in_range(c: Column, lo: float, hi: float) -> Column:
    """Null outside the range."""
    return F.when(c.between(lo, hi), c)


def all_null(columns: list[str]) -> Column:
    """1 if none of the columns has a value."""
    return (F.coalesce(*(F.col(c).cast("string") for c in columns)).isNull()).cast("int")


def recovered_dosage(v: Column, eps: float = 1e-6) -> Column:
    """0, 1 or 2 from 0, 0.5 or 1 within eps; null for imputed values."""
    return F.when(F.abs(v) < eps, 0).when(F.abs(v - 0.5) < eps, 1).when(F.abs(v - 1) < eps, 2)


def without_null_columns(df: DataFrame, keys: list[str]) -> DataFrame:
    """Columns without a null; one pass counts them all."""
    others = [c for c in df.columns if c not in keys]
    n = df.agg(F.count(F.lit(1)).alias("__n"), *(F.count(c).alias(c) for c in others)).first()
    return df.select(*keys, *(c for c in others if n[c] == n["__n"]))


def melt(df: DataFrame, keys: list[str], columns: list[str], name: str = "variable", value: str = "value") -> DataFrame:
    """B17."""
    return df.unpivot(keys, columns, name, value)


def widen(df: DataFrame, keys: list[str], name: str, value: str, values: list[str]) -> DataFrame:
    """A column for each listed value; rows that lack one go."""
    return df.groupBy(*keys).pivot(name, values).agg(F.first(value)).dropna(subset=values)


def grid_bin(c: Column, step: float) -> Column:
    """Lower edge of the bin."""
    return F.floor(c / step) * step


def interactions(a: Column, b: Column) -> Column:
    """All products of two arrays' elements."""
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: x * y)))


def tagged(df: DataFrame, **tags) -> DataFrame:
    """Constant columns."""
    return df.withColumns({k: F.lit(v) for k, v in tags.items()})
