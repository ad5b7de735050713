"""Column expressions shared by the operators: vectors, periods, codes, projections."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cyrillic letters that look like Latin ones, and the Latin ones.
LOOKALIKES = ("АВСЕНКМОРТХ", "ABCEHKMOPTX")
SECTION_WORD = "Раздел"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector over its norm; over 1 where the norm is 0."""
    n = norm(a)
    return F.transform(a, lambda x: x / F.when(n == 0, 1.0).otherwise(n))


def centred(a: Column) -> Column:
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    return F.transform(a, lambda x: x - mean)


def safe(x: Column, by: Column) -> Column:
    """x / by; null where by is 0."""
    return x / F.nullif(by, F.lit(0.0))


def total(*columns: Column) -> Column:
    """The sum of the columns, nulls counting as 0."""
    return reduce(lambda a, b: a + b, (F.coalesce(c, F.lit(0.0)) for c in columns))


def mapped(key: Column, names: Mapping) -> Column:
    """A small fixed dictionary as an expression; null for other keys."""
    return F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[key]


def month_of(value: Column, kind: str) -> Column:
    """First day of the month of a number or string yyyyMM, a string yyyy-MM, or a date.

    ``kind``: ``number``, ``text`` or ``date``. Numbers outside 190001..209912 and texts that are no month give null.
    """
    if kind == "number":
        return F.when(value.between(190001, 209912), F.try_to_timestamp(value.cast("long").cast("string"), F.lit("yyyyMM")).cast("date"))
    if kind == "text":
        return F.trunc(F.coalesce(F.try_to_timestamp(value, F.lit("yyyy-MM")), F.try_to_timestamp(value, F.lit("yyyy-MM-dd"))).cast("date"), "MM")
    return F.trunc(value.cast("date"), "MM")


def code8(code: Column) -> Column:
    """A territory code without hyphens, its first eight characters."""
    return F.substring(F.replace(code, F.lit("-"), F.lit("")), 1, 8)


def section(name: Column) -> Column:
    """The Latin letter of a name like ``Раздел X ...``; ALL for any other."""
    parts = F.split(F.trim(name), r"\s+")
    return F.when(parts[0] == SECTION_WORD, F.translate(F.get(parts, F.lit(1)), *LOOKALIKES)).otherwise("ALL")


def albers(lon: Column, lat: Column, lat1: float = 52.0, lat2: float = 64.0, lat0: float = 56.0, lon0: float = 100.0) -> tuple[Column, Column]:
    """Equal-area conic projection; longitudes below 0 continue beyond 180; y grows to the south."""
    east = F.when(lon < 0, lon + 360).otherwise(lon)
    n = (F.sin(F.radians(F.lit(lat1))) + F.sin(F.radians(F.lit(lat2)))) / 2
    c = F.pow(F.cos(F.radians(F.lit(lat1))), 2) + 2 * n * F.sin(F.radians(F.lit(lat1)))
    radius = lambda phi: F.sqrt(c - 2 * n * F.sin(F.radians(phi))) / n
    angle = n * F.radians(east - lon0)
    return radius(lat) * F.sin(angle), radius(lat) * F.cos(angle) - radius(F.lit(lat0))
