"""Partial dates: year, month, day or timestamp, as a struct that keeps the raw text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY = r"^\d{4}-\d{2}-\d{2}$"
_STAMP = r"^\d{4}-\d{2}-\d{2}T([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d{1,9})?)?(Z|[+-]([01]\d|2[0-3]):[0-5]\d)$"


def partial_date(raw: Column) -> Column:
    """struct(raw, precision, year, month, day); null where it isn't a partial date or no such day exists. Timestamps need an offset."""
    precision = F.when(raw.rlike(r"^\d{4}$"), "year").when(raw.rlike(r"^\d{4}-\d{2}$"), "month").when(raw.rlike(_DAY), "day").when(raw.rlike(_STAMP), "timestamp")
    year, month, day = (F.substring(raw, a, n).cast("int") for a, n in ((1, 4), (6, 2), (9, 2)))
    month = F.when(precision != "year", month)
    day = F.when(precision.isin("day", "timestamp"), day)
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    last = F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    sound = precision.isNotNull() & (year >= 1) & (month.isNull() | month.between(1, 12)) & (day.isNull() | ((day >= 1) & (day <= last)))
    return F.when(sound, F.struct(raw.alias("raw"), precision.alias("precision"), year.alias("year"), month.alias("month"), day.alias("day")))


def temporal_key(value: Column) -> Column:
    """What partial dates are ordered by: missing parts count as the first; the time of day doesn't count."""
    order = F.when(value["precision"] == "year", 1).when(value["precision"] == "month", 2).when(value["precision"] == "day", 3).otherwise(4)
    return F.struct(value["year"].alias("year"), F.coalesce(value["month"], F.lit(1)).alias("month"), F.coalesce(value["day"], F.lit(1)).alias("day"), order.alias("precision"))
