"""Sale dates in the spellings found in exported sheets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Day zero of sheet serial numbers, the last day a sheet can hold, and the year of dates written without one.
SERIAL_EPOCH = "1899-12-30"
LAST_SERIAL = 2_958_465
YEARLESS_YEAR = 2024

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
MONTH_NAME = "(?i)^(?:" + "|".join(f"{m[:3]}(?:{m[3:]})?" for m in MONTHS) + "|sept)$"
SERIAL = r"^[+-]?\d+(\.\d+)?$"
ISO = r"^\d{4}-\d{2}-\d{2}$"
COMPACT = r"^\d{8}$"
WEEKDAY = r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*[, ]+"
CLOCK = r"^(.*?\S)[T, ]+(\d{1,2}):(\d{2})(?::(\d{2}(?:\.\d{1,9})?))?\s*([AaPp][Mm])?\s*(?:[Zz]|UTC|GMT|[+-]\d{2}:?\d{2})?$"
YEAR_PIVOT = 70  # two-digit years below it are 20xx


def _from_serial(days: Column) -> Column:
    known = F.when(days.between(1, LAST_SERIAL), days)
    return F.date_add(F.lit(SERIAL_EPOCH).cast("date"), known).cast("timestamp_ntz")


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _month(name: Column) -> Column:
    """1 to 12 for a month's name, whole or in three letters."""
    place = F.instr(F.lit("".join(m[:3] for m in MONTHS)), F.lower(F.substring(name, 1, 3)))
    return F.when(name.rlike(MONTH_NAME), F.floor((place + 2) / 3).cast("int"))


def _year(text: Column) -> Column:
    year = text.try_cast("int")
    century = F.when(year < YEAR_PIVOT, 2000).otherwise(1900)
    return F.when(F.length(text) == 4, year).when(F.length(text) == 2, year + century)


def _clock(text: Column) -> Column:
    """Struct (day, hour, minute, second) of a date that a clock time may follow."""
    found = F.when(text.rlike(CLOCK), F.array(*[F.regexp_extract(text, CLOCK, i) for i in range(1, 6)]))

    def read(parts: Column) -> Column:
        half, hour = F.lower(parts[4]), parts[1].try_cast("int")
        twelve = F.when(hour.between(1, 12), hour % 12 + F.when(half == "pm", 12).otherwise(0))
        return F.struct(
            F.regexp_replace(F.coalesce(parts[0], text), WEEKDAY, "").alias("day"),
            F.when(parts.isNull(), 0).when(half != "", twelve).otherwise(hour).alias("hour"),
            F.coalesce(parts[2].try_cast("int"), F.lit(0)).alias("minute"),
            F.coalesce(parts[3].try_cast("decimal(16,6)"), F.lit(0).cast("decimal(16,6)")).alias("second"),
        )

    return _bound(found, read)


def _day(text: Column) -> Column:
    """Struct (year, month, day): the ISO form, else the day before the month where both can be months; names of months in either place."""

    def read(pieces: Column) -> Column:
        a, b, c = (F.get(pieces, F.lit(i)) for i in range(3))
        x, y, z = (p.try_cast("int") for p in (a, b, c))
        made = lambda year, month, day: F.struct(year.alias("year"), month.alias("month"), day.alias("day"))
        yearless, first = F.lit(YEARLESS_YEAR), F.lit(1)
        # a month's name with a day or a year of four digits, or year and month; a missing day is the first
        two = (
            F.when(x.isNull() & (F.length(b) == 4), made(y, _month(a), first))
            .when(x.isNull(), made(yearless, _month(a), y))
            .when((F.length(a) == 4) & y.isNotNull(), made(x, y, first))
            .when(F.length(a) == 4, made(x, _month(b), first))
            .when((F.length(b) == 4) & y.isNotNull(), made(y, x, first))
            .when(y.isNull(), made(yearless, _month(b), x))
        )
        return (
            F.when(F.size(pieces) == 2, two)
            .when(F.size(pieces) != 3, F.lit(None))
            .when((F.length(a) == 4) & x.isNotNull() & ((z > 12) | (text.rlike(ISO) & (y <= 12))), made(x, y, z))
            .when((F.length(a) == 4) & x.isNotNull(), made(x, z, y))
            .when(x.isNotNull() & (y > 12), made(_year(c), x, y))
            .when(x.isNotNull() & y.isNotNull(), made(_year(c), y, x))
            .when(x.isNotNull(), made(_year(c), _month(b), x))
            .otherwise(made(_year(c), _month(a), y))
        )

    return _bound(F.split(F.regexp_replace(text, r"[-/., ]+", "-"), "-"), read)


def _from_text(text: Column) -> Column:
    def dated(clock: Column) -> Column:
        made = lambda day: F.try_make_timestamp_ntz(
            day["year"], day["month"], day["day"], clock["hour"], clock["minute"], clock["second"]
        )
        return _bound(_day(clock["day"]), made)

    return _bound(_clock(text), dated)


def parse_sale_date(col: Column, kind: T.DataType = T.StringType()) -> Column:
    """A ``TIMESTAMP_NTZ`` from a sale date of type ``kind``; null where no rule applies.

    Eight digits are year, month and day; other numbers are sheet serials from
    1 to the last day a sheet can hold.  A zone or offset behind a clock time
    is passed over: the time is taken as written.
    """
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return col.cast("timestamp_ntz")
    if isinstance(kind, T.NumericType):
        return _from_serial(col.try_cast("int"))
    text = F.regexp_replace(col, r"^\s+|\s+$", "")
    whole = lambda start, size: F.substring(text, start, size).try_cast("int")
    zero = F.lit(0)
    compact = F.try_make_timestamp_ntz(whole(1, 4), whole(5, 2), whole(7, 2), zero, zero, zero)
    return (
        F.when(text.rlike(COMPACT), compact)
        .when(text.rlike(SERIAL), _from_serial(text.try_cast("double").try_cast("int")))
        .otherwise(_from_text(text))
    )


def micros(col: Column) -> Column:
    """Microseconds since 1970 as a number that quantiles accept."""
    return F.unix_micros(col.cast("timestamp"))
