"""Period and date texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month name beginnings in three languages.
MONTHS = {
    1: ["jan", "yan", "янв"], 2: ["feb", "fev", "фев"], 3: ["mar", "мар"], 4: ["apr", "апр"], 5: ["may", "мая", "май"],
    6: ["jun", "июн"], 7: ["jul", "июл"], 8: ["aug", "авг"], 9: ["sep", "сен"], 10: ["oct", "окт"], 11: ["nov", "ноя"],
    12: ["dec", "дек"],
}
ROMAN = ["I", "II", "III", "IV"]
TEXT_FORMATS = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "yyyy.MM.dd", "d MMM yyyy", "MMM d, yyyy"]
MONTH_FIRST = ["M/d/yyyy", "M-d-yyyy"]
DAY_FIRST = ["d/M/yyyy", "d-M-yyyy", "d.M.yyyy"]


def month_number(token: Column) -> Column:
    """Month of a name that starts like one of the known beginnings."""
    low = F.lower(F.trim(token))
    out = F.lit(None).cast("int")
    for number, starts in reversed(MONTHS.items()):
        out = F.when(low.rlike("^(" + "|".join(starts) + ")"), number).otherwise(out)
    return out


def _first_of(year: Column, month: Column) -> Column:
    return F.when(month.between(1, 12) & (year > 0), F.make_date(year, month, F.lit(1)))


def special_period(text: Column) -> Column:
    """2024Q1, Q1 2024, 2024-M03, 2024-03, Jan 2024, 2024 янв -> first day of the period."""
    v = F.translate(F.lower(F.trim(text)), "_/", "--")
    grab = lambda pattern, i: F.regexp_extract(v, pattern, i)
    whole = lambda pattern, i: F.nullif(grab(pattern, i), F.lit("")).try_cast("int")
    yq, qy = r"^(\d{4})\s*-?\s*q([1-4])$", r"^q([1-4])\s*-?\s*(\d{4})$"
    ym = r"^(\d{4})\s*-?\s*m?(\d{1,2})$"
    ny, yn = r"^([a-zа-я]{3,12})\.?\s*-?\s*(\d{4})$", r"^(\d{4})\s*-?\s*([a-zа-я]{3,12})$"
    return F.coalesce(
        _first_of(whole(yq, 1), (whole(yq, 2) - 1) * 3 + 1), _first_of(whole(qy, 2), (whole(qy, 1) - 1) * 3 + 1),
        _first_of(whole(ym, 1), whole(ym, 2)), _first_of(whole(ny, 2), month_number(grab(ny, 1))),
        _first_of(whole(yn, 1), month_number(grab(yn, 2))))


def mixed_date(text: Column, day_first: bool = False, strict: bool = False) -> Column:
    """Dates of several notations; ``strict``: with day first no date is read month first instead."""
    formats = TEXT_FORMATS + (DAY_FIRST + MONTH_FIRST * (not strict) if day_first else MONTH_FIRST + DAY_FIRST[-1:])
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)).cast("date") for f in formats])


def period_date(text: Column, day_first: bool = False, strict: bool = False) -> Column:
    return F.coalesce(special_period(text), mixed_date(text, day_first, strict))


def numeric_period(x: Column, low: Column, high: Column) -> Column:
    """Whole columns of years, YYYYMM or YYYYMMDD, told apart by their range."""
    n = x.cast("bigint")
    year, ym = n.cast("int"), (n / 100).cast("int")
    return (F.when((low >= 1900) & (high <= 2100), _first_of(year, F.lit(1)))
            .when((low >= 190001) & (high <= 210012), _first_of(ym, (n % 100).cast("int")))
            .when((low >= 19000101) & (high <= 21001231),
                  F.try_to_timestamp(n.cast("string"), F.lit("yyyyMMdd")).cast("date")))


def from_parts(year: Column, month: Column | None = None, quarter: Column | None = None) -> Column:
    """Year with a month (number or name) or a quarter; the year alone is its first day."""
    if month is not None:
        m = F.coalesce(month.try_cast("int"), month_number(month.cast("string")))
        return _first_of(year.try_cast("int"), F.when(m.isNotNull(), F.least(F.greatest(m, F.lit(1)), F.lit(12))))
    if quarter is not None:
        q = F.regexp_extract(quarter.cast("string"), r"(\d)", 1).try_cast("int")
        return _first_of(year.try_cast("int"), (q - 1) * 3 + 1)
    return _first_of(year.try_cast("int"), F.lit(1))


def quarter_label(date: Column) -> Column:
    return F.concat(F.year(date).cast("string"), F.lit("-Ch"), F.quarter(date).cast("string"))


def quarter_phrase(date: Column) -> Column:
    """2025-yil III chorak"""
    return F.concat(F.year(date).cast("string"), F.lit("-yil "), F.element_at(
        F.array(*[F.lit(r) for r in ROMAN]), F.quarter(date).cast("int")), F.lit(" chorak"))
