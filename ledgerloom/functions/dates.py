"""Dates: parsing with fallbacks, day/month order, periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fallback formats in order, Spark patterns (single letters accept one or two digits).
FALLBACKS = (
    "d/M/yyyy", "d-M-yyyy", "d/M/yy", "d-M-yy", "yyyy-M-d", "yyyy/M/d", "M/d/yyyy", "M/d/yy",
    "yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s", "yyyy-M-d H:m", "yyyy-M-d'T'H:m", "d/M/yyyy H:m:s", "d-M-yyyy H:m:s", "d/M/yyyy H:m", "d-M-yyyy H:m",
)
#: Month names as banks write them in five languages.
MONTHS = {
    1: "gennaio gen janvier janv enero ene januar jan january",
    2: "febbraio feb fevrier février fevr févr febrero februar february",
    3: "marzo mar mars märz marz mär mrz march",
    4: "aprile apr avril avr abril abr april",
    5: "maggio mag mai mayo may",
    6: "giugno giu juin junio juni jun june",
    7: "luglio lug juillet juil julio juli jul july",
    8: "agosto ago aout août august aug",
    9: "settembre set septembre sept septiembre setiembre september sep",
    10: "ottobre ott octobre octubre oktober okt oct october",
    11: "novembre novembre noviembre november nov",
    12: "dicembre dic decembre décembre déc dec diciembre dezember dez december",
}
MONTH_FIRST_COUNTRIES = ("US",)


def _with(text: Column, pattern: str) -> Column:
    d = F.try_to_timestamp(text, F.lit(pattern)).cast("date")
    # Two-digit years from 69 on belong to the last century.
    return F.when(F.year(d) >= 2069, F.add_months(d, -1200)).otherwise(d) if "yyyy" not in pattern else d


def _written(text: Column) -> Column:
    """Dates with a written month: day month year, or month day year."""
    tokens = F.filter(F.split(F.lower(text), r"[\s,./-]+"), lambda t: t != "")
    number = F.create_map(*[F.lit(x) for m, names in MONTHS.items() for n in dict.fromkeys(names.split()) for x in (n, str(m))])
    named = F.transform(tokens, lambda t: F.coalesce(F.try_element_at(number, t), t))
    has = F.exists(tokens, lambda t: F.try_element_at(number, t).isNotNull())
    month_at_start = F.try_element_at(number, F.get(tokens, 0)).isNotNull()
    line = F.array_join(named, " ")
    return F.when(has & (F.size(tokens) == 3), F.when(month_at_start, _with(line, "M d yyyy")).otherwise(F.coalesce(_with(line, "d M yyyy"), _with(line, "d M yy"))))


def parse_date(text: Column, pattern: str | None = None) -> Column:
    """The given pattern first, then ISO timestamps (the day as written), the fallbacks, written months; null if none fits."""
    t = F.trim(text)
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d"), _with(F.substring(t, 1, 10), "yyyy-MM-dd"))
    tries = [*([_with(t, pattern)] if pattern else []), iso, *[_with(t, f) for f in FALLBACKS if f != pattern], F.when(t.rlike(r"\p{L}"), _written(t))]
    return F.coalesce(*tries)


def day_first(texts: Column, country: str | None = None) -> Column:
    """Aggregate: whether a column of numeric dates is day first; null if its values contradict one another or there are none."""
    first = F.regexp_extract(texts, r"^\s*(\d{1,2})[./-](\d{1,2})[./-]\d{2,4}\b", 1).try_cast("int")
    second = F.regexp_extract(texts, r"^\s*(\d{1,2})[./-](\d{1,2})[./-]\d{2,4}\b", 2).try_cast("int")
    a, b = F.count_if(first > 12), F.count_if(second > 12)
    default = F.lit((country or "").upper() not in MONTH_FIRST_COUNTRIES)
    return F.when((F.count_if(first.isNotNull()) == 0) | ((a > 0) & (b > 0)), F.lit(None)).when(a > 0, True).when(b > 0, False).otherwise(default)


def month_key(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def month_index(d: Column) -> Column:
    return F.year(d) * 12 + F.month(d) - 1


def swapped(d: Column, today: Column) -> Column:
    """Day and month exchanged, if that is a date, another one, and not in the future."""
    s = F.when(F.dayofmonth(d) <= 12, F.make_date(F.year(d), F.dayofmonth(d), F.month(d)))
    return F.when((s != d) & (s <= today), s)


def period_bounds(d: Column, period: str) -> tuple[Column, Column]:
    """First and last day of the month, quarter or year of d."""
    start = F.trunc(d, period)
    return start, F.date_sub(F.add_months(start, {"month": 1, "quarter": 3, "year": 12}[period]), 1)


def reference_period(last: Column, months: int = 3) -> tuple[Column, Column]:
    """The whole months that end with the month of the last movement."""
    return F.add_months(F.trunc(last, "month"), 1 - months), F.last_day(last)


def window_start(today: Column, months: int = 4) -> Column:
    return F.add_months(F.trunc(today, "month"), -months)
