"""Weeks that start on Saturday, rolling windows, and dates as event pages write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MONTH = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
_DASH = r"\s*[–—\-]\s*"


def week_of(d: Column) -> Column:
    """The Saturday on or before a day (UTC)."""
    return F.date_sub(F.to_date(d), F.dayofweek(F.to_date(d)) % 7)


def week_end(d: Column) -> Column:
    return F.date_add(week_of(d), 6)


def week_label(d: Column) -> Column:
    """``5–11 September`` or ``30 August – 5 September``."""
    a, b = week_of(d), week_end(d)
    day, month = lambda x: F.date_format(x, "d"), lambda x: F.date_format(x, "MMMM")
    return F.when(F.month(a) == F.month(b), F.concat(day(a), F.lit("–"), day(b), F.lit(" "), month(b))).otherwise(
        F.concat(day(a), F.lit(" "), month(a), F.lit(" – "), day(b), F.lit(" "), month(b))
    )


def within_days(ts: Column, asof: Column, days: int) -> Column:
    """Later than ``days`` days before ``asof``."""
    return ts > asof - F.make_dt_interval(F.lit(days))


def minutes_between(a: Column, b: Column) -> Column:
    return (F.unix_timestamp(b) - F.unix_timestamp(a)) / 60


def in_planning_window(starts_on: Column, asof: Column, days: int = 400) -> Column:
    """Undated, or starting within so many days from ``asof``."""
    return starts_on.isNull() | F.datediff(starts_on, asof).between(0, days)


def date_range(text: Column) -> Column:
    """struct(starts_on, ends_on) of the first date form found, else null.

    Forms, in order: ``July 7–9, 2026``; ``June 30 – July 2, 2026``; ``30 June – 2 July 2026``;
    ``26 - 28 May 2027``; ``12 May 2026``; ``May 12, 2026``. A range over New Year belongs to two years.
    """
    t = F.regexp_replace(text, r"\s+", " ")

    def form(pattern: str, *parts: str) -> Column:
        """Named parts of a form's groups (y, m1, d1, m2, d2) as a struct of dates, null unless all hold."""
        p = "(?i)" + pattern
        at = {name: F.regexp_extract(t, p, i + 1) for i, name in enumerate(parts)}
        month = {k: _month(v) for k, v in at.items() if k[0] == "m"}
        number = {k: v.try_cast("int") for k, v in at.items() if k[0] in "dy"}
        m1, m2 = month["m1"], month.get("m2", month["m1"])
        d1, d2, y = number["d1"], number.get("d2", number["d1"]), number["y"]
        y1, y2 = F.when(m2 < m1, y - 1).otherwise(y), y  # the year is the last month's
        if parts[0] == "m1" and "m2" in parts:  # month first: the year is the first month's
            y1, y2 = y, F.when(m2 < m1, y + 1).otherwise(y)
        ok = t.rlike(p) & (d1 >= 1) & (d2 >= 1) & (d1 <= 31) & (d2 <= 31)
        if "m2" not in parts:
            ok = ok & (d2 >= d1)
        day = lambda y, m, d: F.concat(y.cast("string"), F.lit("-"), F.lpad(m.cast("string"), 2, "0"), F.lit("-"), F.lpad(d.cast("string"), 2, "0")).try_cast("date")
        return F.when(ok, F.struct(day(y1, m1, d1).alias("starts_on"), day(y2, m2, d2).alias("ends_on")))

    return F.coalesce(
        form(rf"\b{_MONTH}\.?\s+(\d{{1,2}}){_DASH}(\d{{1,2}}),?\s+(\d{{4}})", "m1", "d1", "d2", "y"),
        form(rf"\b{_MONTH}\.?\s+(\d{{1,2}}){_DASH}{_MONTH}\.?\s+(\d{{1,2}}),?\s+(\d{{4}})", "m1", "d1", "m2", "d2", "y"),
        form(rf"\b(\d{{1,2}})\s+{_MONTH}\.?{_DASH}(\d{{1,2}})\s+{_MONTH}\.?,?\s+(\d{{4}})", "d1", "m1", "d2", "m2", "y"),
        form(rf"\b(\d{{1,2}}){_DASH}(\d{{1,2}})\s+{_MONTH}\.?,?\s+(\d{{4}})", "d1", "d2", "m1", "y"),
        form(rf"\b(\d{{1,2}})\s+{_MONTH}\.?,?\s+(\d{{4}})", "d1", "m1", "y"),
        form(rf"\b{_MONTH}\.?\s+(\d{{1,2}}),?\s+(\d{{4}})", "m1", "d1", "y"),
    )


def edition_dates(lines: Column, year: Column, head: int = 40) -> Column:
    """struct(starts_on, ends_on) of the first of a directory's ``head`` first lines that holds a full date, else of the first that
    does so with ``year`` behind it (from the page's address; null: none), else null. Only the banner at the top tells the edition."""
    month = F.filter(F.slice(lines, 1, head), lambda x: x.rlike(r"\d") & x.rlike(rf"(?i)\b{_MONTH}"))  # no form does without these
    first = lambda dates: F.get(F.filter(dates, lambda d: d.isNotNull()), F.lit(0))
    hinted = F.when(year.isNotNull(), first(F.transform(month, lambda x: date_range(F.concat(x, F.lit(" "), year.cast("string"))))))
    return F.coalesce(first(F.transform(month, date_range)), hinted)


def _month(name: Column) -> Column:
    """1 to 12 of a month's first three letters."""
    return ((F.call_function("locate", F.lower(F.substring(name, 1, 3)), F.lit("janfebmaraprmayjunjulaugsepoctnovdec")) + 2) / 3).cast("int")


def year_in_url(url: Column, asof: Column) -> Column:
    """The latest plausible year in an address: last year to three years on."""
    years = F.transform(F.regexp_extract_all(url, F.lit(r"(?<![0-9])(20\d\d)(?![0-9])"), F.lit(1)), lambda y: y.cast("int"))
    return F.array_max(F.filter(years, lambda y: y.between(F.year(asof) - 1, F.year(asof) + 3)))
