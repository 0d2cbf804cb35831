"""Date arithmetic as closed-form expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def date_parts(ts: Column) -> dict[str, Column]:
    return {
        "minute": F.minute(ts),
        "hour": F.hour(ts),
        "dow": F.weekday(ts),
        "dom": F.dayofmonth(ts),
        "month": F.month(ts),
        "week": F.weekofyear(ts),
        "day_name": F.date_format(ts, "EEEE"),
    }


def parse_date(col: Column, fmt: str) -> Column:
    return F.try_to_timestamp(col, F.lit(fmt))


def excel_serial(col: Column, datemode: int = 0) -> Column:
    """Serial day number -> timestamp.

    Mode 0 counts from 1900 (numbers below 61 are ambiguous there and give NULL), mode 1 from 1904.
    """
    first = "1899-12-30" if datemode == 0 else "1904-01-01"
    day = F.floor(col).cast("int")
    seconds = F.round((col - F.floor(col)) * 86400).cast("long")
    ts = F.timestamp_seconds(F.unix_date(F.date_add(F.lit(first).cast("date"), day)).cast("long") * 86400 + seconds)
    return F.when(col >= (61 if datemode == 0 else 0), ts)


def days_between(start: Column, end: Column, weekdays: str) -> Column:
    """Number of days in the half-open span [start, end) that fall on ``weekdays`` ('MoTuWe...' flags).

    ``weekdays`` is seven 0/1 characters from Monday.  Days counted since a fixed Monday make the
    count a difference of two step functions.
    """
    per_week = weekdays.count("1")

    def upto(d: Column) -> Column:
        n = F.datediff(d, F.lit("1900-01-01").cast("date"))
        r = F.pmod(n, F.lit(7))
        part = F.lit(0)
        for i, flag in enumerate(weekdays):
            if flag == "1":
                part = part + F.when(r > i, 1).otherwise(0)
        return F.floor(n / 7) * per_week + part

    return (upto(end) - upto(start)).cast("long")


def business_day_cols(df: DataFrame, date_cols: Sequence[str]) -> DataFrame:
    """Weekdays and Saturdays of the month: existing, elapsed before the date, remaining from it."""
    out = {}
    for c in date_cols:
        d = F.to_date(c)
        first = F.trunc(d, "month")
        nxt = F.add_months(first, 1)
        for label, days in (("sats", "0000010"), ("bizdays", "1111100")):
            out[f"num_{label}_exist_in_mo_{c}"] = days_between(first, nxt, days)
            out[f"num_{label}_elapsed_in_mo_{c}"] = days_between(first, d, days)
            out[f"num_{label}_remain_in_mo_{c}"] = days_between(d, nxt, days)
    return df.withColumns(out)
