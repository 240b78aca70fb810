"""Fixed-width UTC timestamps as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: YYYY-MM-DDTHH:MM:SSZ, twenty characters.
PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$"


def parse_instant(text: Column) -> Column:
    """TIMESTAMP, or null if the text has another form or names no calendar
    instant (a thirteenth month is refused)."""
    return F.when(text.rlike(PATTERN), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")))


def weekday(instant: Column) -> Column:
    """Monday is 0."""
    return F.weekday(instant)


def epoch_seconds(instant: Column) -> Column:
    return F.unix_timestamp(instant)


def parts(text: Column) -> dict[str, Column]:
    at = parse_instant(text)
    return {
        "year": F.year(at), "month": F.month(at), "day": F.dayofmonth(at), "hour": F.hour(at), "minute": F.minute(at),
        "second": F.second(at), "weekday": weekday(at), "epoch": epoch_seconds(at),
    }
