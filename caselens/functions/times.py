"""Times: parsing by a list of formats, choice among columns, parts of the day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.functions import vocab

#: Formats of times in deviation tables, tried in this order after a fraction is cut off.
FORMATS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")
#: Formats of times in event logs; day first only on request.
LOG_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "M-d-yyyy H:m", "M/d/yyyy H:m")
DAY_FIRST = ("d-M-yyyy H:m", "d/M/yyyy H:m")


def parsed(text: Column, formats: tuple[str, ...] = FORMATS) -> Column:
    """The time that the first fitting format reads, null if none does; a fraction of seconds and a final Z are cut off."""
    plain = F.regexp_replace(F.split_part(F.trim(text), F.lit("."), F.lit(1)), "Z$", "")
    return F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)) for f in formats])


def event_time(df: DataFrame, columns: tuple[str, ...] = ("detected_at", "timestamp", "created_at")) -> Column:
    """The time of a row: the first of the columns that isn't null; text is parsed."""
    there = [F.col(c) for c in columns if c in df.columns]
    if not there:
        return F.lit(None).cast("timestamp")
    if any(dict(df.dtypes)[c] == "string" for c in columns if c in df.columns):
        return parsed(F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in there]))
    return F.coalesce(*there)


def weekday_name(ts: Column) -> Column:
    return F.get(F.array(*map(F.lit, vocab.WEEKDAYS)), F.weekday(ts))


def period(ts: Column) -> Column:
    """night, morning, afternoon or evening."""
    hour = F.hour(ts)
    out = None
    for name, start, end in vocab.PERIODS:
        inside = (hour >= start) & (hour < end)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out
