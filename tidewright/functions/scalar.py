"""Column expressions used by several operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Replacements that make a label safe in file names.
LABEL_REPLACEMENTS = {" ": "_", "–": "-", "ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"}

DAY_MICROS = 86_400_000_000


def micros(time: Column | str) -> Column:
    """Microseconds since the epoch of a plain timestamp, read as UTC."""
    time = F.col(time) if isinstance(time, str) else time
    return F.unix_micros(time.cast("timestamp"))


def from_micros(value: Column) -> Column:
    return F.timestamp_micros(value).cast("timestamp_ntz")


def month_day(time: Column | str) -> Column:
    return F.date_format(time, "MM-dd")


def cyclic_columns(time: str, hour: bool = True, day_of_year: bool = True) -> list[Column]:
    """Hour on a 24-hour circle and day of year on a 365-day circle, leap years included."""
    out = []
    turn = 2 * F.pi()
    if hour:
        angle = turn * F.hour(time) / 24
        out += [F.sin(angle).alias("hour_sin"), F.cos(angle).alias("hour_cos")]
    if day_of_year:
        angle = turn * F.dayofyear(time) / 365
        out += [F.sin(angle).alias("doy_sin"), F.cos(angle).alias("doy_cos")]
    return out


def safe_label(label: Column | str) -> Column:
    """Label for file names: NULL becomes 'unknown', blanks and umlauts are spelled out."""
    label = F.col(label) if isinstance(label, str) else label
    spelled = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])),
                     LABEL_REPLACEMENTS.items(), label.cast("string"))
    return F.coalesce(spelled, F.lit("unknown"))


def _uniform(digest: Column, start: int) -> Column:
    """13 hex digits of a digest as a number in (0, 1)."""
    number = F.conv(F.substring(digest, start, 13), 16, 10).cast("double")
    return (number + F.lit(0.5)) / F.lit(float(16 ** 13))


def gaussian(*identity: Column) -> Column:
    """Standard normal number that depends on ``identity`` alone (Box-Muller on a digest).

    The same row gets the same noise however the data is partitioned and
    however often a task runs again.
    """
    digest = F.md5(F.concat_ws("|", *[c.cast("string") for c in identity]))
    return F.sqrt(-2.0 * F.log(_uniform(digest, 1))) * F.cos(2 * F.pi() * _uniform(digest, 14))
