"""Camera clock and epoch helpers. Camera times are zone-less (TIMESTAMP_NTZ)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import col

# Fixed value: the accepted camera time layout.
TAKEN = r"^(\d{4})[:-](\d{2})[:-](\d{2})[ T](\d{2}):(\d{2}):(\d{2})"


def parse_taken(raw) -> Column:
    """'2019:06:12 14:05:33' or ISO text to TIMESTAMP_NTZ; null when unusable or outside 1900–2100."""
    s = F.trim(col(raw))
    part = [F.regexp_extract(s, TAKEN, i).try_cast("int") for i in range(1, 7)]
    t = F.when(part[5] < 60, F.try_make_timestamp_ntz(*part[:5], part[5].cast("decimal(8,6)")))
    return F.when(F.year(t).between(1900, 2100), t)


def micros(t) -> Column:
    return F.unix_micros(col(t).cast("timestamp"))


def hours_apart(a, b) -> Column:
    """Absolute gap in hours; infinity when either time is missing."""
    gap = F.abs(micros(a) - micros(b)).cast("double") / 3.6e9
    return F.coalesce(gap, F.lit(float("inf")))


def ms_to_date(ms) -> Column:
    """Epoch milliseconds (number or text) to a UTC ISO date; null when it is not a number."""
    v = col(ms).try_cast("double")
    return F.date_format(F.timestamp_millis(v.cast("long")), "yyyy-MM-dd")


def same_day_text(filename, label, hours) -> Column:
    h = col(hours)
    gap = F.when(h < 1, F.lit("within the hour")).otherwise(
        F.concat(F.bround(h, 0).cast("long").cast("string"), F.lit(" h apart"))
    )
    return F.concat(F.lit("Same day as "), col(filename), F.lit(" at "), col(label), F.lit(" ("), gap, F.lit(")"))
