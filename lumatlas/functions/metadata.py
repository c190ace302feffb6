"""GPS text and tag values as written by cameras."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import col, valid_fix


def dms_to_deg(degrees, minutes, seconds, ref) -> Column:
    """Degrees, minutes, seconds and N/S/E/W to signed degrees."""
    d = col(degrees) + col(minutes) / 60.0 + col(seconds) / 3600.0
    return F.when(F.upper(F.trim(F.coalesce(col(ref), F.lit("")))).isin("S", "W"), -d).otherwise(d)


def xmp_coord(raw) -> Column:
    """'37,46.494N', 'd,m,s' with a hemisphere letter, or '+37.77' to signed degrees; null when unusable."""
    s = F.trim(col(raw))
    ref = F.upper(F.regexp_extract(s, r"([NSEWnsew])$", 1))
    body = F.regexp_replace(s, r"[NSEWnsew]$", "")
    part = F.transform(F.split(body, ","), lambda p: F.trim(p).try_cast("double"))
    bad = F.exists(part, lambda p: p.isNull())
    v = (
        F.get(part, F.lit(0))
        + F.coalesce(F.get(part, F.lit(1)), F.lit(0.0)) / 60
        + F.coalesce(F.get(part, F.lit(2)), F.lit(0.0)) / 3600
    )
    return F.when(~bad, F.when(ref.isin("S", "W"), -v).otherwise(v))


def fix(lat, lon, source: str) -> Column:
    """struct(lat, lon, source) rounded to 7 digits, null unless the coordinates are usable."""
    return F.when(
        valid_fix(lat, lon),
        F.struct(F.bround(col(lat), 7).alias("lat"), F.bround(col(lon), 7).alias("lon"), F.lit(source).alias("source")),
    )


def first_fix(*fixes) -> Column:
    return F.coalesce(*[col(f) for f in fixes])
