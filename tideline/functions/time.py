"""Times as UTC whatever the session's zone is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000_000


def utc_day(ts: Column) -> Column:
    """The date in UTC of an instant."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_micros(ts) / DAY).cast("int"))


def utc_text(ts: Column) -> Column:
    """The instant in UTC as `yyyy-MM-dd HH:mm:ss`."""
    return F.translate(F.substring(iso(ts), 1, 19), "T", " ")


def iso(ts: Column) -> Column:
    """The instant in UTC as ISO text; a fraction has six digits, none is left out."""
    micros = F.unix_micros(ts)
    inside = F.floor(F.pmod(micros, F.lit(DAY)) / 1_000_000).cast("int")
    fraction = F.pmod(micros, F.lit(1_000_000))
    rest = F.when(fraction == 0, "").otherwise(F.format_string(".%06d", fraction))
    return F.when(ts.isNotNull(), F.format_string("%sT%02d:%02d:%02d%s+00:00", utc_day(ts).cast("string"), F.floor(inside / 3600).cast("int"), F.floor(inside / 60).cast("int") % 60, inside % 60, rest))
