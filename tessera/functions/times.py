"""Time helpers that do not depend on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    """Microseconds from 1970-01-01 00:00 of a TIMESTAMP_NTZ, as BIGINT."""
    seconds = F.unix_date(F.to_date(ts)).cast("bigint") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return seconds * 1000000 + (F.date_part(F.lit("SECOND"), ts) * 1000000).cast("bigint")


def ntz_from_micros(us: Column) -> Column:
    """The TIMESTAMP_NTZ of so many microseconds from 1970-01-01 00:00."""
    day = F.floor(us / F.lit(86400000000)).cast("int")
    rest = F.pmod(us, F.lit(86400000000))
    span = F.make_dt_interval(day, F.lit(0), F.lit(0), (rest.cast("decimal(20,6)") / F.lit(1000000).cast("decimal(8,0)")).cast("decimal(18,6)"))
    return F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + span
