"""Calendar, cyclical and timestamp expressions (time-zone independent on TIMESTAMP_NTZ)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rounding import round_half_even

# Rush hours and the month -> season map (Dec-Feb 0, Mar-May 1,
# Jun-Aug 2, Sep-Nov 3).
RUSH_HOURS = [7, 8, 9, 17, 18, 19]
SEASON_OF_MONTH = {12: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1, 6: 2, 7: 2, 8: 2, 9: 3, 10: 3, 11: 3}
TS_FORMAT = "yyyy-MM-dd HH:mm:ss"


def trunc_hour(ts: Column) -> Column:
    """Start of the hour, as TIMESTAMP_NTZ, without consulting the session zone."""
    return F.make_timestamp_ntz(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.lit(0), F.lit(0))


def round_hour(ts: Column) -> Column:
    """Nearest hour; exact half past goes to the even hour (pandas ``dt.round('h')``)."""
    base = trunc_hour(ts)
    into = F.minute(ts).cast("decimal(10,6)") * F.lit(60) + F.date_part(F.lit("SECOND"), ts)
    up = base + F.expr("INTERVAL 1 HOUR")
    tie_up = (F.hour(base) % 2) == 1
    return (F.when(into > F.lit(1800), up)
             .when(into < F.lit(1800), base)
             .when(tie_up, up).otherwise(base))


def calendar_parts(ts: Column) -> dict[str, Column]:
    hour = F.hour(ts)
    dow = F.weekday(ts)  # Monday = 0
    return {
        "hour": hour,
        "day": F.dayofmonth(ts),
        "month": F.month(ts),
        "dayofweek": dow,
        "is_weekend": (dow >= 5).cast("int"),
        "is_rush_hour": hour.isin(RUSH_HOURS).cast("int"),
    }


def is_weekend(dayofweek: Column) -> Column:
    return (dayofweek >= 5).cast("int")


def is_rush_hour(hour: Column) -> Column:
    return hour.isin(RUSH_HOURS).cast("int")


def cyclical(value: Column, period: int, digits: int | None = None) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * value.cast("double") / F.lit(float(period))
    s, c = F.sin(angle), F.cos(angle)
    if digits is not None:
        s, c = round_half_even(s, digits), round_half_even(c, digits)
    return s, c


def season(month: Column) -> Column:
    """Dec-Feb 0, Mar-May 1, Jun-Aug 2, Sep-Nov 3; same as the literal map."""
    return F.floor((month % 12) / 3).cast("int")


def parse_ts(text: Column, fmt: str = TS_FORMAT) -> Column:
    return F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz")


def format_ts(ts: Column, fmt: str = TS_FORMAT) -> Column:
    return F.date_format(ts, fmt)


def to_local(ts_utc: Column, zone: str) -> Column:
    """UTC wall clock (NTZ) -> local wall clock (NTZ) in ``zone``."""
    return F.from_utc_timestamp(ts_utc.cast("timestamp_ntz").cast("string"), zone).cast("timestamp_ntz")


def to_utc(ts_local: Column, zone: str) -> Column:
    """Local wall clock (NTZ) in ``zone`` -> UTC wall clock (NTZ)."""
    return F.to_utc_timestamp(ts_local.cast("timestamp_ntz").cast("string"), zone).cast("timestamp_ntz")
