"""Time expressions with fixed semantics, whatever the engine's defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.functions.geo import c

UNIT_US = {"second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000}


def epoch_us(ts) -> Column:
    return F.unix_micros(c(ts).cast("timestamp"))


def epoch_rounded(ts) -> Column:
    """Seconds since 1970 as int, rounded half to even."""
    return F.rint(epoch_us(ts) / 1e6).cast("int")


def boundaries_crossed(unit: str, a, b) -> Column:
    """How often the clock passes a boundary of the unit between a and b."""
    return F.floor(epoch_us(b) / UNIT_US[unit]) - F.floor(epoch_us(a) / UNIT_US[unit])


def lenient_timestamp(y, m, d, h, mi) -> Column:
    """A timestamp from parts that may be out of range: they carry over, as day 30 of February does into March."""
    y, m, d, h, mi = (c(x).cast("int") for x in (y, m, d, h, mi))
    first = F.add_months(F.make_date(y, F.lit(1), F.lit(1)), m - 1)
    seconds = (d - 1).cast("long") * 86400 + h.cast("long") * 3600 + mi.cast("long") * 60
    return F.timestamp_micros((F.unix_date(first).cast("long") * 86400 + seconds) * 1_000_000)


def strict_timestamp(y, m, d, h, mi) -> Column:
    """As `lenient_timestamp`, but null where a part is out of range, as in the codes for "not available"."""
    return F.try_make_timestamp(c(y).cast("int"), c(m).cast("int"), c(d).cast("int"), c(h).cast("int"), c(mi).cast("int"), F.lit(0).cast("decimal(8,6)"))


def feed_timestamp(text) -> Column:
    """The feed's text times, '2016-01-12 00:06:52.39 +0000 UTC' or ISO; null where unreadable."""
    plain = F.regexp_replace(F.regexp_replace(c(text), " UTC$", ""), r" \+0000$", "")
    return F.try_to_timestamp(plain)


def eta_with_year(ts, month, day, hour, minute) -> Column:
    """The next such date on or after the day of `ts`; lenient in its parts."""
    ts, month, day = c(ts), c(month), c(day)
    early = (month < F.month(ts)) | ((month == F.month(ts)) & (day < F.dayofmonth(ts)))
    return lenient_timestamp(F.year(ts) + F.when(early, 1).otherwise(0), month, day, hour, minute)


def sunday_zero(ts) -> Column:
    return F.dayofweek(c(ts)) - 1


def day_fraction(ts) -> Column:
    return F.pmod(epoch_us(ts), F.lit(UNIT_US["day"])) / UNIT_US["day"]


def partition_filter(first: str, last: str, year: str = "year", month: str = "month", day: str = "day") -> Column:
    """Partition predicate for the days from `first` to `last` (ISO dates), so that a time range also prunes folders."""
    from datetime import date, timedelta
    from functools import reduce

    a, b = date.fromisoformat(first[:10]), date.fromisoformat(last[:10])
    days = [a + timedelta(k) for k in range((b - a).days + 1)]
    return reduce(lambda x, y: x | y, [(F.col(year) == t.year) & (F.col(month) == t.month) & (F.col(day) == t.day) for t in days])
