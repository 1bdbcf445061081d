"""Calendar functions as column expressions: parsing, shifting, ISO weeks, Saturdays, ranges.

Strings in a known format go in and come out where the name says so; inside are dates. Formats are
Java patterns. Unparsable input gives null, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Recognised formats in order of preference. None stands for "Thu, 05 Mar 2020 10:11:12 +0000".
DATE_FORMATS = (
    "yyyy-MM-dd", "yyyy-MM", "yyyy-MM-dd-HH", "yyyy-MM-dd HH:mm:ss", None, "yyyy-MM-dd HH:mm", "yyyy-MM-dd HH", "yyyy-MM-dd-HH-mm",
    "yyyy-MM-dd'T'HH:mm:ss'Z'", "M/d/yy", "M/d/yyyy", "M-d-yy", "M-d-yyyy",
)
_MAIL = "dd MMM yyyy HH:mm:ss Z"


def parse(c: Column, fmt: str | None) -> Column:
    """Timestamp of a string in ``fmt`` or null; ``None`` is the mail-header format. Digits need no padding."""
    if fmt is None:
        return F.when(c.rlike(r"^[A-Za-z]{3}, "), F.try_to_timestamp(F.substring(c, 6, 100), F.lit(_MAIL)))
    loose = fmt
    for two, one in (("MM", "M"), ("dd", "d"), ("HH", "H")):
        if ("-" in fmt or "/" in fmt) and two + two[0] not in loose:  # separated, and not a month's name
            loose = loose.replace(two, one)
    return F.try_to_timestamp(c, F.lit(loose))


def check_date_format(c: Column, fmt: str | None) -> Column:
    """Whether a string is a date in ``fmt``."""
    return parse(c, fmt).isNotNull()


def is_epoch(c: Column) -> Column:
    """Whether a number can be an epoch: not negative."""
    return F.coalesce(c >= 0, F.lit(False))


def get_date_format(c: Column, formats=DATE_FORMATS) -> Column:
    """The first format that fits, or null ('EEE, ...' for the mail-header format)."""
    out = F.lit(None).cast("string")
    for f in reversed(formats):
        out = F.when(check_date_format(c, f), F.lit(f or "EEE, " + _MAIL)).otherwise(out)
    return out


def change_format(c: Column, in_fmt: str, out_fmt: str = "yyyy-MM") -> Column:
    return F.date_format(parse(c, in_fmt), out_fmt)


def to_epoch(c: Column, fmt: str = "yyyy-MM-dd", tz: str = "America/Los_Angeles") -> Column:
    """Epoch seconds of a local wall-clock string; of a repeated hour the earlier instant."""
    return F.unix_timestamp(F.to_utc_timestamp(parse(c, fmt), tz))


def from_epoch(c: Column, fmt: str = "yyyy-MM-dd", tz: str = "America/Los_Angeles") -> Column:
    """Local string of epoch seconds, with the offset in force at that instant."""
    return F.date_format(F.from_utc_timestamp(F.timestamp_seconds(c), tz), fmt)


def utc_shift_hours(ts: Column, tz: str) -> Column:
    """UTC offset of a zone at a UTC time, in hours."""
    return (F.unix_timestamp(F.from_utc_timestamp(ts, tz)) - F.unix_timestamp(ts)) / 3600.0


def days_back(n: int, fmt: str = "yyyy-MM-dd", tz: str = "UTC") -> Column:
    """The date n days before now, as a string in a zone."""
    return F.date_format(F.from_utc_timestamp(F.current_timestamp(), tz) - F.expr(f"interval {int(n)} days"), fmt)


def now_epoch() -> Column:
    return F.unix_timestamp(F.current_timestamp())


def days_diff(d1: Column, d2: Column) -> Column:
    """Whole days from d1 to d2 (floor); 0 for equal times."""
    return F.floor((F.unix_timestamp(d2.cast("timestamp")) - F.unix_timestamp(d1.cast("timestamp"))) / 86400).cast("int")


def months_diff(d1: Column, d2: Column) -> Column:
    """Whole months from d1 to d2, for d2 not before d1."""
    return F.floor(F.months_between(d2, d1) + 1e-9).cast("int")


def date_part(d: Column, what: str) -> Column:
    """year, month, day, hour, minute, second or weekday (Monday 0)."""
    f = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second, "weekday": F.weekday}
    return f[what](d)


def year_day(d: Column) -> Column:
    return F.dayofyear(d)


def iso_week(d: Column) -> Column:
    """ISO week, 1 to 53."""
    return F.weekofyear(d)


def iso_year_week(d: Column) -> Column:
    """'YYYY-WW' of the ISO year and week."""
    return F.format_string("%d-%02d", F.extract(F.lit("YEAROFWEEK"), d).cast("int"), F.weekofyear(d))


def iso_weeks_in_year(y: Column) -> Column:
    """52 or 53."""
    return F.weekofyear(F.make_date(y, F.lit(12), F.lit(28)))


def iso_year_bounds(y: Column) -> Column:
    """Struct of the Sundays before the Mondays of the first and the last ISO week."""
    sunday = lambda m, d: F.date_sub(F.trunc(F.make_date(y, F.lit(m), F.lit(d)), "week"), 1)
    return F.struct(sunday(1, 4).alias("first"), sunday(12, 28).alias("last"))


def add_days(c: Column, n: int | Column, fmt: str = "yyyy-MM-dd") -> Column:
    """String in, string out."""
    return F.date_format(F.date_add(parse(c, fmt).cast("date"), n), fmt)


def add_months(c: Column, n: int | Column, fmt: str = "yyyy-MM-dd") -> Column:
    """String in, string out; clamped to the month's end."""
    return F.date_format(F.add_months(parse(c, fmt).cast("date"), n), fmt)


def date_range(start: Column, end: Column, fmt: str = "yyyy-MM-dd", step: int = 1, out_fmt: str | None = None) -> Column:
    """Array of the dates from start up to before end: by days if the format has days, else by months."""
    unit = "day" if "d" in fmt else "month"
    s, e = parse(start, fmt).cast("date"), parse(end, fmt).cast("date")
    full = F.when(s < e, F.sequence(s, e, F.expr(f"interval {int(step)} {unit}")))
    kept = F.filter(F.coalesce(full, F.array().cast("array<date>")), lambda d: d < e)
    return F.transform(kept, lambda d: F.date_format(d, out_fmt or fmt))


_DAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def next_weekday(d: Column, weekday: int) -> Column:
    """The next such weekday (Monday 0) strictly after d."""
    return F.next_day(d, _DAYS[weekday])


def latest_saturday(d: Column) -> Column:
    """The latest Saturday not after d."""
    return F.next_day(F.date_sub(d, 7), "Sat")


def month_last_saturday(d: Column) -> Column:
    """The last Saturday of d's month."""
    return F.next_day(F.date_sub(F.last_day(d), 7), "Sat")


def last_saturday_of(year: Column, month: Column) -> Column:
    return month_last_saturday(F.make_date(year, month, F.lit(1)))


def past_month_saturday(d: Column) -> Column:
    """The month's last Saturday if not after d, else the last Saturday of the month before."""
    own = month_last_saturday(d)
    return F.when(own <= d.cast("date"), own).otherwise(month_last_saturday(F.add_months(d, -1)))
