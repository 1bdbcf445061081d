"""Window and calendar-frame operators: trips, year alignment, date windows, week starts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.operators.intervals import periods_and_gaps


def user_trips(df: DataFrame, guest: str = "id_guest", checkin: str = "ds_checkin", checkout: str = "ds_checkout", book: str = "ds_book", market: str = "dim_market", max_days: int = 3) -> DataFrame:
    """Stays chained into trips: a stay joins when it begins at most ``max_days`` whole days after the trip's last check-out.

    Rows ``guest, first_home_ds_checkin, first_ds_book, dim_markets`` (sorted, distinct). Stays need a
    guest and both times. A stay with whole-day distance d joins while floor(d) <= max_days. Markets
    of a trip are collected as a set.
    """
    stays = df.where(F.col(guest).isNotNull() & F.col(checkin).isNotNull() & F.col(checkout).isNotNull())
    w = Window.partitionBy(guest).orderBy(checkin, checkout, book)
    reach = F.max(F.unix_timestamp(F.col(checkout).cast("timestamp"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    days = F.floor((F.unix_timestamp(F.col(checkin).cast("timestamp")) - reach) / 86400)
    starts = F.when(days.isNull() | (days > max_days), 1).otherwise(0)
    marked = stays.withColumn("_new", starts).withColumn("_trip", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = marked.groupBy(guest, "_trip").agg(F.min(checkin).alias("first_home_ds_checkin"), F.min(book).alias("first_ds_book"), F.sort_array(F.collect_set(market)).alias("dim_markets"))
    return out.select(F.col(guest).alias("guest"), "first_home_ds_checkin", "first_ds_book", "dim_markets")


def covered_periods(df: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """Continuous periods and gaps (see ``intervals``)."""
    return periods_and_gaps(df, entity, start, end)


def plot_by_year(df: DataFrame, cols: Sequence[str], tcol: str, years: Sequence[int] | None = None, base_year: int | None = None, time_scale: str = "W") -> DataFrame:
    """Years side by side by ISO week ('W') or ISO weekday: ``iso_nbr, <tcol> of the base year, <year>_<col>...``.

    Years not given are those of the data, and the base year its first calendar year. The pivot is one
    aggregate. Dates must be unique (ValueError else). Several dates of a year with one ISO number give
    their mean.
    """
    if df.groupBy(tcol).count().where("count > 1").limit(1).count():
        raise ValueError("dates repeat")
    d = F.col(tcol).cast("date")
    iso = F.weekofyear(d) if time_scale == "W" else F.weekday(d) + 1
    year = F.extract(F.lit("YEAROFWEEK"), d).cast("int") if time_scale == "W" else F.year(d)
    if years is None:
        # the first day of a calendar year may be of the ISO year before, which then has one week only
        found = df.where(d.isNotNull()).select(year.alias("y"), F.year(d).alias("c")).distinct().collect()
        years, first = sorted({r["y"] for r in found}), min((r["c"] for r in found), default=None)
        base_year = base_year if base_year is not None else first if first in years else min(years, default=None)
    base = base_year if base_year is not None else min(years, default=None)
    rows = df.select(iso.alias("iso_nbr"), year.alias("_y"), d.alias("_d"), *cols)
    aggs = [F.min(F.when(F.col("_y") == base, F.col("_d"))).alias(tcol)]
    aggs += [F.avg(F.when(F.col("_y") == y, F.col(c))).alias(f"{y}_{c}") for y in years for c in cols]
    return rows.groupBy("iso_nbr").agg(*aggs).where(F.col(tcol).isNotNull())


def set_date_range(spark: SparkSession, init: str, final: str, freq: str = "W", w_start: str = "MON") -> DataFrame:
    """Consecutive windows ``start, end`` of dates from init to final: by day, week (from ``w_start``) or month.

    Partial first and last windows are added, so every day of the range is in one window.
    """
    a, z = F.to_date(F.lit(init)), F.to_date(F.lit(final))
    if freq == "W":
        first, step = F.when(F.date_format(a, "E") == w_start.capitalize(), a).otherwise(F.next_day(a, w_start)), "7 days"
    elif freq == "M":
        first, step = F.when(F.dayofmonth(a) == 1, a).otherwise(F.add_months(F.trunc(a, "month"), 1)), "1 month"
    else:
        first, step = a, "1 day"
    ticks = F.when(first <= z, F.sequence(first, z, F.expr(f"interval {step}"))).otherwise(F.array().cast("array<date>"))
    starts = F.array_sort(F.array_distinct(F.concat(F.array(a), ticks)))
    one = spark.range(1).select(starts.alias("s"))
    return one.select(F.posexplode("s").alias("i", "start"), "s").select("start", F.coalesce(F.date_sub(F.get("s", F.col("i") + 1), 1), z).alias("end")).where("start <= end")


def set_week_start(df: DataFrame, tcol: str = "ds") -> DataFrame:
    """``df`` with ``ds_week_starting``.

    Taken from a column of that name, from ``ds_week_ending`` less 6 days, or, for weekly data whose
    first date is a Saturday, ``tcol`` less 6 days (``tcol`` is shifted as well). Daily data come back
    unchanged. Otherwise the frequency is the most frequent gap between distinct dates, which must
    make up 90 % of them, else ValueError.
    """
    if "ds_week_starting" in df.columns:
        return df.withColumn("ds_week_starting", F.col("ds_week_starting").cast("date"))
    if "ds_week_ending" in df.columns:
        return df.withColumn("ds_week_starting", F.date_sub(F.col("ds_week_ending").cast("date"), 6))
    days = df.select(F.col(tcol).cast("date").alias("d")).where("d is not null").distinct()
    # distinct dates of a calendar are few: one ordered window over them
    gaps = days.select("d", F.datediff(F.lead("d").over(Window.orderBy("d")), "d").alias("gap"))
    counts = gaps.where("gap is not null").groupBy("gap").agg(F.count(F.lit(1)).alias("n"))
    stat = counts.agg(F.max(F.struct("n", (-F.col("gap")).alias("less"))).alias("top"), F.sum("n").alias("total")).first()
    if not stat["total"] or stat["top"]["n"] < 0.9 * stat["total"]:
        raise ValueError("no clear frequency of dates")
    gap = -stat["top"]["less"]
    if gap == 1:
        return df
    if gap != 7:
        raise ValueError(f"dates are {gap} days apart, neither daily nor weekly")
    first = days.agg(F.min("d").alias("d")).select(F.weekday("d")).first()[0]
    if first != 5:
        return df.withColumn("ds_week_starting", F.col(tcol).cast("date"))
    shifted = F.date_sub(F.col(tcol).cast("date"), 6)
    return df.withColumn(tcol, shifted) if tcol == "ds_week_starting" else df.withColumns({"ds_week_starting": shifted, tcol: shifted})
