"""Queries of readers and writers, calendar functions, error variants, transforms, fits and generators, and their SQL.

What no SQL can compute (fits, draws, iterations) comes out as what must hold of it: bounds, tolerances
and optimality, which the SQL states as true for every row it expects.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions import dates, metrics, transforms
from quillstone.functions.special import norm_cdf
from quillstone.operators import aggregate, bins, clean, generate, impute, outliers, parallel, smooth, windows
from quillstone.session import ensure_checkpoint_dir, table
from quillstone.sources import files, status
from quillstone.stats import density, families, mixtures, qfits

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _r(c, name: str, digits: int = 6):
    return F.round(c, digits).alias(name)


# --- readers and writers -------------------------------------------------------------------------


@query("select n_nationkey::varchar as n_nationkey, case when n_name like 'A%' then 'nan' else n_name end as n_name, n_regionkey::double as n_regionkey, n_nationkey % 2 = 1 as odd, strftime(date '2020-01-01' + n_nationkey::int, '%Y-%m-%d') as day from nation")
def csv_in_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV file read as strings and brought into roles."""
    df = table(spark, sf_dir, "nation")
    path = _scratch(spark, "roles") + ".csv"
    raw = df.select("n_nationkey", F.when(~F.col("n_name").startswith("A"), F.col("n_name")).alias("n_name"), "n_regionkey", F.when(F.col("n_nationkey") % 2 == 1, "True").otherwise("0.0").alias("odd"), F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), F.col("n_nationkey").cast("int")), "dd/MM/yyyy").alias("day"))
    raw.write.csv(path, header=True)
    out = files.get_data(spark, path, usecols=["day", "odd", "n_name", "n_regionkey", "n_nationkey"], date_format="dd/MM/yyyy", date_cols=["day"], str_cols=["n_nationkey"], num_cols=["n_regionkey"], b_cols=["odd"], cat_cols=["n_name"])
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


_ORDER_TEXT = "o_orderkey::varchar as o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') as d"


@query(f"select 'par' as kind, {_ORDER_TEXT} from orders union all select 'csv', {_ORDER_TEXT} from orders")
def saved_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames written and read again without naming the format: Parquet, and gzip CSV where Parquet can't hold a column."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    par, csv = _scratch(spark, "frame"), _scratch(spark, "frame")
    files.save_df(df, par + ".csv")
    files.save_df(df.withColumn("gap", F.make_ym_interval(F.lit(1))), csv)
    text = lambda d, kind: d.select(F.lit(kind).alias("kind"), *[F.col(c).cast("string").alias(c) for c in ("o_orderkey", "o_orderstatus", "d")])
    kinds = [files.read_df(spark, p) for p in (par, csv)]
    assert files.read_df(spark, _scratch(spark, "none")) is None
    return text(kinds[0], "par").unionByName(text(kinds[1], "csv"))


@query("select o_custkey, string_agg(o_orderstatus, '|' order by o_orderkey) as stats, count(*) as n, 'F' as first_kind from orders group by 1")
def json_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists and maps as JSON text in Parquet, parsed by a schema or as variants."""
    df = aggregate.list_gb(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus", ["o_orderkey"])
    df = df.withColumn("m", F.create_map(F.lit("n"), F.size("o_orderstatus"))).withColumn("k", F.lit("F"))
    path = _scratch(spark, "cells") + ".gz.par"
    files.to_parquet(df, path, str_cols=["o_orderstatus", "m", "k"])
    out = files.from_parquet(spark, path, {"o_orderstatus": "array<string>", "m": None, "k": None, "absent": None})
    return out.select("o_custkey", F.array_join("o_orderstatus", "|").alias("stats"), F.variant_get("m", "$.n", "bigint").alias("n"), F.variant_get("k", "$", "string").alias("first_kind"))


@query("select event_id, user_id, round(value, 6) as value, json_extract_string(props, '$.k') as k, event_id % 3 = 0 as blank from events")
def json_lines_gz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines, gzip, with nested values and nulls."""
    df = table(spark, sf_dir, "events").select("event_id", "user_id", "value", F.from_json("props", "k string").alias("p"), F.when(F.col("event_id") % 3 != 0, "x").alias("x"))
    path = _scratch(spark, "lines") + ".gz"
    files.write_json_lines(df, path)
    out = files.read_json_lines(spark, path, "event_id long, user_id long, value double, p struct<k: string>, x string")
    return out.select("event_id", "user_id", _r("value", "value"), "p.k", F.col("x").isNull().alias("blank"))


@query("select r_regionkey::varchar as id, r_name as name, (select count(*) from region where r_regionkey % 2 = 0) as dropped from region where r_regionkey % 2 = 1")
def delimited_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines cut by a header with a table prefix; the header's repeats are no rows, lines of other lengths are counted."""
    df = table(spark, sf_dir, "region")
    line = F.concat_ws("\t", F.col("r_regionkey").cast("string"), "r_name", F.when(F.col("r_regionkey") % 2 == 0, "more"))
    lines = df.select(line.alias("value")).unionByName(df.select(F.lit("t.id\tt.name").alias("value")))
    good, dropped = files.to_df(lines, "t.id\tt.name")
    return good.crossJoin(F.broadcast(dropped))  # one row


@query("select c_custkey as id, 'data' || c_custkey || case c_custkey % 4 when 0 then '.v1' else '' end as base, case c_custkey % 4 when 0 then 'par' when 1 then 'csv' when 2 then 'tsv' else '' end as kind from customer")
def path_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suffixes of paths, told and stripped."""
    ends = [".v1.parquet", ".csv.gz", ".tsv", ""]

    def run(batches):
        for pdf in batches:
            p = ["data" + str(i) + ends[i % 4] for i in pdf["id"]]
            yield pd.DataFrame({"id": pdf["id"], "base": [files.strip_suffix(x) for x in p], "kind": [files.suffix(x) for x in p]})

    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).mapInPandas(run, "id long, base string, kind string")


@query("select * from (values ('load', 'failure', 'no input'), ('sum', 'success', null), ('wait', 'started', null)) t(task, status, message)")
def task_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest state of each run from appended rows; a message is data, whatever it holds."""
    path = _scratch(spark, "status")
    for task, code, message in (("load", 1, "no input"), ("sum", 0, None), ("wait", None, None)):
        t = status.TaskTracker(spark, path, task, "2020-01-01")
        t.set_started()
        try:
            if code is not None:
                t.finish(code, message)
        except RuntimeError:
            pass
    return status.latest_status(spark, path).select("task", "status", "message")


@query("select count(*) as n_rows, count(distinct user_id) as agents, count(distinct case when event_type = 'view' then 'NULL' else event_type end) as tickets, round(sum(value), 4) as secs, round(avg((event_type = 'view')::int), 8) as null_rows, round(sum(case when event_type = 'view' then value else 0 end) / sum(value), 8) as null_secs from events")
def sessions_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and shares of sessions without a ticket, from headerless CSV."""
    path = _scratch(spark, "sessions")
    ev = table(spark, sf_dir, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("t"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("ticket"), "value", F.lit("d").alias("ds"))
    ev.write.option("compression", "gzip").csv(path)
    s = files.session_summary(files.read_sessions(spark, path))
    return s.select("n_rows", "agents", "tickets", _r("secs", "secs", 4), _r("null_rows", "null_rows", 8), _r("null_secs", "null_secs", 8))


@query(
    """
with r as (select l_quantity as x, l_discount as y, l_extendedprice as z from lineitem), e as (select min(x) x0, max(x) x1, min(y) y0, max(y) y1 from r),
c as (select least(9, floor((x - x0) / (x1 - x0) * 10))::int as xb, least(4, floor((y - y0) / (y1 - y0) * 5))::int as yb, count(*) as n, avg(z) as z from r, e group by 1, 2)
select xb, yb, n, round(z, 4) as z, round((z - min(z) over ()) / (max(z) over () - min(z) over ()), 6) as shade from c
"""
)
def shaded_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregate.scatter_cells(table(spark, sf_dir, "lineitem"), "l_quantity", "l_discount", "l_extendedprice", 10, 5)
    return out.select("xb", "yb", "n", _r("z", "z", 4), _r("shade", "shade"))


@query("select min(o_totalprice) - 0.05 * abs(min(o_totalprice)) as lo, max(o_totalprice) + 0.05 * abs(max(o_totalprice)) as hi from orders")
def axis_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.plot_limits(table(spark, sf_dir, "orders"), "o_totalprice")


# --- columns and bins ----------------------------------------------------------------------------


@query("select ps, round(b - a, 4) as diff from (select p_partkey as ps, p_size::double as a, p_retailprice as b from part where p_brand in (select distinct p_brand from part order by 1 limit 3))")
def difference_of_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column difference after a list filter and renames."""
    df = table(spark, sf_dir, "part")
    brands = [r[0] for r in df.select("p_brand").distinct().orderBy("p_brand").limit(3).collect()]
    kept = clean.keep_in(df, "p_brand", brands).select(F.col("p_partkey").alias("ps"), F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"))
    out = clean.column_diff(kept, ["a", "b"])
    return out.select("ps", _r("b_diff", "diff", 4))


_SZ = "select *, case when p_retailprice > lo then least(4, greatest(0, ceil((p_retailprice - lo) / ((hi - lo) / 5)) - 1)) else 0 end::int as bin from part, (select min(p_retailprice) as lo, max(p_retailprice) as hi from part)"


@query(f"select bin, round(count(*) / (select count(*) from part), 8) as bin_prob, round(avg(p_retailprice), 4) as price, round(avg(p_size), 6) as size, round(avg((p_brand = (select min(p_brand) from part))::int), 8) as b1 from ({_SZ}) group by 1")
def sz_bins_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal-width bins with means and shares."""
    df = table(spark, sf_dir, "part").select("p_retailprice", "p_size", "p_brand")
    out = bins.get_sz_bins(df, "p_retailprice", 5, "avg")
    first = min(c for c in out.columns if c.startswith("p_brand::"))
    return out.select("bin", _r("bin_prob", "bin_prob", 8), _r("p_retailprice", "price", 4), _r("p_size", "size"), _r(f"`{first}`", "b1", 8))


@query(f"with b as (select bin, avg((p_brand = v)::int) as s, v from ({_SZ}), (select distinct p_brand as v from part) group by bin, v), k as (select v from b group by v having max(s) > 0.05) select b.bin, round(1 - sum(s) filter (v in (select v from k)), 6) as other from b where (select count(*) from k) > 0 group by b.bin")
def sz_bins_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories that never exceed a share are put together."""
    df = table(spark, sf_dir, "part").select("p_retailprice", "p_brand")
    out = bins.get_sz_bins(df, "p_retailprice", 5, "avg", thres=0.05)
    if "p_brand::other" not in out.columns:
        out = out.withColumn("p_brand::other", F.lit(None).cast("double")).where("false")
    return out.select("bin", _r("`p_brand::other`", "other"))


@query("select l_quantity::double as pt, round(count(*) / (select count(*) from lineitem) + case when l_quantity = 7 then 0.25 else 0 end, 8) as mass from lineitem group by 1, l_quantity having count(*) > 0.001 * (select count(*) from lineitem) union all select 1000.5, 0.5")
def masses_put_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mass added at a known point, within the tolerance, and at a new one."""
    found = {r["value"]: r["mass"] for r in aggregate.point_masses(table(spark, sf_dir, "lineitem"), "l_quantity", 0.001).collect()}  # at most 1,000
    found = aggregate.update_mass(aggregate.update_mass(found, 7.00005, 0.25), 1000.5, 0.5)
    return spark.createDataFrame([(float(k), round(v, 8)) for k, v in found.items()], "pt double, mass double")


@query("with d as (select cast(o_orderdate as date) as d, sum(o_totalprice) as y from orders group by 1), r as (select isodow(d)::int as iso_nbr, year(d) as y0, d, y from d) select iso_nbr, strftime(min(case when y0 = 1996 then d end), '%Y-%m-%d') as d, round(avg(case when y0 = 1996 then y end), 2) as y1996, round(avg(case when y0 = 1997 then y end), 2) as y1997 from r group by 1")
def weekdays_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years side by side by weekday."""
    daily = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("d")).agg(F.sum("o_totalprice").alias("y"))
    out = windows.plot_by_year(daily, ["y"], "d", [1996, 1997], time_scale="D")
    return out.select("iso_nbr", F.date_format("d", "yyyy-MM-dd").alias("d"), _r("1996_y", "y1996", 2), _r("1997_y", "y1997", 2))


@query("select 'D' as freq, strftime(d, '%Y-%m-%d') as win_start, strftime(d, '%Y-%m-%d') as win_end from (select range::date as d from range(date '2020-01-08', date '2020-04-20', interval 1 day)) union all select 'M', strftime(greatest(m, date '2020-01-08'), '%Y-%m-%d'), strftime(least((m + interval 1 month)::date - 1, date '2020-04-19'), '%Y-%m-%d') from (select range::date as m from range(date '2020-01-01', date '2020-05-01', interval 1 month))")
def days_and_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows by day and by month with partial ends."""
    one = lambda f: windows.set_date_range(spark, "2020-01-08", "2020-04-19", f).select(F.lit(f).alias("freq"), F.date_format("start", "yyyy-MM-dd").alias("win_start"), F.date_format("end", "yyyy-MM-dd").alias("win_end"))
    return one("D").unionByName(one("M"))


# --- dates ---------------------------------------------------------------------------------------

_STAMPS = "select row_number() over (order by d) as i, d from (select distinct o_orderdate as d from orders)"


@query(
    f"""
with s as ({_STAMPS}), t as (select i, case i % 6 when 0 then strftime(d, '%Y-%m-%d') when 1 then strftime(d, '%Y-%m') when 2 then strftime(d, '%Y-%m-%d %H:%M:%S') when 3 then month(d) || '/' || day(d) || '/' || year(d) when 4 then strftime(d, '%Y-%m-%dT%H:%M:%SZ') else 'no date' end as x from s)
select x, case i % 6 when 0 then 'yyyy-MM-dd' when 1 then 'yyyy-MM' when 2 then 'yyyy-MM-dd HH:mm:ss' when 3 then 'M/d/yyyy' when 4 then 'yyyy-MM-dd''T''HH:mm:ss''Z''' end as fmt, i % 6 = 0 as is_day from t
"""
)
def date_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats recognised in the stated order."""
    d = table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("d")).distinct()
    df = d.withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("d")))  # one row per date of a calendar
    k, f = F.col("i") % 6, lambda p: F.date_format("d", p)
    x = F.when(k == 0, f("yyyy-MM-dd")).when(k == 1, f("yyyy-MM")).when(k == 2, f("yyyy-MM-dd HH:mm:ss")).when(k == 3, f("M/d/yyyy")).when(k == 4, f("yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("no date")
    return df.select(x.alias("x")).select("x", dates.get_date_format(F.col("x")).alias("fmt"), F.coalesce(dates.check_date_format(F.col("x"), "yyyy-MM-dd"), F.lit(False)).alias("is_day"))


@query(
    """
with s as (select distinct epoch(o_orderdate)::bigint + 18000 as ep from orders), t as (select ep, timezone('America/Los_Angeles', to_timestamp(ep)) as la from s)
select ep, strftime(la, '%Y-%m-%d') as la, round((epoch(la) - ep) / 3600.0, 2) as shift, true as is_epoch, true as back from t
"""
)
def epochs_and_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local dates of epochs, the zone's offset, and epochs of dates."""
    df = table(spark, sf_dir, "orders").select((F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + 18000).alias("ep")).distinct()
    ep, zone = F.col("ep"), "America/Los_Angeles"
    local = dates.from_epoch(ep, "yyyy-MM-dd HH:mm:ss", zone)
    back = dates.to_epoch(local, "yyyy-MM-dd HH:mm:ss", zone) == ep
    return df.select("ep", dates.from_epoch(ep, tz=zone).alias("la"), F.round(dates.utc_shift_hours(F.timestamp_seconds(ep), zone), 2).alias("shift"), dates.is_epoch(ep).alias("is_epoch"), back.alias("back"))


@query("select n_nationkey as k, strftime(current_date - n_nationkey::int, '%Y-%m-%d') as d, true as near from nation")
def days_before_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates before today and the epoch of now."""
    near = F.abs(dates.now_epoch() - F.unix_timestamp(F.current_timestamp())) <= 1
    parts = [table(spark, sf_dir, "nation").where(F.col("n_nationkey") == k).select(F.col("n_nationkey").alias("k"), dates.days_back(k).alias("d"), near.alias("near")) for k in range(25)]
    return aggregate.stack(*parts)


@query(
    """
with s as (select c_custkey as k, date '2019-11-28' + (c_custkey % 97)::int as a, c_custkey % 14 as n from customer),
d as (select k, strftime(unnest(range(a::timestamp, a + (n * 2)::int, interval 2 day)), '%Y-%m-%d') as x from s), m as (select k, strftime(unnest(range(date_trunc('month', a)::timestamp, date_trunc('month', a) + to_months(n::int), interval 1 month)), '%Y-%m') as x from s)
select k, 'd' as kind, x from d union all select k, 'm', x from m
"""
)
def ranges_of_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates up to before an end, by days and by months."""
    a, n = F.date_add(F.lit("2019-11-28").cast("date"), (F.col("c_custkey") % 97).cast("int")), (F.col("c_custkey") % 14).cast("int")
    df = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.date_format(a, "yyyy-MM-dd").alias("a"), F.date_format(F.date_add(a, n * 2), "yyyy-MM-dd").alias("z"), F.date_format(a, "yyyy-MM").alias("am"), F.date_format(F.add_months(F.trunc(a, "month"), n), "yyyy-MM").alias("zm"))
    days = df.select("k", F.lit("d").alias("kind"), F.explode(dates.date_range(F.col("a"), F.col("z"), step=2)).alias("x"))
    return days.unionByName(df.select("k", F.lit("m").alias("kind"), F.explode(dates.date_range(F.col("am"), F.col("zm"), "yyyy-MM")).alias("x")))


@query("select distinct strftime(o_orderdate, '%Y-%m-%d') as d, year(o_orderdate)::int as y, month(o_orderdate)::int as m, day(o_orderdate)::int as dd, (isodow(o_orderdate) - 1)::int as wd, strftime(cast(o_orderdate as date), '%m/%d/%Y') as us from orders")
def parts_of_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("d")).distinct()
    t = dates.parse(F.col("d"), "yyyy-MM-dd")
    return df.select("d", *[dates.date_part(t, w).alias(n) for w, n in (("year", "y"), ("month", "m"), ("day", "dd"), ("weekday", "wd"))], dates.change_format(F.col("d"), "yyyy-MM-dd", "MM/dd/yyyy").alias("us"))


# --- errors and residual tests -------------------------------------------------------------------

_PAIRS = "with p as (select series_id, obs_id, y, yhat from (select distinct obs_id, series_id, y, yhat from pandas_utils) where isfinite(y) and isfinite(yhat) and y is not null and yhat is not null)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pandas_utils").select("obs_id", "series_id", "y", "yhat").distinct()
    return rows.where("abs(y) < double('infinity') and abs(yhat) < double('infinity') and not isnan(y) and not isnan(yhat)")


@query(
    f"""
{_PAIRS}, g as (select *, max(abs(y)) over (partition by series_id) as top from p),
yj as (select *, case when y >= 0 then (pow(y + 1, 0.5) - 1) / 0.5 else -(pow(1 - y, 1.5) - 1) / 1.5 end as ty, case when yhat >= 0 then (pow(yhat + 1, 0.5) - 1) / 0.5 else -(pow(1 - yhat, 1.5) - 1) / 1.5 end as th,
  case when yhat - y >= 0 then (pow(yhat - y + 1, 0.5) - 1) / 0.5 else -(pow(1 - yhat + y, 1.5) - 1) / 1.5 end as te, case when y > 0 then (sqrt(y) - 1) / 0.5 end as by_, case when yhat > 0 then (sqrt(yhat) - 1) / 0.5 end as bh from g where top > 0)
select series_id, round(2 * avg(case when y * yhat <> 0 and y + yhat <> 0 then abs(y - yhat) / abs(y + yhat) end), 6) as smape, round(avg(te), 2) as yjd,
  round(avg(case when ty <> 0 then abs(ty - th) / abs(ty) end), 5) as yj, round(avg(case when by_ <> 0 then abs(by_ - bh) / abs(by_) end), 5) as bc, round(sum(abs(yhat - y)) / sum(abs(y)), 6) as wmape
from yj group by 1
"""
)
def error_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by name per series."""
    df = _pairs(spark, sf_dir)
    parts = [metrics.err_func(df, "y", "yhat", t, ["series_id"]).withColumnRenamed("error", n) for t, n in (("sMAPE", "smape"), ("YJd", "yjd"), ("YJ", "yj"), ("BC", "bc"), ("wMAPE", "wmape"))]
    out = aggregate.multi_merge(parts, ["series_id"]).where("wmape is not null")
    return out.select("series_id", _r("smape", "smape"), _r("yjd", "yjd", 2), _r("yj", "yj", 5), _r("bc", "bc", 5), _r("wmape", "wmape"))


@query(
    """
with d as (select cast(o_orderdate as date) as ds, sum(o_totalprice) as y from orders group by 1), f as (select ds, y, lag(y, 7) over (order by ds) as h from d), k as (select * from f where h is not null), l as (select *, lead(y, 7) over (order by ds) as yn, lead(h, 7) over (order by ds) as hn from k)
select round(avg(abs(h - y)) / avg(abs(yn - y)), 6) as mase, round(sqrt(avg(((hn - yn) / y) * ((hn - yn) / y)) / avg(((yn - y) / y) * ((yn - y) / y))), 6) as thiel_u, (select round(avg(abs(h - y)) / avg(abs(y1 - y)), 6) from (select *, lead(y) over (order by ds) as y1 from k)) as named from l
"""
)
def shifted_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors against a week ahead."""
    d = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("ds")).agg(F.sum("o_totalprice").alias("y"))
    d = d.withColumn("one", F.lit(0)).withColumn("h", F.lag("y", 7).over(Window.partitionBy("one").orderBy("ds"))).where("h is not null")  # a calendar of days
    led = metrics.with_leads(d, ["one"], "ds", "y", "h", 7)
    out = led.agg(_r(metrics.mase("y", "h", 7), "mase"), _r(metrics.thiel_u("y", "h", 7), "thiel_u"))
    return out.crossJoin(F.broadcast(metrics.err_func(d, "y", "h", "MASE", ["one"], "ds").select(_r("error", "named"))))  # one row


@query(
    """
with m as (select event_type, count(value)::double as n, avg(value) as m from events group by 1),
c as (select event_type, n, avg(pow(value - m, 2)) as m2, avg(pow(value - m, 3)) as m3, avg(pow(value - m, 4)) as m4 from events join m using (event_type) group by 1, 2),
s as (select event_type, n, m3 / pow(m2, 1.5) as g1, m4 / (m2 * m2) as b2 from c),
a as (select *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) as y, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) as bb, 3 * (n - 1) / (n + 1) as e, 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)) as v,
  6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) as sb from s),
b as (select *, sqrt(2 * (bb - 1)) - 1 as w2, 6 + 8 / sb * (2 / sb + sqrt(1 + 4 / (sb * sb))) as aa, (b2 - e) / sqrt(v) as x from a),
k as (select event_type, n, pow((1 / sqrt(0.5 * ln(w2))) * asinh(y / sqrt(2 / (w2 - 1))), 2) + pow((1 - 2 / (9 * aa) - sign((1 - 2 / aa) / (1 + x * sqrt(2 / (aa - 4)))) * pow(abs((1 - 2 / aa) / (1 + x * sqrt(2 / (aa - 4)))), 1.0 / 3)) / sqrt(2 / (9 * aa)), 2) as k2 from b),
r as (select event_type, event_id, value - m as d from events join m using (event_type)),
l as (select event_type, count(*)::double as n, sum(d * d) as v, """
    + ", ".join(f"sum(d * p{k}) as c{k}" for k in range(1, 11))
    + " from (select *, "
    + ", ".join(f"lag(d, {k}) over (partition by event_type order by event_id) as p{k}" for k in range(1, 11))
    + " from r) group by 1) select event_type, k.n::bigint as n, round(k2, 4) as k2, round(exp(-k2 / 2), 6) as p_k2, round(l.n * (l.n + 2) * ("
    + " + ".join(f"pow(c{k} / v, 2) / (l.n - {k})" for k in range(1, 11))
    + "), 4) as lb from k join l using (event_type)"
)
def white_noise_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K² with its p-value and Ljung-Box over ten lags, as in the test of residuals."""
    df = table(spark, sf_dir, "events").select("event_type", "event_id", "value")
    out = metrics.white_noise_test(df, ["event_type"], "event_id", "value")
    return out.select("event_type", "n", _r("k2", "k2", 4), _r("p_k2", "p_k2"), _r("lb", "lb", 4))


# --- transforms ----------------------------------------------------------------------------------

_HALF = "sqrt(1.5)"


@query(f"select p_partkey, round(z * z / 4 - 0.125 + {_HALF} / 4 / z - 1.375 / (z * z) + 0.625 * {_HALF} / (z * z * z), 6) as ans, round(case when lam * z2 + 1 > 0 then pow(lam * z2 + 1, 1 / lam) - 1 + 0.02 * (1 - lam) * pow(lam * z2 + 1, 1 / lam - 2) end, 6) as yj_pos, round(1 - pow((2 - lam) * z2 + 1, 1 / (2 - lam)) - 0.02 * (1 - (2 - lam)) * pow((2 - lam) * z2 + 1, 1 / (2 - lam) - 2), 6) as yj_neg, p_retailprice as same from (select *, p_size / 5.0::double as z, p_size / 50.0::double as z2, 0.6 as lam from part)")
def more_inverses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverse of the root transform, second-order corrected inverses of Yeo-Johnson, and no transform."""
    df = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", (F.col("p_size") / 5.0).alias("z"), (F.col("p_size") / 50.0).alias("z2"))
    none = transforms.Transform("none").fit(df, "p_retailprice")
    v = F.lit(0.04)
    return df.select("p_partkey", _r(transforms.anscombe_inverse(F.col("z")), "ans"), _r(transforms.yeo_johnson_inverse(F.col("z2"), 0.6, v), "yj_pos"), _r(transforms.yeo_johnson_inverse(-F.col("z2"), 0.6, v), "yj_neg"), none.inverse(none.transform(F.col("p_retailprice"))).alias("same"))


_FITTED = ("anscombe", "log", "logistic", "box-cox", "yeo-johnson", "quantile")


@query(f"select p_partkey, k.kind, true as known, round(p_retailprice, 3) as back from part, (values {', '.join(f'({chr(39)}{k}{chr(39)})' for k in _FITTED if k not in ('anscombe', 'quantile'))}) k(kind)")
def fitted_round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transforms fitted on a column and undone."""
    df = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    parts = []
    for kind in _FITTED:
        if kind in ("anscombe", "quantile"):
            continue
        t = transforms.Transform(kind, floor=0.0, ceiling=10_000.0).fit(df, "p_retailprice")
        z = t.transform(F.col("p_retailprice"))
        parts.append(df.select("p_partkey", F.lit(kind).alias("kind"), z.isNotNull().alias("known"), _r(t.inverse(z), "back", 3)))
    return aggregate.stack(*parts)


@query(
    """
with g as (select unnest([i / 100.0 for i in range(-200, 201)])::double as lam), s as (select ln(p_retailprice) as ly, p_retailprice as y from part),
l as (select lam, -0.5 * ln(var_pop(case when abs(lam) < 1e-12 then ly else (pow(y, lam) - 1) / lam end)) + (lam - 1) * avg(ly) as ll from s, g group by 1),
y as (select lam, -0.5 * ln(var_pop(case when abs(lam) < 1e-12 then ln(1 + y) else (pow(y + 1, lam) - 1) / lam end)) + (lam - 1) * avg(ln(1 + y)) as ll from s, g group by 1)
select 'box-cox' as kind, round(max(ll), 4) as ll from l union all select 'yeo-johnson', round(max(ll), 4) from y
"""
)
def fitted_lambdas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest log-likelihood that a fitted lambda reaches."""
    df = table(spark, sf_dir, "part").select("p_retailprice")
    y, rows = F.col("p_retailprice"), []
    for kind, f, jac in (("box-cox", transforms.box_cox, F.ln(y)), ("yeo-johnson", transforms.yeo_johnson, F.log1p(y))):
        lam = transforms.fit_lambda(df, "p_retailprice", kind)
        rows.append(df.agg(F.lit(kind).alias("kind"), _r(-0.5 * F.ln(F.var_pop(f(y, lam))) + (lam - 1) * F.avg(jac), "ll", 4)))
    return aggregate.stack(*rows)


@query(
    """
with q as (select [quantile_cont(p_retailprice, i / 10) for i in range(0, 11)] as e from part), u as (select p_partkey, p_retailprice as y, e, len(list_filter(e, lambda x: x <= p_retailprice)) as k from part, q)
select p_partkey, round(case when k >= 11 then 1.0 else (k - 1 + (y - e[k]) / (e[k + 1] - e[k])) / 10 end, 6) as p, true as back from u
"""
    .replace("[quantile_cont(p_retailprice, i / 10) for i in range(0, 11)]", "[" + ", ".join(f"quantile_cont(p_retailprice, {i / 10})" for i in range(11)) + "]")
)
def quantile_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quantile transform: probabilities of its scores, and the way back."""
    df = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    t = transforms.Transform("quantile", n_quantiles=11).fit(df, "p_retailprice")
    z = df.withColumn("z", t.transform(F.col("p_retailprice")))

    @F.pandas_udf("double")
    def cdf(v: pd.Series) -> pd.Series:
        p = pd.Series(norm_cdf(v.to_numpy(float)))
        return p.where(p > 1e-6, 0.0).where(p < 1 - 1e-6, 1.0)

    near = F.abs(t.inverse(F.col("z")) - F.col("p_retailprice")) < 0.01 * (t.edges[-1] - t.edges[0])
    return z.select("p_partkey", _r(cdf("z"), "p"), near.alias("back"))


# --- densities and samples -----------------------------------------------------------------------

_GRID = [-1000.0 + 500 * i for i in range(24)]
_PDFS = ", ".join(f"(select avg(exp(-(({g} - c_acctbal) * ({g} - c_acctbal)) / 320000.0)) / (400.0 * sqrt(6.283185307179586)) from customer)" for g in _GRID)


@query(f"with p as (select unnest({_GRID})::double as x, unnest([{_PDFS}]) as pdf), c as (select x, pdf, coalesce(sum(pdf * d) over (order by x), 0) as c from (select x, pdf, x - lag(x) over (order by x) as d from p)) select x, round(pdf, 12) as pdf, round(c / max(c) over (), 9) as cdf from c")
def kde_with_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kernel density on a grid with its distribution."""
    return density.kde(table(spark, sf_dir, "customer"), "c_acctbal", _GRID, 400.0).select("x", _r("pdf", "pdf", 12), _r("cdf", "cdf", 9))


@query("select * from (values ('best', true), ('finite', true)) t(what, holds)")
def kde_best_bandwidth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bandwidth of the largest held-out likelihood is neither the narrowest nor the widest of a wide choice."""
    tries = [1.0, 30.0, 300.0, 1000.0, 100_000.0]
    h = density.kde_bandwidth(table(spark, sf_dir, "customer"), "c_acctbal", "c_custkey", tries)
    return spark.createDataFrame([("best", tries[0] < h < tries[-1]), ("finite", math.isfinite(h))], "what string, holds boolean")


_CX = [5.0, 15.0, 25.0, 35.0, 45.0]


@query(
    f"""
with r as (select l_quantity::double as x, l_extendedprice::double as y from lineitem), e as (select min(y) as lo, (max(y) - min(y)) / 512 as w from r),
b as (select least(511, floor((y - lo) / w)) as b, max(y) as y, {', '.join(f'sum(exp(-(({g} - x) * ({g} - x)) / 18.0)) as w{i}' for i, g in enumerate(_CX))} from r, e group by 1),
c as ({' union all '.join(f'select {g} as x, y, sum(w{i}) over (order by b) / sum(w{i}) over () as c from b' for i, g in enumerate(_CX))})
select x::double as x, round(min(y), 4) as y from c where c >= 0.5 - 1e-12 group by 1
"""
)
def conditional_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median of the price given the quantity, weighted by a kernel."""
    out = density.cond_quantile(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", 0.5, _CX, 3.0)
    return out.select("x", _r("y", "y", 4))


@query(
    """
with c as (select l_quantity as x, sum(count(*)) over (order by l_quantity) / sum(count(*)) over () as cdf from lineitem group by 1)
select round(i / 20.0, 6) as prob, case when i <= 4 then 0 else (select min(x) from c where cdf >= (i / 20.0 - 0.2) / 0.8 - 1e-12) end::double as x from range(1, 21) t(i)
"""
)
def inverse_cdf_with_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverse of a tabulated distribution with a fifth of its mass at zero."""
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_quantity").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(F.lit(0))  # distinct quantities only
    c = c.withColumn("cdf", F.sum("n").over(w.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(w))
    return density.dist_df(c, "x", "cdf", 0.05, 0.2).select(_r("prob", "prob"), F.col("x").cast("double").alias("x"))


@query("select * from (values ('p_retailprice', true, true, true), ('p_size', true, true, true)) t(col, centred, spread, bounded)")
def bootstrap_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of resamples: centred on the mean, with the deviation of a mean of half the rows, and their interval about it."""
    df = table(spark, sf_dir, "part")
    b = density.bootstrap(df, ["p_retailprice", "p_size"], "p_partkey")
    s = aggregate.stack(*[df.agg(F.lit(c).alias("col"), F.avg(c).alias("m"), F.stddev_samp(c).alias("sd"), F.count(c).alias("n")) for c in ("p_retailprice", "p_size")])
    se = F.col("sd") / F.sqrt(F.col("n") * 0.5)
    out = b.join(F.broadcast(s), "col")  # two rows
    return out.select("col", (F.abs(F.col("mean") - F.col("m")) < 0.3 * se).alias("centred"), F.col("std").between(0.8 * se, 1.2 * se).alias("spread"), ((F.col("l_ci") < F.col("m")) & (F.col("m") < F.col("h_ci")) & (F.col("h_ci") - F.col("l_ci")).between(3 * se, 5 * se)).alias("bounded"))


@query("select unnest([0.1, 0.5, 0.9])::double as q, true as near")
def empirical_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws from the listed points have their quantiles."""
    df = table(spark, sf_dir, "orders")
    draws = density.sim_ecdf_draws(df, "o_totalprice", 20_000)
    a, b = density.sim_ecdf(df, "o_totalprice", [0.1, 0.5, 0.9]), density.sim_ecdf(draws, "x", [0.1, 0.5, 0.9]).withColumnRenamed("x", "d")
    return a.join(b, "q").select("q", (F.abs(F.col("x") - F.col("d")) < 0.05 * F.col("x")).alias("near"))


_DELAYS = "select datediff('day', o_orderdate, l_shipdate) as t, l_linestatus = 'F' as ev from lineitem join orders on l_orderkey = o_orderkey where l_shipdate >= o_orderdate"


def _delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_linestatus").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    return lines.where("l_shipdate >= o_orderdate").select("l_orderkey", F.datediff("l_shipdate", "o_orderdate").alias("t0"), (F.col("l_linestatus") == "F").alias("ev"))


@query(f"select true as among, true as positive, true as split from (select count(*) from ({_DELAYS}))")
def survival_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws of durations behind a Kaplan-Meier curve lie among the durations; a sample without its point masses."""
    df = _delays(spark, sf_dir)
    draws, _ = density.survival_draws(df, "t0", "ev", 2000)
    ends = df.agg(F.min("t0"), F.max("t0")).first()
    strange = draws.where(~F.col("x").between(*ends)).count()
    lowest = density.decensor(df, "t0", "ev", 2000).agg(F.min("x")).first()[0]
    rest, masses = density.split_sample(df, "t0", "l_orderkey", min_mass=0.005)
    kept = rest.count() + sum(df.where(F.col("t0") == v).count() for v in masses) == df.where("t0 > 0").count() + (df.where("t0 = 0").count() if 0.0 in masses else 0)
    return spark.createDataFrame([(strange == 0, lowest is None or lowest > 0, kept)], "among boolean, positive boolean, split boolean")


@query(
    """
with c as (select l_linestatus as g, l_extendedprice as x, count(*) filter (l_returnflag = 'N') as a, count(*) filter (l_returnflag <> 'N') as b from lineitem group by 1, 2),
d as (select g, a, b, abs(sum(a) over (partition by g order by x) / sum(a) over (partition by g) - sum(b) over (partition by g order by x) / sum(b) over (partition by g)) as d from c),
k as (select g, max(d) as d, sum(a)::double as n1, sum(b)::double as n2 from d group by 1), l as (select *, d * (sqrt(n1 * n2 / (n1 + n2)) + 0.12 + 0.11 / sqrt(n1 * n2 / (n1 + n2))) as l from k where n1 > 0 and n2 > 0)
select g, round(d, 9) as d, round(least(1, greatest(0, 2 * (exp(-2 * l * l) - exp(-8 * l * l) + exp(-18 * l * l) - exp(-32 * l * l) + exp(-50 * l * l) - exp(-72 * l * l)))), 4) as p from l where l > 0.6
"""
)
def ks_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sample tests per group with p-values."""
    ks = density.with_ks_p(density.ks_two_sample(table(spark, sf_dir, "lineitem"), "l_extendedprice", F.col("l_returnflag") == "N", ["l_linestatus"]))
    size = F.sqrt(F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2")))
    reach = F.col("d") * (size + 0.12 + 0.11 / size)
    return ks.where((F.col("n1") > 0) & (F.col("n2") > 0) & (reach > 0.6)).select(F.col("l_linestatus").alias("g"), _r("d", "d", 9), _r("p_value", "p", 4))


# --- fits and mixtures ---------------------------------------------------------------------------


@query("select distinct fit_id, round(q50, 6) as mid, round(q90 - q10, 6) as reach, n from (select *, (q10 is not null)::int + (q25 is not null)::int + (q50 is not null)::int + (q75 is not null)::int + (q90 is not null)::int as n from q_fits) where isfinite(q50) and isfinite(q10) and isfinite(q90) and q10 is not null and q50 is not null and q90 is not null")
def quantile_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quantiles of a summary as a map by probability."""
    df = table(spark, sf_dir, "q_fits").withColumn("q", qfits.quantile_dict())
    g = lambda p: F.try_element_at("q", F.lit(p))
    known = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) for c in ("q10", "q50", "q90")]
    n = F.size(F.filter(F.map_values("q"), lambda v: v.isNotNull()))
    return df.where(known[0] & known[1] & known[2]).select("fit_id", _r(g(0.5), "mid"), _r(g(0.9) - g(0.1), "reach"), n.alias("n")).distinct()


_Z = 1.2815515655446004


@query(
    f"""
with r as (select distinct fit_id, q10, q90 from q_fits where q10 > 0 and q90 > q10 and isfinite(q90) and isfinite(q10))
select fit_id, round((ln(q90) - ln(q10)) / {2 * _Z}, 6) as s, round(exp((ln(q90) + ln(q10)) / 2) / q10, 4) as c, round((q10 / -ln(0.9) + q90 / -ln(0.1)) / 2 / q10, 4) as e from r
"""
)
def two_quantile_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lognormal and exponential through two quantiles of a row (scales relative to the lower one)."""
    df = table(spark, sf_dir, "q_fits").select("fit_id", "q10", "q90").where("q10 > 0 and q90 > q10 and q90 < double('infinity')").distinct()

    def run(batches):
        for pdf in batches:
            out = []
            for i, a, b in zip(pdf["fit_id"], pdf["q10"], pdf["q90"]):
                (s,), c = families.from_two_quantiles("lognorm", {0.1: a, 0.9: b})
                out.append((i, round(s, 6), round(c / a, 4), round(families.from_two_quantiles("expon", {0.1: a, 0.9: b})[1] / a, 4)))
            yield pd.DataFrame(out, columns=["fit_id", "s", "c", "e"])

    return df.mapInPandas(run, "fit_id long, s double, c double, e double").select("fit_id", _r("s", "s"), _r("c", "c", 4), _r("e", "e", 4))


@query("select distinct c_mktsegment, true as weights, true as ordered, true as close, true as likely from customer where c_acctbal > 0")
def em_mixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two exponentials per segment by EM: weights sum to one, the mean is that of the data, no single exponential is likelier."""
    df = table(spark, sf_dir, "customer").where("c_acctbal > 0")
    fit = mixtures.fit_groups(df, ["c_mktsegment"], "c_acctbal", lambda x, n: mixtures.em(x, 2, "expon", counts=n), weighted=True)
    s = df.groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("m"), F.count("c_acctbal").alias("k"))
    total = F.aggregate("probs", F.lit(0.0), lambda a, x: a + x)
    return fit.join(s, "c_mktsegment").select("c_mktsegment", (F.abs(total - 1) < 1e-9).alias("weights"), (F.array_min("scales") > 0).alias("ordered"), (F.abs(F.col("mean") / F.col("m") - 1) < 0.01).alias("close"), (F.col("llf") > -F.col("k") * (1 + F.ln("m")) - 0.01 * F.col("k")).alias("likely"))


@query("select distinct event_type, true as close, true as likely, true as phases from events")
def hyper_exponentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hyper-exponential fits at the default work: the mean within a tenth, not less likely than one exponential, and no more phases than allowed."""
    df = table(spark, sf_dir, "events").where("value > 0")
    fit = mixtures.fit_groups(df, ["event_type"], "value", lambda x, n: mixtures.hyper_exp(x, counts=n), weighted=True)
    s = df.groupBy("event_type").agg(F.avg("value").alias("m"), F.count("value").alias("k"))
    return fit.join(s, "event_type").select("event_type", (F.abs(F.col("mean") / F.col("m") - 1) < 0.1).alias("close"), (F.col("llf") > -F.col("k") * (1 + F.ln("m")) - 0.05 * F.col("k")).alias("likely"), (F.size("probs") <= 20).alias("phases"))


@query("select * from (values ('gamma', true, true), ('lognorm', true, true)) t(family, close, merged)")
def quantile_mixtures_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixtures of order 2 through five quantiles of a mixed sample: near in probability; components alike are merged."""
    ps = [0.1, 0.25, 0.5, 0.75, 0.9]

    def one(name: str) -> dict:
        shapes = [[4.0], [1.0]] if name == "gamma" else [[0.4], [0.6]]
        m = mixtures.Mixture([name] * 2, [0.6, 0.4], shapes, [1.0, 10.0])
        q = dict(zip(ps, m.ppf(ps)))
        fit = mixtures.quantile_mixture(q, name, 2)
        near = float(np.abs(fit.cdf(np.array(list(q.values()))) - np.array(ps)).max()) < 0.03
        alike = mixtures.merge_similar(mixtures.Mixture([name] * 3, [0.3, 0.3, 0.4], [shapes[0]] * 2 + [shapes[1]], [1.0, 1.0, 500.0]))
        return {"family": name, "close": bool(near), "merged": len(alike.names) == 2}

    return parallel.map_args(spark, one, [("gamma",), ("lognorm",)], "family string, close boolean, merged boolean")


@query("select unnest(['cdf', 'draws', 'inverse', 'masses', 'mean', 'spread'])::varchar as what, true as holds")
def mixture_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixture with point masses: distribution, inverse, moments and draws agree."""

    def one(what: str) -> dict:
        m = mixtures.Mixture(["lognorm", "expon"], [0.5, 0.5], [[0.5], []], [2.0, 7.0], masses={0.0: 0.2})
        x = m.rvs(40_000, 3)
        inner = 0.5 * (1 - 0.2) * (2.0 * math.exp(0.125) + 7.0)
        value = {
            "cdf": lambda: abs(float(m.cdf(5.0)) + float(m.sf(5.0)) - 1) < 1e-12 and abs(float(m.cdf(5.0)) - (x <= 5).mean()) < 0.01,
            "draws": lambda: m.kstest(x[x > 0][:2000])[0] < 0.3 and len(x) == 40_000,
            "inverse": lambda: all(abs(float(m.cdf(float(m.ppf(p)[0]))) - p) < 1e-6 for p in (0.3, 0.6, 0.95)) and float(m.ppf(0.1)[0]) <= 1e-6,
            "masses": lambda: abs((x == 0).mean() - 0.2) < 0.01,
            "mean": lambda: abs(m.mean() - inner) < 1e-9 and abs(x.mean() - inner) < 0.1,
            "spread": lambda: abs(m.std() - x.std()) < 0.15 and m.weighted_std() > 0,
        }[what]()
        return {"what": what, "holds": bool(value)}

    return parallel.map_args(spark, one, [(w,) for w in ("cdf", "draws", "inverse", "masses", "mean", "spread")], "what string, holds boolean")


@query("select unnest(['gamma', 'laplace', 'prony'])::varchar as what, true as holds")
def priors_and_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priors of rates are largest where they say they are; a sum of exponentials is recovered."""

    def one(what: str) -> dict | None:
        rates = np.array([0.5, 1.0, 1.5, 2.0, 4.0])
        if what == "none":
            return None
        if what == "prony":
            t = np.arange(40) * 0.1
            amp, ex = mixtures.prony(t, 2 * np.exp(-t) + 3 * np.exp(-4 * t), 2)
            ok = np.allclose(sorted(ex.real), [-4, -1], atol=1e-3) and np.allclose(sorted(amp.real), [2, 3], atol=1e-3)
        elif what == "laplace":
            mu, b = mixtures.laplace_prior(rates)
            ok = mu == 1.5 and abs(b - 0.9) < 0.101 and mixtures.laplace_prior(rates[:1]) is None
        else:
            a, b = mixtures.gamma_prior(rates)
            top = (a - 1) / b
            f = lambda r: float(mixtures.prior_penalty("gamma", (a, b), np.array([1 / r]))[0]) - 2 * math.log(r)
            ok = abs(a / b - rates.mean()) < 1e-3 and a > 1 and f(top) >= max(f(top * 0.9), f(top * 1.1)) and abs(f(top)) < 1e-9
        return {"what": what, "holds": bool(ok)}

    return parallel.map_args(spark, one, [(w,) for w in ("gamma", "laplace", "prony", "none")], "what string, holds boolean")


@query("select fit_id, true as best, true as centred from (select distinct fit_id, y, q10, q25, q50, q75, q90 from q_fits) where isfinite(y) and isfinite(q10) and isfinite(q25) and isfinite(q50) and isfinite(q75) and isfinite(q90) and y > 0 and least(q10, q25, q50, q75, q90) > 0")
def lognorm_qfit_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with positive finite quantiles and mean has a lognormal fit that keeps its mean and is no worse than five others."""
    df = table(spark, sf_dir, "q_fits").select("fit_id", "y", *qfits.QUANTILES).distinct()
    fit = qfits.lognorm_qfit(df).where("par_shape is not null")
    zs = dict(zip(qfits.QUANTILES, (-1.2815515655446004, -0.6744897501960817, 0.0, 0.6744897501960817, 1.2815515655446004)))

    def err(s):
        terms = [F.pow(1 - F.exp(s * z - s * s / 2) / (F.col(c) / F.col("y")), F.lit(2.0)) for c, z in zs.items()]
        return (terms[0] + terms[1] + terms[2] + terms[3] + terms[4]) / 5

    best = F.lit(True)
    for s in (0.003, 0.05, 0.3, 1.0, 3.0):
        best = best & (F.col("err") <= err(F.lit(s)) * 1.05 + 1e-4)
    mean = F.col("par_scale") * F.exp(F.col("par_shape") * F.col("par_shape") / 2)
    return fit.select("fit_id", best.alias("best"), (F.abs(mean / F.col("y") - 1) < 1e-9).alias("centred"))


@query("select fit_id, true as sound from (select distinct fit_id, y, q10, q25, q50, q75, q90 from q_fits) where isfinite(y) and isfinite(q10) and isfinite(q25) and isfinite(q50) and isfinite(q75) and isfinite(q90) and y > 0 and least(q10, q25, q50, q75, q90) > 0")
def gamma_qfit_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with positive finite quantiles and mean has a gamma fit that keeps its mean; one of shape 1 is the exponential."""
    df = table(spark, sf_dir, "q_fits").select("fit_id", "y", *qfits.QUANTILES).distinct()
    fit = qfits.gamma_qfit(df).where("par_shape is not null")
    terms = [F.pow(1 + F.ln(F.lit(1 - p)) / (F.col(c) / F.col("y")), F.lit(2.0)) for c, p in qfits.QUANTILES.items()]
    expon = (terms[0] + terms[1] + terms[2] + terms[3] + terms[4]) / 5
    ok = (F.abs(F.col("par_shape") * F.col("par_scale") / F.col("y") - 1) < 1e-9) & (F.col("err") <= expon * 1.02 + 1e-6)
    return fit.select("fit_id", ok.alias("sound"))


# --- smoothing, imputation, outliers -------------------------------------------------------------

_LOESS_ROUND = """
w{k} as (select a.g, a.x as x0, b.x, b.y, b.x - a.x as d, pow(1 - pow(least(abs(b.x - a.x) / n.h, 1), 3), 3) * b.delta as w from near n join r{p} a on a.g = n.g and a.x = n.x0 join r{p} b on b.g = n.g and b.x = n.x),
c{k} as (select g, x0, sum(w) as sw, sum(w * d) / sum(w) as md, sum(w * y) / sum(w) as my from w{k} group by 1, 2),
s{k} as (select w.g, w.x0, any_value(md) as md, any_value(my) as my, sum(w * pow(d - md, 2)) as sxx, sum(w * (d - md) * (y - my)) as sxy from w{k} w join c{k} using (g, x0) group by 1, 2),
f{k} as (select a.g, a.x, a.y, my - case when sxx > 1e-9 then sxy / sxx else 0 end * md as s from s{k} join r{p} a on a.g = s{k}.g and a.x = s{k}.x0),
r{k} as (select g, x, y, s, case when m > 0 then pow(1 - pow(greatest(-1, least(1, (y - s) / (6 * m))), 2), 2) else 1 end as delta from (select *, median(abs(y - s)) over (partition by g) as m from f{k}))"""


@query(
    """
with e as (select event_type as g, date_diff('day', date '1970-01-01', cast(ts as date))::double as x, sum(value) as y from events group by 1, 2), r0 as (select g, x, y, 1.0::double as delta from e),
z as (select g, least(count(*), ceil(0.5 * count(*))::bigint + 1) as k from e group by 1),
near as (select g, x0, x, max(d) over (partition by g, x0) as h from (select a.g, a.x as x0, b.x, abs(a.x - b.x) as d, row_number() over (partition by a.g, a.x order by abs(a.x - b.x), b.x) as rn from e a join e b on a.g = b.g) join z using (g) where rn <= k),"""
    + ",".join(_LOESS_ROUND.format(k=k, p=k - 1) for k in (1, 2, 3))
    + " select g as event_type, x, round(s, 4) as smooth from f3"
)
def loess_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robust local lines through daily totals."""
    d = table(spark, sf_dir, "events").groupBy("event_type", F.unix_date(F.col("ts").cast("date")).alias("d")).agg(F.sum("value").alias("y"))
    return smooth.loess(d, ["event_type"], "d", "y", 0.5).select("event_type", "x", _r("smooth", "smooth", 4))


@query("select distinct event_type, true as chosen, true as least from events")
def loess_spans_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The span chosen has the smallest criterion of all spans."""
    d = table(spark, sf_dir, "events").groupBy("event_type", F.unix_date(F.col("ts").cast("date")).alias("d")).agg(F.sum("value").alias("y"))
    spans = [i / 20 for i in range(2, 19)]
    best = smooth.opt_loess(d, ["event_type"], "d", "y").select("event_type", "f_opt").distinct()
    tried = smooth.loess_spans(d, ["event_type"], "d", "y", spans).where(~F.isnan("aicc"))
    of = tried.join(best, "event_type").groupBy("event_type", "f_opt").agg(F.min("aicc").alias("lo"), F.min(F.when(F.abs(F.col("f") - F.col("f_opt")) < 1e-9, F.col("aicc"))).alias("own"))
    return of.select("event_type", F.col("f_opt").between(spans[0], spans[-1]).alias("chosen"), (F.col("own") <= F.col("lo") + 1e-9).alias("least"))


@query("select event_id, case when event_id % 11 <> 0 then event_type end as kept_type, case when event_id % 7 <> 0 then round(value, 6) end as kept_value, true as filled, true as within from events")
def imputed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given cells stay, missing ones are filled by known types and within the range of the values."""
    ev = table(spark, sf_dir, "events")
    df = ev.select("event_id", F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("event_type"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), F.hour("ts").alias("hr"))
    ends = df.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    types = [r[0] for r in df.select("event_type").distinct().collect() if r[0]]  # a few categories
    out = impute.impute(df, ex_cols=["event_id"]).crossJoin(F.broadcast(ends))  # one row
    return out.select(
        "event_id", F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("kept_type"), F.when(F.col("event_id") % 7 != 0, F.round("value", 6)).alias("kept_value"),
        (F.col("event_type").isin(types) & F.col("value").isNotNull()).alias("filled"), F.col("value").between(F.col("lo") - 1e-6, F.col("hi") + 1e-6).alias("within"),
    )


@query(
    """
with d as (select event_type, date_trunc('day', ts) as ds, sum(value) as y from events group by 1, 2), m as (select event_type, avg(y) as b from d group by 1),
e as (select event_type, ds, y, b, y - b as r from d join m using (event_type)), q as (select event_type, quantile_cont(r, 0.25) as q1, quantile_cont(r, 0.75) as q3, count(*) as n from e group by 1)
select event_type, strftime(ds, '%Y-%m-%d') as ds, n > 10 and (r > q3 + 0.5 * (q3 - q1) or r < q1 - 0.5 * (q3 - q1)) and day(ds) <> 3 as is_outlier,
  round(case when n > 10 and day(ds) <> 3 and r > q3 + 0.5 * (q3 - q1) then 0.5 * (b + q3 + 0.5 * (q3 - q1)) + 0.5 * b when n > 10 and day(ds) <> 3 and r < q1 - 0.5 * (q3 - q1) then 0.5 * (b + q1 - 0.5 * (q3 - q1)) + 0.5 * b else y end, 4) as y from e join q using (event_type)
"""
)
def outliers_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outliers of daily totals about their mean, drawn half way to the bound; some dates are spared."""
    d = table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("ds")).agg(F.sum("value").alias("y"))
    d = d.withColumn("b", F.avg("y").over(Window.partitionBy("event_type")))
    spared = [r[0] for r in d.where(F.dayofmonth("ds") == 3).select(F.date_format("ds", "yyyy-MM-dd")).distinct().collect()]  # a date a month
    out = outliers.ts_outliers(d, ["event_type"], "ds", "y", coef=0.5, replace=True, r_val=0.5, ignore_dates=spared, baseline="b")[0]
    return out.select("event_type", F.date_format("ds", "yyyy-MM-dd").alias("ds"), "is_outlier", _r("y", "y", 4))


# --- synthetic series ----------------------------------------------------------------------------


@query("select t, round(2 * cos(t * 6.283185307179586 / 7) + 3 * cos(2 * t * 6.283185307179586 / 7) - 1 * sin(t * 6.283185307179586 / 7) + 0.5 * sin(2 * t * 6.283185307179586 / 7), 8) as season, round(5 + 3 / (1 + exp(-(t - 150) / 40.0)), 8) as squashed, case when t >= 200 then round(4 * pow(1.01, t - 200), 6) when t >= 80 then round(-2 * pow(1.01, t - 80), 6) else 1 end::double as level from (select range as t from range(300))")
def series_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waves of given weights, a squash between bounds, and a parameter with change points that drifts."""
    t = F.col("id")
    return spark.range(300).select(t.alias("t"), _r(generate.fourier(t, 7, 2, [2, 3, -1, 0.5]), "season", 8), _r(generate.bounded((t - 150) / 40.0, 5.0, 8.0), "squashed", 8), _r(generate.parameter(t, [80, 200], [1.0, -2.0, 4.0], 0.01), "level"))


@query("select unnest([0.5, 10.0, 60.0, 1000.0])::double as rate, true as mean, true as variance, true as tails, true as skew")
def poisson_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poisson draws at small and large rates: mean, variance, skewness, and readings beyond three deviations."""
    parts = []
    for rate in (0.5, 10.0, 60.0, 1000.0):
        k = F.col("k")
        d = spark.range(50_000).select(generate.poisson(F.lit(rate), density.hash_uniform(11, F.col("id"))).alias("k"))
        s = d.agg(F.avg(k).alias("m"), F.var_pop(k).alias("v"), F.skewness(k).alias("g"), F.avg((F.abs(k - rate) > 3 * math.sqrt(rate)).cast("double")).alias("far"))
        parts.append(s.select(F.lit(rate).alias("rate"), (F.abs(F.col("m") - rate) < 0.02 * math.sqrt(rate) + 0.01).alias("mean"), (F.abs(F.col("v") / rate - 1) < 0.03).alias("variance"), F.col("far").between(0.0005, 0.03).alias("tails"), (F.abs(F.col("g") - rate**-0.5) < 0.05).alias("skew")))
    return aggregate.stack(*parts)


@query("select unnest(['events', 'seasons', 'series', 'bounds'])::varchar as what, true as holds")
def series_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events come once a period, seasons need two of the longest period, a series is the same when made again and stays in its bounds."""
    ev = spark.range(200).select("id", generate.events(F.col("id"), [10], 4).alias("e")).where("e > 0").agg(F.count("e").alias("n"), F.count_distinct(F.pmod("id", F.lit(10))).alias("k")).first()
    make = lambda: generate.time_series(spark, 300, [("week", 7, 2)], [30], t_size=1, bounds=(0.0, 10.0), trend_cpt=2, level_cpt=1, noise=0.1, seed=5)
    s = make().agg(F.count("y").alias("n"), F.min("y").alias("lo"), F.max("y").alias("hi")).first()
    again = make().select("t", "y").exceptAll(make().select("t", "y")).count()
    rows = [("events", 19 <= ev["n"] <= 20 and ev["k"] == 1), ("seasons", generate.seasonal(F.col("id"), 10, [("week", 7, 2)]) is None), ("series", again == 0 and s["n"] == 300), ("bounds", 0.0 <= s["lo"] and s["hi"] <= 10.0)]
    return spark.createDataFrame(rows, "what string, holds boolean")
