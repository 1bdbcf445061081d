"""Queries of the toolkit's operators on the driver tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.functions import dates, metrics, transforms
from quillstone.operators import aggregate, bins, clean, generate, impute, outliers, smooth, windows
from quillstone.session import table
from quillstone.sources import files
from quillstone.stats import density, mixtures, qfits
from quillstone.streaming import intervals as stream

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query(
    """
with a as (select o_custkey as custkey, date_trunc('month', o_orderdate) as mon, sum(o_totalprice) as amt, min(o_orderdate) as ts_start, max(o_orderdate) as ts_end, count(*) as cnt from orders group by 1, 2),
b as (select o_custkey as custkey, date_trunc('month', o_orderdate) as mon, sum(l_extendedprice) as amt, min(l_shipdate) as ts_start, max(l_shipdate) as ts_end, count(*) as cnt from lineitem join orders on l_orderkey = o_orderkey group by 1, 2)
select custkey, strftime(mon, '%Y-%m') as mon, a.cnt as cnt_1, b.cnt as cnt_2, round(a.amt, 2) as amt_1, round(b.amt, 2) as amt_2, round(b.amt / a.amt, 6) as amt_ratio, b.cnt / a.cnt as cnt_ratio,
  epoch(b.ts_start)::bigint - epoch(a.ts_start)::bigint as start_diff_secs, epoch(b.ts_end)::bigint - epoch(a.ts_end)::bigint as end_diff_secs
from a join b using (custkey, mon)
"""
)
def reconcile_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources grouped by the same keys, joined with suffixes, with ratios and second differences."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("custkey"), F.date_trunc("month", "o_orderdate").alias("mon"), "o_totalprice", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_shipdate").join(orders.select("o_orderkey", "custkey", "mon"), F.col("l_orderkey") == F.col("o_orderkey"))

    def grouped(df: DataFrame, amt: str, ts: str, n: int) -> DataFrame:
        return df.groupBy("custkey", "mon").agg(F.sum(amt).alias(f"amt_{n}"), F.min(ts).alias(f"ts_start_{n}"), F.max(ts).alias(f"ts_end_{n}"), F.count(F.lit(1)).alias(f"cnt_{n}"))

    both = grouped(orders, "o_totalprice", "o_orderdate", 1).join(grouped(lines, "l_extendedprice", "l_shipdate", 2), ["custkey", "mon"])
    secs = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    return both.select(
        "custkey", F.date_format("mon", "yyyy-MM").alias("mon"), "cnt_1", "cnt_2", F.round("amt_1", 2).alias("amt_1"), F.round("amt_2", 2).alias("amt_2"),
        F.round(F.try_divide("amt_2", "amt_1"), 6).alias("amt_ratio"), F.try_divide(F.col("cnt_2").cast("double"), F.col("cnt_1").cast("double")).alias("cnt_ratio"),
        (secs("ts_start_2") - secs("ts_start_1")).alias("start_diff_secs"), (secs("ts_end_2") - secs("ts_end_1")).alias("end_diff_secs"),
    )


# --- filters and bands ---------------------------------------------------------------------------


@query(
    """
with b as (select quantile_cont(l_quantity, 0.25) as q1, quantile_cont(l_quantity, 0.75) as q3, quantile_cont(l_extendedprice, 0.25) as p1, quantile_cont(l_extendedprice, 0.75) as p3 from lineitem)
select l_orderkey, l_linenumber, l_quantity, l_extendedprice from lineitem, b
where l_quantity between q1 - 0.3 * (q3 - q1) and q3 + 0.3 * (q3 - q1) and l_extendedprice between p1 - 0.3 * (p3 - p1) and p3 + 0.3 * (p3 - p1)
"""
)
def trim_iqr_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows within the IQR band of two columns."""
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return clean.trim_df(df, ["l_quantity", "l_extendedprice"], rge=0.3)


@query(
    """
select event_type, round(quantile_cont(value, 0.75) + 3 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)), 6) as upr,
  round(quantile_cont(value, 0.25) - 3 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)), 6) as lwr,
  round(median(value) + 3 * stddev_samp(value), 6) as med_upr, round(median(value) - 3 * stddev_samp(value), 6) as med_lwr from events group by 1
"""
)
def bands_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IQR and median bands per event type."""
    df = table(spark, sf_dir, "events").groupBy("event_type").agg(clean.iqr_bounds("value").alias("i"), clean.median_band("value").alias("m"))
    r = lambda c, n: F.round(c, 6).alias(n)
    return df.select("event_type", r("i.upr", "upr"), r("i.lwr", "lwr"), r("m.upr", "med_upr"), r("m.lwr", "med_lwr"))


@query("select event_id, user_id, event_type, value from events")
def drop_constant_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constant and all-null columns go."""
    df = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return clean.drop_cols(df.withColumns({"same": F.lit("x"), "none": F.lit(None).cast("string"), "some": F.when(F.col("event_id") % 2 == 0, F.lit(1))}))


_PRIORITIES = {"o_orderpriority": {"high": ["1-URGENT", "2-HIGH"], "low": ["5-LOW"]}}


@query("select o_orderkey, case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'high' when o_orderpriority = '5-LOW' then 'low' else o_orderpriority end as o_orderpriority from orders")
def recode_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_cols(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), _PRIORITIES)


@query("select distinct 'o_orderpriority' as col_name, o_orderpriority as value from orders where o_orderpriority not in ('high', 'low', '1-URGENT', '2-HIGH', '5-LOW')")
def new_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.new_values(table(spark, sf_dir, "orders"), _PRIORITIES)


@query("select event_id, 'k' as k1, json_extract_string(props, '$.k') as value from events")
def props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of nested JSON."""
    return clean.flatten_json(table(spark, sf_dir, "events"), "event_id", "props")


@query("select event_id, case when cast(json_extract_string(props, '$.k') as bigint) = 1 then -1 else cast(json_extract_string(props, '$.k') as bigint) end as k from events")
def nested_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value replaced within nested maps."""
    kind = T.MapType(T.StringType(), T.LongType())
    df = table(spark, sf_dir, "events").select("event_id", F.from_json("props", kind).alias("m"))
    return df.select("event_id", F.try_element_at(clean.nested_update(F.col("m"), kind, 1, -1), F.lit("k")).alias("k"))


@query(
    """
with g as (select p_brand, p_type, min(p_retailprice) as lo, max(p_retailprice) as hi, avg(p_retailprice) as m, count(*) as n from part group by 1, 2)
select p_brand, p_type, n, (hi - lo) / (2 * (hi + lo)) > 0.1 as dup, case when (hi - lo) / (2 * (hi + lo)) > 0.1 then null else round(m, 6) end as price from g
"""
)
def near_dup_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups whose values agree become their mean, others stay."""
    ded, dup = clean.num_dedup(table(spark, sf_dir, "part"), ["p_brand", "p_type"], "p_retailprice", 0.1)
    n = aggregate.value_counts(table(spark, sf_dir, "part"), ["p_brand", "p_type"])
    both = ded.select("p_brand", "p_type", F.lit(False).alias("dup"), F.round("p_retailprice", 6).alias("price")).unionByName(dup.select("p_brand", "p_type", F.lit(True).alias("dup"), F.lit(None).cast("double").alias("price")).distinct())
    return both.join(n, ["p_brand", "p_type"])


@query("select p_partkey, p_size, case when p_mfgr is null then null when p_mfgr = 'A' then 1.0 else 0.0 end::double as a, case when p_mfgr is null then null when p_mfgr = 'B' then 1.0 else 0.0 end::double as b from (select *, case when p_size % 3 = 0 then null when p_size % 2 = 0 then 'A' else 'B' end as p_mfgr from part)")
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators, blank where the source is."""
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.when(F.col("p_size") % 3 != 0, F.when(F.col("p_size") % 2 == 0, "A").otherwise("B")).alias("m"))
    made = clean.set_nans(clean.get_dummies(df, "m", ["A", "B"]), "m", ["m::A", "m::B"])
    return made.select("p_partkey", "p_size", F.col("`m::A`").alias("a"), F.col("`m::B`").alias("b"))


_GAPPED = "case when event_id % 7 = 0 then null else value end"


@query(
    f"""
with r as (select user_id, event_id, {_GAPPED} as x, row_number() over (partition by user_id order by event_id) as rn, avg(case when ({_GAPPED}) is null then 1.0 else 0.0 end) over (partition by user_id) as miss from events),
s as (select *, last_value(case when x is not null then rn end ignore nulls) over (partition by user_id order by rn rows between unbounded preceding and current row) as pr,
  last_value(x ignore nulls) over (partition by user_id order by rn rows between unbounded preceding and current row) as px,
  first_value(case when x is not null then rn end ignore nulls) over (partition by user_id order by rn rows between current row and unbounded following) as nr,
  first_value(x ignore nulls) over (partition by user_id order by rn rows between current row and unbounded following) as nx from r)
select user_id, event_id, round(case when miss > 0.2 then null when x is not null then x when px is null then nx when nx is null then px else px + (nx - px) / (nr - pr) * (rn - pr) end, 6) as x from s
"""
)
def gap_fill_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps filled by position, groups with too many left blank."""
    df = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("x"))
    return clean.interpolate(df, "event_id", "x", ["user_id"]).withColumn("x", F.round("x", 6))


# --- aggregation and bins ------------------------------------------------------------------------


@query("select l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 8) as w_discount from lineitem group by 1")
def weighted_discount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(aggregate.w_mean("l_discount", "l_quantity"), 8).alias("w_discount"))


@query(
    """
select o_orderpriority, round(sum(case when o_orderstatus = 'F' then o_totalprice else 0 end) / sum(o_totalprice), 8) as share_f, round(sum(case when o_orderstatus = 'O' then o_totalprice else 0 end) / sum(o_totalprice), 8) as share_o, round(sum(o_totalprice), 2) as total
from orders where o_orderstatus in ('F', 'O') group by 1
"""
)
def hist_status_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = aggregate.df_hist(table(spark, sf_dir, "orders"), "o_orderstatus", "o_totalprice", "o_orderpriority", ["F", "O"])
    return h.select("o_orderpriority", F.round("`o_orderstatus:F`", 8).alias("share_f"), F.round("`o_orderstatus:O`", 8).alias("share_o"), F.round("o_totalprice", 2).alias("total"))


@query("select o_custkey, string_agg(o_orderpriority, '|' order by o_orderkey) as prios, string_agg(o_orderstatus, '|' order by o_orderkey) as stats from orders group by 1")
def list_by_cust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered lists per group."""
    out = aggregate.col_list_gb(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderpriority", "o_orderstatus"], ["o_orderkey"])
    return out.select("o_custkey", F.array_join("o_orderpriority", "|").alias("prios"), F.array_join("o_orderstatus", "|").alias("stats"))


@query("select event_type, count(*) / (select count(*) from events) as share from events group by 1")
def event_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.value_counts(table(spark, sf_dir, "events"), ["event_type"], normalize=True)


@query("select p_type, count(*) as n from part group by 1 order by 2 desc, 1 limit 10")
def top_part_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.top_k(table(spark, sf_dir, "part"), ["p_type"], 10)


@query("select cast(l_quantity as double) as value, count(*) / (select count(*) from lineitem) as mass from lineitem group by 1 having count(*) > 0.02 * (select count(*) from lineitem)")
def quantity_masses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.point_masses(table(spark, sf_dir, "lineitem"), "l_quantity", 0.02)


@query("select 'o_totalprice' as \"column\", count(*) as n_rows, count(*) - count(o_totalprice) as nulls, count(distinct o_totalprice) as distinct_n, round(avg(o_totalprice), 4) as mean, round(stddev_samp(o_totalprice), 4) as std from orders union all select 'o_orderstatus', count(*), count(*) - count(o_orderstatus), count(distinct o_orderstatus), null, null from orders")
def inspect_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = aggregate.df_inspect(table(spark, sf_dir, "orders").select("o_totalprice", "o_orderstatus"), approx=False)
    return df.select("column", "n_rows", "nulls", F.col("distinct").alias("distinct_n"), F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@query("select l_returnflag, l_linestatus, l_orderkey, l_linenumber, count(*) over (partition by l_returnflag, l_linestatus) as n from lineitem")
def pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber")
    return aggregate.pair_counts(df, ["l_returnflag", "l_linestatus"])


@query(
    """
select bin, count(*) as n, min(x) as lo, max(x) as hi from (
  select p_retailprice as x, case when hi0 > lo0 then least(7, greatest(0, ceil((p_retailprice - lo0) / ((hi0 - lo0) / 8)) - 1)) else 0 end::int as bin
  from part, (select min(p_retailprice) as lo0, max(p_retailprice) as hi0 from part)) group by 1
"""
)
def sz_bins_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bins.with_size_bins(table(spark, sf_dir, "part"), "p_retailprice", 8)
    return df.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))


_EDGES = ", ".join(f"round(quantile_cont(o_totalprice, {i / 6}), 9)" for i in range(1, 6))


@query(
    f"""
with e as (select [{_EDGES}] as q from orders),
b as (select o.*, len(list_filter(q, lambda e: e < round(o_totalprice, 9))) as bin from orders o, e)
select bin::int as bin, round(count(*) / (select count(*) from orders), 8) as bin_prob, median(o_totalprice) as price, round(avg(case when o_orderstatus = 'F' then 1.0 else 0 end), 8) as f, round(avg(case when o_orderstatus = 'O' then 1.0 else 0 end), 8) as o from b group by 1
"""
)
def cnt_bins_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal-count bins with shares per category."""
    df = bins.get_cnt_bins(table(spark, sf_dir, "orders").select("o_totalprice", "o_orderstatus"), "o_totalprice", 6)
    return df.select("bin", F.round("bin_prob", 8).alias("bin_prob"), F.col("o_totalprice").alias("price"), F.round("`o_orderstatus::F`", 8).alias("f"), F.round("`o_orderstatus::O`", 8).alias("o"))


@query("select c_nationkey, round(sum(c_acctbal), 2) as amt, count(*) as n from customer group by 1 union all select s_nationkey, round(sum(s_acctbal), 2), count(*) from supplier group by 1")
def stacked_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources stacked by name."""
    one = lambda t, p: table(spark, sf_dir, t).groupBy(F.col(f"{p}_nationkey").alias("c_nationkey")).agg(F.round(F.sum(f"{p}_acctbal"), 2).alias("amt"), F.count(F.lit(1)).alias("n"))
    return aggregate.stack(one("customer", "c"), one("supplier", "s"))


@query("select n_nationkey as k, r_name as name_2, n_name as name_1 from nation join region on n_regionkey = r_regionkey where n_nationkey not in (select distinct c_nationkey from customer where c_acctbal > 9990) union all select -1, null, null where false")
def joined_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suffix join and anti filter."""
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("r"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("k"))
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("r"), F.col("r_name").alias("name"), F.lit(0).alias("z"))
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 9990").select(F.col("c_nationkey").alias("k"))
    return aggregate.suffix_join(n, r, ["r"]).select(F.col("k_1").alias("k"), "name_1", "name_2").join(rich, "k", "left_anti")


@query("select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as rn from orders) where rn = 1")
def first_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First row per key without a window."""
    df = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return aggregate.first_per_key(df, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(
    """
select o_custkey, o_orderkey, lag(o_totalprice) over w as prev, round(o_totalprice - lag(o_totalprice) over w, 4) as diff, round(sum(o_totalprice) over (w rows unbounded preceding), 2) as cum, max(o_totalprice) over (w rows unbounded preceding) as top
from orders window w as (partition by o_custkey order by o_orderkey)
"""
)
def running_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = aggregate.running(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderkey"], "o_totalprice")
    return df.select("o_custkey", "o_orderkey", F.col("o_totalprice_lag").alias("prev"), F.round("o_totalprice_diff", 4).alias("diff"), F.round("o_totalprice_cumsum", 2).alias("cum"), F.col("o_totalprice_cummax").alias("top"))


# --- trips, windows, calendar --------------------------------------------------------------------


@query(
    """
with s as (select distinct id_guest, ds_checkin, ds_checkout, ds_book, dim_market from interview_data where id_guest is not null and ds_checkin is not null and ds_checkout > ds_checkin),
w as (select *, max(ds_checkout) over (partition by id_guest order by ds_checkin, ds_checkout, ds_book rows between unbounded preceding and 1 preceding) as pm from s),
g as (select *, sum(case when pm is null or floor((epoch(ds_checkin) - epoch(pm)) / 86400) > 3 then 1 else 0 end) over (partition by id_guest order by ds_checkin, ds_checkout, ds_book rows unbounded preceding) as k from w)
select id_guest as guest, strftime(min(ds_checkin), '%Y-%m-%d %H:%M:%S') as checkin, strftime(min(ds_book), '%Y-%m-%d %H:%M:%S') as book, string_agg(distinct dim_market, '|' order by dim_market) as markets from g group by id_guest, k
"""
)
def user_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stays chained into trips."""
    stays = table(spark, sf_dir, "interview_data").where("ds_checkout > ds_checkin").select("id_guest", "ds_checkin", "ds_checkout", "ds_book", "dim_market").distinct()
    out = windows.user_trips(stays)
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return out.select("guest", text("first_home_ds_checkin").alias("checkin"), text("first_ds_book").alias("book"), F.when(F.size("dim_markets") > 0, F.array_join("dim_markets", "|")).alias("markets"))


@query("select isoyear(o_orderdate) || '-' || lpad(week(o_orderdate)::varchar, 2, '0') as yw, count(*) as n, round(sum(o_totalprice), 2) as amt from orders group by 1")
def iso_week_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(dates.iso_year_week(F.col("o_orderdate")).alias("yw")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("amt"))


@query(
    """
with d as (select cast(o_orderdate as date) as d, sum(o_totalprice) as y from orders group by 1),
r as (select week(d) as iso_nbr, isoyear(d) as y0, d, y from d)
select iso_nbr::int as iso_nbr, strftime(min(case when y0 = 1995 then d end), '%Y-%m-%d') as d, round(avg(case when y0 = 1995 then y end), 4) as y1995, round(avg(case when y0 = 1996 then y end), 4) as y1996, round(avg(case when y0 = 1997 then y end), 4) as y1997 from r group by r.iso_nbr having min(case when y0 = 1995 then d end) is not null
"""
)
def year_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("d")).agg(F.sum("o_totalprice").alias("y"))
    out = windows.plot_by_year(daily, ["y"], "d", [1995, 1996, 1997])
    return out.select("iso_nbr", F.date_format("d", "yyyy-MM-dd").alias("d"), *[F.round(f"{y}_y", 4).alias(f"y{y}") for y in (1995, 1996, 1997)])


@query(
    """
with d as (select cast(o_orderdate as date) as d, sum(o_totalprice) as y from orders group by 1),
r as (select week(d)::int as iso_nbr, isoyear(d)::int as y0, d, y from d),
b as (select iso_nbr, min(d) as d from r where y0 = (select min(year(d)) from d) group by 1)
select iso_nbr, strftime(b.d, '%Y-%m-%d') as d, y0 as year, round(avg(y), 4) as y from r join b using (iso_nbr) group by all
"""
)
def year_aligned_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every year of the orders by ISO week, a row per week and year."""
    daily = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("d")).agg(F.sum("o_totalprice").alias("y"))
    out = windows.plot_by_year(daily, ["y"], "d")
    out = out.unpivot(["iso_nbr", "d"], [c for c in out.columns if c.endswith("_y")], "year", "y").where("y is not null")
    return out.select("iso_nbr", F.date_format("d", "yyyy-MM-dd").alias("d"), F.regexp_replace("year", "_y$", "").cast("int").alias("year"), F.round("y", 4).alias("y"))


@query(
    """
with s as (select range::date as d from range(date '2020-01-08', date '2020-03-20', interval 1 day)), a as (select d, case when isodow(d) = 1 or d = date '2020-01-08' then d end as st from s),
b as (select d, max(st) over (order by d) as st from a)
select strftime(st, '%Y-%m-%d') as win_start, strftime(max(d), '%Y-%m-%d') as win_end from b group by st
"""
)
def date_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly windows with partial ends."""
    out = windows.set_date_range(spark, "2020-01-08", "2020-03-19", "W", "MON")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("win_start"), F.date_format("end", "yyyy-MM-dd").alias("win_end"))


@query("select strftime(d - 6, '%Y-%m-%d') as ds_week_starting, n from (select (cast(o_orderdate as date) + (6 - cast(isodow(o_orderdate) as int) + 7) % 7)::date as d, count(*) as n from orders group by 1)")
def week_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly data that end on Saturdays, restated by the week's start."""
    sat = F.date_add(F.col("o_orderdate").cast("date"), F.pmod(F.lit(5) - F.weekday("o_orderdate"), F.lit(7)))
    weekly = table(spark, sf_dir, "orders").groupBy(sat.alias("ds")).agg(F.count(F.lit(1)).alias("n"))
    return windows.set_week_start(weekly).select(F.date_format("ds_week_starting", "yyyy-MM-dd").alias("ds_week_starting"), "n")


_LS = "(last_day({0}) - ((cast(isodow(last_day({0})) as int) + 1) % 7))::date"


@query(
    f"""
with d as (select distinct cast(o_orderdate as date) as d from orders)
select strftime(d, '%Y-%m-%d') as d, dayofyear(d)::int as yday, week(d)::int as wk, (isodow(d) - 1)::int as wd, week(make_date(year(d), 12, 28))::int as weeks,
  strftime(date_trunc('week', make_date(year(d), 1, 4)) - interval 1 day, '%Y-%m-%d') as iso_first, strftime(date_trunc('week', make_date(year(d), 12, 28)) - interval 1 day, '%Y-%m-%d') as iso_last,
  strftime(d + 40, '%Y-%m-%d') as plus40, strftime(d - interval 2 month, '%Y-%m-%d') as less2m, datediff('day', d, date '2001-12-31')::int as to_end, datesub('month', d, date '2001-12-15')::int as months,
  strftime((d + case when isodow(d) = 3 then 7 else (10 - cast(isodow(d) as int)) % 7 end)::date, '%Y-%m-%d') as next_wed,
  strftime((d - ((cast(isodow(d) as int) + 1) % 7))::date, '%Y-%m-%d') as last_sat, strftime({_LS.format('d')}, '%Y-%m-%d') as month_sat,
  strftime(case when {_LS.format('d')} <= d then {_LS.format('d')} else {_LS.format('(d - interval 1 month)::date')} end, '%Y-%m-%d') as past_sat from d
"""
)
def calendar_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar functions over all order dates."""
    df = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("x")).distinct()
    d, text = F.col("x"), lambda c: F.date_format(c, "yyyy-MM-dd")
    b = dates.iso_year_bounds(F.year(d))
    s = text(d)
    return df.select(
        s.alias("d"), dates.year_day(d).alias("yday"), dates.iso_week(d).alias("wk"), dates.date_part(d, "weekday").alias("wd"), dates.iso_weeks_in_year(F.year(d)).alias("weeks"),
        text(b["first"]).alias("iso_first"), text(b["last"]).alias("iso_last"), dates.add_days(s, 40).alias("plus40"), dates.add_months(s, -2).alias("less2m"),
        dates.days_diff(d, F.to_date(F.lit("2001-12-31"))).alias("to_end"), dates.months_diff(d, F.to_date(F.lit("2001-12-15"))).alias("months"), text(dates.next_weekday(d, 2)).alias("next_wed"),
        text(dates.latest_saturday(d)).alias("last_sat"), text(dates.month_last_saturday(d)).alias("month_sat"), text(dates.past_month_saturday(d)).alias("past_sat"),
    )


@query("select strftime(d, '%Y-%m-%d') as d, epoch(d::timestamp at time zone 'America/Los_Angeles')::bigint as ep, strftime(d, '%Y-%m') as ym from (select distinct cast(o_orderdate as date) as d from orders)")
def epoch_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local dates as epochs and in other formats."""
    df = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("d")).distinct()
    return df.select("d", dates.to_epoch(F.col("d")).alias("ep"), dates.change_format(F.col("d"), "yyyy-MM-dd").alias("ym"))


# --- errors, transforms, statistics --------------------------------------------------------------

_DAILY = "with d as (select cast(o_orderdate as date) as ds, sum(o_totalprice) as y from orders group by 1), f as (select ds, y, lag(y, 7) over (order by ds) as h from d), k as (select * from f where h is not null), l as (select *, lead(y) over (order by ds) as yn, lead(h) over (order by ds) as hn from k)"


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("ds")).agg(F.sum("o_totalprice").alias("y"))
    # a calendar of daily totals is one short series
    return d.withColumn("h", F.lag("y", 7).over(Window.partitionBy(F.lit(0)).orderBy("ds"))).where("h is not null")


@query(
    f"""
{_DAILY}
select round(avg(abs(y - h) / (abs(y + h) / 2)), 6) as smape, round(sqrt(avg((y - h) * (y - h))), 2) as rmse, round(avg(abs(y - h) / abs(y)), 6) as mape, round(median(abs(y - h) / abs(y)), 6) as mmape, round(sum(abs(y - h)) / sum(abs(y)), 6) as wmape, round(avg(ln(h / y)), 6) as lar, round(avg(abs(sqrt(y) - sqrt(h)) / sqrt(y)), 6) as sr,
  round(avg(abs(h - y)) / avg(abs(yn - y)), 6) as mase, round(sqrt(avg(((hn - yn) / y) * ((hn - yn) / y)) / avg(((yn - y) / y) * ((yn - y) / y))), 6) as thiel_u from l
"""
)
def naive_forecast_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All errors of a naive weekly forecast of daily totals."""
    df = metrics.with_leads(_daily(spark, sf_dir).withColumn("one", F.lit(0)), ["one"], "ds", "y", "h")
    r = lambda c, n, k=6: F.round(c, k).alias(n)
    return df.agg(r(metrics.smape("y", "h"), "smape"), r(metrics.rmse("y", "h"), "rmse", 2), r(metrics.mape("y", "h"), "mape"), r(metrics.median_ape("y", "h"), "mmape"), r(metrics.wmape("y", "h"), "wmape"), r(metrics.lar("y", "h"), "lar"), r(metrics.sqrt_mape("y", "h"), "sr"), r(metrics.mase("y", "h"), "mase"), r(metrics.thiel_u("y", "h"), "thiel_u"))


@query("select event_type, round(mad(value), 6) as mad, round(sqrt(avg(value * value)), 6) as rms from events group by 1")
def spread_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median absolute deviation and root mean square."""
    ev = table(spark, sf_dir, "events").select("event_type", "value")
    a = metrics.group_mad(ev, ["event_type"], "value").select("event_type", F.round("mad", 6).alias("mad"))
    return a.join(ev.groupBy("event_type").agg(F.round(metrics.rms("value"), 6).alias("rms")), "event_type")


@query(
    f"""
{_DAILY}, r as (select ds, y - h - avg(y - h) over () as d from k), lags as (select n, {', '.join(f'sum(d * p{k}) / sum(d * d) as r{k}' for k in range(1, 6))} from (select *, count(*) over () as n, {', '.join(f'lag(d, {k}) over (order by ds) as p{k}' for k in range(1, 6))} from r) group by n)
select n, round(n * (n + 2) * ({' + '.join(f'r{k} * r{k} / (n - {k})' for k in range(1, 6))}), 6) as lb from lags
"""
)
def ljung_box_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _daily(spark, sf_dir).select("ds", (F.col("y") - F.col("h")).alias("e"))
    return metrics.ljung_box(df, [], "ds", "e", 5).select("n", F.round("lb", 6).alias("lb"))


@query(
    """
select p_partkey, round(2 * sqrt(p_retailprice + 0.375), 8) as ans, round(ln(1 + p_retailprice), 8) as logx, round(ln(((p_retailprice - 0) / 3000) / (1 - p_retailprice / 3000)), 8) as logitx,
  round((pow(p_retailprice, 0.3) - 1) / 0.3, 8) as bc, round((pow(p_retailprice + 1, 1.4) - 1) / 1.4, 4) as yj, round(-(pow(p_retailprice + 1, 0.6) - 1) / 0.6, 8) as yj_neg from part where p_retailprice < 3000
"""
)
def transforms_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transforms at fixed parameters."""
    df = table(spark, sf_dir, "part").where("p_retailprice < 3000")
    y, r = F.col("p_retailprice"), lambda c, n, k=8: F.round(c, k).alias(n)
    return df.select("p_partkey", r(transforms.anscombe(y), "ans"), r(transforms.log_transform(y), "logx"), r(transforms.logit(y, 0.0, 3000.0), "logitx"), r(transforms.box_cox(y, 0.3), "bc"), r(transforms.yeo_johnson(y, 1.4), "yj", 4), r(transforms.yeo_johnson(-y, 1.4), "yj_neg"))


@query("select p_partkey, round(p_retailprice, 4) as bc, round(p_retailprice, 4) as yj, round(p_retailprice, 4) as lg, round(p_retailprice, 4) as lo from part where p_retailprice < 3000")
def transforms_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverse of transform is the value."""
    df = table(spark, sf_dir, "part").where("p_retailprice < 3000")
    y, r = F.col("p_retailprice"), lambda c, n: F.round(c, 4).alias(n)
    return df.select("p_partkey", r(transforms.box_cox_inverse(transforms.box_cox(y, 0.3), 0.3), "bc"), r(transforms.yeo_johnson_inverse(transforms.yeo_johnson(y, -0.4), -0.4), "yj"), r(transforms.log_inverse(transforms.log_transform(y)), "lg"), r(transforms.logit_inverse(transforms.logit(y, 0.0, 3000.0), 0.0, 3000.0), "lo"))


@query("select p_partkey, round(expm1(z) + v / 2 * exp(z), 6) as lg, round(s * 10 + v / 2 * 10 * s * (1 - s) * (1 - 2 * s), 8) as lo, round(pow(0.3 * z + 1, 1 / 0.3) + v / 2 * 0.7 * pow(0.3 * z + 1, 1 / 0.3 - 2), 6) as bc, round(pow(abs(2 * 1.0) / 2 / (1.959963984540054 / 2), 2), 8) as fv from (select p_partkey, p_size / 20.0::double as z, 0.04 as v, 1 / (1 + exp(-(p_size / 20.0::double))) as s from part)".replace("expm1(z)", "(exp(z) - 1)"))
def unbiased_inverses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second-order corrected inverses and the variance of an interval."""
    df = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 20.0).alias("z"))
    z, v = F.col("z"), F.lit(0.04)
    return df.select("p_partkey", F.round(transforms.log_inverse(z, v), 6).alias("lg"), F.round(transforms.logit_inverse(z, 0.0, 10.0, v), 8).alias("lo"), F.round(transforms.box_cox_inverse(z, 0.3, v), 6).alias("bc"), F.round(transforms.fcast_var(F.lit(1.0), F.lit(-1.0), 0.95), 8).alias("fv"))


@query(
    """
with r as (select datediff('day', o_orderdate, l_shipdate) as t, l_linestatus = 'F' as ev from lineitem join orders on l_orderkey = o_orderkey where l_shipdate >= o_orderdate),
c as (select t, count(*) as n, count(*) filter (ev) as deaths from r group by 1), a as (select *, sum(n) over (order by t rows between current row and unbounded following) as at_risk from c)
select t::double as t, at_risk::bigint as at_risk, deaths, round(case when max((deaths >= at_risk)::int) over w = 1 then 0 else exp(sum(case when deaths < at_risk then ln(1 - deaths / at_risk) else 0 end) over w) end, 6) as survival from a window w as (order by t rows unbounded preceding)
"""
)
def km_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kaplan-Meier curve of shipping delays."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_linestatus").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    df = lines.where("l_shipdate >= o_orderdate").select(F.datediff("l_shipdate", "o_orderdate").alias("t0"), (F.col("l_linestatus") == "F").alias("ev"))
    return density.kaplan_meier(df, "t0", "ev").select("t", "at_risk", "deaths", F.round("survival", 6).alias("survival"))


@query(
    """
with c as (select l_extendedprice as x, count(*) filter (l_returnflag = 'R') as a, count(*) filter (l_returnflag <> 'R') as b from lineitem group by 1),
d as (select abs(sum(a) over (order by x) / sum(a) over () - sum(b) over (order by x) / sum(b) over ()) as d, a, b from c)
select round(max(d), 9) as d, sum(a)::bigint as n1, sum(b)::bigint as n2 from d
"""
)
def ks_two_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of the prices of returned and other lines."""
    df = density.ks_two_sample(table(spark, sf_dir, "lineitem"), "l_extendedprice", F.col("l_returnflag") == "R")
    return df.select(F.round("d", 9).alias("d"), "n1", "n2")


_GRID = [-1000.0 + 500 * i for i in range(24)]


@query(f"select unnest({_GRID})::double as x, unnest([{', '.join(f'round(avg(exp(-(({g} - c_acctbal) * ({g} - c_acctbal)) / (2 * 400.0 * 400.0))) / (400.0 * sqrt(6.283185307179586)), 12)' for g in _GRID)}]) as pdf from customer")
def kde_fixed_bw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kernel density on a grid."""
    return density.kde(table(spark, sf_dir, "customer"), "c_acctbal", _GRID, 400.0).select("x", F.round("pdf", 12).alias("pdf"))


_QS = [0.05, 0.25, 0.5, 0.75, 0.95]


@query(f"select unnest({_QS})::double as q, unnest([{', '.join(f'round(quantile_cont(o_totalprice, {q}), 4)' for q in _QS)}]) as x from orders")
def sim_ecdf_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.sim_ecdf(table(spark, sf_dir, "orders"), "o_totalprice", _QS).select("q", F.round("x", 4).alias("x"))


@query(
    """
with c as (select l_quantity as x, sum(count(*)) over (order by l_quantity) / sum(count(*)) over () as cdf from lineitem group by 1)
select round(i / 20.0, 6) as prob, (select min(x) from c where cdf >= i / 20.0 - 1e-12) as x from range(1, 21) t(i)
"""
)
def inverse_cdf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverse of a tabulated distribution at even probabilities."""
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_quantity").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(F.lit(0))  # distinct quantities only
    c = c.withColumn("cdf", F.sum("n").over(w.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(w))
    return density.dist_df(c, "x", "cdf", 0.05).select(F.round("prob", 6).alias("prob"), "x")


@query("select o_custkey, round(list_aggregate(list_transform(l, lambda x: x * x), 'sum'), 2) as sq, round(l[1] * l[1] / list_aggregate(list_transform(l, lambda x: x * x), 'sum'), 9) as p1 from (select o_custkey, list(o_totalprice / 1000 order by o_orderkey) as l from orders group by 1)")
def squared_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled squares as probabilities."""
    df = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_totalprice") / 1000).alias("x")).groupBy("o_custkey").agg(aggregate.ordered_list("x", ["o_orderkey"]).alias("l"))
    sq = F.aggregate("l", F.lit(0.0), lambda a, x: a + x * x)
    return df.select("o_custkey", F.round(sq, 2).alias("sq"), F.round(F.get(density.to_probs(F.col("l")), 0), 9).alias("p1"))


@query("select distinct fit_id, 'expon' as dist_name, round(1 / y, 9) as par_rate from q_fits where y > 0.001 and isfinite(y)")
def expon_qfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "q_fits").select("fit_id", "y").where("y > 0.001 and y < double('infinity')").distinct()
    return qfits.expon_qfit(df).select("fit_id", "dist_name", F.round("par_rate", 9).alias("par_rate"))


def _latest_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "q_fits").select("fit_id", "ts_key", "y", *qfits.QUANTILES).distinct()


@query()
def gamma_qfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qfits.gamma_qfit(_latest_fits(spark, sf_dir)).select("fit_id", "dist_name", "par_shape", "par_scale", "err", "reg", "mdl_std")


@query()
def lognorm_qfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qfits.lognorm_qfit(_latest_fits(spark, sf_dir)).select("fit_id", "dist_name", "par_shape", "par_scale", "err", "reg", "mdl_std")


@query()
def em_expon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two exponentials per segment of balances."""
    df = table(spark, sf_dir, "customer").where("c_acctbal > 0")
    return mixtures.fit_groups(df, ["c_mktsegment"], "c_acctbal", lambda x, n: mixtures.em(x, 2, "expon", counts=n), weighted=True)


@query()
def hyper_exp(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").where("value > 0")
    return mixtures.fit_groups(df, ["event_type"], "value", lambda x, n: mixtures.hyper_exp(x, counts=n), weighted=True)


@query()
def loess_best_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").groupBy("event_type", F.unix_date(F.col("ts").cast("date")).alias("d")).agg(F.sum("value").alias("y"))
    return smooth.opt_loess(d, ["event_type"], "d", "y")


@query()
def impute_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing types and values of events, filled by regression."""
    df = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("event_type"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), F.hour("ts").alias("hr"))
    return impute.impute(df, ex_cols=["event_id"])


@query()
def outliers_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("ds")).agg(F.sum("value").alias("y"))
    return outliers.ts_outliers(d, ["event_type"], "ds", "y", coef=1.5)[0]


@query(
    """
with b as (select series_id, obs_id, y, yhat, y - yhat as e from (select distinct obs_id, series_id, y, yhat from pandas_utils where y is not null and isfinite(y) and yhat is not null)),
q as (select series_id, quantile_cont(e, 0.25) as q1, quantile_cont(e, 0.75) as q3, count(*) as n from b group by 1)
select obs_id, n > 10 and (e > q3 + 3 * (q3 - q1) or e < q1 - 3 * (q3 - q1)) as is_outlier from b join q using (series_id)
"""
)
def outliers_by_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residual IQR band about a given forecast."""
    df = table(spark, sf_dir, "pandas_utils").where("y is not null and not isnan(y) and abs(y) < double('infinity') and yhat is not null").select("obs_id", "series_id", "ds", "y", "yhat").distinct()
    return outliers.ts_outliers(df, ["series_id"], "ds", "y", baseline="yhat")[0].select("obs_id", "is_outlier")


@query()
def bootstrap_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.bootstrap(table(spark, sf_dir, "part"), ["p_retailprice", "p_size"], "p_partkey")


@query()
def white_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_type", "event_id", "value")
    return metrics.white_noise_test(df, ["event_type"], "event_id", "value")


@query()
def synthetic_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.time_series(spark, 400, [("week", 7, 2), ("year", 90, 3)], [30], t_size=0, trend_cpt=2, level_cpt=1)


@query("select event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') as hr, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def tumbling_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stream.tumbling(table(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"], "value")
    return out.select("event_type", F.date_format("win_start", "yyyy-MM-dd HH").alias("hr"), "n", F.round("total", 4).alias("total"))


@query(
    """
with e as (select user_id, ts, lag(ts) over (partition by user_id order by ts) as p from events), s as (select *, sum(case when p is null or ts - p >= interval 30 minute then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) as k from e)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as sess_start, count(*) as n from s group by user_id, k
"""
)
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stream.sessions(table(spark, sf_dir, "events"), "ts", "30 minutes", ["user_id"])
    return out.select("user_id", F.date_format("sess_start", "yyyy-MM-dd HH:mm:ss").alias("sess_start"), "n")


@query("select l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 6) as slope, round(regr_intercept(l_extendedprice, l_quantity), 4) as intercept, round(regr_r2(l_extendedprice, l_quantity), 8) as r2, count(*) as n from lineitem group by 1")
def price_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regression line per group."""
    df = aggregate.regression(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return df.select("l_returnflag", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 8).alias("r2"), "n")


@query("select c_nationkey as k, 'both' as side from customer intersect select s_nationkey, 'both' from supplier union all (select c_nationkey, 'only_c' from (select distinct c_nationkey from customer) except all select s_nationkey, 'only_c' from (select distinct s_nationkey from supplier))")
def nation_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set difference and intersection of keys."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).distinct()
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")).distinct()
    only_c, _, both = aggregate.column_changes(s, c)
    return both.select("k", F.lit("both").alias("side")).unionByName(only_c.select("k", F.lit("only_c").alias("side")))


@query("select i, round(tick0, 6) as tick from (select unnest([0, 1, 2, 3, 4])::int as i, unnest([min(o_totalprice), quantile_cont(o_totalprice, 0.25), quantile_cont(o_totalprice, 0.5), quantile_cont(o_totalprice, 0.75), max(o_totalprice)]) as tick0 from orders)")
def axis_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantile ticks of a plot's axis."""
    return files.plot_ticks(table(spark, sf_dir, "orders"), "o_totalprice").select("i", F.round("tick", 6).alias("tick"))


@query("select id_agent, id_ticket, round(sum(case when half = 1 then secs end), 4) as secs_1, round(sum(case when half = 2 then secs end), 4) as secs_2, count(*) filter (half = 1) as cnt_1, count(*) filter (half = 2) as cnt_2 from (select user_id::varchar as id_agent, event_type as id_ticket, value as secs, 1 + (event_id % 2)::int as half from events) group by 1, 2 having count(*) filter (half = 1) > 0 and count(*) filter (half = 2) > 0")
def ticket_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources of ticket sessions side by side."""
    ev = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("id_agent"), F.col("ts").cast("timestamp").alias("ts_session_start"), F.col("event_type").alias("id_ticket"), F.col("value").alias("seconds_in_ticket"), "event_id")
    out = files.reconcile_sessions(ev.where("event_id % 2 = 0").drop("event_id"), ev.where("event_id % 2 = 1").drop("event_id"))
    return out.select("id_agent", "id_ticket", F.round("seconds_in_ticket_1", 4).alias("secs_1"), F.round("seconds_in_ticket_2", 4).alias("secs_2"), F.col("n_sessions_1").alias("cnt_1"), F.col("n_sessions_2").alias("cnt_2"))


@query("select case when p_type like '%STEEL%' then 'nan' else p_type end as p_type, p_size::double as p_size, p_size % 2 = 1 as odd, p_partkey::varchar as p_partkey from part")
def role_typed_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-string rows brought into roles."""
    df = table(spark, sf_dir, "part")
    raw = df.select(F.col("p_partkey").cast("string"), F.when(F.col("p_type").contains("STEEL"), "N/A").otherwise(F.col("p_type")).alias("p_type"), F.col("p_size").cast("string"), (F.col("p_size") % 2).cast("string").alias("odd"))
    return files.typed(raw, num_cols=["p_size"], b_cols=["odd"], cat_cols=["p_type"], str_cols=["p_partkey"])
