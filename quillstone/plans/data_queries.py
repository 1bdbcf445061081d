"""Queries over readings, stays and work records (problems 2, 3 and 5) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.missing import NO_VALUE, is_missing_number, is_missing_text, plain_key
from quillstone.operators.fill import FillSpec, apply_fills, missing_fills
from quillstone.operators.intervals import periods_and_gaps
from quillstone.operators.spikes import implausible_readings
from quillstone.session import broadcast_if_small, table

WORKING_LIFE_DAYS = 60 * 366


READING_BOUNDS = {"secs": (0.0, None, False), "count": (0.0, None, True), "share": (0.0, 1.0, False)}


def p2_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Implausible readings with the kind of fault."""
    return implausible_readings(table(spark, sf_dir, "pandas_utils"), "obs_id", "series_id", "ds", "y", "yhat", "y_unit", READING_BOUNDS)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings that are spikes, stuck or impossible."""
    return p2_faults(spark, sf_dir).select("obs_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods and gaps of every guest's stays."""
    stays = table(spark, sf_dir, "interview_data").where(
        "id_guest is not null and ds_checkin >= timestamp_ntz'2016-01-01 00:00:00' and ds_checkout < timestamp_ntz'2030-01-01 00:00:00'"
    )
    out = periods_and_gaps(stays, "id_guest", "ds_checkin", "ds_checkout")
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("id_guest", "seg_kind", text("ds_from"), text("ds_to"))


def _imputer_fills(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cols = ["rec_id", "ds", "agent_id", "service_region", "language", "interaction_type", "tenure_days"]
    # repeated deliveries have the same content: one row each
    recs = table(spark, sf_dir, "imputer").select(*cols).distinct()
    ref = table(spark, sf_dir, "col_values")
    names = ref.select("col_name", "good_value", F.explode(F.concat(F.array("good_value"), F.coalesce("bad_values", F.array()))).alias("entry"))
    names = names.select("col_name", plain_key(F.col("entry")).alias("key"), "good_value").distinct()
    voted = recs
    for c in ("service_region", "interaction_type"):
        side = names.where(F.col("col_name") == c).groupBy(F.col("key").alias(f"_k_{c}")).agg(F.max("good_value").alias(f"_good_{c}"))
        voted = voted.withColumn(f"_k_{c}", plain_key(F.col(c))).join(broadcast_if_small(side), f"_k_{c}", "left")
    week = F.date_trunc("week", F.col("ds")).cast("date")
    day = F.unix_date(F.col("ds").cast("date")).cast("long")
    agent = F.col("agent_id")
    bad_tenure = is_missing_number(F.col("tenure_days"), 0, WORKING_LIFE_DAYS)
    specs = [
        FillSpec("service_region", is_missing_text(F.col("service_region")), F.col("_good_service_region"), [[agent]]),
        FillSpec("language", is_missing_text(F.col("language")), F.when(F.col("language").rlike("^[a-z]{2}$"), F.col("language")), [[agent]]),
        FillSpec("interaction_type", is_missing_text(F.col("interaction_type")), F.col("_good_interaction_type"), [[agent, week], [agent]]),
        FillSpec("tenure_days", bad_tenure, day - F.round("tenure_days").cast("long"), [[agent]], context=day, restore=lambda v, ctx: (ctx - v.cast("long")).cast("string"), stat="median"),
    ]
    return recs, missing_fills(voted.where(agent.isNotNull()), "rec_id", specs)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What belongs into every missing cell of the work records."""
    return _imputer_fills(spark, sf_dir)[1].select("rec_id", "field_name", "fill_value")


def p5_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The work records with the fills put in and a flag for each filled field."""
    recs, fills = _imputer_fills(spark, sf_dir)
    return apply_fills(recs, "rec_id", fills, ["service_region", "language", "interaction_type", "tenure_days"])


QUERIES = {"p2_found": p2_found, "p2_faults": p2_faults, "p3_found": p3_found, "p5_found": p5_found, "p5_filled": p5_filled}

_NO_VALUE = ", ".join(f"'{x}'" for x in NO_VALUE)

SQL = {
    "p3_found": """
with v as (
  select distinct id_guest, date_trunc('second', ds_checkin) as s, date_trunc('second', ds_checkout) as e from interview_data
  where id_guest is not null and ds_checkin >= timestamp '2016-01-01' and ds_checkout < timestamp '2030-01-01'),
w as (select *, max(e) over (partition by id_guest order by s, e rows between unbounded preceding and 1 preceding) as pm from v where e > s),
g as (select *, sum(case when pm is null or s > pm then 1 else 0 end) over (partition by id_guest order by s, e rows unbounded preceding) as k from w),
p as (select id_guest, k, min(s) as a, max(e) as z from g group by 1, 2),
q as (select *, lag(z) over (partition by id_guest order by k) as pz from p)
select id_guest, 'period' as seg_kind, strftime(a, '%Y-%m-%d %H:%M:%S') as ds_from, strftime(z, '%Y-%m-%d %H:%M:%S') as ds_to from q
union all
select id_guest, 'gap', strftime(pz, '%Y-%m-%d %H:%M:%S'), strftime(a, '%Y-%m-%d %H:%M:%S') from q where pz is not null
""",
    "p5_found": f"""
with r as (select distinct rec_id, ds, agent_id, service_region, language, interaction_type, tenure_days from imputer where agent_id is not null),
nm as (
  select distinct col_name, good_value, lower(regexp_replace(entry, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) as key from (
    select col_name, good_value, good_value as entry from col_values
    union all select col_name, good_value, unnest(bad_values) from col_values)),
nk as (select col_name, key, max(good_value) as good_value from nm group by 1, 2),
t as (
  select rec_id, agent_id, ds, 'service_region' as f, service_region as x from r
  union all select rec_id, agent_id, ds, 'language', language from r
  union all select rec_id, agent_id, ds, 'interaction_type', interaction_type from r),
k as (select *, lower(regexp_replace(x, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) as key from t),
m as (select *, x is null or key = '' or key in ({_NO_VALUE}) or regexp_full_match(x, '\\s*\\\\[Nn]\\s*') as miss from k),
c as (
  select m.rec_id, m.agent_id, m.ds, m.f, m.miss, 0 as ctx,
    case when m.miss then null when m.f = 'language' then case when regexp_full_match(m.x, '[a-z]{{2}}') then m.x end else nk.good_value end as v
  from m left join nk on nk.col_name = m.f and nk.key = m.key
  union all
  select rec_id, agent_id, ds, 'tenure_days', miss, d, case when miss then null else cast(d - cast(round(tenure_days) as bigint) as varchar) end from (
    select *, date_diff('day', date '1970-01-01', cast(ds as date)) as d,
      tenure_days is null or isnan(tenure_days) or isinf(tenure_days) or tenure_days <= 0 or tenure_days > {WORKING_LIFE_DAYS} as miss from r)),
n0 as (select agent_id, f, date_trunc('week', ds) as w, v, count(*) as n from c where v is not null and f = 'interaction_type' group by all),
b0 as (select agent_id, f, w, max_by(v, (n, v)) as v from n0 group by all),
n1 as (select agent_id, f, v, count(*) as n from c where v is not null group by all),
b1 as (select agent_id, f, max_by(v, (n, v)) as v from n1 group by all),
n2 as (select f, v, count(*) as n from c where v is not null group by all),
b2 as (select f, max_by(v, (n, v)) as v from n2 group by all)
select c.rec_id, c.f as field_name,
  case when c.f = 'tenure_days' then cast(c.ctx - cast(coalesce(b1.v, b2.v) as bigint) as varchar) else coalesce(b0.v, b1.v, b2.v) end as fill_value
from c left join b0 on b0.agent_id = c.agent_id and b0.f = c.f and b0.w = date_trunc('week', c.ds)
left join b1 on b1.agent_id = c.agent_id and b1.f = c.f left join b2 on b2.f = c.f
where c.miss
""",
}

_FIELDS = ("service_region", "language", "interaction_type", "tenure_days")
SQL["p5_filled"] = f"""
with fills as ({SQL['p5_found'].strip()}),
r as (select distinct rec_id, ds, agent_id, service_region, language, interaction_type, tenure_days from imputer)
select r.rec_id, r.ds, r.agent_id, {', '.join(f"coalesce({c}.fill_value, r.{c}) as {c}" for c in _FIELDS[:3])}, coalesce(try_cast(tenure_days.fill_value as double), r.tenure_days) as tenure_days,
  {', '.join(f"{c}.rec_id is not null as {c}_filled" for c in _FIELDS)}
from r {' '.join(f"left join (select * from fills where field_name = '{c}') {c} on {c}.rec_id = r.rec_id" for c in _FIELDS)}
"""
