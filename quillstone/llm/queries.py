"""Queries of the llm operators (problems 1, 4, 6, 7 and 8) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.missing import is_missing_text
from quillstone.llm import mixing, percentiles, quality, setsim, tokenizing
from quillstone.session import broadcast_if_small, cut, table

PERCENTILES = [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95]
COLUMNS = ["q10", "q50", "q90"]


def p1_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of the quantile columns per series key."""
    return percentiles.group_percentiles(table(spark, sf_dir, "q_fits"), "ts_key", COLUMNS, PERCENTILES, "fit_id")


def p1_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is kept per day to be combined: a row per day and key with the counts of each column's cells."""
    rows = table(spark, sf_dir, "q_fits").select("fit_id", F.col("ds").cast("date").alias("day"), "ts_key", *COLUMNS).distinct()
    return percentiles.cell_counts(rows, "ts_key", COLUMNS, ["day"])


def p1_daily_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per day, key and column the number of cells and of values that the kept counts have."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("cells")) for c in COLUMNS]))
    n = F.aggregate("v.cells", F.lit(0).cast("long"), lambda a, e: a + e["n"])
    out = p1_daily_counts(spark, sf_dir).select("day", "ts_key", each.alias("v")).where(F.size("v.cells") > 0)
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "ts_key", "v.column_name", F.size("v.cells").cast("long").alias("n_cells"), n.alias("n_values"))


def p1_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of all days from the counts kept per day (written to the shared folder and read again), within 0.8 %."""
    kept = cut(p1_daily_counts(spark, sf_dir))
    out = percentiles.cell_percentiles(percentiles.combine_counts(kept, "ts_key", COLUMNS), PERCENTILES)
    return out.select(F.col("g").alias("ts_key"), F.col("c").alias("column_name"), "p", "value", "n")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list item that each free entry of the work records means, 0 for none."""
    fields = ["service_region", "sector", "interaction_type"]
    ref = table(spark, sf_dir, "col_values").select(F.col("col_name").alias("field"), F.col("ref_id").alias("item"), "good_value", "bad_values")
    items = ref.select("field", "item", F.col("good_value").alias("name"))
    other = ref.select("field", "item", F.explode("bad_values").alias("name"))
    recs = table(spark, sf_dir, "imputer").select("rec_id", *fields).distinct()  # deliveries of a record are equal
    cells = recs.select("rec_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("entry")) for f in fields])).alias("c")).select("rec_id", "c.*")
    good = items.select("field", F.col("name").alias("entry")).distinct()
    # most cells are exactly a listed value; what is left is kept, as it is read twice
    free = cut(cells.where("entry is not null").join(broadcast_if_small(good), ["field", "entry"], "left_anti")).where(~is_missing_text(F.col("entry")))
    out = setsim.map_to_list(free, items, other)
    return out.select("rec_id", F.col("field").alias("field_name"), F.coalesce(F.col("item"), F.lit(0)).cast("long").alias("ref_id"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return tokenizing.encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text")


def p6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the bytes that a document's ids stand for are those of its text."""
    docs = table(spark, sf_dir, "documents")
    raw = tokenizing.decode_ids(p6_ids(spark, sf_dir), "doc_id", "ids")
    both = raw.join(docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text")), "doc_id")
    return both.select("doc_id", F.octet_length("raw").cast("long").alias("n_bytes"), (F.col("raw") == F.col("text")).alias("same"))


def _mix(spark: SparkSession, sf_dir: str, whole: bool = False):
    sizes = mixing.token_sizes(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    targets = table(spark, sf_dir, "mix_targets")
    total = None
    if whole:
        names = targets.select(mixing.tidy_source(F.col("source")).alias("source")).distinct()
        total = float(sizes.join(broadcast_if_small(names), "source").agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    return sizes, mixing.plan_mix(sizes, targets, total)


def p7_mix(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """The mix: documents with their copies, in random order."""
    sizes, plan = _mix(spark, sf_dir, whole)
    out = mixing.draw_mix(sizes, plan)
    return out.select(F.col("key").alias("doc_id"), "source", F.col("size").alias("n_tokens"), "copy")


def p7_mix_full_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of as many tokens as the listed sources hold, where some fall short of their share."""
    return p7_mix(spark, sf_dir, whole=True)


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares reached by the largest mix that holds every share."""
    return mixing.mix_report(*_mix(spark, sf_dir))


def p7_report_full_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares reached by a mix of as many tokens as the listed sources hold, where some fall short."""
    return mixing.mix_report(*_mix(spark, sf_dir, whole=True))


def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, posteriors and type of every document's text."""
    return quality.text_types(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")


def p8_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of characters and lines, and the share of digits, of every document's text."""
    return p8_statistics(spark, sf_dir).select("doc_id", "n_chars", "n_lines", F.round("digit_ratio", 6).alias("digit_ratio"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text is for the larger part a list, a table or junk."""
    return p8_statistics(spark, sf_dir).where("text_type <> 'prose'").select("doc_id")


QUERIES = {
    "p1_percentiles": p1_percentiles,
    "p1_daily_counts": p1_daily_counts,
    "p1_daily_sizes": p1_daily_sizes,
    "p1_combined": p1_combined,
    "p4_found": p4_found,
    "p6_ids": p6_ids,
    "p6_round_trip": p6_round_trip,
    "p7_mix": p7_mix,
    "p7_mix_full_size": p7_mix_full_size,
    "p7_report": p7_report,
    "p7_report_full_size": p7_report_full_size,
    "p8_found": p8_found,
    "p8_statistics": p8_statistics,
    "p8_counts": p8_counts,
}

_P = str(PERCENTILES)
SQL = {
    "p1_percentiles": f"""
with r as (select distinct fit_id, ts_key, q10, q50, q90 from q_fits),
u as (select ts_key, 'q10' as c, q10 as v from r union all select ts_key, 'q50', q50 from r union all select ts_key, 'q90', q90 from r),
f as (select * from u where v is not null and isfinite(v))
select ts_key, c as column_name, unnest({_P})::double as p, unnest(quantile_disc(v, {_P})) + 0.0 as value, count(*) as n from f group by 1, 2
""",
    # a value is cut to 7 bits after the leading one
    "p1_combined": f"""
with r as (select distinct fit_id, cast(ds as date) as d, ts_key, q10, q50, q90 from q_fits),
u as (select ts_key, 'q10' as c, q10 as v from r union all select ts_key, 'q50', q50 from r union all select ts_key, 'q90', q90 from r),
f as (select * from u where v is not null and isfinite(v)),
p as (select ts_key, c, unnest({_P})::double as p, unnest(quantile_disc(v, {_P})) + 0.0 as v, count(*) as n from f group by 1, 2),
s as (select *, pow(2, floor(log2(abs(v))) - 7) as w from p)
select ts_key, c as column_name, p, case when v = 0 then 0.0 else sign(v) * floor(abs(v) / w) * w end as value, n from s
""",
    "p6_round_trip": "select doc_id, strlen(coalesce(text, ''))::bigint as n_bytes, true as same from documents",
    "p8_counts": r"""
with t as (select doc_id, coalesce(text, '') as x from documents),
s as (select doc_id, length(x) as n_chars, regexp_replace(x, '(?i)</(?:tr|li|p|div|h\d)>|<br\s*/?>', chr(10), 'g') as y from t)
select doc_id, n_chars::bigint as n_chars, len(list_filter(regexp_split_to_array(y, '[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'), lambda z: regexp_matches(z, '[^\s\p{Z}\p{C}]')))::bigint as n_lines,
  round(coalesce(len(regexp_extract_all(y, '\p{N}')) / nullif(length(regexp_replace(y, '[\s\p{Z}\p{C}]', '', 'g')), 0), 0), 6) as digit_ratio from s
""",
    "p1_daily_sizes": """
with r as (select distinct fit_id, cast(ds as date) as d, ts_key, q10, q50, q90 from q_fits),
u as (select d, ts_key, 'q10' as c, q10 as v from r union all select d, ts_key, 'q50', q50 from r union all select d, ts_key, 'q90', q90 from r),
f as (select d, ts_key, c, case when v = 0 then 0.0 else sign(v) * floor(abs(v) / pow(2, floor(log2(abs(v))) - 7)) * pow(2, floor(log2(abs(v))) - 7) end as cell from u where v is not null and isfinite(v))
select strftime(d, '%Y-%m-%d') as day, ts_key, c as column_name, count(distinct cell) as n_cells, count(*) as n_values from f group by all
""",
}
