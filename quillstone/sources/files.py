"""Reading and writing: role-typed CSV, Parquet with JSON cells, JSON lines, delimited text, sessions.

Paths are any that Hadoop file systems take (``s3a://`` with the cluster's credential providers;
keys are never parsed or stored here). Compression is a writer option; readers take gzip as it is.
"""

from __future__ import annotations

import logging
import os
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.operators.quantiles import column_quantiles

log = logging.getLogger("quillstone")

# Tokens read as null. The bare token NA is data.
NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "#1.#IND", "1.#QNAN", "N/A", "NULL", "NaN", "n/a", "nan", "null", "undefined", "unknown")
TRUE, FALSE = ("1", "1.0", "True", "true"), ("0", "0.0", "False", "false")


def to_bool(df: DataFrame, col: str, strict: bool = False) -> DataFrame:
    """0/1/True/False to boolean, null stays null; with any other value the column stays as it is.

    ``strict``: other values become null instead, without looking at the data first.
    """
    c = F.trim(F.col(col).cast("string"))
    made = F.when(c.isin(*TRUE), F.lit(True)).when(c.isin(*FALSE), F.lit(False))
    if strict:
        return df.withColumn(col, made)
    ok = df.agg(F.coalesce(F.bool_and(F.coalesce(c.isin(*TRUE, *FALSE), F.lit(True))), F.lit(True)).alias("ok")).first()["ok"]
    if not ok:
        log.warning("column %s has values that are not boolean", col)
        return df
    return df.withColumn(col, made)


def to_time(c: Column, fmt: str | None = None) -> Column:
    """Timestamp by the format, else epoch seconds, else ISO text; null where neither fits."""
    if fmt:
        return F.try_to_timestamp(c, F.lit(fmt))
    number = c.try_cast("double")
    return F.when(number.isNotNull(), F.timestamp_seconds(number)).otherwise(c.try_cast("timestamp"))


def typed(df: DataFrame, date_format: str | None = None, date_cols: Sequence[str] = (), str_cols: Sequence[str] = (), num_cols: Sequence[str] = (), b_cols: Sequence[str] = (), cat_cols: Sequence[str] = (), other_cols: Sequence[str] | None = (), null_text: str | None = "nan") -> DataFrame:
    """All-string columns in their roles, in the order other, date, str, cat, num, bool.

    Null tokens become null; numbers and dates that do not parse as well. Null strings and categories
    become ``null_text`` (None keeps null). ``other_cols`` None keeps unlisted columns, else they go.
    """
    listed = [*date_cols, *str_cols, *num_cols, *b_cols, *cat_cols]
    others = [c for c in df.columns if c not in listed] if other_cols is None else list(other_cols)
    raw = lambda c: F.when(~F.col(f"`{c}`").isin(*NULL_TOKENS), F.col(f"`{c}`"))
    text = lambda c: (F.coalesce(raw(c), F.lit(null_text)) if null_text is not None else raw(c)).alias(c)
    out = df.select(*[raw(c).alias(c) for c in others], *[to_time(raw(c), date_format).alias(c) for c in date_cols], *[text(c) for c in str_cols], *[text(c) for c in cat_cols], *[raw(c).try_cast("double").alias(c) for c in num_cols], *[raw(c).alias(c) for c in b_cols])
    for c in b_cols:
        out = to_bool(out, c)
    return out


def get_data(spark: SparkSession, path: str, usecols: Sequence[str] | None = None, sep: str = ",", **roles) -> DataFrame:
    """A CSV file with header, read as strings and brought into roles (see ``typed``)."""
    df = spark.read.csv(path, header=True, sep=sep, inferSchema=False)
    return typed(df.select(*usecols) if usecols else df, **roles)


def suffix(path: str) -> str:
    """'par', 'csv', 'tsv' or '' by the end of the name, without .gz."""
    name = os.path.basename(path.rstrip("/"))
    name = name[:-3] if name.endswith(".gz") else name
    ext = name.rsplit(".", 1)[-1] if "." in name else ""
    return {"par": "par", "parquet": "par", "csv": "csv", "tsv": "tsv"}.get(ext, "")


def strip_suffix(path: str) -> str:
    """The path without a known suffix; other dots stay."""
    for end in (".csv.gz", ".tsv.gz", ".parquet", ".par", ".csv", ".tsv", ".gz"):
        if path.endswith(end):
            return path[: -len(end)]
    return path


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_df(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame | None:
    """By suffix Parquet, CSV or TSV (gzip too); without one the first present of .par .csv .tsv .csv.gz .tsv.gz; None if missing."""
    tries = [path] if suffix(path) else [path + e for e in (".par", ".csv", ".tsv", ".csv.gz", ".tsv.gz")]
    for p in tries:
        if _exists(spark, p):
            kind = suffix(p)
            return spark.read.parquet(p) if kind == "par" else spark.read.csv(p, header=True, sep=sep or ("\t" if kind == "tsv" else ","))
    log.warning("no file at %s", path)
    return None


def save_df(df: DataFrame, path: str, sep: str = ",") -> str:
    """Parquet at ``path.par``; where Parquet cannot hold the columns gzip CSV at ``path.csv.gz``. Returns the path."""
    base = strip_suffix(path)
    try:
        df.write.mode("overwrite").parquet(base + ".par")
        return base + ".par"
    except AnalysisException as e:  # the columns do not fit; failures of the work itself are not caught
        log.warning("no Parquet at %s: %s", base, str(e)[:200])
        flat = df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f.name).cast("string") for f in df.schema.fields])
        flat.write.mode("overwrite").option("compression", "gzip").csv(base + ".csv.gz", header=True, sep=sep)
        return base + ".csv.gz"


def to_parquet(df: DataFrame, path: str, str_cols: Sequence[str] = (), compression: str | None = None) -> None:
    """Writes Parquet with ``str_cols`` as JSON text; gzip if the path says .gz."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    nested = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
    cells = {c: F.to_json(c) if isinstance(kinds[c], nested) else F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2) for c in str_cols if c in kinds}
    df.withColumns(cells).write.mode("overwrite").option("compression", compression or ("gzip" if ".gz" in path else "snappy")).parquet(path)


def from_parquet(spark: SparkSession, path: str, str_cols: dict[str, str] | Sequence[str] = ()) -> DataFrame:
    """Reads Parquet; JSON text columns with a schema are parsed by it, those without become variants."""
    df = spark.read.parquet(path)
    schemas = str_cols if isinstance(str_cols, dict) else dict.fromkeys(str_cols)
    made = {}
    for c, s in schemas.items():
        if c not in df.columns:
            log.warning("no column %s in %s", c, path)
            continue
        made[c] = F.from_json(c, s) if s else F.try_parse_json(c)
    return df.withColumns(made) if made else df


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line; gzip if the path ends in .gz. Nulls are written."""
    df.write.mode("overwrite").option("compression", "gzip" if path.endswith(".gz") else "none").option("ignoreNullFields", "false").json(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    r = spark.read
    return (r.schema(schema) if schema else r).json(path)


def to_df(lines: DataFrame, header: str, sep: str = "\t", col: str = "value", cols: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(all-string rows of delimited lines, count of the lines dropped for a wrong number of fields).

    A ``table.`` prefix of header names is stripped; lines equal to the header are no rows.
    """
    names = list(cols) if cols else [h.strip().rsplit(".", 1)[-1] for h in header.split(sep)]
    parts = F.split(F.col(col), "\\Q" + sep + "\\E", -1)
    split = lines.where(F.col(col).isNotNull() & (F.col(col) != header)).withColumn("_p", parts)
    good = split.where(F.size("_p") == len(names)).select(*[F.get("_p", F.lit(i)).alias(n) for i, n in enumerate(names)])
    return good, split.agg(F.count_if(F.size("_p") != len(names)).alias("dropped"))


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Headerless ticket sessions: agent, start, ticket ('NULL' where blank), seconds."""
    raw = spark.read.schema("id_agent string, ts_session_start string, id_ticket string, seconds_in_ticket double, ds string").csv(path)
    return clean_sessions(raw)


def clean_sessions(raw: DataFrame) -> DataFrame:
    t = F.trim(F.coalesce(F.col("id_ticket"), F.lit("")))
    number = t.try_cast("double")
    ticket = F.when((t == "") | F.lower(t).isin("nan", "null"), F.lit("NULL")).when(number.isNotNull(), number.cast("long").cast("string")).otherwise(t)
    return raw.select("id_agent", F.col("ts_session_start").try_cast("timestamp").alias("ts_session_start"), ticket.alias("id_ticket"), "seconds_in_ticket")


def session_summary(df: DataFrame) -> DataFrame:
    """One row: rows, agents, tickets, seconds, and the share of rows and of time without ticket."""
    null = F.col("id_ticket") == "NULL"
    s = F.sum("seconds_in_ticket")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("id_agent").alias("agents"), F.count_distinct("id_ticket").alias("tickets"), s.alias("secs"), F.avg(null.cast("double")).alias("null_rows"), F.try_divide(F.sum(F.when(null, F.col("seconds_in_ticket")).otherwise(0.0)), s).alias("null_secs"))


def session_groups(df: DataFrame) -> DataFrame:
    """Per agent and ticket: seconds, first and last start, count."""
    return df.groupBy("id_agent", "id_ticket").agg(F.sum("seconds_in_ticket").alias("seconds_in_ticket"), F.min("ts_session_start").alias("ts_start"), F.max("ts_session_start").alias("ts_end"), F.count(F.lit(1)).alias("n_sessions"))


def reconcile_sessions(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both sources' groups side by side, with ratios and second differences (total, and within the day)."""
    from quillstone.operators.aggregate import suffix_join

    j = suffix_join(session_groups(a), session_groups(b), ["id_agent", "id_ticket"])
    diff = lambda c: F.unix_timestamp(f"{c}_2") - F.unix_timestamp(f"{c}_1")
    return j.withColumns({
        "secs_ratio": F.try_divide(F.col("seconds_in_ticket_2"), F.col("seconds_in_ticket_1")),
        "cnt_ratio": F.try_divide(F.col("n_sessions_2").cast("double"), F.col("n_sessions_1").cast("double")),
        "start_diff": diff("ts_start"), "end_diff": diff("ts_end"),
        "start_diff_in_day": F.pmod(diff("ts_start"), F.lit(86400)), "end_diff_in_day": F.pmod(diff("ts_end"), F.lit(86400)),
    })


def plot_ticks(df: DataFrame, col: str) -> DataFrame:
    """``i, tick``: 5, 3, 2 or 1 quantile ticks by the number of values, for an axis."""
    n = df.agg(F.count(F.nanvl(F.col(col).cast("double"), F.lit(None).cast("double")))).first()[0]
    at = [0.0, 0.25, 0.5, 0.75, 1.0] if n > 5 else [0.0, 0.5, 1.0] if n >= 3 else [0.0, 1.0] if n == 2 else [0.5]
    ticks = column_quantiles(df, [col], at)[col] or []
    return df.sparkSession.createDataFrame(list(enumerate(ticks)), "i int, tick double")


def plot_limits(df: DataFrame, col: str, margin: float = 0.05) -> DataFrame:
    """``lo, hi``: axis limits with a margin on both ends."""
    x = F.col(col).cast("double")
    return df.agg((F.min(x) - margin * F.abs(F.min(x))).alias("lo"), (F.max(x) + margin * F.abs(F.max(x))).alias("hi"))
