"""Hand-made frames: nulls, NaN, ties, constants, empty tables, repeated rows."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.functions import dates
from quillstone.operators import aggregate, bins, clean, generate, impute, outliers, smooth, windows

NAN = float("nan")


def vals(df, *cols):
    return sorted((tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()), key=str)


def test_trim_keeps_nulls_and_bounds(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (4, 4.0), (5, 100.0), (6, None), (7, NAN)], "id int, x double")
    assert vals(clean.trim_df(df, ["x"]), "id") == [1, 2, 3, 4, 6, 7]
    assert vals(clean.trim_df(df, ["x"], upr=False), "id") == [1, 2, 3, 4, 5, 6, 7]
    assert vals(clean.trim_df(df, ["x"], qtiles=(0.75, 0.25)), "id") == [1, 2, 3, 4, 6, 7]
    assert clean.trim_df(df.limit(0), ["x"]).count() == 0
    assert clean.trim_df(df.where("x is null"), ["x"]).count() == 1


def test_trim_by_group(spark):
    df = spark.createDataFrame([(g, float(i)) for g in "ab" for i in range(8)] + [("a", 90.0)], "g string, x double")
    assert clean.trim_df(df, ["x"], by=["g"]).count() == 16


def test_drop_cols(spark):
    df = spark.createDataFrame([(1, "a", None, 1, NAN), (2, "a", None, None, 2.0)], "id int, same string, none int, some int, x double")
    assert clean.drop_cols(df).columns == ["id", "x"]
    assert clean.drop_cols(df.limit(0)).columns == []


def test_clean_cols_and_new_values(spark):
    df = spark.createDataFrame([("b1", "nan"), ("good", "_drop"), ("zz", "k"), (None, "other")], "c string, d string")
    conf = {"c": {"good": ["b1", "b2"]}, "absent": {"x": ["y"]}}
    out = clean.clean_cols(df, conf, do_nan=True)
    assert vals(out, "c", "d") == sorted([("good", None), ("good", None), ("zz", "k"), (None, None)], key=str)
    assert vals(clean.new_values(df, conf), "col_name", "value") == [("c", "zz")]
    assert clean.clean_cols(df, {}, renames={"c": "e"}).columns == ["e", "d"]
    with pytest.raises(ValueError):
        clean.clean_cols(df, {}, renames={"c": "d"})
    assert clean.flip_values({"g": ["b"], "h": ["b"]}) == {"b": "h"}


def test_nested_update(spark):
    kind = T.MapType(T.StringType(), T.MapType(T.StringType(), T.IntegerType()))
    df = spark.createDataFrame([({"a": {"x": 1, "y": None}, "b": {"z": 2}},)], T.StructType([T.StructField("m", kind)]))
    assert df.select(clean.nested_update(F.col("m"), kind, 1, 9)).first()[0] == {"a": {"x": 9, "y": None}, "b": {"z": 2}}
    assert df.select(clean.nested_update(F.col("m"), kind, None, 0)).first()[0] == {"a": {"x": 1, "y": 0}, "b": {"z": 2}}
    with pytest.raises(TypeError):
        clean.nested_update(F.col("m"), kind, {}, 1)


def test_flatten_json(spark):
    docs = ['{"a": {"p": {"d": 1, "e": 2}, "q": 3}, "b": {"p": {"d": 4}}}', "not json", None, "{}"]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "id int, j string")
    out = clean.flatten_json(df, "id", "j", ["x", "y", "z", "val"])
    assert vals(out, "x", "y", "z", "val") == [("a", "p", "d", "1"), ("a", "p", "e", "2"), ("b", "p", "d", "4")]
    assert vals(clean.flatten_json(df, "id", "j", key_depth=2), "k1", "k2", "value") == [("a", "q", "3")]
    with pytest.raises(ValueError):
        clean.flatten_json(df, "id", "j", ["x", "val"])
    assert clean.flatten_json(df.limit(0), "id", "j").count() == 0


def test_num_dedup(spark):
    df = spark.createDataFrame([("a", 100.0), ("a", 100.1), ("b", 1.0), ("b", 9.0), ("c", -1.0), ("c", 1.0), ("d", 5.0), (None, 3.0), ("e", None)], "k string, y double")
    ded, dup = clean.num_dedup(df, ["k"], "y", 0.01)
    assert [(k, y and round(y, 6)) for k, y in vals(ded, "k", "y")] == [("a", 100.05), ("d", 5.0), ("e", None)]
    assert vals(dup, "k", "y") == sorted([("b", 1.0), ("b", 9.0), ("c", -1.0), ("c", 1.0)], key=str)


def test_interpolate(spark):
    rows = [("a", i, v) for i, v in enumerate([None, 1.0, None, None, 4.0, 5.0, NAN, 7.0, 8.0, 9.0, 10.0, 11.0, 12.0, 13.0, 14.0, 15.0, 16.0, 17.0, 18.0, None])]
    rows += [("b", 0, None), ("b", 1, 2.0)]
    out = clean.interpolate(spark.createDataFrame(rows, "g string, i int, x double"), "i", "x", ["g"], nan_pct=0.3)
    got = [r["x"] for r in out.where("g = 'a'").orderBy("i").collect()]
    assert got == pytest.approx([1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 18])
    assert vals(out.where("g = 'b'"), "x") == [None, None]


def test_lists_means_hist(spark):
    df = spark.createDataFrame([("a", 2, None, 1.0), ("a", 1, "x", 3.0), ("b", 1, "y", 0.0), ("b", 2, "z", NAN)], "g string, o int, v string, w double")
    assert dict(vals(aggregate.list_gb(df, ["g"], "v", ["o"]), "g", "v")) == {"a": ["x", None], "b": ["y", "z"]}
    m = {r["g"]: r["m"] for r in df.groupBy("g").agg(aggregate.w_mean("o", "w").alias("m")).collect()}
    assert m["a"] == pytest.approx(5 / 4) and m["b"] is None
    h = aggregate.df_hist(df.where("g = 'a'").na.fill("n", ["v"]), "v", "w", "g", ["x", "n", "q"]).first()
    assert (h["v:x"], h["v:n"], h["v:q"], h["w"]) == (0.75, 0.25, 0.0, 4.0)


def test_counts_masses_inspect(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (2.0,), (None,), (NAN,)], "x double")
    assert vals(aggregate.point_masses(df, "x", 0.5), "value") == [1.0]
    assert aggregate.update_mass({1.0: 0.5}, 1.00001, 0.1) == {1.0: 0.6} and 3.0 in aggregate.update_mass({1.0: 0.5}, 3.0, 0.1)
    r = aggregate.df_inspect(df, approx=False).first()
    assert (r["n_rows"], r["nulls"], r["mean"]) == (5, 2, pytest.approx(4 / 3))
    assert vals(aggregate.top_k(df.where("x = 1 or x = 2"), ["x"], 1), "x", "n") == [(1.0, 2)]


def test_bins(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)] + [(None,)], "x double")
    assert [r["bin"] for r in bins.with_size_bins(df, "x", 3).orderBy("x").collect()] == [None, 0, 0, 0, 0, 1, 1, 1, 2, 2, 2]
    assert [r["bin"] for r in bins.with_count_bins(df, "x", 4).where("x is not null").orderBy("x").collect()] == [0, 0, 0, 1, 1, 2, 2, 3, 3, 3]
    same = spark.createDataFrame([(5.0,)] * 3, "x double")
    assert vals(bins.with_size_bins(same, "x", 3), "bin") == [0, 0, 0]
    assert bins.get_sz_bins(df.limit(0), "x", 3).count() == 0


def test_bin_values_heavy_value_and_shares(spark):
    df = spark.createDataFrame([(0.0, "a")] * 50 + [(float(i), "b" if i % 2 else "a") for i in range(1, 51)], "x double, c string")
    out = bins.get_cnt_bins(df, "x", 4)
    rows = {r["bin"]: r for r in out.collect()}
    assert sum(r["bin_prob"] for r in rows.values()) == pytest.approx(1)
    assert rows[max(rows)]["x"] == 0.0 and rows[max(rows)]["bin_prob"] == 0.5 and len(rows) == 3
    cut = bins.get_cnt_bins(df, "x", 4, thres=0.6)
    assert "c::a" in cut.columns and "c::b" not in cut.columns and "c::other" in cut.columns
    assert all(r["c::a"] + r["c::other"] == pytest.approx(1) for r in cut.collect())


def test_joins_stack_first(spark):
    a, b = spark.createDataFrame([(1, 2)], "k int, v int"), spark.createDataFrame([(1, 3), (2, 4)], "k int, v int")
    assert aggregate.suffix_join(a, b, ["k"]).collect() == [(1, 2, 3)]
    assert aggregate.multi_merge([a, b.withColumnRenamed("v", "w")], ["k"]).count() == 2
    assert aggregate.stack(a, b.withColumn("z", F.lit(1))).count() == 3
    assert vals(aggregate.first_per_key(a.unionByName(a.withColumn("v", F.lit(1))), ["k"], ["v"]), "v") == [1]


def test_trips(spark):
    d = lambda s: dt.datetime.fromisoformat(s)
    rows = [(1, d("2020-01-01"), d("2020-01-05"), d("2019-12-01"), "x"), (1, d("2020-01-08"), d("2020-01-09"), d("2019-11-01"), "y"), (1, d("2020-01-13"), d("2020-01-14"), d("2019-10-01"), "x"), (1, d("2020-01-02"), d("2020-01-03"), d("2019-12-05"), None), (2, None, d("2020-01-03"), None, "z")]
    out = windows.user_trips(spark.createDataFrame(rows, "id_guest long, ds_checkin timestamp_ntz, ds_checkout timestamp_ntz, ds_book timestamp_ntz, dim_market string"))
    got = {(r["guest"], r["first_home_ds_checkin"].day): (r["first_ds_book"].month, r["dim_markets"]) for r in out.collect()}
    assert got == {(1, 1): (11, ["x", "y"]), (1, 13): (10, ["x"])}


def test_plot_by_year_takes_every_year_of_the_data(spark):
    days = [("1995-01-01", 1.0), ("1995-01-02", 2.0), ("1995-12-30", 3.0), ("1997-01-01", 4.0), ("1997-12-25", 5.0), ("2001-01-03", 6.0)]
    df = spark.createDataFrame(days, "d string, y double").withColumn("d", F.to_date("d"))
    out = windows.plot_by_year(df, ["y"], "d").orderBy("iso_nbr")
    assert out.columns == ["iso_nbr", "d", "1994_y", "1995_y", "1997_y", "2001_y"]
    got = [(r["iso_nbr"], str(r["d"]), *r[2:]) for r in out.collect()]
    assert got == [(1, "1995-01-02", None, 2.0, 4.0, 6.0), (52, "1995-12-30", 1.0, 3.0, 5.0, None)]


def test_week_start(spark):
    sat = spark.createDataFrame([(dt.date(2020, 1, 4) + dt.timedelta(days=7 * i),) for i in range(8)], "ds date")
    out = windows.set_week_start(sat)
    assert min(vals(out, "ds_week_starting")) == dt.date(2019, 12, 29) and min(vals(out, "ds")) == dt.date(2019, 12, 29)
    daily = spark.createDataFrame([(dt.date(2020, 1, 1) + dt.timedelta(days=i),) for i in range(20)], "ds date")
    assert windows.set_week_start(daily).columns == ["ds"]
    ending = sat.withColumn("ds_week_ending", F.col("ds"))
    assert min(vals(windows.set_week_start(ending), "ds_week_starting")) == dt.date(2019, 12, 29)
    with pytest.raises(ValueError):
        windows.set_week_start(spark.createDataFrame([(dt.date(2020, 1, 1),)], "ds date"))


def test_date_windows_cover_every_day(spark):
    for freq in "DWM":
        w = sorted(windows.set_date_range(spark, "2020-01-08", "2020-03-19", freq).collect())
        assert w[0]["start"] == dt.date(2020, 1, 8) and w[-1]["end"] == dt.date(2020, 3, 19)
        assert all((b["start"] - a["end"]).days == 1 for a, b in zip(w, w[1:]))


def test_date_formats(spark):
    cases = {"2020-03-05": "yyyy-MM-dd", "2020-03": "yyyy-MM", "2020-03-05 10:11:12": "yyyy-MM-dd HH:mm:ss", "Thu, 05 Mar 2020 10:11:12 +0000": "EEE, dd MMM yyyy HH:mm:ss Z", "3/5/20": "M/d/yy", "03/05/2020": "M/d/yyyy", "2020-03-05T10:11:12Z": "yyyy-MM-dd'T'HH:mm:ss'Z'", "2020-03-05 10:11": "yyyy-MM-dd HH:mm", "hello": None, "": None}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()] + [(None, None)], "s string, want string").withColumn("got", dates.get_date_format(F.col("s")))
    assert [(r["s"], r["got"]) for r in df.where("not (got <=> want)").collect()] == []


def test_date_scalars(spark):
    one = spark.createDataFrame([("2020-01-31", "2020-03-30", 1583000000)], "a string, b string, e long")
    d = lambda c: F.to_date(c)
    r = one.select(
        dates.add_months(F.col("a"), 1).alias("m"), dates.days_diff(d("a"), d("b")).alias("dd"), dates.months_diff(d("a"), d("b")).alias("md"), dates.date_range(F.col("a"), F.lit("2020-02-03")).alias("r"), dates.date_range(F.lit("2020-01"), F.lit("2020-04"), "yyyy-MM").alias("rm"),
        dates.date_range(F.col("b"), F.col("a")).alias("none"), dates.from_epoch(F.col("e"), "yyyy-MM-dd HH:mm", "America/Los_Angeles").alias("l"), dates.utc_shift_hours(F.timestamp_seconds("e"), "America/Los_Angeles").alias("sh"), dates.iso_weeks_in_year(F.lit(2020)).alias("w"), dates.to_epoch(F.col("a")).alias("ep"),
    ).first()
    assert (r["m"], r["dd"], r["md"], r["r"], r["rm"], r["none"]) == ("2020-02-29", 59, 1, ["2020-01-31", "2020-02-01", "2020-02-02"], ["2020-01", "2020-02", "2020-03"], [])
    assert (r["l"], r["sh"], r["w"], r["ep"]) == ("2020-02-29 10:13", -8.0, 53, 1580457600)


def test_outliers(spark):
    rows = [("a", dt.datetime(2020, 1, 1) + dt.timedelta(days=i), 10 + 0.1 * i + (i % 3) * 0.01 + (50 if i == 20 else 0)) for i in range(60)] + [("b", dt.datetime(2020, 1, 1), 5.0)]
    df = spark.createDataFrame(rows, "g string, ds timestamp_ntz, y double")
    out, share = outliers.ts_outliers(df, ["g"], "ds", "y")
    bad = out.where("is_outlier").collect()
    assert [r["ds"].day for r in bad] == [21] and bad[0]["y"] is None and out.where("y is null").count() == 1
    assert {r["g"]: r["pct_outliers"] for r in share.collect()} == {"a": pytest.approx(1.67), "b": None}
    rep = outliers.ts_outliers(df, ["g"], "ds", "y", replace=True)[0].where("is_outlier").first()
    assert 10 < rep["y"] < 35
    assert outliers.ts_outliers(df, ["g"], "ds", "y", ignore_dates=["2020-01-21"])[0].where("is_outlier").count() == 0


def test_loess(spark):
    rows = [("a", float(i), 2.0 * i + 1 + (30 if i == 15 else 0)) for i in range(40)]
    out = smooth.loess(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y", 0.5)
    assert max(abs(r["smooth"] - (2 * r["x"] + 1)) for r in out.collect()) < 0.5
    best = smooth.opt_loess(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y", (0.3, 0.6))
    assert best.count() == 40 and best.first()["f_opt"] in (0.3, 0.6)


def test_impute_sample(spark):
    rows = [(1.0, "x", 1.5, "Mon", None), (2.0, "y", 2.3, "Tues", None), (None, None, 5.2, "Wed", "a"), (4.0, None, 3.0, "Thurs", "bb"), (5.0, "z", None, "Fri", "a"), (6.0, "x", None, "Sat", "a"), (7.0, "z", 5.2, "Sun", "bb")]
    df = spark.createDataFrame(rows, "a double, b string, c double, ds string, d string")
    out = impute.impute(df, ex_cols=["ds"], rounds=3)
    assert out.columns == ["ds", "b", "d", "a", "c"] and out.count() == 7
    assert out.where("a is null or b is null or c is null or d is null").count() == 0
    got = {r["ds"]: r for r in out.collect()}
    assert got["Mon"]["a"] == 1.0 and got["Sun"]["d"] == "bb" and 1.5 <= got["Fri"]["c"] <= 5.2 and 1 <= got["Wed"]["a"] <= 7
    full = df.na.drop()
    assert impute.impute(full, ex_cols=["ds"]).count() == full.count()


def test_series_is_reproducible_and_centred(spark):
    make = lambda n: generate.time_series(spark, 300, [("w", 7, 2)], [30], t_size=2, trend_cpt=1, level_cpt=2, noise=0.1, bounds=(0, 1), seed=n)
    a, b = make(1).toPandas().sort_values("t"), make(1).repartition(7).toPandas().sort_values("t")
    assert a.y.tolist() == b.y.tolist() and a.y.between(0, 1).all()
    assert abs(a.season.mean()) < 1e-9 and abs(a.level.mean()) < 1e-9 and (a.event > 0).sum() >= 9
    flat = generate.time_series(spark, 10, [("y", 90, 1)])
    assert {r["y"] for r in flat.collect()} == {0.0}
    p = spark.range(20_000).select(generate.poisson(F.lit(3.0), generate.hash_uniform(5, F.col("id"))).alias("k")).agg(F.avg("k"), F.variance("k")).first()
    assert p[0] == pytest.approx(3, abs=0.06) and p[1] == pytest.approx(3, abs=0.15) and not math.isnan(p[0])


def test_map_args(spark):
    from quillstone.operators.parallel import map_args

    out = map_args(spark, lambda a, b: {"s": a + b} if b else None, [(1, 2), (3, 0), (5, 6)], "s long")
    assert vals(out, "s") == [11, 3]
    assert map_args(spark, lambda a: {"s": a}, [], "s long").count() == 0


def test_regression_and_changes(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 5.0), (3.0, None), (NAN, 1.0)], "x double, y double")
    r = aggregate.regression(df, "x", "y").first()
    assert (r["slope"], r["intercept"], r["n"]) == (pytest.approx(2), pytest.approx(1), 2)
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "k int"), spark.createDataFrame([(1,), (3,)], "k int")
    new, gone, both = aggregate.column_changes(a, b)
    assert (vals(new, "k"), vals(gone, "k"), vals(both, "k")) == ([3], [1, 2], [1])


def test_baseline_follows_a_change_of_trend(spark):
    """A slope that changes half way is no stretch of outliers; a spike on it is one."""
    import datetime as dt
    import random

    rnd = random.Random(4)
    rows = [("s", dt.datetime(2023, 1, 1) + dt.timedelta(days=i), 100 + 0.5 * i + (6.0 * (i - 100) if i > 100 else 0) + rnd.gauss(0, 4) + (400 if i == 150 else 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, y double")
    from quillstone.operators import outliers

    got = {r["ts"].timetuple().tm_yday - 1 for r in outliers.ts_outliers(df, ["k"], "ts", "y")[0].where("is_outlier").collect()}
    assert 150 in got and len(got) <= 4
    straight = outliers.linear_baseline(df.where("ts < timestamp'2023-04-10'"), ["k"], "ts", "y")
    assert straight.agg({"yhat": "count"}).first()[0] == 99
