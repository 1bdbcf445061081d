import datetime as dt
import gzip

import pytest
from pyspark.sql import functions as F

from quillstone.sources import files
from quillstone.sources.status import TaskTracker, latest_status


def test_role_typed_csv(spark, tmp_path):
    p = tmp_path / "a.csv.gz"
    p.write_bytes(gzip.compress(b"d,s,n,b,c,x\n2020-01-02,NA,1.5,1,k,z\n1583000000,n/a,oops,True,,z\nbad,null,3,0,m,\n"))
    df = files.get_data(spark, str(p), date_cols=["d"], str_cols=["s"], num_cols=["n"], b_cols=["b"], cat_cols=["c"])
    assert df.columns == ["d", "s", "c", "n", "b"]
    got = [tuple(r) for r in df.collect()]
    assert [g[1:] for g in got] == [("NA", "k", 1.5, True), ("nan", "nan", None, True), ("nan", "m", 3.0, False)]
    assert got[0][0] == dt.datetime(2020, 1, 2) and got[1][0].year == 2020 and got[2][0] is None
    assert "x" in files.get_data(spark, str(p), num_cols=["n"], other_cols=None).columns
    assert files.get_data(spark, str(p), usecols=["d"], date_cols=["d"], date_format="yyyy-MM-dd").where("d is not null").count() == 1


def test_to_bool(spark):
    df = spark.createDataFrame([("1",), ("False",), (None,)], "b string")
    assert [r[0] for r in files.to_bool(df, "b").collect()] == [True, False, None]
    odd = spark.createDataFrame([("1",), ("maybe",)], "b string")
    assert files.to_bool(odd, "b").schema["b"].dataType.simpleString() == "string"
    assert [r[0] for r in files.to_bool(odd, "b", strict=True).collect()] == [True, None]


def test_save_and_read(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "i int, s string")
    base = str(tmp_path / "v1.2" / "t")
    assert files.save_df(df, base + ".csv.gz") == base + ".par"
    assert files.read_df(spark, base).collect() == df.collect()
    (tmp_path / "u.tsv").write_text("i\ts\n1\ta\n")
    assert files.read_df(spark, str(tmp_path / "u")).collect() == [("1", "a")]
    assert files.read_df(spark, str(tmp_path / "none")) is None
    odd = df.select(F.expr("interval 1 month").alias("v"))
    assert files.save_df(odd, str(tmp_path / "odd")).endswith((".par", ".csv.gz"))


def test_json_cells_and_lines(spark, tmp_path):
    df = spark.createDataFrame([(1, {"a": 1}, [1, 2], None), (2, None, None, 2.5)], "i int, m map<string,int>, l array<int>, x double")
    p = str(tmp_path / "p.par.gz")
    files.to_parquet(df, p, ["m", "l"])
    back = files.from_parquet(spark, p, {"m": "map<string,int>", "l": "array<int>"}).orderBy("i")
    assert back.collect() == df.orderBy("i").collect()
    assert files.from_parquet(spark, p, ["m", "missing"]).count() == 2
    q = str(tmp_path / "j.json.gz")
    files.write_json_lines(df, q)
    assert files.read_json_lines(spark, q, df.schema).orderBy("i").collect() == df.orderBy("i").collect()


def test_delimited_lines(spark):
    lines = spark.createDataFrame([("t.a|t.b",), ("1|x",), ("1|x|y",), ("t.a|t.b",), (None,), ("|",)], "value string")
    good, dropped = files.to_df(lines, "t.a|t.b", "|")
    assert good.columns == ["a", "b"] and sorted(map(tuple, good.collect())) == [("", ""), ("1", "x")] and dropped.first()[0] == 1


def test_sessions(spark, tmp_path):
    p = tmp_path / "s.csv"
    p.write_text("a1,2020-01-01 10:00:00,12.0,30,x\na1,2020-01-01 11:00:00,,5,x\na1,2020-01-02 09:00:00,12,10,x\n")
    df = files.read_sessions(spark, str(p))
    assert sorted(r["id_ticket"] for r in df.collect()) == ["12", "12", "NULL"]
    s = files.session_summary(df).first()
    assert (s["n_rows"], s["tickets"], s["secs"], s["null_rows"]) == (3, 2, 45.0, pytest.approx(1 / 3))
    later = df.withColumn("ts_session_start", F.col("ts_session_start") + F.expr("interval 25 hours"))
    r = files.reconcile_sessions(df, later).where("id_ticket = '12'").first()
    assert (r["secs_ratio"], r["start_diff"], r["start_diff_in_day"]) == (1.0, 90000, 3600)


def test_ticks(spark):
    df = spark.range(9).select(F.col("id").cast("double").alias("x"))
    assert [r["tick"] for r in files.plot_ticks(df, "x").orderBy("i").collect()] == [0, 2, 4, 6, 8]
    assert [r["tick"] for r in files.plot_ticks(df.limit(1), "x").collect()] == [0]
    assert files.plot_ticks(df.limit(0), "x").count() == 0
    assert tuple(files.plot_limits(df, "x").first()) == (0.0, pytest.approx(8.4))


def test_status(spark, tmp_path):
    t = TaskTracker(spark, str(tmp_path / "st"), "load", "2020-01-01")
    t.set_started()
    t.finish(0)
    u = TaskTracker(spark, str(tmp_path / "st"), "it's", "2020-01-01")
    u.set_started()
    with pytest.raises(RuntimeError):
        u.finish(3, "broke")
    got = {r["task"]: r["status"] for r in latest_status(spark, str(tmp_path / "st")).collect()}
    assert got == {"load": "success", "it's": "failure"}
