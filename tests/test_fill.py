from pyspark.sql import functions as F

from quillstone.functions.missing import is_missing_number, is_missing_text
from quillstone.operators.fill import FillSpec, apply_fills, missing_fills

SCHEMA = "id long, agent string, region string, day long, tenure double, f string, v string, n string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def specs(stat="mode"):
    c = F.col
    return [
        FillSpec("region", is_missing_text(c("region")), c("region"), [[c("agent"), c("day")], [c("agent")]], stat=stat),
        FillSpec("tenure", is_missing_number(c("tenure"), 0, 20000), c("day") - c("tenure").cast("long"), [[c("agent")]], context=c("day"), restore=lambda v, x: (x - v.cast("long")).cast("string")),
    ]


def fills(df, **kw):
    kw = {"min_support": 1} | kw
    return {(r["id"], r["field_name"]): (r["fill_value"], r["fill_level"], r["fill_support"]) for r in missing_fills(df, "id", specs(), **kw).collect()}


def test_missing_words(spark):
    rows = [(None, True), ("", True), ("  ", True), ("_drop", True), ("N/A", True), ("??", True), ("Other ", True), ("keine Angabe", True), ("Ostervik", False), ("nano", False), ("0", False)]
    df = spark.createDataFrame(rows, "x string, want boolean")
    assert df.where(is_missing_text(F.col("x")) != F.col("want")).count() == 0
    nums = spark.createDataFrame([(None, True), (float("nan"), True), (float("inf"), True), (0.0, True), (-3.0, True), (1e9, True), (5.0, False)], "x double, want boolean")
    assert nums.where(is_missing_number(F.col("x"), 0, 20000) != F.col("want")).count() == 0


def test_finest_group_first_then_coarser_then_all(spark):
    df = frame(spark, [(1, "a", "N", 1, 5.0), (2, "a", "S", 2, 6.0), (3, "a", "S", 2, None), (4, "a", None, 1, 5.0), (5, "a", None, 9, 13.0), (6, "b", None, 3, None), (7, None, None, 3, None)])
    got = fills(df)
    assert got[(4, "region")] == ("N", 0, 1)
    assert got[(5, "region")] == ("S", 1, 3)
    assert got[(6, "region")] == ("S", 2, 3)
    assert got[(3, "tenure")] == ("6", 0, 4)
    assert got[(6, "tenure")][1] == 2
    assert got[(7, "region")] == ("S", 2, 3)


def test_support_backs_off(spark):
    df = frame(spark, [(1, "a", "N", 1, 5.0), (2, "a", "S", 2, 6.0), (3, "a", "S", 2, 6.0), (4, "a", None, 1, 5.0)])
    assert fills(df, min_support=2)[(4, "region")] == ("S", 1, 3)


def test_share_and_default_support_back_off(spark):
    """A tie in the finest group is decided beyond it; one vote is not enough unless told so."""
    df = frame(spark, [(1, "a", "N", 1, 5.0), (2, "a", "S", 1, 5.0), (3, "a", None, 1, 5.0), (4, "a", "N", 2, 6.0), (5, "b", "S", 1, 5.0), (6, "b", None, 1, 5.0), (7, "c", "N", 1, 5.0), (8, "c", "N", 9, 13.0)])
    assert fills(df)[(3, "region")] == ("N", 1, 3)
    assert fills(df, min_share=0.0)[(3, "region")] == ("S", 0, 2)
    got = {(r["id"], r["field_name"]): (r["fill_value"], r["fill_level"]) for r in missing_fills(df, "id", specs()).collect()}
    assert got[(6, "region")] == ("N", 2) and fills(df)[(6, "region")][:2] == ("S", 0)


def test_ties_take_the_largest(spark):
    df = frame(spark, [(1, "a", "N", 1, 5.0), (2, "a", "S", 1, 5.0), (3, "a", None, 1, 5.0)])
    assert fills(df)[(3, "region")][0] == "S"


def test_empty_and_voteless(spark):
    assert fills(frame(spark, [])) == {}
    assert fills(frame(spark, [(1, "a", None, 1, None)])) == {(1, "region"): (None, -1, 0), (1, "tenure"): (None, -1, 0)}


def test_apply_marks_what_was_filled(spark):
    df = frame(spark, [(1, "a", "N", 1, 5.0), (2, "a", None, 1, None)])
    out = {r["id"]: r for r in apply_fills(df, "id", missing_fills(df, "id", specs()), ["region", "tenure"]).collect()}
    assert (out[2]["region"], out[2]["region_filled"], out[2]["tenure"], out[2]["tenure_filled"]) == ("N", True, 5.0, True)
    assert (out[1]["region_filled"], out[1]["tenure_filled"]) == (False, False)


def test_median(spark):
    rows = [(i, "a", None, i, float(i)) for i in range(1, 6)] + [(9, "a", None, 3, None)]
    df = frame(spark, rows)
    s = [FillSpec("tenure", is_missing_number(F.col("tenure")), F.col("tenure"), [[F.col("agent")]], stat="median")]
    assert missing_fills(df, "id", s).first()["fill_value"] == "3"


def test_hot_group_is_counted_not_collected(spark):
    df = spark.range(60_000).select(F.col("id"), F.lit("hot").alias("agent"), F.when(F.col("id") % 100 != 0, F.lit("N")).alias("region"), (F.col("id") % 30).alias("day"), F.lit(5.0).alias("tenure"))
    got = missing_fills(df, "id", [specs()[0]])
    assert got.count() == 600 and got.where("fill_value <> 'N'").count() == 0
