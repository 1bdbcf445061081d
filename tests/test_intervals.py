import datetime as dt
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.operators.intervals import IntervalMap, periods_and_gaps

D = lambda d, h=0: dt.datetime(2020, 1, 1, h) + dt.timedelta(days=d)
SCHEMA = "id long, a timestamp_ntz, z timestamp_ntz, s string, k string"


def brute(rows):
    """Entity → periods and gaps by painting sorted intervals."""
    out = set()
    for g in {r[0] for r in rows}:
        own = sorted((a, z) for i, a, z in rows if i == g and a is not None and z is not None and z > a)
        merged = []
        for a, z in own:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(z, merged[-1][1])
            else:
                merged.append([a, z])
        out |= {(g, "period", a, z) for a, z in merged}
        out |= {(g, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:])}
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, a, z, "x", "y") for i, a, z in rows], SCHEMA)
    return {tuple(r) for r in periods_and_gaps(df, "id", "a", "z", **kw).collect()}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 15)), max_size=40))
def test_interval_map_equals_painting(items):
    m = IntervalMap()
    covered = set()
    for s, n in items:
        m.insert(s, s + n)
        covered |= set(range(s, s + n))
    assert {x for a, z in m.periods() for x in range(a, z)} == covered
    assert all(z < a for (_, z), (a, _) in zip(m.periods(), m.periods()[1:]))


def test_overlap_nest_touch_gap(spark):
    rows = [(1, D(0), D(5)), (1, D(1), D(2)), (1, D(5), D(7)), (1, D(9), D(10)), (2, D(0), D(1))]
    assert run(spark, rows) == {(1, "period", D(0), D(7)), (1, "gap", D(7), D(9)), (1, "period", D(9), D(10)), (2, "period", D(0), D(1))}


def test_bad_rows_and_repeats(spark):
    rows = [(None, D(0), D(5)), (1, None, D(5)), (1, D(3), None), (1, D(5), D(3)), (1, D(2), D(2)), (1, D(0), D(1)), (1, D(0), D(1))]
    assert run(spark, rows) == {(1, "period", D(0), D(1))}


def test_empty(spark):
    assert run(spark, []) == set()


def test_before_1970_and_seconds(spark):
    a, z = dt.datetime(1969, 12, 31, 23, 59, 58, 900_000), dt.datetime(1970, 1, 1, 0, 0, 1)
    assert run(spark, [(1, a, z)]) == {(1, "period", a.replace(microsecond=0), z)}


def test_blocks_do_not_show(spark):
    """An interval over many blocks, and many blocks with and without gaps, equal the plain result."""
    rnd = random.Random(3)
    rows = [(g, D(s), D(s + n)) for g in range(4) for s, n in ((rnd.randrange(400), rnd.choice([1, 2, 3, 30])) for _ in range(60))]
    want = brute(rows)
    for days in (1, 3, 7, 1000):
        assert run(spark, rows, block_days=days) == want


def test_hot_entity(spark):
    rows = [(1, D(i, i % 3), D(i, 12)) for i in range(3000)] + [(i, D(0), D(1)) for i in range(2, 50)]
    assert run(spark, rows, block_days=30) == brute(rows)


def test_string_entities(spark):
    df = spark.createDataFrame([("a", D(0), D(1)), ("b", D(0), D(2))], "who string, a timestamp_ntz, z timestamp_ntz")
    assert {r[0] for r in periods_and_gaps(df, "who", "a", "z").collect()} == {"a", "b"}


def test_stream_equals_batch(spark, tmp_path):
    from quillstone.streaming.intervals import periods_of_pieces, stream_pieces

    rows = [(1, D(0), D(5)), (1, D(9), D(10)), (1, D(4), D(7)), (2, D(0), D(1)), (1, D(0), D(5)), (2, D(30), D(200))]
    for i, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, "id long, a timestamp_ntz, z timestamp_ntz").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    src = spark.readStream.schema("id long, a timestamp_ntz, z timestamp_ntz").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    latest = {}

    def sink(df, epoch):
        for key, own in df.toPandas().groupby(["k", "b"]):
            assert len(own) == own["n_pieces"].iloc[0]
            latest[key] = [(r.k, r.b, r.s, r.e) for r in own.itertuples()]

    q = stream_pieces(src, "id", "a", "z", block_days=6).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(sink).start()
    q.processAllAvailable()
    q.stop()
    pieces = spark.createDataFrame([p for ps in latest.values() for p in ps], "k string, b long, s long, e long")
    assert {(int(r["id"]), r["seg_kind"], r["ds_from"], r["ds_to"]) for r in periods_of_pieces(pieces, "id").collect()} == set(brute(rows))
