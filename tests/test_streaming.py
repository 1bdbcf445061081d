import datetime as dt

import pytest

from quillstone.streaming.intervals import sessions, tumbling

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "ts timestamp_ntz, who string, v double"


@pytest.mark.parametrize("kind", ["tumbling", "sessions"])
def test_windows_of_a_stream_equal_the_batch(spark, tmp_path, kind):
    """Closed windows of a stream in three files are those of the whole table; a late row beyond the watermark is dropped."""
    rows = [(T0 + dt.timedelta(minutes=m), w, float(m)) for m in (0, 5, 12, 65, 70, 130) for w in "ab"]
    late = [(T0 - dt.timedelta(days=2), "a", 99.0)]
    for i, part in enumerate((rows[:6], rows[6:], [(T0 + dt.timedelta(days=1), "z", 0.0)], late, [(T0 + dt.timedelta(days=2), "z", 0.0)])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    run = (lambda d: tumbling(d, "ts", "1 hour", ["who"], "v", "10 minutes")) if kind == "tumbling" else (lambda d: sessions(d, "ts", "30 minutes", ["who"], "10 minutes"))
    src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = run(src).writeStream.outputMode("append").format("memory").queryName(kind).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.table(kind).where("who <> 'z'").collect()}
    assert got == {tuple(r) for r in run(spark.createDataFrame(rows, SCHEMA)).collect()}
