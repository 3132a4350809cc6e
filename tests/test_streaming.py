from datetime import datetime, timedelta

import pytest

from seriesloom.streaming import windows

SCHEMA = "series_id string, ts timestamp, y double"


@pytest.fixture
def folder(spark, tmp_path):
    rows = [("a" if i % 3 else "b", datetime(2024, 1, 1) + timedelta(minutes=7 * i), float(i)) for i in range(60)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def drain(query):
    query.processAllAvailable()
    query.stop()


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("build", [lambda df: windows.tumbling(df, ["series_id"], "y", "1 hour"), lambda df: windows.sliding(df, ["series_id"], "y", "2 hours", "1 hour"), lambda df: windows.sessions(df, ["series_id"], "y", "10 minutes", late="1 day")])
def test_stream_and_batch_agree(spark, folder, build):
    stream = build(spark.readStream.schema(SCHEMA).parquet(folder))
    name = f"t{abs(hash(build))}"
    mode = "complete"
    drain(stream.writeStream.outputMode(mode).format("memory").queryName(name).start())
    assert rows_of(spark.table(name)) == rows_of(build(spark.read.parquet(folder)))


def test_dedupe(spark, folder):
    twice = spark.read.parquet(folder)
    assert windows.dedupe(twice.unionByName(twice), ["series_id"]).count() == 60
    stream = windows.dedupe(spark.readStream.schema(SCHEMA).parquet(folder), ["series_id"], late="1 hour")
    drain(stream.writeStream.outputMode("append").format("memory").queryName("deduped").start())
    assert spark.table("deduped").count() == 60


def test_last_windows_keep_state(spark, folder):
    stream = windows.last_windows(spark.readStream.schema(SCHEMA).parquet(folder), 4)
    drain(stream.writeStream.outputMode("update").format("memory").queryName("lasts").start())
    got = {r["series_id"]: (r["n"], r["last_y"]) for r in spark.table("lasts").collect()}
    assert got == {"a": (4, 59.0), "b": (4, 57.0)}
