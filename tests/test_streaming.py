import datetime as dt

from leafmill.streaming import events as E

SCHEMA = "event_id long, event_type string, job_id string, status string, ts timestamp"


def rows():
    t = dt.datetime(2024, 1, 1)
    m = lambda k: t + dt.timedelta(minutes=k)
    return [(1, "status", "a", "running", m(0)), (2, "status", "b", "running", m(1)), (3, "status", "a", "completed", m(50)), (3, "status", "a", "completed", m(50)), (4, "status", "b", "queued", m(0))]


def test_batch_folding(spark):
    e = E.once(spark.createDataFrame(rows(), SCHEMA))
    assert e.count() == 4 and [r["job_id"] for r in E.active(e).collect()] == ["b"]
    assert E.last_events(e, 2).count() == 2 and E.last_per_job(e, 1).count() == 2
    assert {r["job_id"]: r["events"] for r in E.sessions(e.where("job_id = 'b'")).collect()} == {"b": 2}


def test_streams(spark, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).write.parquet(str(tmp_path / "in"))
    src = lambda: E.read(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, 10)
    q = E.fold_status(src()).writeStream.format("memory").queryName("folded").outputMode("update").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    last = {r["job_id"]: r["status"] for r in spark.table("folded").collect()}
    assert last["b"] == "running"
    got = []
    q = E.on_terminal(src(), lambda df: got.extend(r["job_id"] for r in df.select("job_id").collect()), str(tmp_path / "c2"))
    q.awaitTermination(60)
    assert got == ["a"]
