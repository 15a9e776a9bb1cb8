"""Streams in several micro-batches: runs, late rows, batches that run twice."""

from pyspark.sql import functions as F

from lavrado.plans import streams
from lavrado.streaming import ingest, jobs, windows

EVENTS = "job string, state string, ts timestamp, n long"


def at(seconds: int) -> str:
    return f"2024-01-01 {10 + seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}"


def arriving(spark, folder, batches):
    """A stream whose files come one after the other."""
    for k, rows in enumerate(batches):
        df = spark.createDataFrame([(j, s, at(t), n) for j, s, t, n in rows], "job string, state string, t string, n long")
        df.select("job", "state", F.to_timestamp("t").alias("ts"), "n").coalesce(1).write.mode("append").parquet(f"{folder}/b={k}")
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def ran(spark, tmp_path, batches, **how):
    source = arriving(spark, f"{tmp_path}/in", batches)
    out = ingest.run_available(spark, source, lambda d: jobs.runs(d, "job", "state", "ts", **how), f"{tmp_path}/out", f"{tmp_path}/state")
    zero = 1704103200
    return sorted((r.job, r.started_us // 1_000_000 - zero, r.ended_us // 1_000_000 - zero, r.outcome, r.slow) for r in out.collect())


def test_runs_over_batches(spark, tmp_path):
    batches = [
        [("a", "STARTED", 0, 0), ("b", "STARTED", 5, 0), ("c", "SUCCESS", 6, 0), ("d", "PENDING", 7, 0), (None, "STARTED", 8, 0)],
        [("a", "SUCCESS", 200, 0), ("b", "SUCCESS", 290, 0), ("e", "STARTED", 295, 0), ("f", "STARTED", 296, 0)],
        [("e", "STARTED", 300, 0), ("e", "FAILURE", 310, 0), ("g", "STARTED", 310, 0), ("g", "RETRY", 310, 0)],
        [("z", "STARTED", 1000, 0)],
        [("f", "SUCCESS", 1010, 0), ("z", "SUCCESS", 1300, 0), ("z", "STARTED", 1400, 0)],
    ]
    assert ran(spark, tmp_path, batches) == [
        ("a", 0, 200, "SUCCESS", False), ("b", 5, 290, "SUCCESS", True), ("e", 295, 300, "RETRY", False), ("e", 300, 310, "FAILURE", False), ("f", 296, 596, "TASK_FAILED", True), ("g", 310, 610, "TASK_FAILED", True), ("z", 1000, 1300, "SUCCESS", True),
    ]


def test_table_of_jobs_after_batches_that_run_twice(spark, tmp_path):
    table = jobs.JobTable(spark, f"file://{tmp_path}/jobs", "job", "n")
    assert table.read() is None
    rows = lambda *x: spark.createDataFrame(list(x), "job string, n long, state string")
    one, two = rows(("a", 1, "queued"), ("a", 2, "processing"), ("b", 3, "queued"), ("b", 3, "queued")), rows(("a", 4, "succeeded"), ("c", 5, "queued"))
    table.write(one, 0)
    table.write(one, 0)  # a batch that was committed runs again
    one.write.parquet(f"file://{tmp_path}/jobs/batch-000000000001")  # one that was killed before its commit
    (tmp_path / "jobs/batch-000000000001/_SUCCESS").unlink()
    assert sorted(r.job for r in table.read().collect()) == ["a", "b"]
    table.write(two, 1)
    want = [("a", 4, "succeeded"), ("b", 3, "queued"), ("c", 5, "queued")]
    assert sorted(map(tuple, table.read().collect())) == want
    table.compact()
    assert sorted(map(tuple, table.read().collect())) == want and [p.name for p in (tmp_path / "jobs").iterdir()] == ["batch-000000000001"]
    table.write(two, 1)
    table.write(rows(("b", 9, "failed")), 2)
    assert dict((r.job, r.state) for r in table.read().collect())["b"] == "failed"


def test_a_restarted_stream_leaves_one_row_a_job(spark, sf_dir, tmp_path):
    source = arriving(spark, f"{tmp_path}/in", [[("a", "x", 0, 1), ("b", "x", 1, 2)], [("a", "y", 2, 3)]])
    table = jobs.JobTable(spark, f"file://{tmp_path}/jobs", "job", "n")
    assert {r.job: r.state for r in jobs.run_into(source.select("job", "n", "state"), table, f"{tmp_path}/state").collect()} == {"a": "y", "b": "x"}
    # Lose the record that the last batch was committed: it runs again.
    for x in (tmp_path / "state/commits").iterdir():
        if x.name.strip(".").startswith("1"):
            x.unlink()
    again = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    assert {r.job: r.state for r in jobs.run_into(again.select("job", "n", "state"), table, f"{tmp_path}/state").collect()} == {"a": "y", "b": "x"}


def test_late_rows_are_counted(spark, tmp_path):
    batches = [[("a", "x", 10, 1), ("a", "x", 3000, 2)], [("a", "x", 20, 4), ("a", "x", 7200, 8)], [("a", "x", 2900, 16), ("b", "x", 7300, 32)], [("b", "x", 20000, 64), ("a", "x", 2901, 128)]]
    source = arriving(spark, f"{tmp_path}/in", batches)
    made = windows.tumbling(source, "ts", "1 hour", ["job"], {"sum": F.col("n")}, late="10 minutes")
    query = made.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r.job, r.n, r.sum) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("a", 1, 8), ("a", 4, 23), ("b", 1, 32)] and windows.late_rows(query) == 1


def test_queries_have_sql():
    assert {f.__name__ for f in streams.QUERIES} == set(streams.oracle_sql())
