"""Queries of job runs, the table of jobs and event-time windows, over the stream of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..streaming import ingest, jobs, windows


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, their kinds as states of a job for each user."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern, as the table can be a file or a folder
    kind = F.col("event_type")
    state = F.when(kind.isin("click", "signup"), "STARTED").when(kind == "purchase", "SUCCESS").when(kind == "error", "FAILURE").otherwise("PENDING")
    return rows.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("job"), kind, state.alias("state"), _cents())


def _cents() -> Column:
    return F.round(F.col("value") * 100).cast("long").alias("cents")


def _available(spark: SparkSession, rows: DataFrame) -> DataFrame:
    at = ingest.stream_folder(spark)
    return ingest.run_available(spark, rows, lambda d: d, f"{at}/out", f"{at}/state")


def stream_job_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _available(spark, jobs.runs(_events(spark, sf_dir), "job", "state", "ts"))


def stream_job_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each job, by a sink that commits each micro-batch once."""
    at = ingest.stream_folder(spark)
    rows = _events(spark, sf_dir).select("job", "event_id", F.unix_micros("ts").alias("at_us"), ingest.shown_state(F.col("state"), F.lit(None).cast("string")).alias("shown"))
    return jobs.run_into(rows.where("job is not null"), jobs.JobTable(spark, f"{at}/jobs", "job", "event_id"), f"{at}/state")


def stream_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _available(spark, windows.tumbling(_events(spark, sf_dir), "ts", "1 hour", ["event_type"], {"cents": F.col("cents")}))


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _available(spark, windows.tumbling(_events(spark, sf_dir), "ts", "6 hours", ["event_type"], {"cents": F.col("cents")}, slide="2 hours"))


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _available(spark, windows.sessions(_events(spark, sf_dir), "ts", "3 hours", ["job"], {"cents": F.col("cents")}))


QUERIES = [stream_job_runs, stream_job_table, stream_hours, stream_sliding, stream_sessions]


def oracle_sql() -> dict[str, str]:
    rows = """(SELECT event_id, epoch_us(ts) AS us, user_id AS job, event_type, round(value * 100)::BIGINT AS cents, CASE WHEN event_type IN ('click', 'signup') THEN 'STARTED' WHEN event_type = 'purchase' THEN 'SUCCESS' WHEN event_type = 'error' THEN 'FAILURE' ELSE 'PENDING' END AS state FROM events)"""
    mark = "(SELECT max(epoch_us(ts)) FROM events)"
    late, hour = 600_000_000, 3_600_000_000
    size, slide, gap = 6 * hour, 2 * hour, 3 * hour
    return {
        "stream_job_runs": f"""SELECT job::VARCHAR AS job, us AS started_us, CASE WHEN in_time THEN next_us ELSE us + 300000000 END AS ended_us, CASE WHEN NOT in_time THEN 'TASK_FAILED' WHEN next_state = 'STARTED' THEN 'RETRY' ELSE next_state END AS outcome,
 CASE WHEN in_time THEN next_us - us > 240000000 ELSE true END AS slow FROM (SELECT *, coalesce(next_us - us <= 300000000, false) AS in_time FROM (SELECT *, lead(us) OVER w AS next_us, lead(state) OVER w AS next_state FROM {rows} WHERE state <> 'PENDING' WINDOW w AS (PARTITION BY job ORDER BY us, CASE state WHEN 'STARTED' THEN 1 ELSE 0 END)))
 WHERE state = 'STARTED' AND (next_us IS NOT NULL OR us + 300000000 < (SELECT max(us) FROM {rows} WHERE state <> 'PENDING'))""",
        "stream_job_table": f"SELECT job, event_id, us AS at_us, CASE state WHEN 'STARTED' THEN 'processing' WHEN 'SUCCESS' THEN 'succeeded' WHEN 'FAILURE' THEN 'failed' ELSE 'queued' END AS shown FROM {rows} WHERE job IS NOT NULL QUALIFY row_number() OVER (PARTITION BY job ORDER BY event_id DESC) = 1",
        "stream_hours": f"SELECT start_us, start_us + {hour} AS end_us, event_type, count(*) AS n, sum(cents)::BIGINT AS cents FROM (SELECT *, us // {hour} * {hour} AS start_us FROM {rows}) GROUP BY ALL HAVING end_us <= {mark} - {late}",
        "stream_sliding": f"SELECT start_us, start_us + {size} AS end_us, event_type, count(*) AS n, sum(cents)::BIGINT AS cents FROM (SELECT *, (us // {slide} - unnest([0, 1, 2])) * {slide} AS start_us FROM {rows}) GROUP BY ALL HAVING end_us <= {mark} - {late}",
        "stream_sessions": f"""SELECT min(us) AS start_us, max(us) + {gap} AS end_us, job, count(*) AS n, sum(cents)::BIGINT AS cents FROM (SELECT *, sum(CASE WHEN before_ IS NULL OR us - before_ > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY job ORDER BY us ROWS UNBOUNDED PRECEDING) AS part
 FROM (SELECT *, lag(us) OVER (PARTITION BY job ORDER BY us) AS before_ FROM {rows})) GROUP BY job, part HAVING end_us <= {mark} - {late}""",
    }
