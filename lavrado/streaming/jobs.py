"""Jobs of a queue as streams: runs with time limits, and a table of the latest state of each job."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

# Seconds after which a run counts as slow, and after which it is stopped.
SOFT_LIMIT, HARD_LIMIT = 240, 300
_RUN = "job string, started_us long, ended_us long, outcome string, slow boolean"
_STATE = "started_us long"


def runs(events: DataFrame, job: str, state: str, time: str, late: str = "0 seconds", hard: int = HARD_LIMIT, soft: int = SOFT_LIMIT) -> DataFrame:
    """One row for each run of a job, once it has ended: job, started_us and ended_us (microseconds since 1970), outcome
    and slow (it took longer than `soft` seconds).

    events: a stream of a job's states (STARTED, RETRY, SUCCESS, FAILURE; others don't matter) at times.  STARTED begins a
    run.  It ends with the job's next state, whose name is its outcome (a second STARTED ends it as RETRY); if none comes
    within `hard` seconds, it ends then as TASK_FAILED, by a timer when the watermark passes.  An ending without a run is
    no run.  State is kept of open runs only.  Events without a job or a time are left out; the others of these states make
    the watermark, which drops those that come later than `late`.
    """

    def step(key: tuple, frames: Iterator, held) -> Iterator:
        import pandas as pd

        out = []
        start = held.get[0] if held.exists else None
        closed = lambda at, what: out.append((key[0], start, at, what, at - start > soft * 1_000_000))
        if held.hasTimedOut:
            closed(start + hard * 1_000_000, "TASK_FAILED")
            start = None
        else:
            rows = sorted((int(t), n, s) for f in frames for t, n, s in zip(f["_us"], f["_place"], f["_state"]))
            for t, _, s in rows:
                if start is not None and t > start + hard * 1_000_000:
                    closed(start + hard * 1_000_000, "TASK_FAILED")
                    start = None
                if start is not None:
                    closed(t, "RETRY" if s == "STARTED" else s)
                    start = None
                if s == "STARTED":
                    start = t
        if start is None:
            if held.exists:
                held.remove()
        else:
            held.update((start,))
            held.setTimeoutTimestamp(max((start // 1000) + hard * 1000 + 1, held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["job", "started_us", "ended_us", "outcome", "slow"])

    rows = events.where(F.col(job).isNotNull() & F.col(time).isNotNull() & F.col(state).isin("STARTED", "RETRY", "SUCCESS", "FAILURE"))
    # Of events at one time a job's ending comes before a beginning.
    place = F.when(F.col(state) == "STARTED", 1).otherwise(0)
    told = rows.select(F.col(job).cast("string").alias("_job"), F.col(time).cast("timestamp").alias("_time"), F.unix_micros(F.col(time).cast("timestamp")).alias("_us"), place.alias("_place"), F.col(state).alias("_state"))
    return told.withWatermark("_time", late).groupBy("_job").applyInPandasWithState(step, _RUN, _STATE, "append", "EventTimeTimeout")


class JobTable:
    """The latest row of each job, as a folder of batches: a batch is written whole under its number, or again if it wasn't
    finished, so that a batch that runs twice is there once."""

    def __init__(self, spark: SparkSession, at: str, key: str, order: str) -> None:
        self.spark, self.at, self.key, self.order = spark, at.rstrip("/"), key, order

    def _path(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.at}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _done(self, name: str) -> bool:
        path, fs = self._path(f"{name}/_SUCCESS")
        return fs.exists(path)

    def _newest(self, rows: DataFrame) -> DataFrame:
        """Of each key the row of the latest order; ties by the whole row, so that a batch that runs again gives the same."""
        whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
        place = F.struct(F.col(f"`{self.order}`"), F.sha2(F.to_json(whole), 256))
        return rows.groupBy(F.col(f"`{self.key}`").alias("_k")).agg(F.max_by(whole, place).alias("_r")).select("_r.*")

    def has(self, batch: int) -> bool:
        return self._done(f"batch-{batch:012d}")

    def write(self, rows: DataFrame, batch: int) -> None:
        """For foreachBatch: commit a batch, once."""
        if not self.has(batch):
            self._newest(rows).write.mode("overwrite").parquet(f"{self.at}/batch-{batch:012d}")

    def _names(self) -> list[str]:
        path, fs = self._path("")
        if not fs.exists(path):
            return []
        return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(path)) if n.startswith("batch-") and self._done(n))

    def read(self) -> DataFrame | None:
        """One row for each job; None before the first batch."""
        names = self._names()
        return self._newest(self.spark.read.parquet(*[f"{self.at}/{n}" for n in names])) if names else None

    def compact(self) -> None:
        """Put all finished batches into the last one of them, by way of a folder of its own; earlier ones go when it is there."""
        names = self._names()
        if len(names) < 2:
            return
        new, fs = self._path("new")
        fs.delete(new, True)
        self.read().write.parquet(f"{self.at}/new")
        # Readers see the earlier batches until the last one is there again; rows that are there twice count once.
        old, _ = self._path(names[-1])
        aside, _ = self._path("old")
        fs.delete(aside, True)
        fs.rename(old, aside)
        fs.rename(new, old)
        for name in names[:-1]:
            fs.delete(self._path(name)[0], True)
        fs.delete(aside, True)


def run_into(source: DataFrame, table: JobTable, checkpoint: str, mode: str = "append") -> DataFrame | None:
    """Process what a stream has now into a table of jobs, and read it."""
    query = source.writeStream.outputMode(mode).foreachBatch(table.write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return table.read()
