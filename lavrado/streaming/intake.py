"""Files as a stream: each micro-batch is extracted against the cache, and what it gives is cached for later ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import batch
from .jobs import JobTable


class Intake:
    """For foreachBatch: extract a micro-batch's files, write their responses to a table of jobs and remember successes.

    files: see `batch.Batch`; `job` names a file and `order` is its place.  at: a folder for batches.  A micro-batch
    that runs again, whatever it had done, gives the same responses once: it is looked up in the cache as it was before
    its own results went there, since they go there last, from the responses that are written.
    """

    def __init__(self, spark: SparkSession, cache: str, responses: JobTable, order: str, at: str, buckets: int = batch.BUCKETS, **how) -> None:
        self.spark, self.cache, self.responses, self.order, self.at, self.buckets, self.how = spark, cache, responses, order, at.rstrip("/"), buckets, how

    def __call__(self, files: DataFrame, number: int) -> None:
        own = f"{self.at}/files-{number:012d}"
        if not self.responses.has(number):
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)  # of a run that was lost
            self.spark.catalog.refreshTable(self.cache)  # others append to it
            some = batch.Batch(files, self.order, own, self.buckets)
            self.responses.write(some.extracted(self.spark.table(self.cache), **self.how), number)
            some.forget()
        batch.remember(self.spark, own, self.cache)


def run_intake(source: DataFrame, intake: Intake, checkpoint: str) -> DataFrame | None:
    """Process what a stream of files has now, and read the responses."""
    query = source.writeStream.foreachBatch(intake).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return intake.responses.read()
