"""Files that arrive as a stream: hits across micro-batches and restarts."""

from pyspark.sql import functions as F

from lavrado.operators import batch
from lavrado.plans import services
from lavrado.streaming import intake, jobs


def test_a_later_arrival_is_a_hit_across_restarts(spark, sf_dir, tmp_path):
    files = services.files_of_orders(spark, sf_dir).where("k in (10, 11, 14, 16)")
    batch.cache_table(spark, "intake_cache", f"{tmp_path}/cache", buckets=2)
    table = jobs.JobTable(spark, f"file://{tmp_path}/responses", "k", "k")
    run = intake.Intake(spark, "intake_cache", table, "k", f"{tmp_path}/batches", buckets=2, strategy="no_llm")

    def arrive(by):
        files.withColumn("k", F.col("k") + by).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        return {r.k: (r.status, r.error_code, r.extraction_method) for r in intake.run_intake(source, run, f"{tmp_path}/state").collect()}

    first = arrive(0)
    assert first == {10: ("success", None, "xml_parser"), 11: ("success", None, "heuristic"), 14: ("error", "EMPTY_FILE", None), 16: ("error", "HEURISTIC_INSUFFICIENT", None)}
    for x in (tmp_path / "state/commits").iterdir():  # the stream doesn't know that its batch was committed
        x.unlink()
    second = arrive(100)
    assert {k: v for k, v in second.items() if k < 100} == first
    assert [second[k + 100] for k in (10, 11, 14, 16)] == [("success", None, "cache"), ("success", None, "cache"), ("error", "EMPTY_FILE", None), ("error", "HEURISTIC_INSUFFICIENT", None)]
    assert spark.table("intake_cache").count() == 2
    spark.sql("DROP TABLE intake_cache")
