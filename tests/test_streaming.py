"""The streaming roll-up gives what the batch one gives."""

from pyspark.sql import functions as F

from fragmenta.plans import roles
from fragmenta.streaming import rollup


def test_stream_is_batch(spark, sf_dir, tmp_path):
    log = roles.log(spark, sf_dir).withColumn("created_at", F.col("created_at").cast("timestamp"))
    log.repartition(3).write.parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema(log.schema).parquet(f"{tmp_path}/log")
    query = rollup.windowed(stream, "1 day", "30 days").writeStream.format("memory").queryName("rolled").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    key = lambda rows: sorted((r.start, r.stage, r.attempts, r.failures) for r in rows)
    assert key(spark.table("rolled").collect()) == key(rollup.windowed(log, "1 day", "30 days").collect())
