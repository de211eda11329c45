from pyspark.sql import functions as F

from vecloom.functions import histogram
from vecloom.streaming import windowed_vertical


def test_rowwise_and_windowed_on_a_stream(spark, tmp_path):
    rows = spark.range(40).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.array(F.col("id"), F.lit(1).cast("bigint")).alias("a"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = stream.select(histogram("a", start=0, stop=40, spacing=20).alias("h")).writeStream.format("memory").queryName("h").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("h").count() == 40
    for length in (None, 2):
        out = windowed_vertical(stream, "ts", "10 minutes", "1 minute", {"s": ("a", "sum")}, length=length)
        q = out.writeStream.outputMode("update").format("memory").queryName(f"w{length}").start()
        q.processAllAvailable()
        q.stop()
        assert sorted(r["s"] for r in spark.table(f"w{length}").collect()) == [[45, 10], [145, 10], [245, 10], [345, 10]]
