from pyspark.sql import functions as F

from lodestone.streaming.frontier import frontier


def test_frontier_tells_each_url_once(spark, tmp_path):
    rows = [("https://s/a", 1), ("https://S/a#x", 2), ("https://other/a", 3), ("https://s/b", 4), ("bad", 5)]
    spark.createDataFrame(rows, "target string, n int").select("target", F.timestamp_seconds("n").alias("at")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("target string, at timestamp").parquet(str(tmp_path / "in"))
    q = frontier(stream, "https://s/").writeStream.format("memory").queryName("urls").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.url for r in spark.table("urls").collect()) == ["https://s/a", "https://s/b"]
