"""The streaming form of interval pairs meets by time bucket."""

import random
import re

from pyspark.sql import functions as F

from gleaner.streaming.streams import interval_pairs


def test_pairs_of_a_stream_meet_in_buckets(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, rng.choice("ab"), rng.choice((0, 120, 240, rng.randrange(1500))) + 600) for k in range(150)]
    spark.createDataFrame(rows, "id long, g string, s long").select("id", "g", F.timestamp_seconds("s").alias("ts")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, g string, ts timestamp").parquet(f"{tmp_path}/in")
    out = interval_pairs(stream, time="ts", key="id", by="g", seconds=120, delay="400 days")
    query = out.writeStream.format("memory").queryName("stream_pairs").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    want = {(g, a, b) for a, g, s in rows for b, h, t in rows if a < b and g == h and abs(s - t) <= 120}
    got = [(r.g, r.src, r.dst) for r in spark.table("stream_pairs").collect()]
    assert len(got) == len(want) and set(got) == want
    assert re.search(r"SymmetricHashJoin \[by#\w+, bucket#\w+\], \[by2#\w+, bucket2#\w+\]", plan := query._jsq.explainInternal(False)), plan
