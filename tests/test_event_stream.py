import random
from datetime import datetime, timedelta

from sondage.streaming import events


def test_stream_equals_batch_with_late_rows(spark, tmp_path):
    """Three files, some rows of a file older than the last of the one before; two events on all nodes, one on one only."""
    r = random.Random(4)
    t0 = datetime(2026, 1, 1)
    rows = []
    for i in range(1200):
        for node in ("a", "b", "c"):
            loud = 8 if 400 <= i < 430 or 900 <= i < 920 or (600 <= i < 640 and node == "a") else 1
            rows.append((node, t0 + timedelta(seconds=i), loud * r.uniform(-1, 1)))
    cut = {0: [], 1: [], 2: []}
    for row in rows:
        i = (row[1] - t0).seconds
        cut[min(2, max(0, i + r.randrange(-15, 16)) // 400)].append(row)  # late by up to 30 seconds
    schema = "node string, t timestamp, v double"
    for k, part in cut.items():
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/part{k}")
    end = [(n, t0 + timedelta(seconds=5000), 0.0) for n in "abc"]  # moves the watermark past everything
    spark.createDataFrame(end, schema).coalesce(1).write.parquet(f"{tmp_path}/in/part9")
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        out = events.event_stream(stream, "node", "t", "v", "20 seconds", 3, 2.0, "40 seconds")
        q = out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{tmp_path}/check").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert q.exception() is None and not q.isActive
    finally:
        spark.conf.unset(provider)
    batch = events.events(spark.createDataFrame(rows, schema), "node", "t", "v", "20 seconds", 3, 2.0).collect()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    key = lambda x: (x["start"], round(x["score"], 9), x["nodes"])
    assert sorted(map(key, got)) == sorted(map(key, batch))
    assert [(x["start"] - t0).seconds for x in sorted(batch, key=key)] == [400, 420, 900]


def test_levels_of_silence(spark):
    t0 = datetime(2026, 1, 1)
    rows = [("a", t0 + timedelta(seconds=k), 0.0) for k in range(20)] + [("a", t0 + timedelta(seconds=k), float(k % 2)) for k in range(20, 60)]
    df = spark.createDataFrame(rows, "node string, t timestamp, v double")
    assert [(x["start"] - t0).seconds for x in events.events(df, "node", "t", "v", "10 seconds", 1, 0.1).orderBy("start").collect()] == [30, 40, 50]
    assert events.events(df.limit(0), "node", "t", "v", "10 seconds", 1, 0.1).collect() == []
