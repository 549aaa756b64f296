import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from partlake.sources import datasets
from partlake.streaming import dedupe

ROW = T.StructType([T.StructField("pn", T.StringType()), T.StructField("n", T.LongType())])


def test_array_document(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"part-{i}.json").write_text(json.dumps({"x": 1, "rows": [{"pn": f"a{i}", "n": i}, {"pn": f"b{i}", "n": i}]}))
    rows = datasets.read_array_document(spark, str(tmp_path), "rows", ROW).collect()
    assert [r.pn for r in rows] == ["a0", "b0", "a1", "b1"]


def test_json_lines_last_wins(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"pn":"a","n":1}\n\nbroken{\n{"pn":"a","n":2}\n{"pn":"b","n":3}\n')
    rows = {r.pn: r.n for r in datasets.read_json_lines(spark, str(tmp_path), ROW, "pn").collect()}
    assert rows == {"a": 2, "b": 3}


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([('a"b,c', 1), ("line\nend", 2)], ROW)
    assert datasets.write_csv(df, str(tmp_path / "out"))
    assert sorted(r.pn for r in datasets.read_csv(spark, str(tmp_path / "out"), ROW).collect()) == ['a"b,c', "line\nend"]
    assert not datasets.write_csv(df.where("n > 9"), str(tmp_path / "none")) and not (tmp_path / "none").exists()


def test_sharded_document_is_lossless(spark, tmp_path):
    df = spark.range(25).select(F.concat(F.lit("p"), "id").alias("pn"), F.col("id").alias("n"))
    datasets.write_array_document(df, str(tmp_path / "d"), ["n"], 10, "rows")
    back = datasets.read_array_document(spark, str(tmp_path / "d"), "rows", ROW)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_stream_dedupe_and_windows(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.unionByName(events.limit(100)).write.parquet(str(tmp_path / "in"))
    stream = dedupe.first_events(dedupe.read_events(spark, str(tmp_path / "in")), "3650 days")
    q = stream.writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert spark.table("once").count() == events.count()


def test_stream_state_ends_with_the_watermark(spark, tmp_path):
    """A repeat within the lateness is dropped, a row behind the watermark too; a repeat long after is a new event."""
    import datetime as dt

    day = dt.datetime(2024, 1, 1)
    batches = [[("1", 0), ("2", 30)], [("1", 40), ("3", 300)], [("4", 310)], [("9", 0), ("1", 320)]]
    for i, rows in enumerate(batches):
        made = [(int(k), day + dt.timedelta(minutes=m), 1, "x", 1.0, "{}") for k, m in rows]
        spark.createDataFrame(made, dedupe.EVENTS).coalesce(1).write.parquet(str(tmp_path / f"w{i}"))
        (tmp_path / "in").mkdir(exist_ok=True)
        next((tmp_path / f"w{i}").glob("*.parquet")).rename(tmp_path / "in" / f"{i}.parquet")
        first = dedupe.first_events(dedupe.read_events(spark, str(tmp_path / "in")), "1 hour")
        sink = first.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
        sink.trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.event_id, (r.ts - day).total_seconds() // 60) for r in spark.read.parquet(str(tmp_path / "out")).select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts")).collect())
    assert got == [(1, 0), (1, 320), (2, 30), (3, 300), (4, 310)]
