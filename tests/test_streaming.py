import random

from pyspark.sql import functions as F

from binmap.operators import segments
from binmap.streaming import scans

SCHEMA = "scan_id long, seq long, bag_marker long, candidate boolean, is_parts_list boolean"


def pieces(spark, folder, rows, schema, n):
    for i in range(n):
        spark.createDataFrame(rows[i::n] if schema != SCHEMA else [r for r in rows if r[1] % 100 * n // 100 == i], schema).coalesce(1).write.parquet(f"{folder}/{i}")


def run(spark, df, name, folder):
    df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/{name}").outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    return spark.table(name)


def test_bags_of_a_stream_are_those_of_a_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [(s, i, rng.choice([None, None, None, rng.randint(-1, 12)]), rng.random() < 0.1, False) for s in range(5) for i in range(100)]
    pieces(spark, tmp_path / "in", rows, SCHEMA, 3)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = {(r.scan_id, r.seq): (r.assigned, r.status, r.bag) for r in run(spark, scans.stream_bags(stream), "bags", tmp_path).collect()}
    batch = segments.with_ordinals(spark.createDataFrame(rows, SCHEMA).withColumnRenamed("seq", "page_index"))
    batch = batch.withColumn("bag_marker", F.col("assigned"))
    status = {(r.scan_id, r.page_index): (r.assigned, r.status) for r in segments.with_marker_status(batch).collect()}
    bag = {(r.scan_id, r.page_index): r.bag for r in segments.page_bags(batch.drop("assigned")).collect()}
    assert got == {k: (*status[k], bag[k]) for k in status} and len(got) == 500


def test_contents_and_windows(spark, tmp_path):
    rows = [(i, f"text {i % 4}", f"2024-01-01 00:{i:02d}:00") for i in range(20)]
    pieces(spark, tmp_path / "c", rows, "scan_id long, content string, at string", 2)
    stream = spark.readStream.schema("scan_id long, content string, at string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/c/*").withColumn("at", F.to_timestamp("at"))
    assert run(spark, scans.new_contents(stream), "fresh", tmp_path).count() == 4
    counted = run(spark, scans.window_counts(stream.withColumns({"scan_id": F.lit(1), "quantity": F.lit(2)}), size="5 minutes", late="1 minute"), "counted", tmp_path)
    assert {(r.start.minute, r.n, r.quantity) for r in counted.collect()} >= {(0, 5, 10), (5, 5, 10), (10, 5, 10)}


def test_answers_are_appended(spark, tmp_path):
    pieces(spark, tmp_path / "r", [(i, "x") for i in range(6)], "scan_id long, content string", 2)
    stream = spark.readStream.schema("scan_id long, content string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/r/*")
    for _ in range(2):  # the second run finds nothing new
        scans.answer_each(stream, lambda b: b.withColumn("payload", F.upper("content")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert sorted(r.scan_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(6))
