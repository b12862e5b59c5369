"""The driver's tables seen as scans, callouts, inventories and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as pages: a user's events in order are the pages of a scan."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("scan_id"), (F.row_number().over(w) - 1).cast("long").alias("page_index"), F.when(kind == "signup", k).alias("bag_marker"), (kind == "view").alias("candidate"), (kind == "error").alias("is_parts_list"))


def callouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with its part as callouts."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return lines.join(parts, "l_partkey").select(F.col("l_suppkey").alias("scan_id"), (F.col("l_orderkey") % 64).alias("page_index"), F.col("l_quantity").cast("long").alias("quantity"), F.substring_index("p_name", " ", 1).alias("color"), F.col("p_name").alias("shape_desc"))


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as an inventory."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("inv_seq"), F.col("p_brand").alias("part_num"), F.concat_ws(" ", "p_name", F.lower("p_type")).alias("name"), F.substring_index("p_name", " ", 1).alias("color_name"), F.col("p_size").cast("long").alias("quantity"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as two signals about crops."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("crop_id"), F.col("l_partkey").alias("inv_seq"), "l_discount", "l_tax")
    both = F.array(F.struct(F.lit("brickognize").alias("signal"), F.col("l_discount").alias("score")), F.struct(F.lit("embedding").alias("signal"), F.col("l_tax").alias("score")))
    each = lines.withColumn("s", F.explode(both)).select("crop_id", "inv_seq", "s.signal", "s.score")
    return each.groupBy("crop_id", "signal", "inv_seq").agg(F.max("score").alias("score"))


def place_of_line() -> F.Column:
    """A number for each line, unique in its order."""
    return F.col("l_linenumber") * F.lit(1_000_000_000_000) + F.col("l_partkey") * F.lit(1_000_000) + F.col("l_suppkey")


def printed_callouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with its part as callouts with their place; some print an element id, some a part number."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand")
    printed = F.when(F.col("l_linenumber") == 1, F.concat(F.lit(" e"), F.col("l_partkey").cast("string"))).when(F.col("l_linenumber") == 2, F.upper("p_brand"))
    return lines.join(parts, "l_partkey").select(F.col("l_suppkey").alias("scan_id"), (F.col("l_orderkey") % 64).alias("page_index"), (F.col("l_orderkey") * F.lit(10_000_000) + F.col("l_linenumber") * F.lit(1_000_000) + F.col("l_partkey")).alias("callout_pos"), F.col("l_quantity").cast("long").alias("quantity"), F.substring_index("p_name", " ", 1).alias("color"), F.col("p_name").alias("shape_desc"), printed.alias("printed_part_id"))


def full_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as an inventory with all columns; lines repeat part numbers and colours."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("inv_seq"), F.col("p_brand").alias("part_num"), F.when(F.col("p_partkey") % 7 != 0, F.concat_ws(" ", "p_name", F.lower("p_type"))).otherwise(F.lit("")).alias("name"), F.when(F.col("p_partkey") % 3 == 0, (F.col("p_partkey") % 11).cast("int")).alias("color_id"), F.substring_index("p_name", " ", 1).alias("color_name"), F.col("p_size").cast("long").alias("quantity"), F.concat(F.lit("E"), F.col("p_partkey").cast("string")).alias("element_id"), F.lit(None).cast("string").alias("image_url"))


def crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as identified crops: some unidentified, some failed, some by embedding alone."""
    n = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax")
    lost = F.col("l_discount") < 0.01
    entry = lambda name, score: F.struct(F.lit(name).alias("signal"), score.alias("score"))
    parts = entry("brickognize", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_tax")).otherwise(0.0)), entry("embedding", F.col("l_discount"))
    other = F.array(F.struct((F.col("l_partkey") % 50 + 1).alias("inv_seq"), F.lit(0.5).alias("score")), F.struct((F.col("l_partkey") % 30 + 1).alias("inv_seq"), F.lit(0.25).alias("score")))
    return n.select(
        F.col("l_suppkey").alias("scan_id"),
        (F.col("l_orderkey") % 64).alias("page_index"),
        (F.col("l_orderkey") * F.lit(10_000_000_000) + F.col("l_linenumber").cast("long") * F.lit(1_000_000_000) + F.col("l_partkey") * F.lit(100) + F.col("l_quantity").cast("long")).alias("callout_pos"),
        F.col("l_quantity").cast("long").alias("quantity"),
        F.when(F.col("l_linenumber") != 3, F.element_at(F.array(*(F.lit(c) for c in ("Red", "Dark Red", "Blue"))), (F.col("l_partkey") % 3 + 1).cast("int"))).alias("seen_color"),
        F.when(~lost, F.col("l_partkey")).alias("inv_seq"),
        F.when(lost, 0.0).otherwise(F.col("l_discount") * 5 + F.col("l_tax") / 7 + F.col("l_partkey") % 97 / F.lit(970.0)).alias("confidence"),
        F.when(~lost, F.map_from_entries(F.array(*parts))).alias("components"),
        other.alias("alternatives"),
        F.when(lost & (F.col("l_tax") < 0.02), F.concat(F.lit("timeout "), F.col("l_linenumber").cast("string"))).alias("error"),
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as boxes, an order's lines being on one page."""
    n = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return n.select(F.col("l_orderkey").alias("page"), place_of_line().alias("box_id"), (F.col("l_partkey") % 20 * 3).cast("double").alias("x"), (F.col("l_suppkey") % 10 * 2).cast("double").alias("y"), (F.col("l_quantity") * 2).alias("w"), (F.col("l_partkey") % 40).cast("double").alias("h"), F.col("l_quantity").cast("long").alias("quantity"))


def glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as dark glyphs of pages."""
    n = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return n.select(F.col("l_orderkey").alias("page"), place_of_line().alias("box_id"), (F.col("l_partkey") % 12 * 15).cast("double").alias("x"), (F.col("l_suppkey") % 3 * 10).cast("double").alias("y"), F.lit(12.0).alias("w"), (F.col("l_partkey") % 4 * 6 + 20).cast("double").alias("h"))
