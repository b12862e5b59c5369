"""Results as CSV and JSON, and the manifest of crops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binmap.operators import locating

#: The columns of a result's CSV file, in order.
CSV = ("part_num", "name", "color", "element_id", "bags", "pages_1based", "total_seen", "inventory_qty", "count_matches", "confidence", "image_url")


def csv_rows(parts: DataFrame) -> DataFrame:
    """parts as the texts of a CSV row: bags and 1-based pages joined by blanks, two decimals, True and False, nothing for nulls."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    joined = lambda c, by: F.array_join(F.transform(c, lambda x: (x + by).cast("string")), " ")
    shown = {
        "color": text("color_name"),
        "bags": joined("bags", 0),
        "pages_1based": joined("pages", 1),
        "count_matches": F.coalesce(F.initcap(F.col("count_matches").cast("string")), F.lit("")),
        "confidence": F.format_string("%.2f", "confidence"),
    }
    return parts.select(*(c for c in ("scan_id", "ord") if c in parts.columns), *((shown[c] if c in shown else text(c)).alias(c) for c in CSV))


def json_rows(results: DataFrame) -> DataFrame:
    """(scan_id, json): a JSON text for each nested result; nulls are kept."""
    shown = [c for c in results.columns if c != "scan_id"]
    return results.select("scan_id", F.to_json(F.struct(*shown), {"ignoreNullFields": "false"}).alias("json"))


def write_outputs(results: DataFrame, parts: DataFrame, folder: str) -> None:
    """result.json, a line a scan, and result.csv, of every scan's parts in order with the lines ended by CRLF. Folders, as many tasks write them."""
    ordered = csv_rows(parts.withColumn("ord", locating.part_order()))
    ordered = ordered.repartition("scan_id").sortWithinPartitions("scan_id", "ord").drop("ord")
    ordered.write.mode("overwrite").option("header", True).option("lineSep", "\r\n").option("emptyValue", "").csv(f"{folder}/result.csv")
    json_rows(results).select("json").write.mode("overwrite").text(f"{folder}/result.json")


def csv_text(parts: DataFrame) -> str:
    """One scan's result.csv as a text: a scan has some hundred parts."""
    import csv
    import io

    out = io.StringIO()
    writer = csv.writer(out)
    writer.writerow(CSV)
    for r in csv_rows(parts.withColumn("ord", locating.part_order())).orderBy("ord").collect():
        writer.writerow([r[c] for c in CSV])
    return out.getvalue()


def manifest(assigned: DataFrame, inventory: DataFrame) -> DataFrame:
    """A row for each crop of assignments(): its file, where it was seen, what it was assigned to and what it was identified as at first.

    file is part number (or unknown)/pNNN_iNNN.png, i numbering a scan's crops in order; null for a crop without content (has_content).
    """
    by = ["scan_id"] if "scan_id" in inventory.columns else []
    line = inventory.select(*by, "inv_seq", "part_num", "color_name")
    raw = line.select(*by, F.col("inv_seq").alias("raw_inv_seq"), F.col("part_num").alias("raw_part_num"))
    number = F.row_number().over(Window.partitionBy("scan_id").orderBy("place")) - 1
    two = F.transform(F.slice("alternatives", 1, 2), lambda a: F.struct(a["inv_seq"].alias("inv_seq"), a["score"].alias("score")))
    joined = assigned.withColumn("i", number).withColumn("two", two).join(line, [*by, "inv_seq"], "left").join(raw, [*by, "raw_inv_seq"], "left")
    other = line.select(*by, F.col("inv_seq").alias("other"), F.col("part_num").alias("other_num"))
    each = joined.select("scan_id", "i", F.posexplode("two").alias("at", "a")).withColumn("other", F.col("a.inv_seq")).join(other, [*by, "other"])
    named = each.groupBy("scan_id", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col("other_num").alias("part_num"), F.col("a.score").alias("score")))), lambda x: F.struct(x["part_num"].alias("part_num"), x["score"].alias("score"))).alias("alternatives"))
    there = F.col("has_content") if "has_content" in assigned.columns else F.lit(True)
    file = F.concat(F.coalesce(F.nullif(F.col("part_num"), F.lit("")), F.lit("unknown")), F.format_string("/p%03d_i%03d.png", "page_index", "i"))
    out = joined.drop("alternatives").join(named, ["scan_id", "i"], "left")
    none = F.array().cast(named.schema["alternatives"].dataType)
    return out.select("scan_id", "i", F.when(there, file).alias("file"), "page_index", "bag", "quantity", "seen_color", "part_num", "color_name", "raw_part_num", "confidence", "components", F.coalesce("alternatives", none).alias("alternatives"))


def write_crops(entries: DataFrame, contents: DataFrame, folder: str) -> None:
    """The manifest as JSON lines below folder/manifest, and (scan_id, i, content) as files at their entry's place, written by the tasks."""
    from binmap.sources.stores import write_bytes

    entries.write.mode("overwrite").json(f"{folder}/manifest")
    rows = entries.where("file is not null").select("scan_id", "i", "file").join(contents, ["scan_id", "i"])
    rows.select("file", "content").foreachPartition(lambda part: [write_bytes(f"{folder}/{r.file}", bytes(r.content)) for r in part] and None)
