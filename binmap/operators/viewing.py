"""What a viewer asks of located parts: search, filter, sort, facets, one part's occurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binmap.functions import columns as C

#: The fields that a search looks into.
FIELDS = ("name", "color_name", "element_id", "part_num")


def with_status(parts: DataFrame) -> DataFrame:
    """parts with status: vision, ok or bad."""
    return parts.withColumn("status", C.status(F.col("reconciled"), F.coalesce("count_matches", F.lit(False))))


def filtered(parts: DataFrame, text: str = "", bag: int | None = None, status: str | None = None) -> DataFrame:
    """parts of a bag and a status that have the text in one of FIELDS, whatever its case; what is left out doesn't filter."""
    wanted = text.lower().strip()
    shown = with_status(parts)
    if bag is not None:
        shown = shown.where(F.array_contains("bags", F.lit(bag)))
    if status:
        shown = shown.where(F.col("status") == status)
    if wanted:
        has = [F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(wanted)) for c in FIELDS]
        shown = shown.where(has[0] | has[1] | has[2] | has[3])
    return shown


def sort_key(parts: DataFrame, column: str) -> Column:
    """What a column is sorted by: an array by its first element, -1 if it is empty."""
    if parts.schema[column].dataType.typeName() == "array":
        return F.coalesce(F.get(column, F.lit(0)), F.lit(-1))
    return F.col(column)


def ordered(parts: DataFrame, column: str = "bags", descending: bool = False) -> DataFrame:
    """parts sorted by a column, nulls as the least; equal ones by key."""
    key = sort_key(parts, column)
    return parts.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_first(), "scan_id", "key")


def occurrences(parts: DataFrame) -> DataFrame:
    """(scan_id, key, ord, bag, page, quantity): a row for each occurrence, with its page counted from 1."""
    each = parts.select("scan_id", "key", F.posexplode("occurrences").alias("ord", "o"))
    return each.select("scan_id", "key", "ord", F.col("o.bag").alias("bag"), (F.col("o.page_index") + 1).alias("page"), F.col("o.quantity").alias("quantity"))


def facets(parts: DataFrame) -> DataFrame:
    """(scan_id, bag, status, n): the parts of each bag, of each status, and all (both null), in one pass."""
    each = with_status(parts).select("scan_id", "key", "status", F.explode(F.concat(F.array(F.lit(None).cast("long")), F.transform("bags", lambda b: b.cast("long")))).alias("bag"))
    whole = F.col("bag").isNull()
    sets = F.explode(F.when(whole, F.array(F.lit(None).cast("string"), F.col("status"))).otherwise(F.array(F.lit(None).cast("string"))))
    return each.select("scan_id", "bag", sets.alias("status")).groupBy("scan_id", "bag", "status").agg(F.count(F.lit(1)).alias("n"))


def cards(segments: DataFrame, counts: DataFrame) -> DataFrame:
    """(scan_id, bag, label, pages, n_parts, n_bad): a card for each segment. counts as bag_cards() has them."""
    joined = segments.join(counts, ["scan_id", "bag"], "left")
    return joined.select("scan_id", "bag", C.bag_label(F.col("bag")).alias("label"), C.page_span(F.col("start_page"), F.col("end_page")).alias("pages"), F.coalesce("n_parts", F.lit(0)).alias("n_parts"), F.coalesce("n_bad", F.lit(0)).alias("n_bad"))


def rows(parts: DataFrame) -> DataFrame:
    """(scan_id, key, name, color, bags, pages, seen, inventory, delta, confidence): the texts of a table's row."""
    shown = with_status(parts)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return shown.select(
        "scan_id",
        "key",
        C.html_escaped(F.coalesce(F.nullif("name", F.lit("")), F.lit("unknown"))).alias("name"),
        C.html_escaped(text("color_name")).alias("color"),
        F.array_join(F.transform("bags", lambda b: b.cast("string")), " ").alias("bags"),
        F.array_join(F.transform("pages", lambda p: (p + 1).cast("string")), ", ").alias("pages"),
        text("total_seen").alias("seen"),
        F.coalesce(F.col("inventory_qty").cast("string"), F.lit("—")).alias("inventory"),
        C.count_delta(F.col("total_seen"), F.col("inventory_qty"), F.col("status")).alias("delta"),
        F.format_string("%.2f", F.coalesce("confidence", F.lit(0.0))).alias("confidence"),
    )
