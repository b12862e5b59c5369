"""Sparse ordered markers as dense segments. All windows share the partitioning by scan_id.

pages: scan_id, page_index, bag_marker (null: none), candidate, is_parts_list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _in_order(by: str = "page_index") -> Window:
    return Window.partitionBy("scan_id").orderBy(by)


def _so_far(by: str = "page_index") -> Window:
    return _in_order(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _before() -> Window:
    return _in_order().rowsBetween(Window.unboundedPreceding, -1)


def with_marker_status(pages: DataFrame) -> DataFrame:
    """pages with last_kept (the marker in force before the page) and status: kept, repeated or suspect; null without a marker.

    A marker is kept iff it exceeds the last kept one, which is therefore the running maximum, at least 0.
    """
    last = F.greatest(F.lit(0), F.coalesce(F.max("bag_marker").over(_before()), F.lit(0)))
    kind = F.when(F.col("bag_marker") > F.col("last_kept"), "kept").when(F.col("bag_marker") == F.col("last_kept"), "repeated").otherwise("suspect")
    return pages.withColumn("last_kept", last).withColumn("status", F.when(F.col("bag_marker").isNotNull(), kind))


def marker_warnings(pages: DataFrame) -> DataFrame:
    """(scan_id, page_index, message) for every marker that opens no segment."""
    # The texts are part of the result.
    repeated = F.format_string("Bag marker %d repeated on page %d (same as the current bag); ignored.", "bag_marker", F.col("page_index") + 1)
    suspect = F.format_string("Ignored suspect bag marker %d on page %d (less than previous bag %d).", "bag_marker", F.col("page_index") + 1, "last_kept")
    found = with_marker_status(pages).where(F.col("status").isin("repeated", "suspect"))
    return found.select("scan_id", "page_index", F.when(F.col("status") == "repeated", repeated).otherwise(suspect).alias("message"))


def segment_warnings(pages: DataFrame, num_pages: DataFrame | None = None) -> DataFrame:
    """(scan_id, phase, ord, message): markers that open no segment, in page order; a scan (with pages) that has none at all."""
    order = F.row_number().over(_in_order())
    each = marker_warnings(pages).select("scan_id", F.lit(1).alias("phase"), order.cast("long").alias("ord"), "message")
    # Fixed value: the text is part of the result.
    none = "No bag markers detected; treating the whole PDF as bag 0 (unknown)."
    lacking = with_marker_status(pages).groupBy("scan_id").agg(F.count_if(F.col("status") == "kept").alias("n"), (F.max("page_index") + 1).alias("num_pages"))
    if num_pages is not None:
        lacking = num_pages.join(lacking.drop("num_pages"), "scan_id", "left")
    lacking = lacking.where((F.coalesce("n", F.lit(0)) == 0) & (F.col("num_pages") > 0))
    return each.unionByName(lacking.select("scan_id", F.lit(1).alias("phase"), F.lit(1 << 40).cast("long").alias("ord"), F.lit(none).alias("message")))


def segments(pages: DataFrame, num_pages: DataFrame | None = None) -> DataFrame:
    """(scan_id, bag, start_page, end_page), with bag 0 for the pages before the first kept marker.

    num_pages (scan_id, num_pages) defaults to the last page. A segment that ends before it starts raises an error.
    """
    if num_pages is None:
        num_pages = pages.groupBy("scan_id").agg((F.max("page_index") + 1).alias("num_pages"))
    kept = with_marker_status(pages).where(F.col("status") == "kept").join(num_pages, "scan_id")
    bags = kept.select("scan_id", F.col("bag_marker").alias("bag"), F.col("page_index").alias("start_page"), F.coalesce(F.lead("page_index").over(_in_order()) - 1, F.col("num_pages") - 1).alias("end_page"))
    first = kept.groupBy("scan_id").agg(F.min("page_index").alias("first"))
    intro = num_pages.join(first, "scan_id", "left").where((F.col("num_pages") > 0) & (F.coalesce("first", F.lit(1)) > 0))
    intro = intro.select("scan_id", F.lit(0).cast("long").alias("bag"), F.lit(0).cast("long").alias("start_page"), F.coalesce(F.col("first") - 1, F.col("num_pages") - 1).alias("end_page"))
    checked = F.when(F.col("end_page") >= F.col("start_page"), F.col("end_page")).otherwise(F.raise_error(F.lit("a segment ends before it starts")).cast("long"))
    return bags.unionByName(intro).withColumn("end_page", checked)


def page_bags(pages: DataFrame, num_pages: DataFrame | None = None) -> DataFrame:
    """(scan_id, page_index, bag): the last kept marker up to each page, else 0.

    num_pages (scan_id, num_pages): of every page of the document, also those that weren't looked at; else of the pages given.
    """
    if num_pages is not None:
        return expanded(segments(pages, num_pages))
    kept = F.when(F.col("status") == "kept", F.col("bag_marker"))
    return with_marker_status(pages).select("scan_id", "page_index", F.coalesce(F.last(kept, ignorenulls=True).over(_so_far()), F.lit(0)).alias("bag"))


def expanded(found: DataFrame) -> DataFrame:
    """(scan_id, page_index, bag) for every page of every segment: the interval join as an explode, to be joined by equality."""
    return found.select("scan_id", F.explode(F.sequence("start_page", "end_page")).alias("page_index"), "bag")


def with_ordinals(pages: DataFrame) -> DataFrame:
    """pages with assigned: the marker, or for a candidate without one the number after the last.

    The order is the one in which pages were given: scan_seq, if there is such a column, else page_index. The recurrence last = marker if
    it exceeds last, last + 1 at a candidate, has a closed form: with c the candidates so far, last = c + max(0, max of marker - c).
    """
    return _ordinals(pages).withColumn("assigned", F.coalesce("bag_marker", F.when(F.col("candidate"), F.col("__last")))).drop("__c", "__last")


def _ordinals(pages: DataFrame) -> DataFrame:
    so_far = _so_far("scan_seq" if "scan_seq" in pages.columns else "page_index")
    counted = pages.withColumn("__c", F.count(F.when(F.col("bag_marker").isNull() & F.col("candidate"), 1)).over(so_far))
    return counted.withColumn("__last", F.col("__c") + F.greatest(F.lit(0), F.coalesce(F.max(F.col("bag_marker") - F.col("__c")).over(so_far), F.lit(0))))


def ordinal_warnings(pages: DataFrame) -> DataFrame:
    """(scan_id, phase, ord, message) for every marker that was read but doesn't exceed the number in force."""
    order = _in_order("scan_seq" if "scan_seq" in pages.columns else "page_index")
    found = _ordinals(pages).withColumn("before", F.coalesce(F.lag("__last").over(order), F.lit(0))).where(F.col("bag_marker") <= F.col("before"))
    # Fixed value: the text is part of the result.
    message = F.format_string("page %d: OCR-read bag_marker=%d does not exceed the running sequence (%d); left as-is for the monotonic filter to handle", "page_index", "bag_marker", "before")
    return found.select("scan_id", F.lit(5).alias("phase"), F.row_number().over(order).cast("long").alias("ord"), message.alias("message"))
