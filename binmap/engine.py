"""A scan from its sources to its result.

engine A reads page extracts, engine B identifies the crops of page images; both give parts, segments and warnings as tables, and a nested
result. Any table can be queried by plain SQL once it is registered.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binmap.functions import colors
from binmap.operators import locating, matching
from binmap.plans import sinks
from binmap.sources import files, stores
from binmap.vision import detection


@dataclass(frozen=True)
class Options:
    """What a scan is asked for. pages: a range; weights, capacity, use_color, counts and read are for images."""

    pages: str | None = None
    max_pages: int | None = None
    weights: tuple[tuple[str, float], ...] = tuple(matching.WEIGHTS.items())
    capacity: bool = True
    use_color: bool = True
    counts: bool = True
    top_k: int = 5
    thresholds: detection.Thresholds = detection.Thresholds()
    read: Callable | None = None
    set_num: str | None = None
    set_name: str | None = None
    source: str | None = None


@dataclass(frozen=True)
class Scan:
    """Tables of finished scans."""

    parts: DataFrame
    bags: DataFrame
    warnings: DataFrame
    result: DataFrame
    crops: DataFrame | None = None  # as assignments() has them

    def write(self, folder: str) -> None:
        sinks.write_outputs(self.result, self.parts, folder)

    def register(self, prefix: str = "scan_") -> None:
        """Temporary views for plain SQL: scan_parts, scan_bags, scan_warnings, scan_result."""
        for name in ("parts", "bags", "warnings", "result"):
            getattr(self, name).createOrReplaceTempView(prefix + name)


def _num_pages(pages: DataFrame) -> DataFrame:
    """Pages of each scan, counted before any are left out."""
    return pages.groupBy("scan_id").agg((F.max("page_index") + 1).alias("num_pages"))


def _chosen(pages: DataFrame, options: Options) -> DataFrame:
    """The pages asked for, with their place; a scan's own number of pages bounds the range."""
    if options.pages is None and options.max_pages is None:
        return pages
    most = pages.agg(F.max("page_index") + 1).first()[0] or 0
    return files.select_pages(pages, options.pages, most, options.max_pages)


def load_result(spark: SparkSession, path: str) -> DataFrame:
    """Results that Scan.write() wrote, a nested row a scan."""
    return spark.read.json(f"{path}/result.json")


def _scan(tables: tuple[DataFrame, DataFrame, DataFrame], num_pages: DataFrame, options: Options, reconciled: bool, crops: DataFrame | None = None) -> Scan:
    parts, bags, warnings = tables
    text = lambda x: F.lit(x).cast("string")
    scans = num_pages.select("scan_id", text(options.set_num).alias("set_num"), text(options.set_name).alias("set_name"), text(options.source).alias("source_pdf"), "num_pages", F.lit(reconciled).alias("reconciled"))
    return Scan(parts, bags, warnings, locating.results(parts, bags, warnings, scans), crops)


def scan_extracts(extracts: DataFrame, inventory: DataFrame | None = None, options: Options = Options()) -> Scan:  # noqa: B008
    """Engine A: page extracts (scan_id and what files.load_extracts() gives). Without an inventory, parts are what callouts say."""
    n = _num_pages(extracts)
    pages = _chosen(extracts, options)
    marked = pages.select("scan_id", "page_index", "bag_marker", F.lit(False).alias("candidate"), F.coalesce("is_parts_list", F.lit(False)).alias("is_parts_list"))
    callouts = files.callouts_of(pages).select("scan_id", "page_index", "callout_pos", "quantity", "color", "shape_desc", "printed_part_id")
    return _scan(locating.scan_extracts(marked, callouts, inventory, n), n, options, inventory is not None)


TRIAGE = "bag_marker long, is_parts_list boolean, has_callouts boolean, printed_page_number long"


def extract_two_pass(small: DataFrame, triage: Callable, detail: Callable, large: Callable[[DataFrame], DataFrame] | None = None, cache: DataFrame | None = None, write_to: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Page extracts for scan_extracts(), and how many pages were looked at closely.

    Every page of small (scan_id, page_index, content) is triaged by a cheap model; those with callouts that aren't part lists are rendered
    anew by large(pages), if given, and read by the detailed model. The models are transports as stores.answered() takes them.
    """
    asked = stores.answered(small, triage, cache, "content", "triage", write_to, make_caller=stores._once)
    read = F.from_json("payload", TRIAGE)
    first = asked.select("scan_id", "page_index", "content", read.alias("t")).select("scan_id", "page_index", "content", "t.bag_marker", F.col("t.printed_page_number").alias("printed"), *(F.coalesce(f"t.{c}", F.lit(False)).alias(c) for c in ("is_parts_list", "has_callouts")))
    needed = locating.needs_detail(first).select("scan_id", "page_index", "content")
    pages = needed if large is None else large(needed.drop("content"))
    second = stores.vision_extracts(pages, detail, "detail", cache, write_to).withColumn("printed", F.col("printed_page_number"))
    none = F.array().cast(second.schema["callouts"].dataType)
    merged = locating.two_pass(first.drop("content"), second, none).withColumnRenamed("printed", "printed_page_number")
    return merged, locating.two_pass_stats(first)


def scan_images(images: DataFrame, inventory: DataFrame, recognise: Callable[[DataFrame], DataFrame] | None = None, gallery: DataFrame | None = None, encode=None, options: Options = Options()) -> Scan:  # noqa: B008
    """Engine B: page images (scan_id, page_index, content). recognise adds payload and error to crops (crop_id, content); gallery
    (inv_seq, embedding) is searched with what encode makes of a crop.

    The inventory holds for all scans; with a column scan_id it raises ValueError, as crops would meet other scans' lines.
    """
    if "scan_id" in inventory.columns:
        raise ValueError("the inventory must hold for all scans")
    n = _num_pages(images)
    found = detection.detections(_chosen(images, options), options.thresholds, options.read)
    cut = detection.callouts(found, ["scan_id", "page_index"], options.read)
    cut = cut.withColumn("crop_id", F.concat_ws("/", "scan_id", "page_index", "callout_pos")).withColumnRenamed("crop", "content")
    if not options.use_color:
        cut = cut.withColumn("seen_color", F.lit(None).cast("string"))
    candidates = hits = errors = None
    if recognise is not None:
        answers = recognise(cut.select("crop_id", "content"))
        candidates = matching.parse_predictions(answers.select("crop_id", "payload")).select("crop_id", "part_num", "score")
        errors = answers.select("crop_id", "error")
    if gallery is not None and encode is not None:
        vectors = matching.embedded(cut.select("crop_id", "content"), encode).withColumn("query_id", F.xxhash64("crop_id"))
        near = matching.nearest(vectors.select("query_id", "embedding"), gallery.select("inv_seq", "embedding"), options.top_k, itself=True)
        hits = near.join(vectors.select("query_id", "crop_id"), "query_id").select("crop_id", "inv_seq", F.col("similarity").alias("score"))
    scores = colors.name_scores(cut, inventory) if options.use_color else None
    got = matching.identify(cut.select("crop_id", "seen_color"), inventory, candidates, hits, scores, dict(options.weights), options.top_k)
    crops = cut.join(got, "crop_id")
    crops = crops.join(errors, "crop_id", "left") if errors is not None else crops.withColumn("error", F.lit(None).cast("string"))
    pages = found.select("scan_id", "page_index", *(["scan_seq"] if "scan_seq" in found.columns else []), "bag_marker", "candidate", "is_parts_list")
    tables = locating.scan_crops(pages, crops, inventory, n, options.capacity, options.counts)
    return _scan(tables, n, options, options.counts, crops)


def debug(images: DataFrame, folder: str, options: Options = Options()) -> DataFrame:  # noqa: B008
    """Statistics of each page's panels, written to folder/stats as JSON, with overlay and mask images beside them; a page that fails has its error."""
    found = detection.detections(_chosen(images, options), options.thresholds, options.read)
    by = ["scan_id", "page_index"]
    drawn = detection.overlays(found, by, t=options.thresholds).where("overlay is not null")
    drawn.foreachPartition(lambda rows: [(stores.write_bytes(f"{folder}/{r.scan_id}/page_{r.page_index:03d}.png", bytes(r.overlay)), stores.write_bytes(f"{folder}/{r.scan_id}/mask_{r.page_index:03d}.png", bytes(r.mask))) for r in rows] and None)
    stats = detection.stats(found, by)
    stats.write.mode("overwrite").json(f"{folder}/stats")
    return stats


def main(arguments: list[str] | None = None) -> None:
    """python -m binmap.engine EXTRACTS --out FOLDER [--inventory FILE] [--pages RANGE] [--max-pages N] [--set NUMBER]"""
    import argparse

    parser = argparse.ArgumentParser(prog="binmap", description="Locate a set's parts in page extracts.")
    parser.add_argument("extracts")
    parser.add_argument("--out", default="out")
    parser.add_argument("--inventory")
    parser.add_argument("--pages")
    parser.add_argument("--max-pages", type=int)
    parser.add_argument("--set")
    a = parser.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    extracts = files.load_extracts(spark, a.extracts).withColumn("scan_id", F.lit(a.set or "scan"))
    inventory = files.load_inventory(spark, a.inventory) if a.inventory else None
    try:
        scan_extracts(extracts, inventory, Options(pages=a.pages, max_pages=a.max_pages, set_num=a.set)).write(a.out)
    except ValueError as e:
        parser.error(str(e))


if __name__ == "__main__":
    main()
