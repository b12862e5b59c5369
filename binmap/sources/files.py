"""Inventory files, page extracts, page ranges, and a content-addressed cache table."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Accepted headers of an inventory file; case, blanks and punctuation don't matter.
ALIASES = {
    "part_num": ("part_num", "part", "partnum", "item_no", "itemid", "number", "blitemno"),
    "name": ("name", "part_name", "item_name", "description"),
    "color_id": ("color_id", "colorid", "color", "bl_color_id"),
    "color_name": ("color_name", "colorname", "colour", "color_text"),
    "quantity": ("quantity", "qty", "count", "minqty"),
    "element_id": ("element_id", "elementid", "element", "lego_element_id"),
    "image_url": ("image_url", "img_url", "part_img_url", "image"),
}
#: Fixed value: characters at the beginning of a file by which its separator is told.
SAMPLE = 2048

PAGE_SCHEMA = "page_index long, printed_page_number long, bag_marker long, is_parts_list boolean, callouts array<struct<quantity: long, color: string, shape_desc: string, printed_part_id: string>>, notes string"


def page_range(spec: str | None, num_pages: int) -> list[int]:
    """Zero-based pages of "1-3,5", each once in the order given, without those beyond the end; blank chunks are skipped. Null or "": all."""
    if not spec:
        return list(range(num_pages))
    out: dict[int, None] = {}
    for part in filter(None, (p.strip() for p in spec.split(","))):
        ends = part.split("-", 1)
        try:
            start, end = int(ends[0]), int(ends[-1])
        except ValueError:
            raise ValueError(f"invalid page range {part!r} in {spec!r}: not integers") from None
        if start > end:
            raise ValueError(f"invalid page range {part!r} in {spec!r}: start > end")
        out.update(dict.fromkeys(i - 1 for i in range(max(1, start), min(end, num_pages) + 1)))
    return list(out)


def select_pages(pages: DataFrame, spec: str | None, num_pages: int, limit: int | None = None) -> DataFrame:
    """pages of a range and limit, with scan_seq, their place in it."""
    order = page_range(spec, num_pages)[:limit]
    rows = pages.sparkSession.createDataFrame(list(zip(order, range(len(order)), strict=True)), "page_index long, scan_seq long")
    return pages.join(rows, "page_index")


def _plain(header: str) -> str:
    return re.sub(r"[^a-z0-9]", "", header.lower())


def _whole(text: Column) -> Column:
    """The whole number of a text, towards zero; 0 if it has none. A negative one raises an error."""
    number = text.try_cast("double")
    whole = F.when(number.isNotNull() & ~F.isnan(number) & (F.abs(number) < 1e18), number.cast("long")).otherwise(F.lit(0).cast("long"))
    return F.when(whole < 0, F.raise_error(F.lit("a quantity is negative")).cast("long")).otherwise(whole)


def _line(pick, seq: Column) -> list[Column]:
    """Inventory columns from pick(field), a text or null."""
    return [
        seq.alias("inv_seq"),
        pick("part_num").alias("part_num"),
        F.coalesce(pick("name"), F.lit("")).alias("name"),
        pick("color_id").try_cast("int").alias("color_id"),
        pick("color_name").alias("color_name"),
        _whole(pick("quantity")).alias("quantity"),
        pick("element_id").alias("element_id"),
        pick("image_url").alias("image_url"),
    ]


def inventory_of(raw: DataFrame) -> DataFrame:
    """The inventory columns of a table with any accepted headers: of several, the first that isn't blank. Rows without a part number go.

    inv_seq ascends in the table's order.
    """

    def pick(field: str) -> Column:
        wanted = {_plain(a) for a in ALIASES[field]}
        found = [F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) for c in raw.columns if _plain(c) in wanted]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    return raw.select(*_line(pick, F.monotonically_increasing_id())).where(F.col("part_num").isNotNull())


def inventory_of_json(rows: DataFrame, column: str = "rows") -> DataFrame:
    """The inventory of JSON lists: column has a text, a list of objects. An object whose part is an object itself has the nested
    form of a catalogue's payload and is kept whatever it lacks; a flat one is read by its headers, in their order."""
    each = rows.select(F.posexplode(F.from_json(column, "array<map<string,string>>"))).toDF("inv_seq", "row").where("row is not null")
    entries = F.map_entries("row")

    def pick(field: str) -> Column:
        wanted = F.array(*(F.lit(_plain(a)) for a in ALIASES[field]))
        named = F.filter(entries, lambda e: F.array_contains(wanted, F.regexp_replace(F.lower(e["key"]), "[^a-z0-9]", "")) & (F.trim(e["value"]) != ""))
        return F.trim(F.get(named, F.lit(0))["value"])

    inner = F.from_json(F.try_element_at("row", F.lit("part")), "part_num string, name string, part_img_url string")
    color = F.from_json(F.try_element_at("row", F.lit("color")), "id int, name string")
    is_nested = F.try_element_at("row", F.lit("part")).startswith("{")
    at = lambda name: F.try_element_at("row", F.lit(name))
    nested = {"part_num": F.coalesce(inner["part_num"], F.lit("")), "name": inner["name"], "color_id": color["id"].cast("string"), "color_name": color["name"], "quantity": at("quantity"), "element_id": at("element_id"), "image_url": inner["part_img_url"]}
    seq = F.col("inv_seq").cast("long")
    flat = each.where(~F.coalesce(is_nested, F.lit(False))).select(*_line(pick, seq)).where(F.col("part_num").isNotNull())
    return flat.unionByName(each.where(is_nested).select(*_line(nested.__getitem__, seq)))


def load_inventory(spark: SparkSession, path: str) -> DataFrame:
    """The inventory of a CSV, TSV or JSON file; ValueError if JSON is not a list or an object with a list called results.

    A file is one scan's inventory, some hundred lines; its beginning (CSV) or its kind (JSON) comes to the driver.
    """
    try:
        whole = spark.read.text(path, wholetext=True)
        first = whole.select(F.substring("value", 1, SAMPLE).alias("head")).first()
    except AnalysisException as e:
        raise FileNotFoundError(f"no inventory file {path}") from e
    if not path.lower().endswith(".json"):
        head = first["head"] if first else ""
        return inventory_of(spark.read.csv(path, header=True, sep="\t" if head.count("\t") > head.count(",") else ",", multiLine=True))
    parsed = F.try_parse_json("value")
    kind = whole.select(parsed.isNotNull().alias("valid"), F.schema_of_variant(parsed).alias("of"), F.schema_of_variant(F.try_variant_get(parsed, "$.results", "variant")).alias("results")).first()
    if not kind or not kind.valid:
        raise ValueError(f"{path} is not valid JSON")
    if kind.of.startswith("OBJECT"):
        if kind.results is None:
            raise ValueError(f"{path} is a JSON object without results: a list of rows is expected, or an object with one called results")
        if not kind.results.startswith("ARRAY"):
            raise ValueError(f"{path}: results is no list")
        return inventory_of_json(whole.select(F.get_json_object("value", "$.results").alias("rows")))
    if not kind.of.startswith("ARRAY"):
        raise ValueError(f"{path}: a list of rows is expected, not {kind.of}")
    return inventory_of_json(whole.select(F.col("value").alias("rows")))


def extract_of_json(column: Column) -> Column:
    """A page extract (without its index) from a JSON object: a callout's quantity is 1 by default, flags are false."""
    fields = "printed_page_number long, bag_marker long, is_parts_list boolean, callouts array<struct<quantity: long, color: string, shape_desc: string, printed_part_id: string>>, notes string"
    got = F.from_json(column, fields)
    callouts = F.transform(F.coalesce(got["callouts"], F.array().cast("array<struct<quantity: long, color: string, shape_desc: string, printed_part_id: string>>")), lambda c: c.withField("quantity", F.coalesce(c["quantity"], F.lit(1))))
    return got.withField("callouts", callouts).withField("is_parts_list", F.coalesce(got["is_parts_list"], F.lit(False)))


def load_extracts(spark: SparkSession, path: str) -> DataFrame:
    """Page extracts from a JSON list."""
    return spark.read.schema(PAGE_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)


def callouts_of(extracts: DataFrame) -> DataFrame:
    """The callouts of page extracts that aren't part lists, with callout_pos, their place on the page. Other columns stay."""
    kept = [c for c in extracts.columns if c != "callouts"]
    each = extracts.select(*kept, F.posexplode("callouts").alias("callout_pos", "c"))
    return each.select(*kept, "callout_pos", F.coalesce("c.quantity", F.lit(1)).alias("quantity"), "c.color", "c.shape_desc", "c.printed_part_id")


def content_hash(payload: Column) -> Column:
    return F.sha2(payload.cast("binary"), 256)


def cache_get(cache: DataFrame, namespace: str) -> DataFrame:
    """(sha, value): the cached JSON of a namespace, the latest of each content; a value that isn't JSON is a miss."""
    own = cache.where((F.col("namespace") == namespace) & F.try_parse_json("value").isNotNull())
    return own.groupBy("sha").agg(F.max_by("value", "at").alias("value"))


def cache_set(rows: DataFrame, path: str, namespace: str) -> None:
    """Append (sha, value) rows to the cache table at path, partitioned by namespace."""
    rows.select("sha", "value", F.lit(namespace).alias("namespace"), F.current_timestamp().alias("at")).write.mode("append").partitionBy("namespace").parquet(path)


def cache_split(requests: DataFrame, cache: DataFrame, payload: str) -> tuple[DataFrame, DataFrame]:
    """Requests whose content's digest the cache (sha, value) has, with the value; and those it lacks, each content once."""
    hashed = requests.withColumn("sha", content_hash(F.col(payload)))
    return hashed.join(cache, "sha"), hashed.join(cache.select("sha"), "sha", "left_anti").dropDuplicates(["sha"])


def page_url(set_number: Column, base: str, locale: str = "en-gb") -> Column:
    """Address of a set's page: without the suffix behind the first dash."""
    return F.concat(F.lit(f"{base.rstrip('/')}/{locale}/service/building-instructions/"), F.trim(F.substring_index(set_number, "-", 1)))


def document_urls(html: Column, host: str) -> Column:
    """Distinct links to booklets in order of first appearance: those below the host's asset path, else any of the domain's that end in .pdf.

    Escaped slashes are undone first. host: the domain, as in "example.com".
    """
    text = F.replace(F.coalesce(html, F.lit("")), F.lit("\\/"), F.lit("/"))
    found = lambda pattern: F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 0))
    # The patterns of asset links and of other links.
    exact = found(r"https://[\w.-]+/cdn/product-assets/product\.bi\.[\w.]+/\d+\.pdf")
    return F.when(F.size(exact) > 0, exact).otherwise(found(rf"https://[\w.-]*{re.escape(host)}/\S+?\.pdf"))
