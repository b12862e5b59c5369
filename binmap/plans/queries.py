"""Queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from binmap.functions import columns as C
from binmap.operators import locating, matching, segments
from binmap.sources import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

PAGES = """v_pages AS (SELECT user_id AS scan_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS page_index,
 CASE WHEN event_type = 'signup' THEN CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT) END AS bag_marker,
 event_type = 'view' AS candidate, event_type = 'error' AS is_parts_list FROM events),
v_status AS (SELECT *, greatest(0, coalesce(max(bag_marker) OVER (PARTITION BY scan_id ORDER BY page_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS last_kept FROM v_pages),
v_bags AS (SELECT scan_id, page_index, coalesce(last_value(CASE WHEN bag_marker > last_kept THEN bag_marker END IGNORE NULLS) OVER (PARTITION BY scan_id ORDER BY page_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS bag FROM v_status),
v_segments AS (SELECT scan_id, bag_marker AS bag, page_index AS start_page, coalesce(lead(page_index) OVER (PARTITION BY scan_id ORDER BY page_index) - 1, n - 1) AS end_page
 FROM v_status JOIN (SELECT scan_id, max(page_index) + 1 AS n FROM v_pages GROUP BY scan_id) USING (scan_id) WHERE bag_marker > last_kept
 UNION ALL SELECT scan_id, 0, 0, coalesce(f, n) - 1 FROM (SELECT scan_id, max(page_index) + 1 AS n FROM v_pages GROUP BY scan_id)
 LEFT JOIN (SELECT scan_id, min(page_index) AS f FROM v_status WHERE bag_marker > last_kept GROUP BY scan_id) USING (scan_id) WHERE coalesce(f, 1) > 0)"""
CALLOUTS = """v_callouts AS (SELECT l_suppkey AS scan_id, l_orderkey % 64 AS page_index, CAST(l_quantity AS BIGINT) AS quantity, split_part(p_name, ' ', 1) AS color, p_name AS shape_desc
 FROM lineitem JOIN part ON l_partkey = p_partkey),
v_names AS (SELECT DISTINCT color, shape_desc, 'vision:' || array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(color), '[a-z0-9]+'), lambda t: t NOT IN ('color', 'colour')))), ' ')
 || '|' || array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(shape_desc), '[a-z0-9]+'), lambda t: t NOT IN ('color', 'colour')))), ' ') AS key FROM v_callouts),
v_counted AS (SELECT c.scan_id, c.page_index, quantity, c.color, c.shape_desc, key, coalesce(bag, 0) AS bag FROM v_callouts c JOIN v_names n ON c.color = n.color AND c.shape_desc = n.shape_desc
 LEFT JOIN v_bags b ON c.scan_id = b.scan_id AND c.page_index = b.page_index
 WHERE NOT EXISTS (SELECT 1 FROM v_pages p WHERE p.is_parts_list AND p.scan_id = c.scan_id AND p.page_index = c.page_index)),
v_located AS (SELECT scan_id, key, list_sort(list(DISTINCT bag)) AS bags, list_sort(list(DISTINCT page_index)) AS pages, CAST(sum(quantity) AS BIGINT) AS total_seen, count(*) AS n_occurrences FROM v_counted GROUP BY scan_id, key)"""
INVENTORY = "v_inventory AS (SELECT p_partkey AS inv_seq, p_brand AS part_num, p_name || ' ' || lower(p_type) AS name, split_part(p_name, ' ', 1) AS color_name, CAST(p_size AS BIGINT) AS quantity FROM part)"
TOKENS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"
MATCH = f"""v_desc AS (SELECT DISTINCT color, shape_desc, {TOKENS.format("color")} AS ct, {TOKENS.format("shape_desc")} AS st FROM v_callouts),
v_lines AS (SELECT color_name, name, min(inv_seq) AS inv_seq, {TOKENS.format("color_name")} AS ct, {TOKENS.format("name")} AS st FROM v_inventory GROUP BY color_name, name),
v_scores AS (SELECT color, shape_desc, inv_seq, round(least(CAST(0.9 AS DOUBLE), CAST(0.5 AS DOUBLE) * len(list_intersect(d.ct, l.ct)) / len(list_distinct(list_concat(d.ct, l.ct))) + CAST(0.5 AS DOUBLE) * len(list_intersect(d.st, l.st)) / len(list_distinct(list_concat(d.st, l.st)))), 9) AS score FROM v_desc d, v_lines l),
v_match AS (SELECT color, shape_desc, inv_seq, score FROM (SELECT *, row_number() OVER (PARTITION BY color, shape_desc ORDER BY score DESC, inv_seq) AS r FROM v_scores WHERE score >= 0.35) WHERE r = 1)"""
VALIDATED = """v_parts AS (SELECT scan_id, CAST(m.inv_seq AS VARCHAR) AS key, any_value(i.name) AS label, list_sort(list(DISTINCT bag)) AS bags, CAST(sum(c.quantity) AS BIGINT) AS total_seen, count(*) AS n_occurrences, any_value(i.quantity) AS inventory_qty
 FROM v_counted c JOIN v_match m ON c.color = m.color AND c.shape_desc = m.shape_desc JOIN v_inventory i ON i.inv_seq = m.inv_seq GROUP BY scan_id, m.inv_seq)"""
SIGNALS = """v_signals AS (SELECT l_orderkey AS crop_id, 'brickognize' AS signal, CAST(0.5 AS DOUBLE) AS w, l_partkey AS inv_seq, max(l_discount) AS score FROM lineitem GROUP BY l_orderkey, l_partkey
 UNION ALL SELECT l_orderkey, 'embedding', CAST(0.4 AS DOUBLE), l_partkey, max(l_tax) FROM lineitem GROUP BY l_orderkey, l_partkey),
v_blend AS (SELECT crop_id, inv_seq, round(sum(w * score) / (CAST(0.5 AS DOUBLE) + CAST(0.4 AS DOUBLE)), 9) AS confidence FROM v_signals GROUP BY crop_id, inv_seq),
v_ranked AS (SELECT *, row_number() OVER (PARTITION BY crop_id ORDER BY confidence DESC, inv_seq) AS rank FROM v_blend)"""


def _q(sql: str | None = None, *ctes: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = (f"WITH {', '.join(ctes)} " if ctes else "") + sql
        return f

    return add


def _joined(name: str) -> F.Column:
    return F.array_join(F.transform(name, lambda x: x.cast("string")), " ").alias(name)


@_q("SELECT scan_id, page_index, bag_marker, last_kept, CASE WHEN bag_marker > last_kept THEN 'kept' WHEN bag_marker = last_kept THEN 'repeated' ELSE 'suspect' END AS status FROM v_status WHERE bag_marker IS NOT NULL", PAGES)
def marker_status(spark: SparkSession, d: str) -> DataFrame:
    return segments.with_marker_status(views.pages(spark, d)).where("bag_marker is not null").select("scan_id", "page_index", "bag_marker", "last_kept", "status")


@_q("SELECT scan_id, page_index, CASE WHEN bag_marker = last_kept THEN printf('Bag marker %d repeated on page %d (same as the current bag); ignored.', bag_marker, page_index + 1) ELSE printf('Ignored suspect bag marker %d on page %d (less than previous bag %d).', bag_marker, page_index + 1, last_kept) END AS message FROM v_status WHERE bag_marker <= last_kept", PAGES)
def marker_warnings(spark: SparkSession, d: str) -> DataFrame:
    return segments.marker_warnings(views.pages(spark, d))


@_q("SELECT scan_id, bag, start_page, end_page FROM v_segments", PAGES)
def bag_segments(spark: SparkSession, d: str) -> DataFrame:
    return segments.segments(views.pages(spark, d))


@_q("SELECT scan_id, page_index, bag FROM v_bags", PAGES)
def page_to_bag(spark: SparkSession, d: str) -> DataFrame:
    return segments.page_bags(views.pages(spark, d))


@_q("SELECT scan_id, page_index, bag FROM v_bags", PAGES)
def segment_pages(spark: SparkSession, d: str) -> DataFrame:
    return segments.expanded(segments.segments(views.pages(spark, d)))


@_q("""SELECT scan_id, page_index, coalesce(bag_marker, CASE WHEN candidate THEN c + greatest(0, coalesce(max(bag_marker - c) OVER (PARTITION BY scan_id ORDER BY page_index ROWS UNBOUNDED PRECEDING), 0)) END) AS assigned
FROM (SELECT *, count(CASE WHEN bag_marker IS NULL AND candidate THEN 1 END) OVER (PARTITION BY scan_id ORDER BY page_index ROWS UNBOUNDED PRECEDING) AS c FROM v_pages)""", PAGES)
def ordinal_bags(spark: SparkSession, d: str) -> DataFrame:
    return segments.with_ordinals(views.pages(spark, d)).select("scan_id", "page_index", "assigned")


@_q("SELECT scan_id, count(*) AS n_pages FROM v_pages WHERE NOT is_parts_list GROUP BY scan_id", PAGES)
def bom_exclusion(spark: SparkSession, d: str) -> DataFrame:
    return views.pages(spark, d).where(~F.col("is_parts_list")).groupBy("scan_id").agg(F.count(F.lit(1)).alias("n_pages"))


@_q("SELECT scan_id, page_index, count(*) AS n_callouts, count(*) >= 12 AS is_parts_list FROM v_callouts GROUP BY scan_id, page_index", PAGES, CALLOUTS)
def bom_flag(spark: SparkSession, d: str) -> DataFrame:
    found = views.callouts(spark, d).groupBy("scan_id", "page_index").agg(F.count(F.lit(1)).alias("n_callouts"))
    return found.withColumn("is_parts_list", F.col("n_callouts") >= 12)


def _counted(spark: SparkSession, d: str) -> DataFrame:
    p = views.pages(spark, d)
    names = views.callouts(spark, d).select("color", "shape_desc").distinct().withColumn("key", C.vision_key(F.col("color"), F.col("shape_desc")))
    found = locating.counted(views.callouts(spark, d), p, segments.page_bags(p))
    return found.join(names, ["color", "shape_desc"])


@_q("SELECT scan_id, key, array_to_string(bags, ' ') AS bags, array_to_string(pages, ' ') AS pages, total_seen, n_occurrences, CAST(0.4 AS DOUBLE) AS confidence FROM v_located", PAGES, CALLOUTS)
def located_parts(spark: SparkSession, d: str) -> DataFrame:
    found = locating.located(_counted(spark, d)).withColumn("confidence", F.lit(locating.VISION_ONLY))
    return found.select("scan_id", "key", _joined("bags"), _joined("pages"), "total_seen", "n_occurrences", "confidence")


@_q("SELECT DISTINCT p_name, key FROM part JOIN v_names ON p_name = shape_desc", PAGES, CALLOUTS)
def vision_keys(spark: SparkSession, d: str) -> DataFrame:
    names = views.callouts(spark, d).select("color", "shape_desc").distinct()
    return names.select(F.col("shape_desc").alias("p_name"), C.vision_key(F.col("color"), F.col("shape_desc")).alias("key"))


@_q("SELECT color, shape_desc, inv_seq, score FROM v_match", PAGES, CALLOUTS, INVENTORY, MATCH)
def theta_match(spark: SparkSession, d: str) -> DataFrame:
    return matching.theta_match(views.callouts(spark, d), views.inventory(spark, d))


def _validated(spark: SparkSession, d: str) -> DataFrame:
    inv = views.inventory(spark, d)
    match = matching.theta_match(views.callouts(spark, d), inv).select("color", "shape_desc", "inv_seq")
    seen = _counted(spark, d).drop("key").join(match, ["color", "shape_desc"]).withColumn("key", F.col("inv_seq").cast("string"))
    lines = inv.select(F.col("inv_seq").cast("string").alias("key"), F.col("name").alias("label"), F.col("quantity").alias("inventory_qty"))
    return locating.validated(locating.located(seen).join(lines, "key"))


@_q("SELECT scan_id, key, total_seen, inventory_qty, total_seen = inventory_qty AS count_matches, CASE WHEN total_seen = inventory_qty THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.6 AS DOUBLE) END AS confidence FROM v_parts", PAGES, CALLOUTS, INVENTORY, MATCH, VALIDATED)
def count_validation(spark: SparkSession, d: str) -> DataFrame:
    return _validated(spark, d).select("scan_id", "key", "total_seen", "inventory_qty", "count_matches", "confidence")


@_q("""SELECT scan_id, key, CASE WHEN total_seen > inventory_qty AND total_seen - inventory_qty < n_occurrences THEN 'reuse' ELSE 'mismatch' END AS kind,
CASE WHEN total_seen > inventory_qty AND total_seen - inventory_qty < n_occurrences THEN printf('%s appears in %d step(s) (piece count %d) — multi-step reuse, not a miscount.', label, n_occurrences, inventory_qty)
ELSE printf('Count mismatch for %s: saw %d, inventory has %d.', label, total_seen, inventory_qty) END AS message FROM v_parts WHERE total_seen <> inventory_qty""", PAGES, CALLOUTS, INVENTORY, MATCH, VALIDATED)
def mismatch_warnings(spark: SparkSession, d: str) -> DataFrame:
    return locating.count_warnings(_validated(spark, d))


@_q("SELECT scan_id, bag, array_to_string(list_sort(list(key)), ' ') AS keys FROM (SELECT scan_id, key, unnest(bags) AS bag FROM v_located) GROUP BY scan_id, bag", PAGES, CALLOUTS)
def reverse_index(spark: SparkSession, d: str) -> DataFrame:
    return locating.reverse_index(locating.located(_counted(spark, d))).select("scan_id", "bag", F.array_join("keys", " ").alias("keys"))


@_q("""SELECT scan_id, bag, count(key) AS n_parts, count(CASE WHEN total_seen <> inventory_qty THEN 1 END) AS n_bad FROM (SELECT scan_id, bag FROM v_segments UNION SELECT scan_id, unnest(bags) FROM v_parts)
LEFT JOIN (SELECT scan_id, key, total_seen, inventory_qty, unnest(bags) AS bag FROM v_parts) USING (scan_id, bag) GROUP BY scan_id, bag""", PAGES, CALLOUTS, INVENTORY, MATCH, VALIDATED)
def bag_cards(spark: SparkSession, d: str) -> DataFrame:
    return locating.bag_cards(segments.segments(views.pages(spark, d)), _validated(spark, d))


@_q("SELECT DISTINCT bag FROM (SELECT bag FROM v_segments UNION ALL SELECT unnest(bags) FROM v_located)", PAGES, CALLOUTS)
def bag_facet(spark: SparkSession, d: str) -> DataFrame:
    found = locating.located(_counted(spark, d)).select(F.explode("bags").alias("bag"))
    return found.union(segments.segments(views.pages(spark, d)).select("bag")).distinct()


@_q("SELECT CASE WHEN total_seen = inventory_qty THEN 'ok' ELSE 'bad' END AS status, count(*) AS n, CAST(sum(total_seen - inventory_qty) AS BIGINT) AS delta FROM v_parts GROUP BY 1", PAGES, CALLOUTS, INVENTORY, MATCH, VALIDATED)
def status_facet(spark: SparkSession, d: str) -> DataFrame:
    parts = _validated(spark, d).withColumn("status", C.status(F.col("reconciled"), F.col("count_matches")))
    return parts.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("total_seen") - F.col("inventory_qty")).alias("delta"))


@_q("SELECT l_orderkey AS crop_id, inv_seq, max(greatest(CAST(0 AS DOUBLE), l_discount)) AS score FROM lineitem JOIN part p ON l_partkey = p.p_partkey JOIN (SELECT p_brand, min(p_partkey) AS inv_seq FROM part GROUP BY p_brand) b ON p.p_brand = b.p_brand GROUP BY 1, 2")
def closed_set_candidates(spark: SparkSession, d: str) -> DataFrame:
    part = views.table(spark, d, "part")
    named = part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("part_num"))
    candidates = views.table(spark, d, "lineitem").join(named, "l_partkey").select(F.col("l_orderkey").alias("crop_id"), "part_num", F.col("l_discount").alias("score"))
    lines = part.groupBy(F.col("p_brand").alias("part_num")).agg(F.min("p_partkey").alias("inv_seq"))
    return matching.closed_set(candidates, lines)


@_q("SELECT crop_id, inv_seq, confidence FROM v_ranked WHERE rank = 1", SIGNALS)
def blend_rank(spark: SparkSession, d: str) -> DataFrame:
    return matching.ranked(matching.blend(views.signals(spark, d)), 1).drop("rank")


@_q("SELECT crop_id, inv_seq, confidence, rank FROM v_ranked WHERE rank BETWEEN 2 AND 5", SIGNALS)
def alternatives_topk(spark: SparkSession, d: str) -> DataFrame:
    return matching.ranked(matching.blend(views.signals(spark, d)), 5).where("rank > 1")


@_q("""SELECT t.doc_id AS page_index, CASE WHEN toxic = 1 THEN quality END AS bag_marker, coalesce(nullif(quality, 0), CAST(n_chars AS INTEGER)) AS printed, coalesce(callouts, 0) AS callouts FROM labels t
LEFT JOIN (SELECT doc_id, n_chars, 1 AS callouts FROM documents) d ON t.doc_id = d.doc_id AND quality = 1 AND toxic = 0""")
def two_pass_merge(spark: SparkSession, d: str) -> DataFrame:
    t = views.table(spark, d, "labels").select(F.col("doc_id").alias("page_index"), F.when(F.col("toxic") == 1, F.col("quality")).alias("bag_marker"), F.col("quality").alias("printed"), (F.col("toxic") == 1).alias("is_parts_list"), (F.col("quality") == 1).alias("has_callouts"))
    x = views.table(spark, d, "documents").select(F.col("doc_id").alias("page_index"), F.lit(None).cast("int").alias("bag_marker"), F.col("n_chars").cast("int").alias("printed"), F.lit(False).alias("is_parts_list"), F.lit(1).alias("callouts"))
    return locating.two_pass(t, x).drop("is_parts_list")


@_q("SELECT count(*) AS triaged, count(CASE WHEN quality = 1 AND toxic = 0 THEN 1 END) AS detailed, count(CASE WHEN NOT (quality = 1 AND toxic = 0) THEN 1 END) AS skipped FROM labels")
def two_pass_stats(spark: SparkSession, d: str) -> DataFrame:
    return locating.two_pass_stats(views.table(spark, d, "labels").select((F.col("quality") == 1).alias("has_callouts"), (F.col("toxic") != 0).alias("is_parts_list")))


@_q("SELECT l_returnflag, min(l_quantity) AS low, quantile_cont(l_quantity, 0.5) AS median, max(l_quantity) AS high FROM lineitem GROUP BY l_returnflag")
def min_median_max(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.min("l_quantity").alias("low"), F.percentile("l_quantity", 0.5).alias("median"), F.max("l_quantity").alias("high"))


@_q("SELECT doc_id, greatest(1, coalesce(TRY_CAST(nullif(regexp_extract(text, '([0-9]+)\\s*[xX]', 1), '') AS INTEGER), 1)) AS quantity FROM documents")
def quantity_parse(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "documents").select("doc_id", C.quantity(F.col("text")).alias("quantity"))


@_q("SELECT label, vec_id, row_number() OVER (ORDER BY label, vec_id) - 1 AS idx FROM embeddings")
def dataset_flatten(spark: SparkSession, d: str) -> DataFrame:
    """Places 0, 1, ... in order of (label, vec_id): numbers within a label plus the sizes of the labels before it."""
    e = views.table(spark, d, "embeddings").select("label", "vec_id")
    sizes = e.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("label", F.coalesce(F.sum("n").over(Window.orderBy("label").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    inner = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return e.withColumn("i", inner).join(before, "label").select("label", "vec_id", (F.col("offset") + F.col("i")).alias("idx"))


LAB = """v_rgb AS (SELECT p_partkey, CAST(p_partkey % 256 AS DOUBLE) AS r, CAST(p_partkey * 7 % 256 AS DOUBLE) AS g, CAST(p_partkey * 13 % 256 AS DOUBLE) AS b FROM part),
v_lin AS (SELECT p_partkey, CASE WHEN r / 255 <= 0.04045 THEN r / 255 / CAST(12.92 AS DOUBLE) ELSE pow((r / 255 + CAST(0.055 AS DOUBLE)) / CAST(1.055 AS DOUBLE), CAST(2.4 AS DOUBLE)) END AS r,
 CASE WHEN g / 255 <= 0.04045 THEN g / 255 / CAST(12.92 AS DOUBLE) ELSE pow((g / 255 + CAST(0.055 AS DOUBLE)) / CAST(1.055 AS DOUBLE), CAST(2.4 AS DOUBLE)) END AS g,
 CASE WHEN b / 255 <= 0.04045 THEN b / 255 / CAST(12.92 AS DOUBLE) ELSE pow((b / 255 + CAST(0.055 AS DOUBLE)) / CAST(1.055 AS DOUBLE), CAST(2.4 AS DOUBLE)) END AS b FROM v_rgb),
v_xyz AS (SELECT p_partkey, (r * CAST(0.4124564 AS DOUBLE) + g * CAST(0.3575761 AS DOUBLE) + b * CAST(0.1804375 AS DOUBLE)) / CAST(0.95047 AS DOUBLE) AS x, r * CAST(0.2126729 AS DOUBLE) + g * CAST(0.7151522 AS DOUBLE) + b * CAST(0.0721750 AS DOUBLE) AS y,
 (r * CAST(0.0193339 AS DOUBLE) + g * CAST(0.1191920 AS DOUBLE) + b * CAST(0.9503041 AS DOUBLE)) / CAST(1.08883 AS DOUBLE) AS z FROM v_lin),
v_f AS (SELECT p_partkey, CASE WHEN x > pow(6.0 / 29, 3) THEN cbrt(x) ELSE x / (3 * pow(6.0 / 29, 2)) + 4.0 / 29 END AS x, CASE WHEN y > pow(6.0 / 29, 3) THEN cbrt(y) ELSE y / (3 * pow(6.0 / 29, 2)) + 4.0 / 29 END AS y,
 CASE WHEN z > pow(6.0 / 29, 3) THEN cbrt(z) ELSE z / (3 * pow(6.0 / 29, 2)) + 4.0 / 29 END AS z FROM v_xyz)"""


@_q("SELECT p_partkey, round(116 * y - 16, 5) AS l, round(500 * (x - y), 5) AS a, round(200 * (y - z), 5) AS b FROM v_f", LAB)
def lab_colors(spark: SparkSession, d: str) -> DataFrame:
    p = views.table(spark, d, "part").select("p_partkey", *((F.col("p_partkey") * m % 256).cast("double").alias(n) for n, m in (("r", 1), ("g", 7), ("bl", 13))))
    l, a, b = C.lab(F.col("r"), F.col("g"), F.col("bl"))
    return p.select("p_partkey", F.round(l, 5).alias("l"), F.round(a, 5).alias("a"), F.round(b, 5).alias("b"))
