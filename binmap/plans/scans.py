"""Queries that run both engines to their results, and what a viewer asks of these; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binmap.functions import colors
from binmap.functions import columns as C
from binmap.operators import locating, matching, segments, viewing
from binmap.plans import sinks
from binmap.plans.queries import PAGES, SIGNALS, _joined, _q
from binmap.sources import files, views

TOKENS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"
BARE = "list_filter(" + TOKENS + ", lambda t: t NOT IN ('color', 'colour'))"
JACCARD = "len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1})))"
WORDS = "array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+')), lambda t: t NOT IN ('color', 'colour'))), ' ')"

LINES = """v_lines AS (SELECT p_partkey AS inv_seq, p_brand AS part_num, CASE WHEN p_partkey % 7 <> 0 THEN p_name || ' ' || lower(p_type) ELSE '' END AS name, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 11 END AS color_id,
 split_part(p_name, ' ', 1) AS color_name, CAST(p_size AS BIGINT) AS quantity, 'E' || p_partkey AS element_id FROM part),
v_keyed AS (SELECT *, part_num || '|' || coalesce(CAST(color_id AS VARCHAR), color_name, 'None') AS line_key FROM v_lines)"""
PRINTED = """v_seen AS (SELECT l_suppkey AS scan_id, l_orderkey % 64 AS page_index, l_orderkey * 10000000 + l_linenumber * 1000000 + l_partkey AS pos, CAST(l_quantity AS BIGINT) AS quantity, split_part(p_name, ' ', 1) AS color, p_name AS shape_desc,
 CASE WHEN l_linenumber = 1 THEN ' e' || l_partkey WHEN l_linenumber = 2 THEN upper(p_brand) END AS printed FROM lineitem JOIN part ON l_partkey = p_partkey)"""
BEST = f"""v_ids AS (SELECT lower(element_id) AS id, inv_seq, 1.0 AS score FROM v_lines UNION ALL SELECT lower(part_num), inv_seq, 0.95 FROM v_lines),
v_id AS (SELECT id, inv_seq FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, inv_seq) AS r FROM v_ids) WHERE r = 1),
v_desc AS (SELECT DISTINCT color, shape_desc, {BARE.format("color")} AS ct, {TOKENS.format("shape_desc")} AS st FROM v_seen),
v_short AS (SELECT color_name, name, min(inv_seq) AS inv_seq, {BARE.format("color_name")} AS ct, {TOKENS.format("name")} AS st FROM v_lines GROUP BY color_name, name),
v_scores AS (SELECT color, shape_desc, inv_seq, round(least(CAST(0.9 AS DOUBLE), CASE WHEN len(d.ct) > 0 AND len(l.ct) > 0 THEN CAST(0.5 AS DOUBLE) * {JACCARD.format("d.ct", "l.ct")} ELSE 0 END
 + CASE WHEN len(d.st) > 0 AND len(l.st) > 0 THEN CAST(0.5 AS DOUBLE) * {JACCARD.format("d.st", "l.st")} ELSE 0 END), 9) AS score FROM v_desc d, v_short l),
v_theta AS (SELECT color, shape_desc, inv_seq FROM (SELECT *, row_number() OVER (PARTITION BY color, shape_desc ORDER BY score DESC, inv_seq) AS r FROM v_scores WHERE score >= 0.35) WHERE r = 1)"""
PARTS = f"""v_kept AS (SELECT s.*, coalesce(b.bag, 0) AS bag, coalesce(i.inv_seq, t.inv_seq) AS inv_seq FROM v_seen s LEFT JOIN v_bags b ON s.scan_id = b.scan_id AND s.page_index = b.page_index
 LEFT JOIN v_id i ON trim(lower(s.printed)) = i.id LEFT JOIN v_theta t ON t.color = s.color AND t.shape_desc = s.shape_desc
 WHERE NOT EXISTS (SELECT 1 FROM v_pages p WHERE p.is_parts_list AND p.scan_id = s.scan_id AND p.page_index = s.page_index)),
v_occ AS (SELECT k.scan_id, k.page_index, k.pos, k.quantity, k.bag, coalesce(l.line_key, 'vision:' || {WORDS.format("k.color")} || '|' || {WORDS.format("k.shape_desc")}) AS key,
 CASE WHEN l.line_key IS NULL THEN k.shape_desc ELSE l.name END AS name, l.part_num, CASE WHEN l.line_key IS NULL THEN k.color ELSE l.color_name END AS color_name, l.element_id, l.quantity AS inventory_qty, l.line_key IS NOT NULL AS reconciled
 FROM v_kept k LEFT JOIN v_keyed l ON l.inv_seq = k.inv_seq),
v_first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, key ORDER BY page_index, pos) AS r FROM v_occ) WHERE r = 1),
v_sums AS (SELECT scan_id, key, list_sort(list(DISTINCT bag)) AS bags, list_sort(list(DISTINCT page_index)) AS pages, CAST(sum(quantity) AS BIGINT) AS total_seen, count(*) AS n_occurrences,
 string_agg(bag || ':' || page_index || ':' || quantity, ' ' ORDER BY page_index, pos, bag, quantity) AS occurrences FROM v_occ GROUP BY scan_id, key),
v_part AS (SELECT s.*, f.name, f.part_num, f.color_name, f.element_id, f.inventory_qty, f.reconciled, f.page_index AS first_page, f.pos AS first_pos, CASE WHEN f.reconciled THEN s.total_seen = f.inventory_qty END AS count_matches,
 CASE WHEN NOT f.reconciled THEN CAST(0.4 AS DOUBLE) WHEN s.total_seen = f.inventory_qty THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.6 AS DOUBLE) END AS confidence FROM v_sums s JOIN v_first f ON s.scan_id = f.scan_id AND s.key = f.key),
v_listed AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY bags[1], coalesce(nullif(name, ''), key), first_page, first_pos) - 1 AS ord FROM v_part)"""
ENGINE_A = (PAGES, LINES, PRINTED, BEST, PARTS)


def _occurrences() -> F.Column:
    return F.array_join(F.transform("occurrences", lambda o: F.concat_ws(":", o["bag"].cast("string"), o["page_index"].cast("string"), o["quantity"].cast("string"))), " ").alias("occurrences")


def _scan(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return locating.scan_extracts(views.pages(spark, d), views.printed_callouts(spark, d), views.full_inventory(spark, d))


def _reconciled(spark: SparkSession, d: str) -> DataFrame:
    return _scan(spark, d)[0]


@_q("SELECT scan_id, ord, key, part_num, name, color_name, element_id, occurrences, array_to_string(bags, ' ') AS bags, array_to_string(pages, ' ') AS pages, total_seen, inventory_qty, reconciled, count_matches, confidence FROM v_listed", *ENGINE_A)
def reconciled_parts(spark: SparkSession, d: str) -> DataFrame:
    """Every part with its occurrences, in the order of its scan's list."""
    parts = _reconciled(spark, d).withColumn("ord", locating.part_order())
    return parts.select("scan_id", "ord", "key", "part_num", "name", "color_name", "element_id", _occurrences(), _joined("bags"), _joined("pages"), "total_seen", "inventory_qty", "reconciled", "count_matches", "confidence")


@_q("""SELECT scan_id, 1 AS phase, row_number() OVER (PARTITION BY scan_id ORDER BY page_index) AS ord, CASE WHEN bag_marker = last_kept THEN printf('Bag marker %d repeated on page %d (same as the current bag); ignored.', bag_marker, page_index + 1)
 ELSE printf('Ignored suspect bag marker %d on page %d (less than previous bag %d).', bag_marker, page_index + 1, last_kept) END AS message FROM v_status WHERE bag_marker <= last_kept
UNION ALL SELECT scan_id, 1, 1099511627776, 'No bag markers detected; treating the whole PDF as bag 0 (unknown).' FROM v_status GROUP BY scan_id HAVING count(CASE WHEN bag_marker > last_kept THEN 1 END) = 0
UNION ALL SELECT scan_id, 2, row_number() OVER (PARTITION BY scan_id ORDER BY first_page, first_pos), printf('Count mismatch for %s: saw %d in pages, inventory has %d.', coalesce(nullif(name, ''), key), total_seen, inventory_qty) FROM v_part WHERE NOT count_matches""", *ENGINE_A)
def scan_warnings(spark: SparkSession, d: str) -> DataFrame:
    """Warnings of the first engine, by phase and in order."""
    return _scan(spark, d)[2]


@_q("""SELECT scan_id, ord, coalesce(part_num, '') AS part_num, coalesce(name, '') AS name, coalesce(color_name, '') AS color, coalesce(element_id, '') AS element_id, array_to_string(bags, ' ') AS bags, array_to_string(list_transform(pages, lambda p: p + 1), ' ') AS pages_1based,
CAST(total_seen AS VARCHAR) AS total_seen, coalesce(CAST(inventory_qty AS VARCHAR), '') AS inventory_qty, CASE WHEN count_matches THEN 'True' WHEN NOT count_matches THEN 'False' ELSE '' END AS count_matches, printf('%.2f', confidence) AS confidence, '' AS image_url FROM v_listed""", *ENGINE_A)
def csv_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows of every scan's CSV file, in order."""
    return sinks.csv_rows(_reconciled(spark, d).withColumn("ord", locating.part_order()))


def _results(spark: SparkSession, d: str) -> DataFrame:
    parts, bags, warnings = _scan(spark, d)
    pages = views.pages(spark, d)
    scans = pages.groupBy("scan_id").agg((F.max("page_index") + 1).alias("num_pages"))
    named = scans.select("scan_id", F.col("scan_id").cast("string").alias("set_num"), F.lit(None).cast("string").alias("set_name"), F.lit(None).cast("string").alias("source_pdf"), "num_pages", F.lit(True).alias("reconciled"))
    return locating.results(parts, bags, warnings, named)


SCANS = "v_scans AS (SELECT scan_id, max(page_index) + 1 AS num_pages FROM v_pages GROUP BY scan_id)"


@_q("""SELECT s.scan_id, num_pages, (SELECT count(*) FROM v_segments g WHERE g.scan_id = s.scan_id) AS n_bags, (SELECT count(*) FROM v_part p WHERE p.scan_id = s.scan_id) AS n_parts,
(SELECT key FROM v_listed l WHERE l.scan_id = s.scan_id AND l.ord = 0) AS first_part, (SELECT count(*) FROM v_part p WHERE p.scan_id = s.scan_id AND NOT count_matches) + (SELECT count(*) FROM v_status t WHERE t.scan_id = s.scan_id AND bag_marker <= last_kept)
 + CASE WHEN EXISTS (SELECT 1 FROM v_status t WHERE t.scan_id = s.scan_id AND bag_marker > last_kept) THEN 0 ELSE 1 END AS n_warnings FROM v_scans s""", *ENGINE_A, SCANS)
def scan_results(spark: SparkSession, d: str) -> DataFrame:
    """What the nested result of each scan holds."""
    size = lambda c: F.size(c).cast("long")
    return _results(spark, d).select("scan_id", "num_pages", size("bags").alias("n_bags"), size("parts").alias("n_parts"), F.get("parts", F.lit(0))["key"].alias("first_part"), size("warnings").alias("n_warnings"))


@_q()
def scan_result_json(spark: SparkSession, d: str) -> DataFrame:
    """The result of each scan as a JSON text."""
    return sinks.json_rows(_results(spark, d))


STATUS = "CASE WHEN NOT reconciled THEN 'vision' WHEN coalesce(count_matches, false) THEN 'ok' ELSE 'bad' END"


@_q(f"""SELECT scan_id, key, total_seen, {STATUS} AS status FROM v_part WHERE list_contains(bags, 1) AND {STATUS} = 'bad'
 AND (contains(lower(name), 'e1') OR contains(lower(color_name), 'e1') OR contains(lower(coalesce(element_id, '')), 'e1') OR contains(lower(coalesce(part_num, '')), 'e1'))""", *ENGINE_A)
def viewer_filter(spark: SparkSession, d: str) -> DataFrame:
    """Parts of bag 1 whose count is off and that have a text in one of four fields."""
    return viewing.filtered(_reconciled(spark, d), " E1", 1, "bad").select("scan_id", "key", "total_seen", "status")


@_q("SELECT scan_id, key, row_number() OVER (PARTITION BY scan_id ORDER BY coalesce(bags[1], -1) DESC, key) AS place FROM v_part", *ENGINE_A)
def viewer_order(spark: SparkSession, d: str) -> DataFrame:
    """Places of a scan's parts when they are sorted by their bags, the last first."""
    from pyspark.sql import Window

    parts = _reconciled(spark, d)
    order = Window.partitionBy("scan_id").orderBy(viewing.sort_key(parts, "bags").desc_nulls_last(), "key")
    return parts.select("scan_id", "key", F.row_number().over(order).alias("place"))


@_q("SELECT scan_id, key, row_number() OVER (PARTITION BY scan_id, key ORDER BY page_index, pos, bag, quantity) - 1 AS ord, bag, page_index + 1 AS page, quantity FROM v_occ", *ENGINE_A)
def viewer_occurrences(spark: SparkSession, d: str) -> DataFrame:
    return viewing.occurrences(_reconciled(spark, d))


@_q(f"""SELECT scan_id, bag, CAST(NULL AS VARCHAR) AS status, count(*) AS n FROM (SELECT scan_id, key, unnest(bags) AS bag FROM v_part) GROUP BY scan_id, bag
UNION ALL SELECT scan_id, NULL, status, count(*) FROM (SELECT scan_id, {STATUS} AS status FROM v_part) GROUP BY GROUPING SETS ((scan_id, status), (scan_id))""", *ENGINE_A)
def viewer_facets(spark: SparkSession, d: str) -> DataFrame:
    return viewing.facets(_reconciled(spark, d))


@_q(f"""SELECT g.scan_id, g.bag, CASE WHEN g.bag = 0 THEN 'Intro' ELSE 'Bag ' || g.bag END AS label, CASE WHEN start_page = end_page THEN 'page ' || (start_page + 1) ELSE 'pages ' || (start_page + 1) || '–' || (end_page + 1) END AS pages,
count(p.key) AS n_parts, count(CASE WHEN p.key IS NOT NULL AND {STATUS} = 'bad' THEN 1 END) AS n_bad FROM v_segments g LEFT JOIN v_part p ON p.scan_id = g.scan_id AND list_contains(p.bags, g.bag) GROUP BY ALL""", *ENGINE_A)
def viewer_cards(spark: SparkSession, d: str) -> DataFrame:
    parts, bags, _ = _scan(spark, d)
    return viewing.cards(bags, locating.bag_cards(bags, parts))


@_q(f"""SELECT scan_id, key, coalesce(nullif(name, ''), 'unknown') AS name, color_name AS color, array_to_string(bags, ' ') AS bags, array_to_string(list_transform(pages, lambda p: p + 1), ', ') AS pages, CAST(total_seen AS VARCHAR) AS seen,
coalesce(CAST(inventory_qty AS VARCHAR), '—') AS inventory, CASE WHEN {STATUS} = 'bad' THEN '(' || CASE WHEN total_seen < inventory_qty THEN '−' || (inventory_qty - total_seen) ELSE '+' || (total_seen - inventory_qty) END || ' seen)' ELSE '' END AS delta, printf('%.2f', confidence) AS confidence FROM v_part""", *ENGINE_A)
def viewer_rows(spark: SparkSession, d: str) -> DataFrame:
    return viewing.rows(_reconciled(spark, d))


@_q("SELECT s.scan_id, '#' || s.scan_id || ' · ' || count(p.key) || ' parts · ' || num_pages || ' pages · reconciled' AS meta FROM v_scans s LEFT JOIN v_part p ON p.scan_id = s.scan_id GROUP BY s.scan_id, num_pages", *ENGINE_A, SCANS)
def meta_lines(spark: SparkSession, d: str) -> DataFrame:
    r = _results(spark, d)
    return r.select("scan_id", C.meta_line(F.col("set_name"), F.col("set_num"), F.size("parts"), F.col("num_pages"), F.col("reconciled")).alias("meta"))


@_q("SELECT p_partkey, p_name, p_size FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_brand), '#7') OR contains(lower(p_type), 'red')")
def search_parts(spark: SparkSession, d: str) -> DataFrame:
    has = lambda c, t: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(t))
    return views.table(spark, d, "part").where(has("p_name", "red") | has("p_brand", "#7") | has("p_type", "red")).select("p_partkey", "p_name", "p_size")


@_q("SELECT scan_id, page_index, bag_marker, CASE page_index WHEN 2 THEN 0 WHEN 3 THEN 1 WHEN 4 THEN 2 WHEN 5 THEN 3 ELSE 4 END AS scan_seq FROM v_pages WHERE page_index BETWEEN 2 AND 6", PAGES)
def page_limit(spark: SparkSession, d: str) -> DataFrame:
    """The first five pages of a range, with their places in it."""
    pages = views.pages(spark, d)
    n = pages.agg(F.max("page_index") + 1).first()[0] or 0
    return files.select_pages(pages, "3-9,4", n, 5).select("scan_id", "page_index", "bag_marker", "scan_seq")


@_q("""SELECT scan_id, 5 AS phase, row_number() OVER (PARTITION BY scan_id ORDER BY page_index) AS ord, printf('page %d: OCR-read bag_marker=%d does not exceed the running sequence (%d); left as-is for the monotonic filter to handle', page_index, bag_marker, before) AS message
FROM (SELECT *, coalesce(lag(c + greatest(0, coalesce(m, 0))) OVER (PARTITION BY scan_id ORDER BY page_index), 0) AS before FROM
 (SELECT *, max(bag_marker - c) OVER (PARTITION BY scan_id ORDER BY page_index ROWS UNBOUNDED PRECEDING) AS m FROM
 (SELECT *, count(CASE WHEN bag_marker IS NULL AND candidate THEN 1 END) OVER (PARTITION BY scan_id ORDER BY page_index ROWS UNBOUNDED PRECEDING) AS c FROM v_pages))) WHERE bag_marker <= before""", PAGES)
def ordinal_warnings(spark: SparkSession, d: str) -> DataFrame:
    return segments.ordinal_warnings(views.pages(spark, d))


CROPS = """v_crops AS (SELECT l_suppkey AS scan_id, l_orderkey % 64 AS page_index, l_orderkey * 10000000000 + CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 100 + CAST(l_quantity AS BIGINT) AS pos, CAST(l_quantity AS BIGINT) AS quantity,
 CASE WHEN l_linenumber <> 3 THEN ['Red', 'Dark Red', 'Blue'][l_partkey % 3 + 1] END AS seen_color, CASE WHEN l_discount >= 0.01 THEN l_partkey END AS inv_seq,
 CASE WHEN l_discount < 0.01 THEN 0 ELSE l_discount * 5 + l_tax / 7 + l_partkey % 97 / CAST(970 AS DOUBLE) END AS confidence, CASE WHEN l_discount < 0.01 AND l_tax < 0.02 THEN 'timeout ' || l_linenumber END AS error FROM lineitem),
v_ordinal AS (SELECT scan_id, page_index, is_parts_list, coalesce(bag_marker, CASE WHEN candidate THEN c + greatest(0, coalesce(max(bag_marker - c) OVER (PARTITION BY scan_id ORDER BY page_index ROWS UNBOUNDED PRECEDING), 0)) END) AS bag_marker
 FROM (SELECT *, count(CASE WHEN bag_marker IS NULL AND candidate THEN 1 END) OVER (PARTITION BY scan_id ORDER BY page_index ROWS UNBOUNDED PRECEDING) AS c FROM v_pages)),
v_marked AS (SELECT *, greatest(0, coalesce(max(bag_marker) OVER (PARTITION BY scan_id ORDER BY page_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS last_kept FROM v_ordinal),
v_bagged AS (SELECT scan_id, page_index, coalesce(last_value(CASE WHEN bag_marker > last_kept THEN bag_marker END IGNORE NULLS) OVER (PARTITION BY scan_id ORDER BY page_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS bag FROM v_marked),
v_held AS (SELECT c.*, coalesce(b.bag, 0) AS bag FROM v_crops c LEFT JOIN v_bagged b ON b.scan_id = c.scan_id AND b.page_index = c.page_index WHERE NOT EXISTS (SELECT 1 FROM v_pages p WHERE p.is_parts_list AND p.scan_id = c.scan_id AND p.page_index = c.page_index)),
v_crop_occ AS (SELECT h.scan_id, h.page_index, h.pos, h.quantity, h.bag, h.seen_color, coalesce(l.line_key, 'unknown:' || coalesce(h.seen_color, '?')) AS key, CASE WHEN l.line_key IS NULL THEN 'Unidentified (' || coalesce(h.seen_color, 'unknown colour') || ')' ELSE l.name END AS name,
 l.part_num, l.quantity AS inventory_qty, CASE WHEN l.line_key IS NULL THEN 0 ELSE h.confidence END AS sure FROM v_held h LEFT JOIN v_keyed l ON l.inv_seq = h.inv_seq),
v_crop_part AS (SELECT o.scan_id, o.key, f.name, f.part_num, f.inventory_qty, o.total_seen, o.n, o.confidence, o.bags, f.page_index AS first_page, f.pos AS first_pos, o.total_seen = f.inventory_qty AS count_matches FROM
 (SELECT scan_id, key, CAST(sum(quantity) AS BIGINT) AS total_seen, count(*) AS n, round(avg(sure), 3) AS confidence, list_sort(list(DISTINCT bag)) AS bags FROM v_crop_occ GROUP BY scan_id, key) o
 JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, key ORDER BY page_index, pos) AS r FROM v_crop_occ) WHERE r = 1) f ON f.scan_id = o.scan_id AND f.key = o.key)"""
ENGINE_B = (PAGES, LINES, CROPS)


def _assembled(spark: SparkSession, d: str, capacity: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    return locating.scan_crops(views.pages(spark, d), views.crops(spark, d), views.full_inventory(spark, d), capacity=capacity)


@_q("SELECT scan_id, key, name, part_num, array_to_string(bags, ' ') AS bags, total_seen, n AS n_occurrences, inventory_qty, count_matches, confidence FROM v_crop_part", *ENGINE_B)
def assembled_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts of identified crops, each kept where it was identified; unidentified ones by colour; mean confidences."""
    parts = _assembled(spark, d, False)[0]
    return parts.select("scan_id", "key", "name", "part_num", _joined("bags"), "total_seen", F.size("occurrences").cast("long").alias("n_occurrences"), "inventory_qty", "count_matches", "confidence")


@_q("""SELECT scan_id, 2 AS phase, row_number() OVER (PARTITION BY scan_id ORDER BY first_page, first_pos) AS ord, CASE WHEN total_seen > inventory_qty AND total_seen - inventory_qty < n THEN printf('%s appears in %d step(s) (piece count %d) — multi-step reuse, not a miscount.', coalesce(nullif(name, ''), key), n, inventory_qty)
 ELSE printf('Count mismatch for %s: saw %d, inventory has %d.', coalesce(nullif(name, ''), key), total_seen, inventory_qty) END AS message FROM v_crop_part WHERE NOT count_matches
UNION ALL SELECT scan_id, 3, r, message FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY page, pos) AS r FROM (SELECT scan_id, message, min(page) AS page, arg_min(pos, page * 10000000000000000 + pos) AS pos FROM
 (SELECT scan_id, page_index AS page, pos, printf('identify failed on page %d: %s', page_index + 1, error) AS message FROM v_held WHERE error IS NOT NULL) GROUP BY scan_id, message)) WHERE r <= 3
UNION ALL SELECT scan_id, 3, 4, printf('%d identify call(s) failed in total (only the first 3 distinct messages are shown above).', count(*)) FROM v_held WHERE error IS NOT NULL GROUP BY scan_id HAVING count(*) > 3
UNION ALL SELECT scan_id, 4, 1, printf('%d callout(s) could not be identified against the inventory.', CAST(sum(n) AS BIGINT)) FROM v_crop_part WHERE key LIKE 'unknown:%' GROUP BY scan_id""", *ENGINE_B)
def assembled_warnings(spark: SparkSession, d: str) -> DataFrame:
    """Warnings of the second engine about counts, failures and what stayed unidentified."""
    return _assembled(spark, d, False)[2].where(F.col("phase").between(2, 4))


@_q()
def assembled_with_capacity(spark: SparkSession, d: str) -> DataFrame:
    """Parts of identified crops, diverted where a line's pieces are used up."""
    parts = _assembled(spark, d, True)[0]
    return parts.select("scan_id", "key", _joined("bags"), "total_seen", "inventory_qty", "count_matches", "confidence")


@_q("""SELECT scan_id, i, coalesce(part_num, 'unknown') || printf('/p%03d_i%03d.png', page_index, i) AS file, bag, quantity, seen_color, part_num, part_num AS raw_part_num, round(confidence, 9) AS confidence FROM
(SELECT h.scan_id, h.page_index, h.bag, h.quantity, h.seen_color, l.part_num, CASE WHEN l.inv_seq IS NULL THEN 0 ELSE h.confidence END AS confidence, row_number() OVER (PARTITION BY h.scan_id ORDER BY h.page_index, h.pos) - 1 AS i FROM v_held h LEFT JOIN v_keyed l ON l.inv_seq = h.inv_seq)""", *ENGINE_B)
def crop_manifest(spark: SparkSession, d: str) -> DataFrame:
    """The manifest's entry of every crop."""
    pages = segments.with_ordinals(views.pages(spark, d)).withColumn("bag_marker", F.col("assigned")).drop("assigned")
    inventory = views.full_inventory(spark, d)
    found = sinks.manifest(locating.assignments(views.crops(spark, d), pages, segments.page_bags(pages), inventory, False), inventory)
    return found.select("scan_id", "i", "file", "bag", "quantity", "seen_color", "part_num", "raw_part_num", F.round("confidence", 9).alias("confidence"))


@_q("""SELECT scan_id, crop_id, inv_seq, confidence, diverted FROM rec WHERE rn > 0""", """RECURSIVE v_order AS (SELECT l_orderkey AS scan_id, l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey AS crop_id, CAST(l_quantity AS BIGINT) AS quantity, l_partkey % 5 AS pick, l_discount * 10 AS score, l_linenumber % 2 = 0 AS alone,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount * 10 DESC, l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey) AS rn FROM lineitem),
rec(scan_id, rn, used, crop_id, inv_seq, confidence, diverted) AS (SELECT DISTINCT scan_id, CAST(0 AS BIGINT), [CAST(0 AS BIGINT), 0, 0, 0, 0], CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS DOUBLE), false FROM v_order
 UNION ALL SELECT scan_id, rn, CASE WHEN line IS NULL THEN used ELSE list_transform(used, lambda u, i: u + CASE WHEN i = line + 1 THEN quantity ELSE 0 END) END, crop_id, line, CASE WHEN line IS NULL THEN 0 WHEN line = pick THEN score ELSE CAST(0.5 AS DOUBLE) END, line IS DISTINCT FROM pick FROM
 (SELECT o.*, r.used, CASE WHEN NOT (o.alone AND o.pick > 0 AND r.used[o.pick + 1] >= o.pick * 10) THEN o.pick WHEN (o.pick + 1) % 5 > 0 AND r.used[(o.pick + 1) % 5 + 1] >= (o.pick + 1) % 5 * 10 THEN NULL ELSE (o.pick + 1) % 5 END AS line FROM rec r JOIN v_order o ON o.scan_id = r.scan_id AND o.rn = r.rn + 1))""")
def capacity_assign(spark: SparkSession, d: str) -> DataFrame:
    """Orders as scans, their lines as crops: five lines of 0 (unlimited) to 40 pieces."""
    lines = views.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("scan_id"), views.place_of_line().alias("crop_id"), F.col("l_quantity").cast("long").alias("quantity"), (F.col("l_partkey") % 5).alias("inv_seq"), (F.col("l_discount") * 10).alias("confidence"), (F.col("l_linenumber") % 2 == 0).alias("embedding_only"))
    other = F.array(F.struct(((F.col("inv_seq") + 1) % 5).alias("inv_seq"), F.lit(0.5).alias("score")))
    rooms = spark.range(5).select(F.col("id").alias("inv_seq"), F.col("id").cast("string").alias("key"), (F.col("id") * 10).alias("quantity"))
    return locating.assigned(lines.withColumn("seq", F.col("crop_id")).withColumn("alternatives", other), rooms)


#: Colours that crops were seen in, and those of the inventory's lines, for the queries that identify.
SEEN, LINE_COLORS = ("Red", "Dark Red", "Blue", "mystery"), ("Red", "Dark Red", "blue", "light  bluish gray", "nameless")
IDENTIFY_LINES = """v_small AS (SELECT part_num, color_name, min(p_partkey) AS inv_seq FROM (SELECT p_partkey, p_brand AS part_num, ['Red', 'Dark Red', 'blue', 'light  bluish gray', 'nameless'][p_partkey % 5 + 1] AS color_name FROM part) GROUP BY part_num, color_name),
v_seen_color AS (SELECT l_orderkey AS crop_id, ['Red', 'Dark Red', 'Blue', 'mystery'][min(l_partkey) % 4 + 1] AS seen_color FROM lineitem GROUP BY l_orderkey)"""


def _color_pairs() -> str:
    import math

    known = {name.lower(): colors.lab_of(*rgb) for _, name, *rgb in colors.COLORS}
    norm = lambda n: " ".join(n.lower().split())
    rows = [(s, c, 1 - math.dist(known[norm(s)], known[norm(c)]) / C.FULL_MISMATCH) for s in SEEN for c in LINE_COLORS if norm(s) in known and norm(c) in known]
    return "v_pairs(seen_color, color_name, score) AS (VALUES " + ", ".join(f"('{s}', '{c}', CAST({x!r} AS DOUBLE))" for s, c, x in rows if x > 0) + ")"


SIGNALLED = """v_all AS (SELECT l_orderkey AS crop_id, inv_seq, max(l_discount) AS score, 'brickognize' AS signal, CAST(0.5 AS DOUBLE) AS w FROM lineitem JOIN part ON l_partkey = p_partkey JOIN v_small s ON s.part_num = p_brand WHERE l_linenumber <= 2 GROUP BY 1, 2
 UNION ALL SELECT l_orderkey, inv_seq, max(greatest(0, l_tax - 0.02)), 'embedding', CAST(0.4 AS DOUBLE) FROM lineitem JOIN v_small ON inv_seq = l_partkey % 50 + 1 WHERE l_linenumber = 3 GROUP BY 1, 2),
v_every AS (SELECT * FROM v_all UNION ALL SELECT crop_id, inv_seq, score, 'color', CAST(0.1 AS DOUBLE) FROM v_seen_color JOIN v_pairs USING (seen_color) JOIN v_small USING (color_name) WHERE crop_id IN (SELECT crop_id FROM v_all)),
v_weight AS (SELECT crop_id, sum(w) AS total FROM (SELECT DISTINCT crop_id, signal, w FROM v_every) GROUP BY crop_id),
v_mixed AS (SELECT crop_id, inv_seq, round(sum(w * score) / any_value(total), 9) AS confidence FROM v_every JOIN v_weight USING (crop_id) GROUP BY crop_id, inv_seq),
v_placed AS (SELECT *, row_number() OVER (PARTITION BY crop_id ORDER BY confidence DESC, inv_seq) AS rank FROM v_mixed)"""


@_q("""SELECT c.crop_id, p.inv_seq, coalesce(p.confidence, 0) AS confidence, coalesce((SELECT string_agg(x.inv_seq || ':' || printf('%.6f', x.confidence), ' ' ORDER BY x.rank) FROM v_placed x WHERE x.crop_id = c.crop_id AND x.rank BETWEEN 2 AND 5), '') AS alternatives,
coalesce((SELECT string_agg(signal || ':' || printf('%.6f', score), ' ' ORDER BY signal) FROM (SELECT signal, coalesce(max(CASE WHEN e.inv_seq = p.inv_seq THEN e.score END), 0) AS score FROM v_every e WHERE e.crop_id = c.crop_id GROUP BY signal)), '') AS components
FROM v_seen_color c LEFT JOIN v_placed p ON p.crop_id = c.crop_id AND p.rank = 1""", IDENTIFY_LINES, _color_pairs(), SIGNALLED)
def identify_crops(spark: SparkSession, d: str) -> DataFrame:
    """Orders as crops: candidates by part number, hits of a gallery, and colours seen, blended against a closed inventory."""
    lines = views.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount", "l_tax")
    part = views.table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("part_num"))
    pick = lambda names, c: F.element_at(F.array(*map(F.lit, names)), (F.col(c) % len(names) + 1).cast("int"))
    inventory = part.withColumn("color_name", pick(LINE_COLORS, "p_partkey")).groupBy("part_num", "color_name").agg(F.min("p_partkey").alias("inv_seq"))
    crops = lines.groupBy(F.col("l_orderkey").alias("crop_id")).agg(F.min("l_partkey").alias("k")).withColumn("seen_color", pick(SEEN, "k")).drop("k")
    candidates = lines.where("l_linenumber <= 2").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("crop_id"), "part_num", F.col("l_discount").alias("score"))
    hits = lines.where("l_linenumber = 3").select(F.col("l_orderkey").alias("crop_id"), (F.col("l_partkey") % 50 + 1).alias("inv_seq"), (F.col("l_tax") - 0.02).alias("score")).join(inventory.select("inv_seq"), "inv_seq", "left_semi")
    hits = hits.groupBy("crop_id", "inv_seq").agg(F.max("score").alias("score"))
    got = matching.identify(crops, inventory, candidates, hits, colors.name_scores(crops, inventory))
    six = lambda x: F.format_string("%.6f", x)
    shown = F.array_sort(F.transform(F.map_entries("components"), lambda e: F.concat_ws(":", e["key"], six(e["value"]))))
    return got.select("crop_id", "inv_seq", "confidence", F.array_join(F.transform("alternatives", lambda a: F.concat_ws(":", a["inv_seq"].cast("string"), six(a["score"]))), " ").alias("alternatives"), F.array_join(shown, " ").alias("components"))


#: Answers of a recogniser: an order's lines as items, some without an id, some with a score that is no number.
ANSWERS = """v_items AS (SELECT l_orderkey AS crop_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos, CASE WHEN l_linenumber <> 3 THEN p_brand END AS part_num, CASE WHEN l_tax < 0.01 THEN 0 ELSE l_discount END AS score, p_name AS name FROM lineitem JOIN part ON p_partkey = l_partkey),
v_answers AS (SELECT *, row_number() OVER (PARTITION BY crop_id ORDER BY score DESC, pos) AS rank FROM v_items WHERE part_num IS NOT NULL)"""


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    lines = views.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_tax")
    named = lines.join(views.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_name"), "l_partkey")
    item = F.struct(F.when(F.col("l_linenumber") % 2 == 1, F.when(F.col("l_linenumber") != 3, F.col("p_brand"))).alias("id"), F.when(F.col("l_linenumber") % 2 == 0, F.col("p_brand")).alias("part_num"), F.col("p_name").alias("name"), F.when(F.col("l_tax") < 0.01, F.lit("none")).otherwise(F.col("l_discount").cast("string")).alias("score"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", item.alias("i")))), lambda x: x["i"])
    answers = named.groupBy(F.col("l_orderkey").alias("crop_id")).agg(F.to_json(F.struct(items.alias("items"))).alias("payload"))
    return matching.parse_predictions(answers)


@_q("SELECT crop_id, rank, part_num, name, score FROM v_answers", ANSWERS)
def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Ranked candidates of JSON answers."""
    return _predictions(spark, d).select("crop_id", "rank", "part_num", "name", "score")


@_q("""SELECT c.crop_id, part_num, name, CASE WHEN part_num IS NOT NULL THEN 'Red' END AS color_name, coalesce(score, 0) AS confidence, (SELECT count(*) FROM v_answers x WHERE x.crop_id = c.crop_id AND x.rank BETWEEN 2 AND 5) AS n_alternatives
FROM (SELECT DISTINCT l_orderkey AS crop_id FROM lineitem) c LEFT JOIN v_answers a ON a.crop_id = c.crop_id AND a.rank = 1""", ANSWERS)
def identify_unconstrained(spark: SparkSession, d: str) -> DataFrame:
    """The first candidate of every answer, without an inventory."""
    crops = views.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("crop_id"), F.lit("Red").alias("seen_color")).distinct()
    got = matching.unconstrained(crops, _predictions(spark, d))
    return got.select("crop_id", "part_num", "name", "color_name", "confidence", F.size("alternatives").cast("long").alias("n_alternatives"))


@_q("""SELECT crop_id, array_to_string(list(signal || ':' || n ORDER BY signal), ' ') AS signals FROM (SELECT crop_id, signal, count(*) AS n FROM v_signals GROUP BY crop_id, signal) GROUP BY crop_id""", SIGNALS)
def signal_union(spark: SparkSession, d: str) -> DataFrame:
    """Which signals each crop has, and how many lines each names."""
    n = views.signals(spark, d).groupBy("crop_id", "signal").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("crop_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "signal", F.col("n").cast("string")))), " ").alias("signals"))
