"""Queries of colours, boxes, vectors, training tables, caches and addresses; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binmap.functions import colors
from binmap.functions import columns as C
from binmap.operators import boxes, matching, texts, training
from binmap.plans.queries import LAB, _q
from binmap.sources import files, views

# Vectors

COSINE = "round(list_cosine_similarity(CAST({0}.embedding AS DOUBLE[]), CAST({1}.embedding AS DOUBLE[])), 6)"
DRAW = "CAST('0x' || substr(md5({}), 1, 15) AS BIGINT)"


@_q(f"""SELECT query_id, inv_seq, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, inv_seq) AS rank FROM
(SELECT q.vec_id AS query_id, g.vec_id AS inv_seq, {COSINE.format("q", "g")} AS similarity FROM embeddings q, embeddings g WHERE q.vec_id % 50 = 0 AND g.vec_id <> q.vec_id)) WHERE rank <= 5""")
def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest of all other vectors to each vector whose id is divisible by 50."""
    e = views.table(spark, d, "embeddings")
    return matching.nearest(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("inv_seq"), "embedding"), 5)


SPLIT = f"""v_drawn AS (SELECT label, vec_id, embedding, row_number() OVER (PARTITION BY label ORDER BY {DRAW.format("'0:' || label || ':' || vec_id")}, vec_id) <= least(floor(count(*) OVER (PARTITION BY label) * CAST(0.25 AS DOUBLE)), count(*) OVER (PARTITION BY label) - 2) AS held_out FROM embeddings)"""


def _dataset(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "embeddings").select(F.col("label").cast("string").alias("part_num"), F.col("vec_id").alias("variant"))


@_q("SELECT CAST(label AS VARCHAR) AS part_num, vec_id AS variant, held_out FROM v_drawn", SPLIT)
def train_split(spark: SparkSession, d: str) -> DataFrame:
    return training.split(_dataset(spark, d))


@_q(f"""SELECT count(*) AS n, round(avg(CASE WHEN ql = gl THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM (SELECT ql, gl, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, inv_seq) AS r FROM
(SELECT q.vec_id AS query_id, q.label AS ql, g.vec_id AS inv_seq, g.label AS gl, {COSINE.format("q", "g")} AS similarity FROM v_drawn q, v_drawn g WHERE q.held_out AND NOT g.held_out)) WHERE r = 1""", SPLIT)
def retrieval_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """How many of the crops held out have a crop of their own part as nearest one."""
    e = views.table(spark, d, "embeddings").select("vec_id", "embedding", F.col("label").cast("string").alias("part_num")).withColumn("variant", F.col("vec_id"))
    marked = training.split(e)
    found = matching.nearest(marked.where("held_out").select(F.col("vec_id").alias("query_id"), "embedding"), marked.where("not held_out").select(F.col("vec_id").alias("inv_seq"), "embedding"), 1)
    label = e.select("vec_id", "part_num")
    both = found.join(label.toDF("query_id", "ql"), "query_id").join(label.toDF("inv_seq", "gl"), "inv_seq")
    return both.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("ql") == F.col("gl")).cast("double")), 9).alias("accuracy"))


@_q(f"""SELECT a.vec_id AS anchor, coalesce(min_by(negative, struct_pack(d := dist, n := negative)) FILTER (WHERE dist > pos AND dist < pos + CAST(0.3 AS DOUBLE)), min_by(negative, struct_pack(d := dist, n := negative))) AS negative
FROM (SELECT a.vec_id, n.vec_id AS negative, round(CAST(1 AS DOUBLE) - {COSINE.format("a", "n")}, 6) AS dist, p.pos FROM embeddings a JOIN embeddings n ON a.label <> n.label
JOIN (SELECT x.vec_id, min(round(CAST(1 AS DOUBLE) - {COSINE.format("x", "y")}, 6)) AS pos FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE x.vec_id % 50 = 0 GROUP BY x.vec_id) p ON p.vec_id = a.vec_id WHERE a.vec_id % 50 = 0) a GROUP BY a.vec_id""")
def semihard_negative(spark: SparkSession, d: str) -> DataFrame:
    """For each anchor (ids divisible by 50) the nearest negative just beyond its nearest positive, else the hardest."""
    e = views.table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    return matching.semihard(e.where("vec_id % 50 = 0"), e)


# Training tables


@_q("SELECT label, vec_id, 0 AS part FROM embeddings UNION ALL SELECT label + 5, vec_id, 1 FROM embeddings")
def dataset_merge(spark: SparkSession, d: str) -> DataFrame:
    """Two datasets in one, the base first; parts that only the second has are kept."""
    e = views.table(spark, d, "embeddings").select("label", "vec_id")
    return e.withColumn("part", F.lit(0)).unionByName(e.select((F.col("label") + 5).alias("label"), "vec_id").withColumn("part", F.lit(1)))


PLACES = """v_places AS (SELECT CAST(label AS VARCHAR) AS part_num, vec_id, row_number() OVER (ORDER BY CAST(label AS VARCHAR), vec_id) - 1 AS idx, dense_rank() OVER (ORDER BY CAST(label AS VARCHAR)) - 1 AS part_no,
 row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS variant_no, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
v_parts AS (SELECT part_no, any_value(n) AS n, row_number() OVER (ORDER BY part_no) - 1 AS e FROM v_places GROUP BY part_no)"""


@_q(f"""SELECT t.i, a.idx AS anchor, p.idx AS positive, x.idx AS negative FROM
(SELECT *, {DRAW.format("'7:' || i || ':negative'")} % m AS v FROM (SELECT t.*, q.n AS m FROM
 (SELECT *, CASE WHEN o0 >= part_no THEN o0 + 1 ELSE o0 END AS o, CASE WHEN p0 >= av THEN p0 + 1 ELSE p0 END AS pv FROM
  (SELECT r.i, part_no, {DRAW.format("'7:' || i || ':anchor'")} % n AS av, {DRAW.format("'7:' || i || ':positive'")} % (n - 1) AS p0, {DRAW.format("'7:' || i || ':other'")} % ((SELECT count(*) FROM v_parts) - 1) AS o0
   FROM (SELECT i, {DRAW.format("'7:' || i || ':part'")} % (SELECT count(*) FROM v_parts) AS e FROM range(2000) t(i)) r JOIN v_parts USING (e))) t JOIN v_parts q ON q.part_no = t.o)) t
JOIN v_places a ON a.part_no = t.part_no AND a.variant_no = av JOIN v_places p ON p.part_no = t.part_no AND p.variant_no = pv JOIN v_places x ON x.part_no = t.o AND x.variant_no = t.v""", PLACES)
def triplet_samples(spark: SparkSession, d: str) -> DataFrame:
    """2,000 triplets: places of two crops of a part and of one of another."""
    return training.triplets(_dataset(spark, d), 2000, 7)


@_q("SELECT DISTINCT p_brand AS part_num, 3 * 1000003 + dense_rank() OVER (ORDER BY p_brand) - 1 AS seed FROM part")
def part_seeds(spark: SparkSession, d: str) -> DataFrame:
    return training.part_seeds(views.table(spark, d, "part").select(F.col("p_brand").alias("part_num")), 3)


MANIFEST = """v_manifest AS (SELECT l_orderkey * 10000000 + l_linenumber * 1000000 + l_partkey AS n, CASE WHEN l_partkey % 9 <> 0 THEN 'p' || l_partkey % 40 ELSE '' END AS part_num, CASE WHEN l_linenumber = 2 THEN 'other' ELSE 'p' || l_partkey % 40 END AS raw_part_num,
 l_discount * 8 AS confidence, l_tax AS brickognize, l_quantity AS size FROM lineitem)"""


@_q("SELECT part_num, 'p/' || n || '.png' AS file FROM v_manifest WHERE part_num <> '' AND raw_part_num = part_num AND confidence >= CAST(0.3 AS DOUBLE) AND brickognize > 0 AND n IN (SELECT n FROM v_manifest GROUP BY n HAVING max(size) > 10)", MANIFEST)
def real_crop_filter(spark: SparkSession, d: str) -> DataFrame:
    """Lines as crops of a manifest; files of up to ten pieces are empty."""
    n = views.table(spark, d, "lineitem").withColumn("file", F.concat(F.lit("p/"), (F.col("l_orderkey") * F.lit(10_000_000) + F.col("l_linenumber") * F.lit(1_000_000) + F.col("l_partkey")).cast("string"), F.lit(".png")))
    part = F.concat(F.lit("p"), (F.col("l_partkey") % 40).cast("string"))
    manifest = n.select("file", F.when(F.col("l_partkey") % 9 != 0, part).otherwise(F.lit("")).alias("part_num"), F.when(F.col("l_linenumber") == 2, F.lit("other")).otherwise(part).alias("raw_part_num"), (F.col("l_discount") * 8).alias("confidence"), F.create_map(F.lit("brickognize"), F.col("l_tax")).alias("components"))
    contents = n.groupBy("file").agg(F.max("l_quantity").alias("q")).select("file", F.when(F.col("q") > 10, F.lit(b"x")).otherwise(F.lit(b"")).alias("content"))
    return training.real_crops(manifest, contents).select("part_num", "file")


@_q("""SELECT p AS part_num, CASE WHEN p IN (SELECT r FROM v_refs) THEN p || '.dat' WHEN regexp_extract(p, '^(\\d+[a-z]*?)(?:pr|pat|px)\\w*$', 1) IN (SELECT r FROM v_refs) THEN regexp_extract(p, '^(\\d+[a-z]*?)(?:pr|pat|px)\\w*$', 1) || '.dat' END AS ref FROM (SELECT DISTINCT p FROM v_numbers)""",
    "v_numbers AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE (p_partkey - p_partkey % 4) || 'pr' || p_partkey % 4 END AS p FROM part), v_refs AS (SELECT CAST(p_partkey AS VARCHAR) AS r FROM part WHERE p_size > 10)")
def part_refs(spark: SparkSession, d: str) -> DataFrame:
    """Files of part numbers, some of them printed parts; parts of a size over 10 have one."""
    p = views.table(spark, d, "part")
    k = F.col("p_partkey")
    number = F.when(k % 3 == 0, k.cast("string")).otherwise(F.concat((k - k % 4).cast("string"), F.lit("pr"), (k % 4).cast("string")))
    index = training.index_of(p.where("p_size > 10").select(F.concat(F.lit("parts/"), k.cast("string"), F.lit(".DAT")).alias("path")))
    return training.part_references(p.select(number.alias("part_num")), index)


LINEAGE = """RECURSIVE tree(root, p, scale, shift) AS (SELECT p_partkey, p_partkey, CAST(1 AS DOUBLE), CAST(0 AS DOUBLE) FROM part
 UNION ALL SELECT root, 3 * p + 7, scale * 2, shift + scale * (p % 5) FROM tree JOIN part ON p_partkey = 3 * p + 7)"""


@_q("SELECT root, count(*) AS n_triangles, sum(scale * (p % 7) + shift) AS sum_x, max(scale) AS max_scale FROM tree GROUP BY root", LINEAGE)
def geometry_triangles(spark: SparkSession, d: str) -> DataFrame:
    """Parts as files: each has a triangle and refers, twice as large and moved, to part 3p + 7 if there is one, to any depth."""
    part = views.table(spark, d, "part").select("p_partkey")
    name = lambda c: F.concat(c.cast("string"), F.lit(".dat"))
    k = F.col("p_partkey")
    triangle = F.concat_ws(" ", F.lit("3 16"), (k % 7).cast("string"), F.lit("0 0 1 0 0 0 1 0"))
    sub = F.concat_ws(" ", F.lit("1 16"), (k % 5).cast("string"), F.lit("0 0 2 0 0 0 2 0 0 0 2"), name(3 * k + 7))
    lines = part.select(name(k).alias("ref"), F.explode(F.array(triangle, sub)).alias("line"))
    got = training.geometry(lines, part.select(name(k).alias("ref")))
    scale = F.get("points", F.lit(7)) - F.get("points", F.lit(1))  # the third point stands 1 above the first
    return got.groupBy("root").agg(F.count(F.lit(1)).alias("n_triangles"), F.sum(F.get("points", F.lit(0))).alias("sum_x"), F.max(scale).alias("max_scale")).withColumn("root", F.substring_index("root", ".", 1).cast("long"))


@_q("SELECT epoch, accuracy FROM (SELECT l_linenumber AS epoch, round(avg(l_discount), 9) AS accuracy FROM lineitem GROUP BY l_linenumber) ORDER BY accuracy DESC, epoch LIMIT 1")
def best_epoch(spark: SparkSession, d: str) -> DataFrame:
    metrics = views.table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("epoch")).agg(F.round(F.avg("l_discount"), 9).alias("accuracy"))
    return training.best_epoch(metrics)


# Colours

NAMED = "v_named(pos, name, r, g, b) AS (VALUES " + ", ".join(f"({i}, '{name}', CAST({r} AS DOUBLE), CAST({g} AS DOUBLE), CAST({b} AS DOUBLE))" for i, (_, name, r, g, b) in enumerate(colors.COLORS)) + ")"
# The same steps as for v_rgb, over the named colours.
NAMED_LAB = LAB.split(" FROM part),\n", 1)[1].replace("p_partkey", "pos").replace("v_rgb", "v_named").replace("v_lin", "n_lin").replace("v_xyz", "n_xyz").replace("v_f", "n_f")


def _rgb(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "part").select("p_partkey", *((F.col("p_partkey") * m % 256).cast("double").alias(n) for n, m in (("r", 1), ("g", 7), ("b", 13))))


@_q("""SELECT p_partkey, name, round(distance, 5) AS distance FROM (SELECT p_partkey, pos, distance, row_number() OVER (PARTITION BY p_partkey ORDER BY round(distance, 9), pos) AS rank FROM
(SELECT p.p_partkey, n.pos, sqrt(pow(116 * (p.y - n.y), 2) + pow(500 * ((p.x - p.y) - (n.x - n.y)), 2) + pow(200 * ((p.y - p.z) - (n.y - n.z)), 2)) AS distance FROM v_f p, n_f n)) x JOIN v_named c ON c.pos = x.pos WHERE rank = 1""", LAB, NAMED, NAMED_LAB)
def nearest_color(spark: SparkSession, d: str) -> DataFrame:
    found = colors.nearest(F.col("r"), F.col("g"), F.col("b"))
    return _rgb(spark, d).select("p_partkey", found.alias("n")).select("p_partkey", "n.name", F.round("n.distance", 5).alias("distance"))


@_q("""SELECT p_partkey, coalesce(c.r, -1) AS r, coalesce(c.g, -1) AS g, coalesce(c.b, -1) AS b, CAST('0x' || substr(md5(p_name), 1, 2) AS INTEGER) AS hex_r FROM (SELECT *, ['DARK  red', 'tan', ' Medium Azure ', p_name][p_partkey % 4 + 1] AS color FROM part) p
LEFT JOIN v_named c ON lower(c.name) = lower(trim(regexp_replace(p.color, '\\s+', ' ', 'g')))""", NAMED)
def color_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Channels of colour names, and of hexadecimal digits."""
    name = F.element_at(F.array(F.lit("DARK  red"), F.lit("tan"), F.lit(" Medium Azure "), F.col("p_name")), (F.col("p_partkey") % 4 + 1).cast("int"))
    rgb = colors.channels_of(name)
    at = lambda c: F.coalesce(rgb[c], F.lit(-1)).cast("double").alias(c)
    return views.table(spark, d, "part").select("p_partkey", at("r"), at("g"), at("b"), colors.hex_channels(F.concat(F.lit("#"), F.substring(F.md5("p_name"), 1, 6)))["r"].alias("hex_r"))


PIXELS = "v_pixels AS (SELECT l_suppkey AS crop, CAST(l_partkey * 3 % 40 + CASE WHEN l_linenumber = 1 THEN 215 ELSE 0 END AS INTEGER) AS r, CAST(l_orderkey % 50 + CASE WHEN l_linenumber = 1 THEN 205 ELSE 0 END AS INTEGER) AS g, CAST(l_quantity AS INTEGER) % 36 + CASE WHEN l_linenumber = 1 THEN 219 ELSE 0 END AS b FROM lineitem)"


@_q("""SELECT p.crop, CAST(round_even(coalesce(t.r, p.r), 0) AS INTEGER) AS r, CAST(round_even(coalesce(t.g, p.g), 0) AS INTEGER) AS g, CAST(round_even(coalesce(t.b, p.b), 0) AS INTEGER) AS b FROM
(SELECT crop, quantile_cont(r, 0.5) AS r, quantile_cont(g, 0.5) AS g, quantile_cont(b, 0.5) AS b FROM v_pixels GROUP BY crop) p LEFT JOIN
(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY crop ORDER BY n DESC, code) AS k FROM (SELECT crop, (r >> 4) * 256 + (g >> 4) * 16 + (b >> 4) AS code, count(*) AS n, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM v_pixels
 WHERE NOT (r > 235 AND g > 235 AND b > 235) AND NOT (r < 35 AND g < 35 AND b < 35) GROUP BY 1, 2)) WHERE k = 1) t ON t.crop = p.crop""", PIXELS)
def dominant_color(spark: SparkSession, d: str) -> DataFrame:
    """Lines as the pixels of their supplier's crop."""
    light = lambda by: F.when(F.col("l_linenumber") == 1, by).otherwise(0)
    pixels = views.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("crop"), (F.col("l_partkey") * 3 % 40 + light(215)).cast("int").alias("r"), (F.col("l_orderkey") % 50 + light(205)).cast("int").alias("g"), (F.col("l_quantity").cast("int") % 36 + light(219)).alias("b"))
    return colors.dominant(pixels, ["crop"])


# Boxes

BOXES = """v_boxes AS (SELECT l_orderkey AS page, l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey AS box_id, CAST(l_partkey % 20 * 3 AS DOUBLE) AS x, CAST(l_suppkey % 10 * 2 AS DOUBLE) AS y, l_quantity * 2 AS w, CAST(l_partkey % 40 AS DOUBLE) AS h, CAST(l_quantity AS BIGINT) AS quantity FROM lineitem)"""
SHARE = "CASE WHEN {0}.w * {0}.h <= 0 THEN 0 ELSE greatest(least({0}.x + {0}.w, {1}.x + {1}.w) - greatest({0}.x, {1}.x), 0) * greatest(least({0}.y + {0}.h, {1}.y + {1}.h) - greatest({0}.y, {1}.y), 0) / ({0}.w * {0}.h) END"


@_q("SELECT page, box_id FROM v_boxes WHERE h <> 0 AND w * h BETWEEN CAST(0.0005 AS DOUBLE) * 12000 AND CAST(0.2 AS DOUBLE) * 12000 AND w / h BETWEEN CAST(0.3 AS DOUBLE) AND 4", BOXES)
def box_gate(spark: SparkSession, d: str) -> DataFrame:
    """Boxes that fit a page of 12,000 pixels by area share and aspect."""
    return views.boxes(spark, d).where(boxes.fits(F.col("w"), F.col("h"), F.lit(12_000.0))).select("page", "box_id")


@_q(f"SELECT a.page, a.box_id FROM v_boxes a WHERE a.quantity <= 25 AND NOT EXISTS (SELECT 1 FROM v_boxes c WHERE c.quantity > 25 AND c.page = a.page AND {SHARE.format('a', 'c')} > CAST(0.3 AS DOUBLE))", BOXES)
def box_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Small boxes as candidates that no large one, a panel, covers."""
    b = views.boxes(spark, d)
    return boxes.without_overlap(b.where("quantity <= 25"), b.where("quantity > 25"), ["page"]).select("page", "box_id")


@_q(f"""SELECT page, x, y, w, h, row_number() OVER (PARTITION BY page ORDER BY y, x, w, h) - 1 AS place FROM (SELECT page, unnest(kept, recursive := true) FROM rec JOIN v_last USING (page, rn))""",
    "RECURSIVE " + BOXES, "v_turn AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY box_id, x, y, w, h) AS rn FROM v_boxes)", "v_last AS (SELECT page, max(rn) AS rn FROM v_turn GROUP BY page)",
    f"""rec(page, rn, kept) AS (SELECT page, rn, [{{'x': x, 'y': y, 'w': w, 'h': h}}] FROM v_turn WHERE rn = 1
 UNION ALL SELECT t.page, t.rn, CASE WHEN len(list_filter(r.kept, lambda o: {SHARE.format("t", "o")} > CAST(0.6 AS DOUBLE))) > 0 THEN r.kept ELSE list_append(r.kept, {{'x': t.x, 'y': t.y, 'w': t.w, 'h': t.h}}) END FROM rec r JOIN v_turn t ON t.page = r.page AND t.rn = r.rn + 1)""")
def box_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Boxes that no kept earlier one of their page covers, in reading order."""
    return boxes.first_come(views.boxes(spark, d), ["page"])


GLYPHS = """v_glyphs AS (SELECT l_orderkey AS page, l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey AS box_id, CAST(l_partkey % 12 * 15 AS DOUBLE) AS x, CAST(l_suppkey % 3 * 10 AS DOUBLE) AS y, CAST(12 AS DOUBLE) AS w, CAST(l_partkey % 4 * 6 + 20 AS DOUBLE) AS h FROM lineitem)"""


@_q("""SELECT page, x, y, w, h, parts, row_number() OVER (PARTITION BY page ORDER BY w * h DESC, y, x, w, h, parts) - 1 AS place FROM (SELECT page, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, count(*) AS parts FROM v_glyphs g JOIN v_low USING (page, box_id) GROUP BY page, low)""",
    "RECURSIVE " + GLYPHS, """v_pairs AS (SELECT a.page, a.box_id AS one, b.box_id AS two FROM v_glyphs a JOIN v_glyphs b ON a.page = b.page AND a.box_id <> b.box_id
 WHERE greatest(b.x - a.x - a.w, a.x - b.x - b.w, 0) < CAST(0.6 AS DOUBLE) * greatest(a.h, b.h) AND (greatest(a.h, b.h) - least(a.h, b.h)) / greatest(a.h, b.h) <= CAST(0.4 AS DOUBLE) AND greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) >= CAST(0.5 AS DOUBLE) * least(a.h, b.h))""",
    "reach(page, box_id, other) AS (SELECT page, box_id, box_id FROM v_glyphs UNION SELECT r.page, r.box_id, p.two FROM reach r JOIN v_pairs p ON p.page = r.page AND p.one = r.other)", "v_low AS (SELECT page, box_id, min(other) AS low FROM reach GROUP BY page, box_id)")
def glyph_numerals(spark: SparkSession, d: str) -> DataFrame:
    """Glyphs of a page that belong together, as the box around them."""
    return boxes.numerals(views.glyphs(spark, d), ["page"])


@_q("""SELECT page, count(*) AS n_callouts, array_to_string(list(quantity ORDER BY box_id, quantity), ' ') AS quantities, count(*) >= 12 AS is_parts_list, min(w * h / 12000) AS area_min, quantile_cont(w * h / 12000, 0.5) AS area_median, max(w * h / 12000) AS area_max,
min(CASE WHEN h > 0 THEN w / h END) AS aspect_min, quantile_cont(CASE WHEN h > 0 THEN w / h END, 0.5) AS aspect_median, max(CASE WHEN h > 0 THEN w / h END) AS aspect_max FROM v_boxes GROUP BY page""", BOXES)
def page_box_stats(spark: SparkSession, d: str) -> DataFrame:
    """Minimum, median and maximum of the boxes' area shares and aspects on pages of 120 by 100."""
    b = views.boxes(spark, d)
    pages = b.select("page").distinct().select("page", F.lit(120.0).alias("page_w"), F.lit(100.0).alias("page_h"))
    return boxes.page_stats(pages, b, ["page"]).withColumn("quantities", F.array_join(F.transform("quantities", lambda q: q.cast("string")), " "))


# Texts, caches and addresses

@_q()
def set_numbers(spark: SparkSession, d: str) -> DataFrame:
    """The likeliest set number of each document, its lines being the pages."""
    docs = views.table(spark, d, "documents").select(F.col("doc_id").alias("scan_id"), F.posexplode(F.split("text", "\n")).alias("page_index", "text"))
    return texts.set_number(docs)


@_q("""SELECT doc_id, count(*) AS n_numbers, min(CAST(token AS BIGINT)) AS least FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\b[0-9]{4,7}\\b')) AS token FROM documents) GROUP BY doc_id""")
def number_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of four to seven digits in each document that has any."""
    found = views.table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\b[0-9]{4,7}\b"), 0)).alias("t"))
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_numbers"), F.min(F.col("t").cast("long")).alias("least"))


@_q("SELECT doc_id, trim(lang) || ' ' || doc_id AS t, CAST(doc_id AS BIGINT) AS whole, CASE WHEN doc_id % 2 = 0 THEN doc_id || '-2' ELSE doc_id || '-1' END AS set_num, 'https://www.example.com/en-gb/service/building-instructions/' || doc_id AS url FROM documents")
def scalar_forms(spark: SparkSession, d: str) -> DataFrame:
    """Whole numbers of texts, normal set numbers, and page addresses."""
    k = F.col("doc_id").cast("string")
    num = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" "), k, F.lit("-2"))).otherwise(k)
    return views.table(spark, d, "documents").select("doc_id", F.concat_ws(" ", F.trim("lang"), k).alias("t"), C.pure_integer(F.concat(F.lit(" "), k, F.lit(" "))).alias("whole"), C.normalized_set_number(num).alias("set_num"), files.page_url(num, "https://www.example.com").alias("url"))


CACHED = "v_cache AS (SELECT DISTINCT sha256(text) AS sha FROM documents JOIN labels USING (doc_id))"


def _cached(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents as requests; those that have a label were asked before."""
    docs = views.table(spark, d, "documents").select("doc_id", "text")
    cache = docs.join(views.table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select(files.content_hash(F.col("text")).alias("sha")).distinct()
    return files.cache_split(docs, cache, "text")


@_q("SELECT doc_id, sha256(text) AS sha FROM documents WHERE sha256(text) IN (SELECT sha FROM v_cache)", CACHED)
def cache_hits(spark: SparkSession, d: str) -> DataFrame:
    return _cached(spark, d)[0].select("doc_id", "sha")


@_q("SELECT DISTINCT sha256(text) AS sha FROM documents WHERE sha256(text) NOT IN (SELECT sha FROM v_cache)", CACHED)
def cache_misses(spark: SparkSession, d: str) -> DataFrame:
    return _cached(spark, d)[1].select("sha")


STORED = "v_store AS (SELECT 'n' || doc_id % 3 AS namespace, lang AS sha, CASE WHEN doc_id % 4 = 0 THEN '{broken' ELSE '{\"v\": ' || doc_id || '}' END AS value, doc_id AS moment FROM documents)"


@_q("SELECT sha, arg_max(value, moment) AS value FROM v_store WHERE namespace = 'n1' AND value <> '{broken' GROUP BY sha", STORED)
def cache_latest(spark: SparkSession, d: str) -> DataFrame:
    """The latest value of each key of a namespace; what isn't JSON is a miss."""
    k = F.col("doc_id")
    store = views.table(spark, d, "documents").select(F.concat(F.lit("n"), (k % 3).cast("string")).alias("namespace"), F.col("lang").alias("sha"), F.when(k % 4 == 0, F.lit("{broken")).otherwise(F.concat(F.lit('{"v": '), k.cast("string"), F.lit("}"))).alias("value"), k.alias("at"))
    return files.cache_get(store, "n1")


@_q("SELECT page_id, len(list_distinct(regexp_extract_all(html, 'https?://[^\\s\"''<>]+'))) AS n_urls, array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'https?://[^\\s\"''<>]+'))), ' ') AS urls FROM pages")
def url_extract(spark: SparkSession, d: str) -> DataFrame:
    found = F.array_distinct(F.regexp_extract_all("html", F.lit(r"(https?://[^\s\"'<>]+)"), 1))
    return views.table(spark, d, "pages").select("page_id", F.size(found).cast("long").alias("n_urls"), F.array_join(F.sort_array(found), " ").alias("urls"))


LINKS = """v_links AS (SELECT page_id, replace(html || ' https:\\/\\/m.example.com\\/a\\/' || page_id || '.pdf https://m.example.com/a/' || page_id || '.pdf ' || CASE WHEN page_id % 2 = 0 THEN '\"https://cdn.example.com/cdn/product-assets/product.bi.core.pdf/' || page_id || '.pdf\"' ELSE '' END, '\\/', '/') AS t FROM pages),
v_found AS (SELECT page_id, regexp_extract_all(t, 'https://[\\w.-]+/cdn/product-assets/product\\.bi\\.[\\w.]+/\\d+\\.pdf') AS exact, regexp_extract_all(t, 'https://[\\w.-]*example\\.com/\\S+?\\.pdf') AS other FROM v_links)"""


@_q("SELECT page_id, array_to_string(list_sort(list_distinct(CASE WHEN len(exact) > 0 THEN exact ELSE other END)), ' ') AS urls FROM v_found", LINKS)
def booklet_links(spark: SparkSession, d: str) -> DataFrame:
    """Links to booklets in pages: assets where there are any, else any PDF of the domain."""
    k = F.col("page_id").cast("string")
    other = F.concat(F.lit(r" https:\/\/m.example.com\/a\/"), k, F.lit(".pdf https://m.example.com/a/"), k, F.lit(".pdf "))
    asset = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('"https://cdn.example.com/cdn/product-assets/product.bi.core.pdf/'), k, F.lit('.pdf"'))).otherwise(F.lit(""))
    found = files.document_urls(F.concat("html", other, asset), "example.com")
    return views.table(spark, d, "pages").select("page_id", F.array_join(F.sort_array(found), " ").alias("urls"))


@_q("SELECT p_brand AS part_num, p_name AS name, p_type AS color_name, CAST(p_size AS BIGINT) AS quantity, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey AS INTEGER) END AS color_id, count(*) AS n FROM part WHERE p_partkey % 5 <> 0 GROUP BY ALL")
def inventory_headers(spark: SparkSession, d: str) -> DataFrame:
    """An inventory under other headers, with blank numbers and colours that are no numbers."""
    k = F.col("p_partkey")
    p = views.table(spark, d, "part")
    raw = p.select(F.lit("").alias("part"), F.when(k % 5 != 0, F.concat(F.lit(" "), "p_brand")).otherwise(F.lit("  ")).alias("Item No"), F.col("p_name").alias("Part Name"), F.col("p_type").alias("Colour"), F.concat("p_size", F.lit(".9")).alias("MinQty"), F.when(k % 3 == 0, k.cast("string")).otherwise(F.lit("red")).alias("BL Color ID"))
    found = files.inventory_of(raw)
    return found.groupBy("part_num", "name", "color_name", "quantity", "color_id").agg(F.count(F.lit(1)).alias("n"))


@_q("SELECT p_brand AS part_num, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS quantity, max(CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS INTEGER) END) AS color_id, max(p_type) AS color_name FROM part GROUP BY p_brand")
def inventory_json(spark: SparkSession, d: str) -> DataFrame:
    """Inventories as JSON lists, a brand's lines in each, flat rows beside nested ones."""
    p = views.table(spark, d, "part")
    k = F.col("p_partkey")
    flat = F.to_json(F.struct(F.col("p_brand").alias("item_no"), F.col("p_name").alias("description"), F.col("p_type").alias("color_text"), F.col("p_size").cast("string").alias("Qty")))
    nested = F.to_json(F.struct(F.struct(F.col("p_brand").alias("part_num"), F.col("p_name").alias("name")).alias("part"), F.struct(k.cast("int").alias("id"), F.col("p_type").alias("name")).alias("color"), F.col("p_size").alias("quantity")))
    lists = p.groupBy("p_brand").agg(F.concat(F.lit("["), F.array_join(F.collect_list(F.when(k % 2 == 0, nested).otherwise(flat)), ","), F.lit("]")).alias("rows"))
    found = files.inventory_of_json(lists)
    return found.groupBy("part_num").agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity"), F.max("color_id").alias("color_id"), F.max("color_name").alias("color_name"))


@_q("SELECT doc_id, sum(1) AS n, CAST(sum(greatest(1, coalesce(quality, 1))) AS BIGINT) AS quantity FROM labels GROUP BY doc_id")
def extract_parse(spark: SparkSession, d: str) -> DataFrame:
    """Page extracts from JSON objects; a callout without a quantity counts once."""
    labels = views.table(spark, d, "labels")
    callout = F.to_json(F.struct(F.when(F.col("quality") > 0, F.col("quality")).alias("quantity"), F.lit("red").alias("color")))
    pages = labels.select("doc_id", F.concat(F.lit('{"bag_marker": 1, "callouts": ['), callout, F.lit("]}")).alias("j"))
    got = pages.select("doc_id", F.explode(files.extract_of_json(F.col("j"))["callouts"]).alias("c"))
    return got.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("c.quantity").alias("quantity"))
