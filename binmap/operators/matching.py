"""Callouts against a closed inventory, and signals about crops.

An inventory (inv_seq, part_num, name, color_id, color_name, quantity, element_id, image_url) holds for all scans, or, if it has
a column scan_id, for that scan only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from binmap.functions import columns as C

#: Weights of the signals.
WEIGHTS = {"brickognize": 0.5, "embedding": 0.4, "color": 0.1}
#: Vectors of a block of queries and of a block of the gallery, as they meet in one task.
QUERY_BLOCK, GALLERY_BLOCK = 4_096, 65_536


def _scan(inventory: DataFrame) -> list[str]:
    return ["scan_id"] if "scan_id" in inventory.columns else []


def _overlaps(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """(by, a, b, overlap): Jaccard similarity of token sets of texts a and b that share a token. left (by, a, tokens), right (by, b, tokens)."""
    one = left.select(*by, "a", F.size("tokens").alias("x"), F.explode("tokens").alias("t"))
    two = right.select(*by, "b", F.size("tokens").alias("y"), F.explode("tokens").alias("t"))
    shared = one.join(two, [*by, "t"]).groupBy(*by, "a", "b", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    return shared.select(*by, "a", "b", (F.col("n") / (F.col("x") + F.col("y") - F.col("n"))).alias("overlap"))


def theta_match(callouts: DataFrame, inventory: DataFrame, min_score: float = C.MIN_SCORE) -> DataFrame:
    """(color, shape_desc, inv_seq, score): for each distinct descriptor the best inventory line, of equal scores the first.

    Half of a score is the overlap of the colours, half that of shape and name. Distinct colours meet distinct colour names,
    and distinct shapes distinct names, by shared tokens; a pair without one scores 0. Of the lines that only share a
    descriptor's colour the first one stands for all, so that a common colour doesn't bring all its lines.
    """
    if min_score <= 0:
        raise ValueError("min_score must be above 0: pairs that share no token are never looked at")
    by = _scan(inventory)
    color = lambda c: F.array_except(C.tokens(F.col(c)), F.array(*map(F.lit, C.STOP_WORDS)))
    wanted = callouts.select(*by, "color", "shape_desc").distinct()
    lines = inventory.groupBy(*by, "color_name", "name").agg(F.min("inv_seq").alias("inv_seq"))
    colors = _overlaps(wanted.select(*by, F.col("color").alias("a")).distinct().withColumn("tokens", color("a")), lines.select(*by, F.col("color_name").alias("b")).distinct().withColumn("tokens", color("b")), by)
    shapes = _overlaps(wanted.select(*by, F.col("shape_desc").alias("a")).distinct().withColumn("tokens", C.tokens(F.col("a"))), lines.select(*by, F.col("name").alias("b")).distinct().withColumn("tokens", C.tokens(F.col("b"))), by)
    colors = colors.select(*by, F.col("a").alias("color"), F.col("b").alias("color_name"), (F.col("overlap") * 0.5).alias("of_color"))
    shapes = shapes.select(*by, F.col("a").alias("shape_desc"), F.col("b").alias("name"), (F.col("overlap") * 0.5).alias("of_shape"))
    both = wanted.join(shapes, [*by, "shape_desc"]).join(lines, [*by, "name"]).join(colors, [*by, "color", "color_name"], "left")
    both = both.select(*by, "color", "shape_desc", "inv_seq", (F.col("of_shape") + F.coalesce("of_color", F.lit(0.0))).alias("raw"))
    # A null shape scores by its colour, so it takes part in the second half only.
    first = lines.groupBy(*by, "color_name").agg(F.min("inv_seq").alias("inv_seq"))
    only = wanted.join(colors, [*by, "color"]).join(first, [*by, "color_name"]).select(*by, "color", "shape_desc", "inv_seq", F.col("of_color").alias("raw"))
    scored = both.unionByName(only).withColumn("score", F.round(F.least("raw", F.lit(C.OTHER_CAP)), 9)).where(F.col("score") >= min_score)
    best = F.max_by(F.struct("inv_seq", "score"), F.struct("score", -F.col("inv_seq"))).alias("b")
    return scored.groupBy(*by, "color", "shape_desc").agg(best).select(*by, "color", "shape_desc", F.col("b.inv_seq").alias("inv_seq"), F.col("b.score").alias("score"))


def id_match(callouts: DataFrame, inventory: DataFrame) -> DataFrame:
    """callouts whose printed id is an element id (score 1) or a part number (0.95), with inv_seq and score: an equality join."""
    by = _scan(inventory)
    norm = lambda c: F.lower(F.trim(F.col(c)))
    of = lambda c, score: inventory.select(*by, "inv_seq", norm(c).alias("id"), F.lit(score).alias("score"))
    ids = of("element_id", C.ELEMENT_ID_SCORE).unionByName(of("part_num", C.PART_NUM_SCORE)).where(F.col("id") != "")
    ids = ids.groupBy(*by, "id").agg(F.max_by(F.struct("inv_seq", "score"), F.struct("score", -F.col("inv_seq"))).alias("b"))
    kept = callouts.columns
    found = callouts.withColumn("id", norm("printed_part_id")).join(ids, [*by, "id"])
    return found.select(*kept, F.col("b.inv_seq").alias("inv_seq"), F.col("b.score").alias("score"))


def best_lines(callouts: DataFrame, inventory: DataFrame, min_score: float = C.MIN_SCORE) -> DataFrame:
    """(color, shape_desc, printed_part_id, inv_seq, score) for each distinct descriptor that has a line: by its printed id, else by tokens."""
    by = _scan(inventory)
    names = [*by, "color", "shape_desc", "printed_part_id"]
    wanted = callouts.select(*names).distinct()
    printed = id_match(wanted, inventory)
    others = wanted.withColumn("printed", F.coalesce("printed_part_id", F.lit(""))).join(printed.select(*by, F.col("printed_part_id").alias("printed")).distinct(), [*by, "printed"], "left_anti").drop("printed")
    theta = theta_match(others, inventory, min_score)
    theta = theta.select(*(F.col(c).alias(f"t_{c}") for c in [*by, "color", "shape_desc"]), "inv_seq", "score")
    same = [F.col(c).eqNullSafe(F.col(f"t_{c}")) for c in [*by, "color", "shape_desc"]]
    joined = others.join(theta, same).select(*names, "inv_seq", "score")
    return printed.select(*names, "inv_seq", "score").unionByName(joined)


def closed_set(candidates: DataFrame, inventory: DataFrame) -> DataFrame:
    """(crop_id, inv_seq, score): candidates that the inventory has, the best of each line, never below 0."""
    joined = candidates.join(inventory.select("part_num", "inv_seq"), "part_num")
    return joined.groupBy("crop_id", "inv_seq").agg(F.max(F.greatest(F.lit(0.0), F.col("score"))).alias("score"))


def blend(signals: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(crop_id, inv_seq, confidence) from (crop_id, signal, inv_seq, score): the mean weighted by the signals that the crop has.

    A line that a present signal doesn't name scores 0 there. Crops whose signals weigh nothing are left out.
    """
    weight = F.coalesce(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))[F.col("signal")], F.lit(0.0))
    # One exchange by crop for both: the signals a crop has, and its lines.
    crop = Window.partitionBy("crop_id")
    weighed = signals.withColumn("w", weight)
    firsts = F.row_number().over(Window.partitionBy("crop_id", "signal").orderBy("inv_seq")) == 1
    weighed = weighed.repartition("crop_id").withColumn("own", F.when(firsts, F.col("w")).otherwise(0.0)).withColumn("total", F.sum("own").over(crop))
    summed = weighed.where("total > 0").groupBy("crop_id", "inv_seq").agg(F.sum(F.col("w") * F.col("score")).alias("s"), F.first("total").alias("total"))
    return summed.select("crop_id", "inv_seq", F.round(F.col("s") / F.col("total"), 9).alias("confidence"))


def ranked(scores: DataFrame, top_k: int = 5) -> DataFrame:
    """scores with rank 1 to top_k within each crop; of equal confidences the first inventory line leads."""
    w = Window.partitionBy("crop_id").orderBy(F.desc("confidence"), "inv_seq")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)


def identified(scores: DataFrame, top_k: int = 5) -> DataFrame:
    """(crop_id, inv_seq, confidence, alternatives): the first, and the others of top_k as array<struct<inv_seq, score>>."""
    first = F.col("rank") == 1
    others = F.array_sort(F.collect_list(F.when(~first, F.struct("rank", "inv_seq", F.col("confidence").alias("score")))))
    out = ranked(scores, top_k).groupBy("crop_id").agg(F.max(F.when(first, F.struct("inv_seq", "confidence"))).alias("b"), others.alias("o"))
    return out.select("crop_id", F.col("b.inv_seq").alias("inv_seq"), F.col("b.confidence").alias("confidence"), F.transform("o", lambda x: F.struct(x["inv_seq"].alias("inv_seq"), x["score"].alias("score"))).alias("alternatives"))


def color_signal(crops: DataFrame, inventory: DataFrame, scores: DataFrame) -> DataFrame:
    """(crop_id, inv_seq, score): every line whose colour agrees with the crop's seen one. scores (seen_color, color_name, score) above 0."""
    return crops.select("crop_id", "seen_color").join(scores, "seen_color").join(inventory.select("inv_seq", "color_name"), "color_name").select("crop_id", "inv_seq", "score")


def token_color_scores(crops: DataFrame, inventory: DataFrame) -> DataFrame:
    """Scores for color_signal() by the overlap of the names' tokens."""
    one = crops.select(F.col("seen_color").alias("a")).distinct().withColumn("tokens", C.tokens(F.col("a")))
    two = inventory.select(F.col("color_name").alias("b")).distinct().withColumn("tokens", C.tokens(F.col("b")))
    return _overlaps(one, two, []).toDF("seen_color", "color_name", "score")


def identify(crops: DataFrame, inventory: DataFrame, candidates: DataFrame | None = None, hits: DataFrame | None = None, color_scores: DataFrame | None = None, weights: dict[str, float] = WEIGHTS, top_k: int = 5) -> DataFrame:
    """(crop_id, inv_seq, confidence, components, alternatives) for each crop; null and 0 if nothing identifies it.

    crops (crop_id, seen_color), candidates (crop_id, part_num, score) of a recogniser, hits (crop_id, inv_seq, score) of the gallery,
    color_scores as color_signal() takes them. Colour only supports: a crop without a candidate in the inventory and without a hit
    isn't identified. components maps each signal that the crop has to the winner's score.
    """
    parts = []
    if candidates is not None:
        parts.append(closed_set(candidates, inventory).withColumn("signal", F.lit("brickognize")))
    if hits is not None:
        parts.append(hits.select("crop_id", "inv_seq", F.greatest(F.lit(0.0), F.col("score")).alias("score")).withColumn("signal", F.lit("embedding")))
    if not parts:
        found = crops.select("crop_id").limit(0).withColumns({"inv_seq": F.lit(None).cast("long"), "confidence": F.lit(0.0)})
        anchored = found.select("crop_id", "inv_seq", F.lit(0.0).alias("score"), F.lit("").alias("signal"))
    else:
        anchored = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    signals = anchored
    if color_scores is not None:
        sure = crops.join(anchored.select("crop_id").distinct(), "crop_id", "left_semi")
        signals = signals.unionByName(color_signal(sure, inventory, color_scores).withColumn("signal", F.lit("color")))
    best = identified(blend(signals, weights), top_k)
    of = signals.groupBy("crop_id", "signal").agg(F.map_from_entries(F.collect_list(F.struct("inv_seq", "score"))).alias("scores"))
    named = of.join(best.select("crop_id", "inv_seq"), "crop_id").groupBy("crop_id").agg(F.map_from_entries(F.collect_list(F.struct("signal", F.coalesce(F.try_element_at("scores", F.col("inv_seq")), F.lit(0.0))))).alias("components"))
    out = crops.select("crop_id").join(best, "crop_id", "left").join(named, "crop_id", "left")
    none = F.array().cast("array<struct<inv_seq:bigint,score:double>>")
    return out.select("crop_id", F.col("inv_seq").cast("long").alias("inv_seq"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("components", F.create_map().cast("map<string,double>")).alias("components"), F.coalesce(F.col("alternatives").cast("array<struct<inv_seq:bigint,score:double>>"), none).alias("alternatives"))


def parse_predictions(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """payloads' other columns with rank, part_num, name, score, img_url and category of each candidate, the best first.

    A recogniser's answer has items; one without an id or part_num is dropped, a score that isn't a number is 0, and equal
    scores stay in the answer's order. An answer that isn't JSON, or has no items, has no candidates.
    """
    kept = [c for c in payloads.columns if c != payload]
    items = F.from_json(F.col(payload), "items array<struct<id: string, part_num: string, name: string, score: string, img_url: string, category: string>>")["items"]
    each = payloads.select(*kept, F.posexplode(items).alias("pos", "x")).where("x is not null")
    some = lambda c: F.nullif(F.col(f"x.{c}"), F.lit(""))
    read = each.select(*kept, "pos", F.coalesce(some("id"), some("part_num")).alias("part_num"), F.coalesce("x.name", F.lit("")).alias("name"), F.coalesce(F.col("x.score").try_cast("double"), F.lit(0.0)).alias("score"), "x.img_url", "x.category").where("part_num is not null")
    order = Window.partitionBy(*kept).orderBy(F.desc("score"), "pos")
    return read.withColumn("rank", F.row_number().over(order)).drop("pos")


def unconstrained(crops: DataFrame, candidates: DataFrame, top_k: int = 5) -> DataFrame:
    """(crop_id, part_num, name, color_name, image_url, confidence, alternatives): the first candidate, without an inventory; the seen colour is its colour.

    candidates (crop_id, rank, part_num, name, score, img_url) as parse_predictions() has them. Crops without any have nulls and 0.
    """
    first = F.col("rank") == 1
    others = F.array_sort(F.collect_list(F.when(~first & (F.col("rank") <= top_k), F.struct("rank", "part_num", "score"))))
    best = candidates.groupBy("crop_id").agg(F.max(F.when(first, F.struct("part_num", "name", "img_url", "score"))).alias("b"), others.alias("o"))
    out = crops.select("crop_id", "seen_color").join(best, "crop_id", "left")
    found = F.col("b").isNotNull()
    return out.select("crop_id", "b.part_num", "b.name", F.when(found, F.col("seen_color")).alias("color_name"), F.col("b.img_url").alias("image_url"), F.greatest(F.lit(0.0), F.coalesce("b.score", F.lit(0.0))).alias("confidence"), F.coalesce(F.transform("o", lambda x: F.struct(x["part_num"].alias("part_num"), x["score"].alias("score"))), F.array().cast("array<struct<part_num:string,score:double>>")).alias("alternatives"))


def gallery(inventory: DataFrame, images: DataFrame) -> DataFrame:
    """(inv_seq, part_num, embedding): each line whose part has an image's vector. images (part_num, embedding); others are left out."""
    return inventory.select("inv_seq", "part_num").join(images.select("part_num", "embedding"), "part_num").select("inv_seq", "part_num", "embedding")


def _blocks(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def _unit(vectors: pa.Array) -> np.ndarray:
    """Rows of unit length; zero rows stay zero."""
    wide = np.stack([np.asarray(v, np.float64) for v in vectors.to_numpy(zero_copy_only=False)]) if len(vectors) else np.empty((0, 0))
    length = np.linalg.norm(wide, axis=1, keepdims=True)
    return wide / np.where(length == 0, 1, length)


def nearest(queries: DataFrame, gallery: DataFrame, k: int = 5, itself: bool = False) -> DataFrame:
    """(query_id, inv_seq, similarity, rank): the k gallery vectors nearest to each query by cosine, of equal ones the first.

    queries (query_id, embedding), gallery (inv_seq, embedding). A query set is stated, so all its rows meet all gallery rows: both are
    cut into blocks by their sizes, a block meets a block as one matrix product, and only k a query leave it.
    itself: a vector with the query's own number counts too.
    """
    q_blocks = _blocks(queries.count(), QUERY_BLOCK)
    g_blocks = max(_blocks(gallery.count(), GALLERY_BLOCK), min(8, gallery.sparkSession.sparkContext.defaultParallelism))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"), deal("query_id", q_blocks).alias("qb")).withColumn("gb", every(g_blocks))
    g = gallery.select(F.col("inv_seq").cast("long").alias("inv_seq"), F.col("embedding").cast("array<double>").alias("embedding"), deal("inv_seq", g_blocks).alias("gb")).withColumn("qb", every(q_blocks))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, lines = left["query_id"].to_numpy(), right["inv_seq"].to_numpy()
        order = np.argsort(lines)
        lines = lines[order]
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if len(ids) and len(lines):
            wide = _unit(right["embedding"].combine_chunks())[order].T
            unit = _unit(left["embedding"].combine_chunks())
            for a in range(0, len(ids), 256):
                near = np.round(unit[a : a + 256] @ wide, 6) + 0.0
                if not itself:
                    near[ids[a : a + 256, None] == lines[None, :]] = -np.inf
                top = np.argsort(-near, axis=1, kind="stable")[:, :k]
                row = np.repeat(np.arange(len(near)), top.shape[1])
                got = near[row, top.ravel()]
                real = np.isfinite(got)
                out.append((ids[a : a + 256][row][real], lines[top.ravel()][real], got[real]))
        return pa.table({n: np.concatenate(x) for n, x in zip(("query_id", "inv_seq", "similarity"), zip(*out, strict=True), strict=True)})

    kept = q.groupBy("qb", "gb").cogroup(g.groupBy("qb", "gb")).applyInArrow(meet, "query_id long, inv_seq long, similarity double")
    over = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "inv_seq")
    return kept.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= k)


def semihard(anchors: DataFrame, vectors: DataFrame, margin: float = 0.3) -> DataFrame:
    """(anchor, negative): for each anchor (vec_id, label, embedding) the nearest vector of another label that is farther than its nearest
    of its own label, but by less than margin; if there is none, the nearest of another label. Of equally far ones the first.

    Anchors are a stated set; blocks of them meet blocks of the vectors, and each leaves a few numbers an anchor: first the distance of the
    nearest positive, then, with that known, the best negatives.
    """
    a_blocks = _blocks(anchors.count(), QUERY_BLOCK)
    v_blocks = max(_blocks(vectors.count(), GALLERY_BLOCK), min(8, vectors.sparkSession.sparkContext.defaultParallelism))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    plain = [F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")]
    a = anchors.select(*plain, deal(a_blocks).alias("ab"))
    v = vectors.select(*plain, deal(v_blocks).alias("vb")).withColumn("ab", every(a_blocks))

    def far(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ids, order = left["vec_id"].to_numpy(), np.argsort(right["vec_id"].to_numpy())
        others = right["vec_id"].to_numpy()[order]
        kinds, own = np.array(right["label"].to_pylist(), object)[order], np.array(left["label"].to_pylist(), object)
        gap = np.round(1 - np.round(_unit(left["embedding"].combine_chunks()) @ _unit(right["embedding"].combine_chunks())[order].T, 6), 6)
        return ids, others, gap, own[:, None] == kinds[None, :]

    def positives(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.empty(0, np.int64), np.empty(0))]
        if len(left) and len(right):
            ids, others, gap, same = far(left, right)
            gap[~same | (ids[:, None] == others[None, :])] = np.inf
            out.append((ids, gap.min(1)))
        ids, near = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"vec_id": ids[np.isfinite(near)], "pos": near[np.isfinite(near)]})

    right = v.groupBy("ab", "vb")
    near = a.withColumn("vb", every(v_blocks)).groupBy("ab", "vb").cogroup(right).applyInArrow(positives, "vec_id long, pos double").groupBy("vec_id").agg(F.min("pos").alias("pos"))

    def negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, bool))]
        if len(left) and len(right):
            ids, others, gap, same = far(left, right)
            pos = left["pos"].to_numpy()[:, None]
            for band in (True, False):
                x = np.where(~same & ((gap > pos) & (gap < pos + margin) if band else True), gap, np.inf)
                at = x.argmin(1)
                best = x[np.arange(len(ids)), at]
                real = np.isfinite(best)
                out.append((ids[real], others[at][real], best[real], np.full(real.sum(), band)))
        return pa.table(dict(zip(("anchor", "negative", "dist", "band"), (np.concatenate(x) for x in zip(*out, strict=True)), strict=True)))

    known = a.join(near, "vec_id").withColumn("vb", every(v_blocks))
    found = known.groupBy("ab", "vb").cogroup(right).applyInArrow(negatives, "anchor long, negative long, dist double, band boolean")
    return found.groupBy("anchor").agg(F.min_by("negative", F.struct(~F.col("band"), "dist", "negative")).alias("negative"))


def embedded(crops: DataFrame, encode, content: str = "content") -> DataFrame:
    """crops with embedding: encode(list of bytes) gives an array of vectors, a batch at a time; made once a worker if it has a method load()."""
    schema = StructType([*crops.schema.fields, StructField("embedding", ArrayType(FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encode.load() if hasattr(encode, "load") else encode
        for batch in batches:
            got = np.asarray(model(batch.column(content).to_pylist()), np.float32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(got), pa.list_(pa.float32()))], [*batch.schema.names, "embedding"])

    return crops.mapInArrow(run, schema)
