"""Where each part occurs, how often it was seen, and whether that agrees with the inventory.

Two engines give parts: reconciled() groups callouts that were read, assembled() crops that were identified. A part
(PART) has its key, what the first of its callouts says of it, its occurrences in order, and what follows from these. A part's occurrences
are an array in its row, as results have them; they are bounded by one scan's callouts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binmap.functions import columns as C
from binmap.operators import matching, segments

#: Confidences of a part whose count agrees, one whose count doesn't, and one without an inventory line.
AGREES, DIFFERS, VISION_ONLY = 0.9, 0.6, 0.4
#: Below the first an independent signal counts as absent; a crop is rerouted only to a score of the second.
EPSILON, REROUTE = 1e-9, 0.3
#: Fixed value: messages of failed identifications that are shown.
SHOWN = 3

ATTRIBUTES = ("name", "part_num", "color_name", "element_id", "image_url", "inventory_qty", "reconciled")
PART = ("scan_id", "key", "part_num", "name", "color_name", "element_id", "image_url", "occurrences", "bags", "pages", "total_seen", "inventory_qty", "reconciled", "count_matches", "confidence", "first_seen")


def counted(callouts: DataFrame, pages: DataFrame, bags: DataFrame) -> DataFrame:
    """callouts (scan_id, page_index, ...) of pages that aren't part lists, with their page's bag (0 if it has none)."""
    lists = pages.where("is_parts_list").select("scan_id", "page_index")
    kept = callouts.join(lists, ["scan_id", "page_index"], "left_anti")
    return kept.join(bags, ["scan_id", "page_index"], "left").withColumn("bag", F.coalesce("bag", F.lit(0)))


def located(occurrences: DataFrame) -> DataFrame:
    """A row for each scan and key: sorted distinct bags and pages, how many were seen, in how many callouts."""
    return occurrences.groupBy("scan_id", "key").agg(F.sort_array(F.collect_set("bag")).alias("bags"), F.sort_array(F.collect_set("page_index")).alias("pages"), F.sum("quantity").alias("total_seen"), F.count(F.lit(1)).alias("n_occurrences"))


def validated(parts: DataFrame) -> DataFrame:
    """parts (total_seen, inventory_qty) with reconciled, count_matches (null without an inventory line) and confidence."""
    have = F.col("inventory_qty").isNotNull()
    same = F.col("total_seen") == F.col("inventory_qty")
    return parts.withColumns({"reconciled": have, "count_matches": F.when(have, same), "confidence": F.when(~have, VISION_ONLY).when(same, AGREES).otherwise(DIFFERS)})


def _grouped(occurrences: DataFrame, *more: Column) -> DataFrame:
    """occurrences (scan_id, key, ATTRIBUTES, bag, page_index, quantity, place) as parts without confidence. place: their order in the scan."""
    each = F.array_sort(F.collect_list(F.struct("place", "bag", "page_index", "quantity")))
    first = F.min_by(F.struct(*ATTRIBUTES), "place")
    grouped = occurrences.groupBy("scan_id", "key").agg(each.alias("o"), first.alias("f"), F.min("place").alias("first_seen"), F.sum("quantity").alias("total_seen"), *more)
    listed = F.transform("o", lambda x: F.struct(x["bag"].alias("bag"), x["page_index"].alias("page_index"), x["quantity"].alias("quantity")))
    distinct = lambda c: F.array_sort(F.array_distinct(F.transform("o", lambda x: x[c])))
    parts = grouped.select("*", listed.alias("occurrences"), distinct("bag").alias("bags"), distinct("page_index").alias("pages"), *(F.col(f"f.{a}").alias(a) for a in ATTRIBUTES)).drop("o", "f")
    checked = F.col("reconciled") & F.col("inventory_qty").isNotNull()
    return parts.withColumn("count_matches", F.when(checked, F.col("total_seen") == F.col("inventory_qty")))


def _place(df: DataFrame) -> Column:
    """The order of callouts within a scan: by page, then as the pages were given, then as they stand on the page."""
    return F.struct("page_index", *(F.col(c) for c in ("page_seq", "callout_pos") if c in df.columns))


def reconciled(callouts: DataFrame, pages: DataFrame, bags: DataFrame, inventory: DataFrame | None = None, min_score: float = C.MIN_SCORE) -> DataFrame:
    """Parts (PART) of callouts (scan_id, page_index, callout_pos, quantity, color, shape_desc, printed_part_id).

    A callout belongs to the best inventory line, if there is one of at least min_score, under that line's part number and colour; else
    to what its words say. Lines of one key are one part, with the quantity of the line that was met first.
    """
    seen = counted(callouts, pages, bags)
    seen = seen.withColumn("place", _place(seen))
    plain = {"name": F.col("shape_desc"), "part_num": F.lit(None).cast("string"), "color_name": F.col("color"), "element_id": F.lit(None).cast("string"), "image_url": F.lit(None).cast("string"), "inventory_qty": F.lit(None).cast("long"), "reconciled": F.lit(False)}
    key = C.vision_key(F.col("color"), F.col("shape_desc"))
    if inventory is not None:
        by = ["scan_id"] if "scan_id" in inventory.columns else []
        best = matching.best_lines(callouts, inventory, min_score)
        line = inventory.select(*by, "inv_seq", C.inventory_key(F.col("part_num"), F.col("color_id"), F.col("color_name")).alias("line_key"), F.struct("name", "part_num", "color_name", "element_id", "image_url", F.col("quantity").cast("long").alias("inventory_qty"), F.lit(True).alias("reconciled")).alias("line"))
        best = best.join(line, [*by, "inv_seq"]).drop("inv_seq", "score")
        names = [*by, "color", "shape_desc", "printed_part_id"]
        best = best.select(*(F.col(c).alias(f"m_{c}") for c in names), "line_key", "line")
        seen = seen.join(best, [F.col(c).eqNullSafe(F.col(f"m_{c}")) for c in names], "left")
        plain = {a: F.when(F.col("line").isNotNull(), F.col(f"line.{a}")).otherwise(c) for a, c in plain.items()}
        key = F.coalesce("line_key", key)
    found = seen.select("scan_id", key.alias("key"), *(c.alias(a) for a, c in plain.items()), "bag", "page_index", "quantity", "place")
    sure = F.when(F.col("count_matches").isNull(), VISION_ONLY).when(F.col("count_matches"), AGREES).otherwise(DIFFERS)
    return _grouped(found).withColumn("confidence", sure).select(*PART)


def assembled(crops: DataFrame, pages: DataFrame, bags: DataFrame, inventory: DataFrame, capacity: bool = True, counts: bool = True) -> DataFrame:
    """Parts (PART) of identified crops.

    crops: scan_id, page_index, callout_pos, quantity, seen_color, inv_seq (null: unidentified), confidence, components,
    alternatives. Crops are assigned by capacity first (if counts are to agree at all). Unidentified ones gather by their seen colour.
    Confidence is the mean, to three digits.
    """
    seen = assignments(crops, pages, bags, inventory, capacity and counts, ("scan_id", "seen_color", "bag", "quantity", "place"))
    line = inventory.select(*(["scan_id"] if "scan_id" in inventory.columns else []), "inv_seq", C.inventory_key(F.col("part_num"), F.col("color_id"), F.col("color_name")).alias("line_key"), "name", "part_num", "color_name", "element_id", "image_url", F.col("quantity").cast("long").alias("line_qty"))
    joined = seen.join(line, [*(["scan_id"] if "scan_id" in inventory.columns else []), "inv_seq"], "left")
    there = F.col("line_key").isNotNull()
    unknown = F.concat(F.lit("Unidentified ("), F.coalesce("seen_color", F.lit("unknown colour")), F.lit(")"))
    found = joined.select(
        "scan_id",
        F.coalesce("line_key", F.concat(F.lit("unknown:"), F.coalesce("seen_color", F.lit("?")))).alias("key"),
        F.when(there, F.col("name")).otherwise(unknown).alias("name"),
        "part_num",
        F.when(there, F.col("color_name")).otherwise(F.col("seen_color")).alias("color_name"),
        "element_id",
        "image_url",
        F.when(there & F.lit(counts), F.col("line_qty")).alias("inventory_qty"),
        (there & F.lit(counts)).alias("reconciled"),
        "bag",
        F.col("place")["page_index"].alias("page_index"),
        "quantity",
        "place",
        F.when(there, F.col("confidence")).otherwise(0.0).alias("sure"),
    )
    return _grouped(found, C.half_even(F.avg("sure"), 3).alias("confidence")).select(*PART)


def assignments(crops: DataFrame, pages: DataFrame, bags: DataFrame, inventory: DataFrame, capacity: bool = True, columns: Sequence[str] | None = None) -> DataFrame:
    """crops on pages that aren't part lists, with bag, place, raw_inv_seq (the identified line), and the line and confidence assigned.

    columns: those that are wanted besides the line and confidence, all by default. Crops without a scan are left out.
    """
    # What the assignment asks of a crop is found before crops are dealt out; then they needn't take components and alternatives along.
    asked = {"components": F.coalesce("components", F.create_map().cast("map<string,double>")), "__alone": embedding_only(), "__others": F.when(embedding_only(), F.col("alternatives"))}
    crops = crops.where("scan_id is not null").withColumns(asked)
    seen = counted(crops, pages, bags)
    seen = seen.withColumn("place", _place(seen))
    fields = {c: F.col(c) for c in seen.columns if c not in ("inv_seq", "confidence", "__alone", "__others")} | {"raw_inv_seq": F.col("inv_seq")}
    names = columns or list(fields)
    # A crop goes through the assignment as a whole, as its own id: no join to find it again.
    whole = F.struct(*(fields[c].alias(c) for c in names if c != "scan_id")).alias("crop_id")
    signs = F.col("__alone").alias("embedding_only"), F.col("__others").alias("alternatives")
    order = seen.select("scan_id", whole, F.col("place").alias("seq"), "quantity", "inv_seq", "confidence", *signs)
    given = assigned(order, inventory, capacity, crops.select("scan_id", "inv_seq", *signs))
    return given.select(*(F.col(c) if c == "scan_id" else F.col("crop_id")[c].alias(c) for c in names), "inv_seq", "confidence")


def part_order() -> Column:
    """The number of a part in its scan's list: by its first bag, then by name (or key), then as it was first seen."""
    first = F.coalesce(F.get("bags", F.lit(0)), F.lit(0))
    label = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("key"))
    return F.row_number().over(Window.partitionBy("scan_id").orderBy(first, label, "first_seen")) - 1


def part_warnings(parts: DataFrame, ensemble: bool) -> DataFrame:
    """(scan_id, phase, ord, message): parts whose count differs, as first seen. ensemble: of assembled(), which tells reuse from a mismatch."""
    excess = F.col("total_seen") - F.col("inventory_qty")
    bad = parts.where(~F.col("count_matches")).withColumn("label", F.coalesce(F.nullif("name", F.lit("")), "key")).withColumn("n_occurrences", F.size("occurrences"))
    # The texts are part of the result.
    reuse = F.format_string("%s appears in %d step(s) (piece count %d) — multi-step reuse, not a miscount.", "label", "n_occurrences", "inventory_qty")
    differ = F.format_string("Count mismatch for %s: saw %d, inventory has %d.", "label", "total_seen", "inventory_qty")
    paged = F.format_string("Count mismatch for %s: saw %d in pages, inventory has %d.", "label", "total_seen", "inventory_qty")
    message = F.when((excess > 0) & (excess < F.col("n_occurrences")), reuse).otherwise(differ) if ensemble else paged
    order = F.row_number().over(Window.partitionBy("scan_id").orderBy("first_seen"))
    return bad.select("scan_id", F.lit(2).alias("phase"), order.cast("long").alias("ord"), message.alias("message"))


def failure_warnings(crops: DataFrame) -> DataFrame:
    """(scan_id, phase, ord, message): the first SHOWN distinct messages of failed calls, and how many failed if that is more.

    crops (scan_id, page_index, callout_pos, error), of pages that aren't part lists; a null error is none.
    """
    # The texts are part of the result.
    failed = crops.where("error is not null").select("scan_id", _place(crops).alias("place"), F.format_string("identify failed on page %d: %s", F.col("page_index") + 1, "error").alias("message"))
    distinct = failed.groupBy("scan_id", "message").agg(F.min("place").alias("place"))
    order = F.row_number().over(Window.partitionBy("scan_id").orderBy("place"))
    shown = distinct.withColumn("ord", order.cast("long")).where(F.col("ord") <= SHOWN).select("scan_id", F.lit(3).alias("phase"), "ord", "message")
    total = F.format_string("%d identify call(s) failed in total (only the first 3 distinct messages are shown above).", "n")
    every = failed.groupBy("scan_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHOWN)
    return shown.unionByName(every.select("scan_id", F.lit(3).alias("phase"), F.lit(SHOWN + 1).cast("long").alias("ord"), total.alias("message")))


def unidentified_warnings(parts: DataFrame) -> DataFrame:
    """(scan_id, phase, ord, message): how many crops gathered under unknown keys."""
    lost = parts.where(F.col("key").startswith("unknown:")).groupBy("scan_id").agg(F.sum(F.size("occurrences")).alias("n"))
    return lost.select("scan_id", F.lit(4).alias("phase"), F.lit(1).cast("long").alias("ord"), F.format_string("%d callout(s) could not be identified against the inventory.", "n").alias("message"))


def count_warnings(parts: DataFrame) -> DataFrame:
    """(scan_id, key, kind, message) for parts whose counts differ: multi-step reuse, or a mismatch."""
    excess = F.col("total_seen") - F.col("inventory_qty")
    reuse = (excess > 0) & (excess < F.col("n_occurrences"))
    # The texts are part of the result.
    seen = F.format_string("%s appears in %d step(s) (piece count %d) — multi-step reuse, not a miscount.", "label", "n_occurrences", "inventory_qty")
    differ = F.format_string("Count mismatch for %s: saw %d, inventory has %d.", "label", "total_seen", "inventory_qty")
    bad = validated(parts).where(~F.col("count_matches"))
    return bad.select("scan_id", "key", F.when(reuse, "reuse").otherwise("mismatch").alias("kind"), F.when(reuse, seen).otherwise(differ).alias("message"))


def reverse_index(parts: DataFrame, order: str | None = None) -> DataFrame:
    """(scan_id, bag, keys): the parts of each bag, in the order of a column, or sorted."""
    each = parts.select("scan_id", F.struct(*([order] if order else []), "key").alias("k"), F.explode("bags").alias("bag"))
    return each.groupBy("scan_id", "bag").agg(F.transform(F.array_sort(F.collect_list("k")), lambda x: x["key"]).alias("keys"))


def bag_cards(segments: DataFrame, parts: DataFrame) -> DataFrame:
    """(scan_id, bag, n_parts, n_bad) for every bag of a segment or a part; a part in several bags counts in each."""
    status = C.status(F.col("reconciled"), F.col("count_matches"))
    each = parts.select("scan_id", F.explode("bags").alias("bag"), F.lit(1).alias("n"), (status == "bad").cast("int").alias("bad"))
    # A segment is a row that counts nothing: one exchange, no join.
    every = each.unionByName(segments.select("scan_id", "bag", F.lit(0).alias("n"), F.lit(0).alias("bad")))
    return every.groupBy("scan_id", "bag").agg(F.sum("n").alias("n_parts"), F.sum("bad").alias("n_bad"))


def embedding_only(components: str = "components") -> Column:
    """Whether a crop's identity rests on its embedding alone."""
    at = lambda k: F.coalesce(F.try_element_at(F.col(components), F.lit(k)), F.lit(0.0))
    return (at("brickognize") <= EPSILON) & (at("embedding") > EPSILON)


def assigned(crops: DataFrame, inventory: DataFrame, capacity: bool = True, asking: DataFrame | None = None) -> DataFrame:
    """Greedy assignment by capacity: (scan_id, crop_id, inv_seq, confidence, diverted).

    crops: scan_id, crop_id, seq, quantity, inv_seq, confidence, embedding_only, alternatives. inventory: inv_seq, quantity, and scan_id if
    it is one scan's, and key (or what a key is made of), if lines share their room. In order of descending
    confidence each crop takes its winner, unless that rests on the embedding alone and its key's capacity is used up;
    then the first alternative of at least REROUTE with room, else none. Capacity is checked before a crop is added;
    0 is unlimited. One decision depends on all before it, so a scan's lines and then its crops are streamed in order through one
    task, which holds what the scan's lines have used; scans go side by side. asking: crops or more, with the columns that name lines, if
    that is less work than crops themselves; they are read twice where many lines are shared.
    """
    if not capacity:
        none = F.col("inv_seq").isNull()
        return crops.select("scan_id", "crop_id", "inv_seq", F.when(none, 0.0).otherwise(F.col("confidence")).alias("confidence"), F.lit(False).alias("diverted"))
    if "key" in inventory.columns:
        key = F.col("key").cast("string")
    elif "part_num" in inventory.columns:
        key = C.inventory_key(F.col("part_num"), F.col("color_id"), F.col("color_name"))
    else:
        key = F.col("inv_seq").cast("string")
    shared = "scan_id" not in inventory.columns
    lines = inventory.select(*([] if shared else ["scan_id"]), F.col("inv_seq").cast("long").alias("inv_seq"), key.alias("key"), F.col("quantity").cast("long").alias("quantity"))
    # One inventory for all scans is broadcast and read by each task once if it is small, as a set's some hundred lines are; of a larger one each scan gets the lines that its crops may take.
    few = _few(lines) if shared else None
    common = None if few is None else crops.sparkSession.sparkContext.broadcast(few)
    if shared and common is None:
        lines, shared = _wanted(crops if asking is None else asking).join(lines, "inv_seq"), False
    made = T.StructType().add("scan_id", crops.schema["scan_id"].dataType).add("crop_id", crops.schema["crop_id"].dataType).add("inv_seq", "long").add("confidence", "double").add("diverted", "boolean")
    order = crops.select("scan_id", F.lit(1).alias("turn"), "crop_id", "seq", F.col("quantity").cast("long").alias("quantity"), F.col("inv_seq").cast("long").alias("inv_seq"), F.col("confidence").cast("double").alias("confidence"), "embedding_only", F.when(F.col("embedding_only"), F.transform("alternatives", lambda a: F.struct(a["inv_seq"].cast("long").alias("inv_seq"), a["score"].cast("double").alias("score")))).alias("alternatives"), F.lit(None).cast("string").alias("key"))
    if not shared:
        order = order.unionByName(lines.withColumn("turn", F.lit(0)), allowMissingColumns=True)
    order = order.repartition("scan_id").sortWithinPartitions("scan_id", "turn", F.desc("confidence"), "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rooms, used = object(), {}, {}
        fixed = {i: (k, q) for i, k, q in common.value} if common else None

        def full(line: int) -> bool:
            k, room = rooms.get(line, (line, 0))
            return 0 < room <= used.get(k, 0)

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("scan_id", "turn", "inv_seq", "confidence", "quantity", "embedding_only", "alternatives", "key")), strict=True)
            lines, scores, moved, keep = [], [], [], []
            for i, (scan_id, turn, pick, score, quantity, alone, others, key) in enumerate(rows):
                if scan_id != at:
                    at, used, rooms = scan_id, {}, fixed if fixed is not None else {}
                if turn == 0:
                    rooms[pick] = (key, quantity)
                    continue
                won = pick
                if pick is None:
                    score = 0.0
                elif alone and full(pick):
                    pick, score = next(((a["inv_seq"], a["score"]) for a in others or () if a["score"] >= REROUTE and not full(a["inv_seq"])), (None, 0.0))
                if pick is not None:
                    k = rooms.get(pick, (pick, 0))[0]
                    used[k] = used.get(k, 0) + quantity
                keep.append(i)
                lines.append(pick)
                scores.append(score)
                moved.append(pick != won)
            mine = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([mine.column("scan_id"), mine.column("crop_id"), pa.array(lines, pa.int64()), pa.array(scores, pa.float64()), pa.array(moved, pa.bool_())], ["scan_id", "crop_id", "inv_seq", "confidence", "diverted"])

    return order.mapInArrow(run, made)


#: Lines of an inventory that all scans share, at most, for it to be broadcast.
MOST_LINES = 100_000


def _few(lines: DataFrame) -> list | None:
    """The rows of at most MOST_LINES lines; None if there are more."""
    rows = lines.limit(MOST_LINES + 1).collect()
    return None if len(rows) > MOST_LINES else [tuple(r) for r in rows]


def _wanted(crops: DataFrame) -> DataFrame:
    """(scan_id, inv_seq): the lines that each scan's crops were identified as, or may be diverted to."""
    others = F.when(F.col("embedding_only"), F.transform("alternatives", lambda a: a["inv_seq"].cast("long")))
    named = F.concat(F.array(F.col("inv_seq").cast("long")), F.coalesce(others, F.array().cast("array<long>")))
    return crops.select("scan_id", F.explode(named).alias("inv_seq")).where("inv_seq is not null").distinct()


def needs_detail(triage: DataFrame) -> DataFrame:
    """The pages of a triage that a detailed look is for: those with callouts that aren't part lists."""
    return triage.where("has_callouts and not is_parts_list")


def two_pass(triage: DataFrame, detail: DataFrame, none: Column | None = None) -> DataFrame:
    """The triage of each page with the detail of those that need it; none: the callouts of a page without (0 by default).

    The triage's bag marker counts, also 0; its printed number only if it isn't 0; either may say that it is a parts list. Pages are
    told apart by page_index, and by scan_id where both have it.
    """
    by = [c for c in ("scan_id", "page_index") if c in triage.columns and c in detail.columns]
    needed = needs_detail(triage).select(*by)
    d = detail.join(needed, by, "left_semi").select(*by, F.col("bag_marker").alias("d_bag"), F.col("printed").alias("d_printed"), F.col("is_parts_list").alias("d_list"), "callouts")
    joined = triage.join(d, by, "left")
    return joined.select(*by, F.coalesce("bag_marker", "d_bag").alias("bag_marker"), F.coalesce(F.nullif(F.col("printed"), F.lit(0)), "d_printed").alias("printed"), (F.col("is_parts_list") | F.coalesce("d_list", F.lit(False))).alias("is_parts_list"), F.coalesce("callouts", F.lit(0) if none is None else none).alias("callouts"))


def two_pass_stats(triage: DataFrame) -> DataFrame:
    """(triaged, detailed, skipped): how many pages."""
    need = F.col("has_callouts") & ~F.col("is_parts_list")
    return triage.agg(F.count(F.lit(1)).alias("triaged"), F.count_if(need).alias("detailed"), F.count_if(~need).alias("skipped"))


def results(parts: DataFrame, bags: DataFrame, warnings: DataFrame, scans: DataFrame) -> DataFrame:
    """A nested row for each scan: set_num, set_name, source_pdf, num_pages, reconciled, bags, parts, warnings.

    scans (scan_id, set_num, set_name, source_pdf, num_pages, reconciled); parts (PART), bags as segments() has them, warnings (scan_id, phase, ord, message).
    """
    shown = [c for c in PART if c not in ("scan_id", "first_seen")]
    listed = parts.withColumn("ord", part_order()).groupBy("scan_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct(*shown).alias("part")))), lambda x: x["part"]).alias("parts"))
    spans = bags.groupBy("scan_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("start_page", "bag", "end_page"))), lambda x: F.struct(x["bag"].alias("bag"), x["start_page"].alias("start_page"), x["end_page"].alias("end_page"))).alias("bags"))
    said = warnings.groupBy("scan_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("phase", "ord", "message"))), lambda x: x["message"]).alias("warnings"))
    out = scans
    for each in (spans, listed, said):
        out = out.join(each, "scan_id", "left")
    empty = lambda c, df: F.coalesce(c, F.array().cast(df.schema[c].dataType)).alias(c)
    return out.select("scan_id", "set_num", "set_name", "source_pdf", "num_pages", "reconciled", empty("bags", spans), empty("parts", listed), empty("warnings", said))


def scan_extracts(pages: DataFrame, callouts: DataFrame, inventory: DataFrame | None = None, num_pages: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parts, segments and warnings of page extracts: segment, look up, match, group, validate."""
    bags = segments.page_bags(pages, num_pages)
    parts = reconciled(callouts, pages, bags, inventory)
    warnings = segments.segment_warnings(pages, num_pages)
    if inventory is not None:
        warnings = warnings.unionByName(part_warnings(parts, ensemble=False))
    return parts, segments.segments(pages, num_pages), warnings


def scan_crops(pages: DataFrame, crops: DataFrame, inventory: DataFrame, num_pages: DataFrame | None = None, capacity: bool = True, counts: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parts, segments and warnings of identified crops; bag numbers that weren't read are filled in first."""
    numbered = segments.with_ordinals(pages)
    read = numbered.withColumn("bag_marker", F.col("assigned")).drop("assigned")
    bags = segments.page_bags(read, num_pages)
    parts = assembled(crops, read, bags, inventory, capacity, counts)
    lists = read.where("is_parts_list").select("scan_id", "page_index")
    warnings = segments.segment_warnings(read, num_pages).unionByName(part_warnings(parts, ensemble=True))
    if "error" in crops.columns:
        warnings = warnings.unionByName(failure_warnings(crops.join(lists, ["scan_id", "page_index"], "left_anti")))
    warnings = warnings.unionByName(unidentified_warnings(parts)).unionByName(segments.ordinal_warnings(pages))
    return parts, segments.segments(read, num_pages), warnings
