"""Boxes on pages: gates, overlaps, first-come deduplication, digits that make a numeral, statistics.

boxes: page (any columns given as by), box_id (their order on the page), x, y, w, h. A page's boxes are few; folds over them run inside
one row, without Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least and greatest area of a panel as a share of the page, and its least and greatest width by height.
AREA, ASPECT = (0.0005, 0.2), (0.3, 4.0)
#: A box that an earlier one covers beyond the first goes; a numeral that a panel covers beyond the second isn't one.
SAME, INSIDE = 0.6, 0.3
#: Two digits make a numeral if the gap is below the first share of the taller, their heights differ by at most the second,
#: and they overlap by the third of the shorter at least.
GAP, HEIGHT, OVERLAP = 0.6, 0.4, 0.5
#: Fixed value: panels of a page from which on it is a parts list.
LIST_PANELS = 12

BOX = "struct<x:double,y:double,w:double,h:double>"


def fits(w: Column, h: Column, page_area: Column, area: tuple[float, float] = AREA, aspect: tuple[float, float] = ASPECT) -> Column:
    """Whether a box may be a panel, by its area and shape; the bounds fit."""
    return (h != 0) & (w * h).between(area[0] * page_area, area[1] * page_area) & (w / F.nullif(h, F.lit(0))).between(*aspect)


def covered(a: Column, b: Column) -> Column:
    """The share of a's area that lies in b; boxes are structs. 0 for an empty box."""
    wide = F.greatest(F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]), F.lit(0.0))
    high = F.greatest(F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]), F.lit(0.0))
    area = a["w"] * a["h"]
    return F.when(area <= 0, F.lit(0.0)).otherwise(wide * high / area)


def digits_join(a: Column, b: Column) -> Column:
    """Whether two glyphs look like neighbouring digits of a numeral."""
    tall, short = F.greatest(a["h"], b["h"]), F.least(a["h"], b["h"])
    gap = F.greatest(b["x"] - a["x"] - a["w"], a["x"] - b["x"] - b["w"], F.lit(0.0))
    row = F.greatest(F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]), F.lit(0.0))
    return (tall > 0) & (gap < GAP * tall) & ((tall - short) / F.nullif(tall, F.lit(0.0)) <= HEIGHT) & (row >= OVERLAP * short)


def _box() -> Column:
    return F.struct(*(F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h")))


def without_overlap(candidates: DataFrame, cells: DataFrame, by: list[str], most: float = INSIDE) -> DataFrame:
    """candidates that no cell of their page covers by more than most: an anti join on the page."""
    cells = cells.select(*by, _box().alias("cell"))
    own = candidates.withColumn("own", _box())
    return own.join(cells, [own[c].eqNullSafe(cells[c]) for c in by] + [covered(own["own"], cells["cell"]) > most], "left_anti").drop("own")


def first_come(boxes: DataFrame, by: list[str], most: float = SAME) -> DataFrame:
    """(by, x, y, w, h, place): boxes in their order, without those that a kept earlier one covers by more than most, then in reading order."""
    listed = boxes.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("box_id", _box().alias("b")))), lambda e: e["b"]).alias("boxes"))
    none = F.array().cast(f"array<{BOX}>")
    keep = lambda kept, b: F.when(F.exists(kept, lambda o: covered(b, o) > most), kept).otherwise(F.concat(kept, F.array(b)))
    kept = F.aggregate("boxes", none, keep)
    order = F.transform(F.array_sort(F.transform(kept, lambda b: F.struct(b["y"].alias("y"), b["x"].alias("x"), b["w"].alias("w"), b["h"].alias("h")))), lambda b: b)
    return listed.select(*by, F.posexplode(order).alias("place", "b")).select(*by, "b.x", "b.y", "b.w", "b.h", "place")


def numerals(glyphs: DataFrame, by: list[str]) -> DataFrame:
    """(by, x, y, w, h, parts): the boxes around glyphs that belong together, directly or through others, the largest first (place).

    Each glyph in turn joins all groups that have a neighbour of it into one: the connected components of the page's pairs.
    """
    listed = glyphs.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("box_id", _box().alias("b")))), lambda e: e["b"]).alias("boxes"))
    none = F.array().cast(f"array<array<{BOX}>>")

    def add(groups: Column, b: Column) -> Column:
        touches = lambda g: F.exists(g, lambda o: digits_join(o, b))
        joined = F.concat(F.flatten(F.filter(groups, touches)), F.array(b))
        return F.concat(F.filter(groups, lambda g: ~touches(g)), F.array(joined))

    def around(g: Column) -> Column:
        left, top = F.array_min(F.transform(g, lambda b: b["x"])), F.array_min(F.transform(g, lambda b: b["y"]))
        right, bottom = F.array_max(F.transform(g, lambda b: b["x"] + b["w"])), F.array_max(F.transform(g, lambda b: b["y"] + b["h"]))
        w, h = right - left, bottom - top
        return F.struct((-w * h).alias("minus"), top.alias("y"), left.alias("x"), w.alias("w"), h.alias("h"), F.size(g).alias("parts"))

    found = F.array_sort(F.transform(F.aggregate("boxes", none, add), around))
    return listed.select(*by, F.posexplode(found).alias("place", "g")).select(*by, "g.x", "g.y", "g.w", "g.h", "g.parts", "place")


def page_stats(pages: DataFrame, boxes: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_callouts, quantities, and min, median and max of area share and aspect) for each page (by, page_w, page_h); nulls without boxes.

    boxes has quantity; a box without size (null w) counts as a callout only.
    """
    joined = pages.join(boxes, by, "left")
    area = F.when(F.col("page_w") * F.col("page_h") > 0, F.col("w") * F.col("h") / (F.col("page_w") * F.col("page_h")))
    aspect = F.when(F.col("h") > 0, F.col("w") / F.col("h"))
    three = lambda c, name: (F.min(c).alias(f"{name}_min"), F.percentile(c, 0.5).alias(f"{name}_median"), F.max(c).alias(f"{name}_max"))
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("box_id").isNotNull(), F.struct("box_id", "quantity")))), lambda e: e["quantity"])
    out = joined.groupBy(*by).agg(F.count("box_id").alias("n_callouts"), listed.alias("quantities"), *three(area, "area"), *three(aspect, "aspect"))
    return out.withColumn("is_parts_list", F.col("n_callouts") >= LIST_PANELS)
