"""Panels and bag numerals on page images.

A task reads a page's pixels once and returns boxes and features; what makes a box a panel or a numeral is decided by column
expressions over these, so that it can be pushed, tested and tuned without looking at pixels again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binmap.functions import colors
from binmap.functions import columns as C
from binmap.operators import boxes
from binmap.vision import images, regions


@dataclass(frozen=True)
class Thresholds:
    """Fixed values, as shares of the page or its height where they are below 1."""

    panel_low: int = 200
    panel_high: int = 240
    border_ink: int = 120
    border_extent: float = 0.85
    list_panels: int = boxes.LIST_PANELS
    ink: int = 90
    height: float = 0.12
    area: float = 0.10
    width: float = 0.35
    aspect: float = 0.15
    fill: float = 0.42
    ring_fill: float = 0.28
    ring_parts: int = 2
    ring_dominant: float = 0.65
    ring_height: float = 0.05
    parts: int = 8
    saturation: float = 90


BOX = "struct<x:double,y:double,w:double,h:double>"
MARK = "struct<x:double,y:double,w:double,h:double,fill:double,parts:long,dominant:double,saturation:double>"
SEEN = f"page_w long, page_h long, filled array<{BOX}>, bordered array<{BOX}>, marks array<{MARK}>, error string"


def _marks(grey: np.ndarray, rgb: np.ndarray, t: Thresholds) -> list[dict]:
    """Dark glyphs that are tall enough, neighbouring ones as one, with what tells a numeral from other ink."""
    mask = grey <= t.ink
    tall = [b for b in regions.blobs(mask).tolist() if b[3] >= min(t.height, t.ring_height) * len(grey)]
    groups: list[list[list[int]]] = []
    for b in tall:
        touching = [g for g in groups if any(_joined(b, o) for o in g)]
        groups = [g for g in groups if g not in touching] + [[b, *(o for g in touching for o in g)]]
    out, colourful = [], images.saturation(rgb) if groups else None
    for g in groups:
        x, y = min(b[0] for b in g), min(b[1] for b in g)
        w, h = max(b[0] + b[2] for b in g) - x, max(b[1] + b[3] for b in g) - y
        own = mask[y : y + h, x : x + w]
        parts = regions.blobs(own)
        out.append({"x": x, "y": y, "w": w, "h": h, "fill": float(own.mean()), "parts": len(parts), "dominant": float((parts[:, 2] * parts[:, 3]).max() / (w * h)), "saturation": float(colourful[y : y + h, x : x + w][own].mean())})
    return out


def _joined(a: list[int], b: list[int]) -> bool:
    """As boxes.digits_join(), of two boxes."""
    tall, short = max(a[3], b[3]), min(a[3], b[3])
    gap = max(b[0] - a[0] - a[2], a[0] - b[0] - b[2], 0)
    rows = max(min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]), 0)
    return gap < boxes.GAP * tall and tall - short <= boxes.HEIGHT * tall and rows >= boxes.OVERLAP * short


def looked_at(pages: DataFrame, t: Thresholds = Thresholds(), content: str = "content") -> DataFrame:  # noqa: B008
    """pages with SEEN: the size, grey fields, fields within a border, dark marks. An image that can't be read has none of them; a failure
    is told in error, and other pages go on."""
    kept = pages.columns
    names = [c.split()[0] for c in SEEN.split(", ")]

    def look(data: bytes | None) -> tuple:
        try:
            rgb = images.decode(data)
            if rgb is None:
                return None, None, [], [], [], None
            grey = images.grey(rgb)
            box = lambda b: dict(zip("xywh", b, strict=True))
            filled = [box(b[:4]) for b in regions.blobs((grey >= t.panel_low) & (grey <= t.panel_high)).tolist()]
            bordered = [box(b[:4]) for b in regions.holes(grey <= t.border_ink) if b[4] >= t.border_extent * b[2] * b[3]]
            return grey.shape[1], grey.shape[0], filled, bordered, _marks(grey, rgb, t), None
        except Exception as e:  # one bad page must not lose the others
            return None, None, [], [], [], f"{type(e).__name__}: {e}"

    fields = pages.sparkSession.createDataFrame([], SEEN).schema.fields
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    kinds = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [look(x) for x in batch.column(content).to_pylist()]
            got = [pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *got], [*kept, *names])

    return pages.mapInArrow(run, StructType([*pages.schema.fields, *fields]))


def panels(seen: DataFrame) -> Column:
    """array<BOX>: both kinds of fields through the gate, without those that an earlier one covers, in reading order."""
    fit = lambda b: boxes.fits(b["w"], b["h"], (F.col("page_w") * F.col("page_h")).cast("double"))
    every = F.filter(F.concat("filled", "bordered"), fit)
    keep = lambda kept, b: F.when(F.exists(kept, lambda o: boxes.covered(b, o) > boxes.SAME), kept).otherwise(F.concat(kept, F.array(b)))
    first = F.aggregate(every, F.array().cast(f"array<{BOX}>"), keep)
    order = F.array_sort(F.transform(first, lambda b: F.struct(b["y"].alias("y"), b["x"].alias("x"), b["w"].alias("w"), b["h"].alias("h"))))
    return F.transform(order, lambda b: F.struct(b["x"].alias("x"), b["y"].alias("y"), b["w"].alias("w"), b["h"].alias("h")))


def is_numeral(m: Column, page_w: Column, page_h: Column, t: Thresholds = Thresholds()) -> Column:  # noqa: B008
    """Whether a mark may be a bag's number: small, not too wide or narrow, black, and solid or made of a ring and what it holds."""
    small = (m["w"] * m["h"] <= t.area * page_w * page_h) & (m["w"] <= t.width * page_w) & (m["w"] / m["h"] >= t.aspect)
    solid = (m["fill"] >= t.fill) & (m["h"] >= t.height * page_h)
    ring = (m["fill"] >= t.ring_fill) & (m["parts"] == t.ring_parts) & (m["dominant"] >= t.ring_dominant) & (m["h"] >= t.ring_height * page_h)
    return small & (solid | ring) & (m["saturation"] <= t.saturation) & (m["parts"] <= t.parts)


def detections(pages: DataFrame, t: Thresholds = Thresholds(), read: Callable[[np.ndarray], str] | None = None, content: str = "content") -> DataFrame:  # noqa: B008
    """pages with panels, candidate, numeral (the largest plausible mark's box), bag_marker (what read makes of it, if a whole number),
    is_parts_list and error."""
    seen = looked_at(pages, t, content)
    found = seen.withColumn("panels", panels(seen))
    inside = lambda m: F.exists("panels", lambda p: boxes.covered(m, p) > boxes.INSIDE)
    good = F.filter("marks", lambda m: is_numeral(m, F.col("page_w"), F.col("page_h"), t) & ~inside(m))
    order = F.array_sort(F.transform(good, lambda m: F.struct((-m["w"] * m["h"]).alias("minus"), F.struct(*(m[c].alias(c) for c in "xywh")).alias("box"))))
    found = found.withColumn("plausible", F.transform(order, lambda o: o["box"])).drop("filled", "bordered", "marks")
    found = found.withColumn("is_parts_list", F.size("panels") >= t.list_panels)
    number = _read_first(found, read, content) if read else found.withColumn("read", F.lit(None).cast("struct<number:long,at:int>"))
    at = F.coalesce(F.col("read.at"), F.lit(0))
    out = number.withColumn("bag_marker", F.col("read.number")).withColumn("candidate", F.col("read.number").isNull() & (F.size("plausible") > 0))
    return out.withColumn("numeral", F.get("plausible", at)).drop("plausible", "read")


def _read_first(found: DataFrame, read: Callable[[np.ndarray], str], content: str) -> DataFrame:
    """found with read: the first of the plausible boxes, the largest ones first, that reads as a whole number, and its place."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<string>")
    def texts(data, plausible):
        import pandas as pd

        out = []
        for one, listed in zip(data, plausible, strict=True):
            rgb = images.decode(one) if listed is not None and len(listed) else None
            out.append([] if rgb is None else [read(rgb[int(b["y"]) : int(b["y"] + b["h"]), int(b["x"]) : int(b["x"] + b["w"])]) for b in listed])
        return pd.Series(out)

    numbers = F.transform(texts(F.col(content), F.col("plausible")), lambda x, i: F.struct(C.pure_integer(x).alias("number"), i.alias("at")))
    return found.withColumn("read", F.get(F.filter(numbers, lambda x: x["number"].isNotNull()), F.lit(0)))


CALLOUT = "callout_pos int, bbox struct<x:long,y:long,w:long,h:long>, crop binary, label string, r int, g int, b int"


def callouts(found: DataFrame, by: list[str], read: Callable[[np.ndarray], str] | None = None, content: str = "content") -> DataFrame:
    """(by, callout_pos, bbox, crop, quantity, seen_color): each panel of detections() cut out, with what read makes of its label (1 without)."""
    rows = found.select(*by, F.col(content).alias("content"), "panels")
    schema = rows.select(*by).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, out = [], {"callout_pos": [], "bbox": [], "crop": [], "label": [], "r": [], "g": [], "b": []}
            for i, (data, listed) in enumerate(zip(batch.column("content").to_pylist(), batch.column("panels").to_pylist(), strict=True)):
                rgb = images.decode(data) if listed else None
                for pos, p in enumerate(listed or ()):
                    x, y, w, h = (int(p[c]) for c in "xywh")
                    x, y = max(x, 0), max(y, 0)
                    crop = rgb[y : y + h, x : x + w]
                    keep.append(i)
                    for name, value in zip(out, (pos, {"x": x, "y": y, "w": w, "h": h}, images.encode(crop), read(crop) if read else "", *images.dominant(crop)), strict=True):
                        out[name].append(value)
            kinds = {"callout_pos": pa.int32(), "bbox": pa.struct([(c, pa.int64()) for c in "xywh"]), "crop": pa.binary(), "label": pa.string(), "r": pa.int32(), "g": pa.int32(), "b": pa.int32()}
            own = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(own.column(c) for c in by), *(pa.array(v, kinds[c]) for c, v in out.items())], [*by, *out])

    from pyspark.sql.types import StructType

    more = found.sparkSession.createDataFrame([], CALLOUT).schema.fields
    cut = rows.mapInArrow(run, StructType([*schema.fields, *more]))
    name = colors.nearest(*(F.col(c).cast("double") for c in "rgb"))["name"]
    return cut.select(*by, "callout_pos", "bbox", "crop", C.quantity(F.col("label")).alias("quantity"), name.alias("seen_color"))


#: The digits 0 to 9 and x, five by seven, a row of each in a line.
_FONT = """
.###. ..#.. .###. ##### ...#. ##### ..##. ##### .###. .###. .....
#...# .##.. #...# ...#. ..##. #.... .#... ....# #...# #...# .....
#..## ..#.. ....# ..#.. .#.#. ####. #.... ...#. #...# #...# #...#
#.#.# ..#.. ...#. ...#. #..#. ....# ####. ..#.. .###. .#### .#.#.
##..# ..#.. ..#.. ....# ##### ....# #...# .#... #...# ....# ..#..
#...# ..#.. .#... #...# ...#. #...# #...# .#... #...# ...#. .#.#.
.###. .###. ##### .###. ...#. .###. .###. .#... .###. .##.. #...#
"""
_SHAPE = (16, 12)


def glyph_templates() -> list[np.ndarray]:
    """The font's glyphs, cut to their ink."""
    rows = [line.split() for line in _FONT.split("\n") if line]
    out = []
    for k in range(11):
        glyph = np.array([[c == "#" for c in row[k]] for row in rows])
        out.append(_cut(glyph))
    return out


def _cut(mask: np.ndarray) -> np.ndarray:
    y, x = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    return mask[y[0] : y[-1] + 1, x[0] : x[-1] + 1]


def _scaled(mask: np.ndarray) -> np.ndarray:
    rows = (np.arange(_SHAPE[0]) * mask.shape[0] // _SHAPE[0]).clip(0, mask.shape[0] - 1)
    columns = (np.arange(_SHAPE[1]) * mask.shape[1] // _SHAPE[1]).clip(0, mask.shape[1] - 1)
    return mask[np.ix_(rows, columns)]


class DigitReader:
    """Reads labels like 12x: rows of small dark glyphs in the lower part of a crop, compared with the font's by shared ink.

    The lowest row that reads as digits and an x counts; without one the text is empty. Made for plain fonts; no claim on scans.
    """

    #: Ink below this grey; a glyph's least and greatest height by the crop's, share of ink in its box, and least likeness.
    INK, LEAST, MOST, LIKE = 70, 0.08, 0.5, 0.25

    def __init__(self):
        self.templates = [_scaled(g) for g in glyph_templates()]
        self.ratio = [g.shape[1] / g.shape[0] for g in glyph_templates()]

    def glyph(self, mask: np.ndarray) -> str | None:
        own, ratio = _scaled(mask), mask.shape[1] / mask.shape[0]
        likeness = [(own & t).sum() / max(1, (own | t).sum()) - 0.2 * abs(ratio - r) for t, r in zip(self.templates, self.ratio, strict=True)]
        best = int(np.argmax(likeness))
        return "0123456789x"[best] if likeness[best] >= self.LIKE else None

    def __call__(self, rgb: np.ndarray) -> str:
        mask = images.grey(rgb) < self.INK
        h = len(mask)
        found = [b for b in regions.blobs(mask).tolist() if max(7, self.LEAST * h) <= b[3] <= self.MOST * h and b[1] + b[3] / 2 > 0.4 * h and b[4] / (b[2] * b[3]) >= 0.1]
        rows: list[list[list[int]]] = []
        for b in sorted(found, key=lambda b: b[1] + b[3]):
            if rows and b[1] + b[3] - rows[-1][-1][1] - rows[-1][-1][3] <= 0.35 * b[3]:
                rows[-1].append(b)
            else:
                rows.append([b])
        for row in reversed(rows):
            text = "".join(self.glyph(mask[y : y + hh, x : x + w]) or "?" for x, y, w, hh, _ in sorted(row))
            if 2 <= len(text) <= 6 and text[-1] == "x" and text[:-1].isdigit():
                return text
        return ""


def overlays(found: DataFrame, by: list[str], content: str = "content", t: Thresholds = Thresholds()) -> DataFrame:  # noqa: B008
    """(by, overlay, mask): the page with its panels and numeral framed, and where its grey is that of panels, as PNG; nulls for unreadable ones."""
    rows = found.select(*by, F.col(content).alias("content"), "panels", "numeral")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn, masks = [], []
            for data, listed, numeral in zip(*(batch.column(c).to_pylist() for c in ("content", "panels", "numeral")), strict=True):
                rgb = images.decode(data)
                if rgb is None:
                    drawn.append(None)
                    masks.append(None)
                    continue
                grey = images.grey(rgb)
                masks.append(images.encode(np.where((grey >= t.panel_low) & (grey <= t.panel_high), 255, 0)))
                out = rgb.copy()
                for box, colour in [*((p, (0, 160, 0)) for p in listed or ()), *([(numeral, (200, 0, 0))] if numeral else [])]:
                    x, y, w, h = (int(box[c]) for c in "xywh")
                    for part in (np.s_[max(y, 0) : y + 3, max(x, 0) : x + w], np.s_[max(y + h - 3, 0) : y + h, max(x, 0) : x + w], np.s_[max(y, 0) : y + h, max(x, 0) : x + 3], np.s_[max(y, 0) : y + h, max(x + w - 3, 0) : x + w]):
                        out[part] = colour
                drawn.append(images.encode(out))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in by), pa.array(drawn, pa.binary()), pa.array(masks, pa.binary())], [*by, "overlay", "mask"])

    from pyspark.sql.types import BinaryType, StructField, StructType

    return rows.mapInArrow(run, StructType([*rows.select(*by).schema.fields, StructField("overlay", BinaryType()), StructField("mask", BinaryType())]))


def stats(found: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_callouts, shares and aspects, bag_marker, error) for each page of detections()."""
    each = found.select(*by, F.posexplode("panels").alias("box_id", "p")).select(*by, "box_id", "p.w", "p.h", F.lit(1).alias("quantity"))
    got = boxes.page_stats(found.select(*by, F.col("page_w").cast("double").alias("page_w"), F.col("page_h").cast("double").alias("page_h"), "bag_marker", "error"), each, by)
    return got.join(found.select(*by, "bag_marker", "error"), by)
