"""Named colours: a fixed table, lookup by name, the nearest by distance, and the dominant colour of pixels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from binmap.functions import columns as C

#: Id, name and 8-bit sRGB of the named colours; of equally near ones the first counts.
COLORS = (
    (0, "Black", 33, 33, 33),
    (15, "White", 244, 244, 244),
    (4, "Red", 201, 26, 9),
    (1, "Blue", 0, 85, 191),
    (14, "Yellow", 242, 205, 55),
    (2, "Green", 35, 120, 65),
    (72, "Dark Bluish Gray", 100, 110, 104),
    (71, "Light Bluish Gray", 160, 165, 169),
    (7, "Light Gray", 155, 161, 157),
    (8, "Dark Gray", 109, 110, 92),
    (19, "Tan", 228, 205, 158),
    (28, "Dark Tan", 149, 138, 115),
    (70, "Reddish Brown", 88, 42, 18),
    (6, "Brown", 88, 57, 39),
    (25, "Orange", 254, 138, 24),
    (484, "Dark Orange", 160, 95, 53),
    (191, "Bright Light Orange", 248, 187, 61),
    (320, "Dark Red", 114, 0, 18),
    (27, "Lime", 165, 202, 24),
    (288, "Dark Green", 0, 69, 26),
    (10, "Bright Green", 75, 159, 74),
    (48, "Sand Green", 160, 188, 172),
    (330, "Olive Green", 155, 154, 90),
    (322, "Medium Azure", 54, 174, 191),
    (321, "Dark Azure", 7, 139, 201),
    (73, "Medium Blue", 90, 147, 219),
    (9, "Light Blue", 180, 210, 227),
    (63, "Dark Blue", 10, 52, 99),
    (379, "Sand Blue", 96, 116, 161),
    (26, "Magenta", 146, 57, 120),
    (22, "Purple", 129, 0, 123),
    (89, "Dark Purple", 63, 54, 145),
    (13, "Pink", 252, 151, 172),
    (353, "Coral", 255, 105, 143),
    (18, "Nougat", 208, 145, 104),
    (150, "Medium Nougat", 170, 125, 85),
    (226, "Bright Light Yellow", 255, 240, 58),
    (47, "Trans-Clear", 252, 252, 252),
)
#: Pixels whose channels all exceed the first are background, those whose channels are all below the second are outline.
BACKGROUND, OUTLINE = 235, 35


def table(spark: SparkSession) -> DataFrame:
    """(pos, id, name, r, g, b): the named colours."""
    return spark.createDataFrame([(i, *row) for i, row in enumerate(COLORS)], "pos int, id int, name string, r int, g int, b int")


def lab_of(r: float, g: float, b: float) -> tuple[float, float, float]:
    """CIE L*a*b* of one colour, as functions.columns.lab() has it for columns."""
    line = [x / 255 / 12.92 if x / 255 <= 0.04045 else ((x / 255 + 0.055) / 1.055) ** 2.4 for x in (r, g, b)]
    white = [sum(p * q for p, q in zip(row, line, strict=True)) / w for *row, w in C.XYZ]
    f = [math.cbrt(t) if t > (6 / 29) ** 3 else t / (3 * (6 / 29) ** 2) + 4 / 29 for t in white]
    return 116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])


def hex_channels(text: Column) -> Column:
    """struct<r, g, b> of "#RRGGBB" or "RRGGBB"; another length raises an error, a null stays null."""
    bare = F.regexp_replace(F.trim(text), "^#+", "")
    part = lambda at: F.conv(F.substring(bare, at, 2), 16, 10).cast("int")
    good = F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b"))
    return F.when(F.length(bare) == 6, good).when(text.isNotNull(), F.raise_error(F.lit("a colour has six hexadecimal digits")).cast("struct<r:int,g:int,b:int>"))


def normal_name(name: Column) -> Column:
    """Lower case, runs of white space as one blank."""
    return F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))


def channels_of(name: Column) -> Column:
    """struct<r, g, b> of a colour's name, null if it isn't in the table."""
    known = F.map_from_arrays(F.array(*(F.lit(n.lower()) for _, n, *_ in COLORS)), F.array(*(F.struct(F.lit(r).alias("r"), F.lit(g).alias("g"), F.lit(b).alias("b")) for _, _, r, g, b in COLORS)))
    return F.try_element_at(known, F.coalesce(normal_name(name), F.lit("")))


def nearest(r: Column, g: Column, b: Column) -> Column:
    """struct<distance, pos, name> of the named colour nearest in L*a*b*. The colour is converted once and compared with a literal list."""
    known = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip("xyz", lab_of(*rgb), strict=True)), F.lit(i).alias("pos"), F.lit(name).alias("name")) for i, (_, name, *rgb) in enumerate(COLORS)))

    def least(own: Column) -> Column:
        far = lambda c: F.sqrt(sum((F.pow(own[n] - c[n], F.lit(2.0)) for n in "xyz"), F.lit(0.0)))
        return F.array_min(F.transform(known, lambda c: F.struct(far(c).alias("distance"), c["pos"].alias("pos"), c["name"].alias("name"))))

    own = F.struct(*(v.alias(n) for n, v in zip("xyz", C.lab(r, g, b), strict=True)))
    return C.let(own, least)


def name_scores(one: DataFrame, two: DataFrame) -> DataFrame:
    """(seen_color, color_name, score) for distinct names of one (seen_color) and two (color_name) that score above 0.

    A name outside the table scores 0, so each side has at most as many distinct normal names as the table: the joins are by equality
    with the table's pairs, whose scores are literals.
    """
    lab = [lab_of(*rgb) for _, _, *rgb in COLORS]
    pairs = [(a[1].lower(), b[1].lower(), 1 - math.dist(p, q) / C.FULL_MISMATCH) for a, p in zip(COLORS, lab, strict=True) for b, q in zip(COLORS, lab, strict=True)]
    scores = one.sparkSession.createDataFrame([x for x in pairs if x[2] > 0], "x string, y string, score double")
    left = one.select("seen_color").distinct().withColumn("x", normal_name(F.col("seen_color")))
    right = two.select("color_name").distinct().withColumn("y", normal_name(F.col("color_name")))
    return left.join(F.broadcast(scores), "x").join(right, "y").select("seen_color", "color_name", "score")


def dominant(pixels: DataFrame, by: list[str]) -> DataFrame:
    """(by, r, g, b): the mean colour of the fullest of 16-level bins, the lowest of equally full ones, without background and outline.

    If nothing else is there, each channel's median. Means and medians are rounded half to even.
    """
    channels = ("r", "g", "b")
    light = F.least(*channels) > BACKGROUND
    dark = F.greatest(*channels) < OUTLINE
    code = sum((F.shiftright(c, 4).cast("int") * m for c, m in zip(channels, (256, 16, 1), strict=True)), F.lit(0))
    bins = pixels.where(~light & ~dark).withColumn("code", code).groupBy(*by, "code").agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in channels))
    top = bins.groupBy(*by).agg(F.max_by(F.struct(*channels), F.struct("n", -F.col("code"))).alias("top"))
    plain = pixels.groupBy(*by).agg(*(F.percentile(c, 0.5).alias(c) for c in channels))
    return plain.join(top, by, "left").select(*by, *(F.rint(F.coalesce(f"top.{c}", c)).cast("int").alias(c) for c in channels))
