"""Column expressions: tokens, similarities, keys, colours, vectors and parsing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that don't tell colours apart.
STOP_WORDS = ("color", "colour")
#: The least score of a match, the scores of printed ids, and the cap of all other matches.
MIN_SCORE, ELEMENT_ID_SCORE, PART_NUM_SCORE, OTHER_CAP = 0.35, 1.0, 0.95, 0.9
#: Colour distance from which two colours have nothing in common.
FULL_MISMATCH = 50.0


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(text: Column) -> Column:
    """Distinct runs of a-z and 0-9 of the lower-cased text, in order of first appearance; null gives none."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1))


def key_text(text: Column) -> Column:
    """Sorted distinct tokens without stop words, joined by spaces."""
    return F.array_join(F.sort_array(F.array_except(tokens(text), F.array(*map(F.lit, STOP_WORDS)))), " ")


def vision_key(color: Column, shape: Column) -> Column:
    return F.concat(F.lit("vision:"), key_text(color), F.lit("|"), key_text(shape))


def inventory_key(part_num: Column, color_id: Column, color_name: Column) -> Column:
    """part_num|color_id, else the colour's name, else None."""
    return F.concat(part_num, F.lit("|"), F.coalesce(color_id.cast("string"), color_name, F.lit("None")))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token sets; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norms: Column | None = None) -> Column:
    """Cosine of two vectors in double precision; a zero vector is at right angles to all. norms: the product of their norms, if known."""
    both = norm(a) * norm(b) if norms is None else norms
    return F.when(both == 0, F.lit(0.0)).otherwise(dot(a, b) / both)


#: Rows of the matrix from linear sRGB to XYZ, each with the D65 white point's value.
XYZ = ((0.4124564, 0.3575761, 0.1804375, 0.95047), (0.2126729, 0.7151522, 0.0721750, 1.0), (0.0193339, 0.1191920, 0.9503041, 1.08883))


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIE L*a*b* (D65) of an 8-bit sRGB colour."""
    # sRGB's transfer curve.
    linear = lambda c: F.when(c / 255.0 <= 0.04045, c / 255.0 / 12.92).otherwise(F.pow((c / 255.0 + 0.055) / 1.055, F.lit(2.4)))
    x, y, z = (linear(c) for c in (r, g, b))
    white = [(x * p + y * q + z * s) / w for p, q, s, w in XYZ]
    f = lambda t: F.when(t > (6 / 29) ** 3, F.cbrt(t)).otherwise(t / (3 * (6 / 29) ** 2) + 4 / 29)
    fx, fy, fz = map(f, white)
    return 116 * fy - 16, 500 * (fx - fy), 200 * (fy - fz)


def color_distance(one: tuple[Column, Column, Column], two: tuple[Column, Column, Column]) -> Column:
    """Euclidean distance of two L*a*b* colours."""
    return F.sqrt(sum((F.pow(p - q, F.lit(2.0)) for p, q in zip(one, two, strict=True)), F.lit(0.0)))


def color_score(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - distance / FULL_MISMATCH)


def quantity(text: Column) -> Column:
    """The number before the first x, at least 1; 1 if there is none."""
    found = F.nullif(F.regexp_extract(text, r"([0-9]+)\s*[xX]", 1), F.lit(""))
    return F.greatest(F.lit(1), F.coalesce(found.try_cast("int"), F.lit(1)))


def normalized_set_number(text: Column) -> Column:
    """The trimmed number, with -1 behind it if it has no dash."""
    t = F.trim(text)
    return F.when(t.contains("-"), t).otherwise(F.concat(t, F.lit("-1")))


def pure_integer(text: Column) -> Column:
    """The number of a text that has digits only, between white space; else null."""
    return F.when(F.trim(text).rlike("^[0-9]+$"), F.trim(text).try_cast("long"))


def half_even(value: Column, scale: int) -> Column:
    """Rounded to scale digits, ties to even. Ties are those of the shortest decimal form of the double."""
    return F.bround(value, scale)


def bag_label(bag: Column) -> Column:
    return F.when(bag == 0, F.lit("Intro")).otherwise(F.concat(F.lit("Bag "), bag.cast("string")))


def page_span(start: Column, end: Column) -> Column:
    """1-based pages as text."""
    one, two = (start + 1).cast("string"), (F.coalesce(end, start) + 1).cast("string")
    return F.when(one == two, F.concat(F.lit("page "), one)).otherwise(F.concat(F.lit("pages "), one, F.lit("–"), two))


def count_delta(total_seen: Column, inventory_qty: Column, status: Column) -> Column:
    """(+n seen) or (−n seen) of a part whose count is off, else empty."""
    d = total_seen - inventory_qty
    sign = F.when(d < 0, F.concat(F.lit("−"), F.abs(d).cast("string"))).otherwise(F.concat(F.lit("+"), d.cast("string")))
    return F.when((status == "bad") & d.isNotNull(), F.concat(F.lit("("), sign, F.lit(" seen)"))).otherwise(F.lit(""))


def meta_line(set_name: Column, set_num: Column, n_parts: Column, num_pages: Column, reconciled: Column) -> Column:
    """The parts that are there, joined by dots."""
    some = lambda c: F.nullif(c, F.lit(""))
    return F.concat_ws(" · ", some(set_name), F.concat(F.lit("#"), some(set_num)), F.concat(n_parts.cast("string"), F.lit(" parts")), F.concat(num_pages.cast("string"), F.lit(" pages")), F.when(reconciled, "reconciled").otherwise("vision-only"))


def status(reconciled: Column, count_matches: Column) -> Column:
    return F.when(~reconciled, "vision").when(count_matches, "ok").otherwise("bad")


def html_escaped(text: Column) -> Column:
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text
