"""The set number that a document's pages speak of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pages looked at from the beginning and the end; what a number is; characters around it, and what there speaks for it.
FIRST, LAST = 4, 2
NUMBER, AROUND, LENGTH, BONUS = r"(?U)\b\d{4,7}\b", 30, 8, 3
CONTEXT = ("age", "ages", "+", "pcs", "pieces")


def scored_numbers(text: Column) -> Column:
    """array<struct<number, score>> of a text's numbers in order: shorter ones and those whose surroundings have a CONTEXT word score more."""
    numbers = F.regexp_extract_all(text, F.lit(NUMBER), 0)
    between = F.split(text, NUMBER)
    # Where each number begins: all pieces of text up to it, and the numbers before it.
    before = lambda i: F.aggregate(F.slice(between, F.lit(1), i + 1), F.lit(0), lambda s, x: s + F.length(x)) + F.aggregate(F.slice(numbers, F.lit(1), i), F.lit(0), lambda s, x: s + F.length(x))

    def scored(number: Column, i: Column) -> Column:
        start = F.greatest(before(i) - AROUND, F.lit(0))
        near = F.lower(F.substring(text, start + 1, before(i) + F.length(number) + AROUND - start))
        speaks = F.exists(F.array(*map(F.lit, CONTEXT)), lambda w: F.contains(near, w))
        return F.struct(number.alias("number"), (F.greatest(F.lit(0), LENGTH - F.length(number)) + F.when(speaks, BONUS).otherwise(0)).alias("score"))

    return F.transform(numbers, scored)


def set_number(pages: DataFrame) -> DataFrame:
    """(scan_id, set_num): the number of the greatest score on the first and last pages, of equal ones the first; null if there is none.

    pages (scan_id, page_index, text).
    """
    count = pages.groupBy("scan_id").agg((F.max("page_index") + 1).alias("n"))
    # Only pages with a number, and of those only the ones looked at.
    some = pages.where(F.col("text").rlike(r"\d{4}")).join(count, "scan_id").where((F.col("page_index") < FIRST) | (F.col("page_index") >= F.col("n") - LAST))
    each = some.select("scan_id", "page_index", F.posexplode(scored_numbers(F.col("text"))).alias("at", "s"))
    best = each.groupBy("scan_id").agg(F.max_by("s.number", F.struct("s.score", -F.col("page_index"), -F.col("at"))).alias("set_num"))
    return count.select("scan_id").join(best, "scan_id", "left")
