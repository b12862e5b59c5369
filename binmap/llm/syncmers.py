"""Closed-syncmer fingerprints of documents (native).

Over the words of a text, each window of K words is a k-mer and each run of S words inside it an inner
substring. The k-mer is a closed syncmer if the least hash of its inner substrings stands at its first or
last place. That depends on the k-mer alone, so equal passages give equal anchors wherever they stand.

The fingerprint is all anchors in order, each with its place. The likeness of two fingerprints is positional: anchors match
whose hashes are equal and whose offset is nearly that of a neighbouring match. A text of 1 to K - 1 words has one anchor, all its words.
A text without words (also null) has none; two such fingerprints have likeness 1, one such and another 0.
In a run of more than LONG characters without white space each character counts as a word.

Everything is done by DataFrame functions, in as many places as there are words. with_next() raises ValueError if a column of
its own is there already.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh

K, S = 5, 2
#: Characters of a word at most.
LONG = 40
#: Words by which the offsets of two neighbouring matches may differ.
DRIFT = 64
#: Bits of a place; a hash keeps the others when fingerprints are matched. Texts have fewer than 2**_PLACE words.
_PLACE = 27
#: Rows that one range of ids is meant to hold, and ranges at most.
RANGE_ROWS, MOST_RANGES = 2_000, 1 << 14


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, also where body uses it in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text, between ASCII white space, longer ones by character; those at its ends may be empty."""
    plain = F.trim(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\f\r", "     "))
    long = lambda w: F.length(w) > LONG
    cut = lambda w: F.when(long(w), F.split(w, "")).otherwise(F.array(w))
    return _let(F.split(plain, " "), lambda ws: F.when(F.exists(ws, long), F.flatten(F.transform(ws, cut))).otherwise(ws))


def anchors(text: Column) -> Column:
    """Closed syncmers of a text as array<struct<at: int, hash: bigint>>: the number of the k-mer's first word, and the k-mer's hash."""
    none = F.array().cast("array<struct<at:int,hash:bigint>>")

    def found(w: Column, h: Column) -> Column:
        def anchor(first: Column, i: Column) -> Column:
            inner = [first, *(F.get(h, i + j) for j in range(1, K - S + 1))]
            closed = F.least(inner[0], inner[-1]) <= F.least(*inner[1:-1])
            kmer = F.xxhash64(*inner[::S], *([] if (K - S) % S == 0 else [inner[-1]]))  # these cover all its words
            return F.when((i <= F.size(w) - K) & closed, F.struct(i.alias("at"), kmer.alias("hash")))

        return F.filter(F.transform(h, anchor), lambda x: x.isNotNull())

    short = lambda w: F.array(F.struct(F.lit(0).alias("at"), F.xxhash64(w).alias("hash")))
    inner = lambda w: F.transform(w, lambda x, i: F.xxhash64(x, *(F.get(w, i + j) for j in range(1, S))))
    long = lambda w: _let(inner(w), lambda h: found(w, h))
    hashed = F.transform(F.filter(words(text), lambda w: w != ""), lambda w: F.xxhash64(w))
    return _let(hashed, lambda w: F.when(F.size(w) >= K, long(w)).when(F.size(w) > 0, short(w)).otherwise(none))


def matches(a: Column, b: Column) -> Column:
    """Anchors of a and b with equal hashes that keep their distance, as array<bigint>: a's place << _PLACE | b's place.

    Both sides' anchors are sorted by hash and place as plain numbers; neighbours of equal hash and different sides are pairs. In the
    order of a's places a pair counts if a pair next to it has nearly the same offset (or if one side has one anchor only), so
    that an anchor found by chance, or in another order, matches nothing.
    """
    place = (1 << _PLACE) - 1
    at = lambda x: F.shiftright(x, 1).bitwiseAND(F.lit(place))
    coded = lambda x, side: F.transform(x, lambda y: F.shiftleft(y["hash"], _PLACE + 1).bitwiseOR(F.shiftleft(y["at"].cast("long").bitwiseAND(F.lit(place)), 1)).bitwiseOR(F.lit(side)))
    odd = lambda x: x.bitwiseAND(F.lit(1))
    of_a = lambda pair: F.shiftright(pair, _PLACE)
    offset = lambda pair: pair.bitwiseAND(F.lit(place)) - of_a(pair)

    def pairs(every: Column) -> Column:
        def pair(x: Column, i: Column) -> Column:
            y = F.get(every, i - 1)
            same = (F.shiftright(x, _PLACE + 1) == F.shiftright(y, _PLACE + 1)) & (odd(x) != odd(y))
            first, second = F.when(odd(x) == 0, at(x)).otherwise(at(y)), F.when(odd(x) == 0, at(y)).otherwise(at(x))
            return F.when(same, F.shiftleft(first, _PLACE).bitwiseOR(second))

        return F.sort_array(F.filter(F.transform(every, pair), lambda x: x.isNotNull()))

    def chained(found: Column) -> Column:
        near = lambda x, y: F.coalesce(F.abs(offset(x) - offset(y)) <= DRIFT, F.lit(False))
        lone = F.least(F.size(a), F.size(b)) == 1
        return F.filter(F.transform(found, lambda x, i: F.when(lone | near(x, F.get(found, i - 1)) | near(x, F.get(found, i + 1)), x)), lambda x: x.isNotNull())

    every = F.sort_array(F.concat(coded(a, 0), coded(b, 1)))
    return _let(_let(every, pairs), chained)


def likeness(a: Column, b: Column) -> Column:
    """Matched anchors of two fingerprints, of both sides, as a share of all: 2 s / (1 + s) for a Jaccard similarity s, given as s."""
    places = lambda pairs: F.size(F.array_distinct(F.transform(pairs, lambda x: F.shiftright(x, _PLACE)))) + F.size(F.array_distinct(F.transform(pairs, lambda x: x.bitwiseAND(F.lit((1 << _PLACE) - 1)))))
    every = F.size(a) + F.size(b)
    share = _let(matches(a, b), lambda pairs: places(pairs) / every)
    return F.when(every == 0, F.lit(1.0)).otherwise(_let(share, lambda x: x / (2 - x)))


def as_text(anchors: Column) -> Column:
    """All anchors as place:hash, in order."""
    return F.array_join(F.transform(anchors, lambda x: F.concat_ws(":", x["at"].cast("string"), F.lower(F.hex(x["hash"])))), " ")


def with_next(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """df with next_<column> from the next row by key (nulls first; equal keys by the columns), after the last row the first.

    Rows are dealt by ranges of the key whose bounds are keys that occur; a range's last row finds the
    first row of the next range in a copy, so no order spans a single task.
    """
    fresh(df.columns, *(f"next_{c}" for c in columns), "__k", "__coarse", "__r", "__to", "__range", "__copy")
    least = -(1 << 63)
    k = F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(least))
    rows, low = df.select(F.count(F.lit(1)), F.min(k)).first()
    ranges = max(1, min(MOST_RANGES, rows // RANGE_ROWS))
    steps = [i / ranges for i in range(1, ranges)]
    # At most MOST_RANGES numbers come to the driver.
    cuts = df.select(F.percentile_approx(k, F.lit(steps), F.lit(max(10_000, 4 * ranges)))).first()[0] if steps and rows else []
    bounds = sorted({*([] if low is None else [low]), *(cuts or [])})
    per = max(1, int(len(bounds) ** 0.5))
    literal = F.lit(bounds) if bounds else F.array().cast("array<bigint>")
    coarse = F.size(F.filter(F.lit(bounds[::per]) if bounds else literal, lambda b: b <= F.col("__k"))) - 1
    fine = F.size(F.filter(F.slice(literal, F.col("__coarse") * per + 1, per), lambda b: b <= F.col("__k"))) - 1
    last = len(bounds) - 1
    dealt = df.withColumn("__k", k).withColumn("__coarse", coarse).withColumn("__r", F.col("__coarse") * per + fine)
    opens = F.col("__k") == F.get(literal, F.col("__r"))  # a range's first rows, which also go behind the range before
    copies = F.when(opens, F.array(F.struct(F.col("__r").alias("r"), F.lit(False).alias("copy")), F.struct(F.when(F.col("__r") == 0, F.lit(last)).otherwise(F.col("__r") - 1).alias("r"), F.lit(True).alias("copy")))).otherwise(F.array(F.struct(F.col("__r").alias("r"), F.lit(False).alias("copy"))))
    dealt = dealt.withColumn("__to", F.explode(copies)).withColumn("__range", F.col("__to.r")).withColumn("__copy", F.col("__to.copy"))
    w = Window.partitionBy("__range").orderBy("__copy", "__k", *(F.col(f"`{c}`") for c in columns))
    out = dealt.select(*(F.col(f"`{c}`") for c in df.columns), "__copy", *(F.lead(F.col(f"`{c}`")).over(w).alias(f"next_{c}") for c in columns))
    return out.where(~F.col("__copy")).drop("__copy")
