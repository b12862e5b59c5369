"""Weighted rendezvous sharding of stable record keys (native).

Each shard draws one uniform number per key from a hash of (key, shard) and scores -weight / ln(u); the
key goes to the shard with the highest score. A new shard only takes the keys on which it wins.

Places within a shard are numbered without gaps. Equal rows are counted first, so a hot key costs one
row; the distinct rows are numbered within hashed slices of each shard, whose sizes (a bounded table)
give each slice its first number.

A null key is a key of its own; equal keys always share a shard. Repeated rows each get a slot.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh, inner_name, written

#: Distinct rows that a slice of a shard is meant to hold, and slices per shard at most.
SLICE_ROWS, MOST_SLICES = 20_000, 1 << 14


def score(key: Column, shard: int, weight: float) -> Column:
    """The shard's bid for the key."""
    if not (weight > 0 and math.isfinite(weight)):
        raise ValueError("weights must be positive and finite")
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11)
    return F.lit(-float(weight)) / F.log((bits.cast("double") + 0.5) * F.lit(2.0**-53))


def assign(key: Column, weights: list[float], first: int = 0) -> Column:
    """struct<score, shard>: the best of shards first, first + 1, ... with these weights; of equal scores the lowest shard wins."""
    bids = [F.struct(score(key, first + i, w).alias("score"), F.lit(-first - i).alias("minus")) for i, w in enumerate(weights)]
    best = F.greatest(*bids) if len(bids) > 1 else bids[0]
    return F.struct(best["score"].alias("score"), (-best["minus"]).alias("shard"))


def with_shards(df: DataFrame, key: str, weights: list[float], into: str = "shard", grown: tuple[str, float] | None = None) -> DataFrame:
    """df with each row's shard, and (grown: column, weight) its shard were there one more of that weight."""
    fresh(df.columns, into, *([grown[0]] if grown else []))
    best = inner_name(df.columns, "__best")
    k = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("\0null"))
    out = df.withColumn(best, assign(k, weights))
    if grown:
        out = out.withColumn(grown[0], F.when(score(k, len(weights), grown[1]) > F.col(f"{best}.score"), F.lit(len(weights))).otherwise(F.col(f"{best}.shard")))
    return out.withColumn(into, F.col(f"{best}.shard")).drop(best)


def with_slots(df: DataFrame, shard: str, into: str = "slot") -> DataFrame:
    """df with numbers 0, 1, ... for the rows of each shard, by a hash of the row and then by the row. A column into raises ValueError."""
    fresh(df.columns, into)
    names = [f"c{i}" for i in range(len(df.columns))]
    plain = df.toDF(*names)
    of_shard = names[[c.lower() for c in df.columns].index(shard.lower())]
    # Read twice below, so written once: narrow rows, each distinct one with its count.
    counted = written(plain.groupBy(*names).agg(F.count(F.lit(1)).alias("n")), "shard-rows")
    rows = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    slices = max(64, min(MOST_SLICES, -(-rows // SLICE_ROWS)))
    counted = counted.withColumn("slice", F.pmod(F.xxhash64(*names), F.lit(slices)))
    sizes = counted.groupBy(of_shard, "slice").agg(F.sum("n").alias("size"))
    before = Window.partitionBy(of_shard).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col(of_shard).alias("shard"), F.col("slice").alias("of"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(of_shard, "slice").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    numbered = counted.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    # One row per shard and slice: at most shards * MOST_SLICES short rows.
    joined = numbered.join(F.broadcast(offsets), F.col(of_shard).eqNullSafe(F.col("shard")) & (F.col("slice") == F.col("of")))
    first = F.col("offset") + F.col("before")
    slots = F.when(F.col("n") == 1, F.array(first)).otherwise(F.sequence(first, first + F.col("n") - 1))
    return joined.select(*names, F.explode(slots).alias("slot")).toDF(*df.columns, into)
