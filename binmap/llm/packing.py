"""Conflict-constrained best-fit packing.

Pieces are dealt by hash to groups of bounded size, and each group is packed by best-fit decreasing. A bin
carries bitmaps of the sources and duplicate clusters in it; a piece may not join a bin that holds its source or its
cluster. Bins stand in the order of their residual room; the search begins at the smallest residual that is
large enough and goes on to the successors until it meets a compatible bin, which is the tightest one. If there is none, a bin is opened.

A document larger than a bin is cut into full bins and a rest; full pieces have bins of their own. No row
is dropped: a null or empty text has size 1 (its end mark). Null sources and null clusters conflict with nothing.
Repeated rows are packed one by one. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

CAPACITY = 2048
#: Pieces that a group is meant to hold.
GROUP = 1_000

COLUMNS = ("doc_id", "piece", "size", "source", "cluster", "bin", "offset")
SCHEMA = ", ".join(f"{c} {'string' if c == 'source' else 'long'}" for c in COLUMNS)


def size_of(text: Column) -> Column:
    """Words of a text, between white space (\\s), plus one for its end."""
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")) + 1).cast("long")


def _bits(keys: list) -> list[int]:
    """A bit for each key that occurs more than once; others can't conflict."""
    often = [k for k, n in Counter(keys).items() if k is not None and n > 1]
    number = {k: 1 << i for i, k in enumerate(often)}
    return [number.get(k, 0) for k in keys]


def pack(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[tuple[int, int]]:
    """Bin and offset of each piece, in the order given. sources and clusters: a bitmap of one bit, or 0."""
    rooms: list[tuple[int, int]] = []  # (residual, bin), in order
    held: list[list[int]] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        at = bisect.bisect_left(rooms, (size, -1))
        while at < len(rooms) and (held[rooms[at][1]][0] & source or held[rooms[at][1]][1] & cluster):
            at += 1
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b = capacity, len(held)
            held.append([0, 0])
        held[b][0] |= source
        held[b][1] |= cluster
        out.append((b, capacity - room))
        if room > size:
            bisect.insort(rooms, (room - size, b))
    return out


def best_fit(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of docs (doc_id, source, cluster, size) with their bin and the offset in it.

    cluster: a number that the copies of a document share. The columns are those of SCHEMA; others are left out.
    """
    rest = F.col("size") % capacity
    pieces = F.concat(F.transform(F.sequence(F.lit(0), F.floor(F.col("size") / capacity) - 1), lambda i: F.struct(i.cast("long").alias("piece"), F.lit(capacity).cast("long").alias("size"))), F.array(F.struct(F.floor(F.col("size") / capacity).alias("piece"), rest.alias("size"))))
    simple = F.array(F.struct(F.lit(0).cast("long").alias("piece"), F.col("size")))
    cut = docs.withColumn("p", F.explode(F.when(F.col("size") <= capacity, simple).otherwise(F.filter(pieces, lambda x: x["size"] > 0))))
    cut = cut.select("doc_id", "source", "cluster", F.col("p.piece").alias("piece"), F.col("p.size").alias("size"))
    # Sizes are found once. Equal rows are counted and numbered, so that many don't meet in one group, and however the
    # input is split the groups are the same.
    cut = written(cut.groupBy(*cut.columns).agg(F.count(F.lit(1)).alias("n")), "pieces")
    rows = cut.agg(F.sum("n")).first()[0] or 0
    groups = max(1, -(-int(rows) // GROUP))
    cut = cut.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("n")
    cut = cut.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "cluster", "source", "size", "copy"), F.lit(groups))).drop("copy")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["doc_id", "source", "cluster", "piece", "size"]).to_pylist(), key=lambda r: (-r["size"], r["doc_id"] is not None, r["doc_id"] or 0, r["piece"], r["cluster"] or 0, r["source"] or ""))
        got = pack([r["size"] for r in rows], _bits([r["source"] for r in rows]), _bits([r["cluster"] for r in rows]), capacity)
        first = key[0].as_py() << 24
        out = [{**r, "bin": first + b, "offset": o} for r, (b, o) in zip(rows, got, strict=True)]
        return pa.Table.from_pylist(out, pa.schema([(c, pa.string() if c == "source" else pa.int64()) for c in COLUMNS]))

    return cut.groupBy("group").applyInArrow(run, SCHEMA)
