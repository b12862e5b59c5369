"""Structured Streaming forms: bags of pages that arrive in order, contents that are new, windowed counts, answers as they come.

The reference data has no streams; these give the batch operators' results for input that arrives piece by piece.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from binmap.sources import files

BAGS = "scan_id long, seq long, bag_marker long, assigned long, status string, bag long"


def stream_bags(pages: DataFrame, timeout: str | None = None) -> DataFrame:
    """(BAGS) for every page of a stream (scan_id, seq, bag_marker, candidate): its number, read or filled in, what became of it, and the page's bag.

    A scan's pages arrive in ascending seq, over any number of batches; in a batch their order doesn't matter. The state of a scan is
    three numbers: the last number filled in or read, the last kept marker, and the seq up to which pages were seen. Pages from before that
    come too late and are left out. timeout: after so much processing time without pages a scan's state goes.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known, kept, seen = state.get if state.exists else (0, 0, -(1 << 62))
        rows = []
        every = pd.concat(list(batches)).sort_values("seq", kind="stable")
        for seq, marker, candidate in zip(every["seq"], every["bag_marker"], every["candidate"], strict=True):
            if seq <= seen:
                continue
            seen = int(seq)
            marker = None if pd.isna(marker) else int(marker)
            assigned = marker if marker is not None else known + 1 if candidate else None
            known = known if assigned is None else max(known, assigned)
            status = None
            if assigned is not None:
                status = "kept" if assigned > kept else "repeated" if assigned == kept else "suspect"
                kept = max(kept, assigned)
            rows.append((key[0], seen, marker, assigned, status, kept))
        state.update((known, kept, seen))
        if timeout:
            state.setTimeoutDuration(timeout)
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in BAGS.split(", ")])
        yield out.astype({"bag_marker": "Int64", "assigned": "Int64"})

    limit = GroupStateTimeout.ProcessingTimeTimeout if timeout else GroupStateTimeout.NoTimeout
    return pages.select("scan_id", "seq", "bag_marker", "candidate").groupBy("scan_id").applyInPandasWithState(step, BAGS, "known long, kept long, seen long", "append", limit)


def new_contents(requests: DataFrame, content: str = "content", at: str = "at", late: str = "1 hour") -> DataFrame:
    """requests of a stream, each content once (with sha): a cache whose entries last as long as late ones are waited for."""
    return requests.withColumn("sha", files.content_hash(F.col(content))).withWatermark(at, late).dropDuplicatesWithinWatermark(["sha"])


def window_counts(callouts: DataFrame, at: str = "at", size: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """(scan_id, start, end, n, quantity) of callouts in tumbling windows of event time; a window is final when late ones aren't waited for any more."""
    w = F.window(at, size)
    counted = callouts.withWatermark(at, late).groupBy("scan_id", w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity"))
    return counted.select("scan_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "quantity")


def answer_each(requests: DataFrame, answer: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, **trigger):
    """A running query that asks for each batch's answers and appends them to path once: a batch that is run again replaces its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        answer(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
