"""Documents as pages, behind an injected renderer.

A renderer is a plain function that can be pickled: render(content, dpi, indices) yields (page_index, png, text) for the pages asked for (all
if indices is null), and count(content) gives their number or raises. Without a library for PDF here none comes with this package.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

#: Dots an inch of the pages that are looked at, of those that are only triaged, and of the detailed ones.
DPI, TRIAGE_DPI, DETAIL_DPI = 150, 110, 180

Render = Callable[[bytes, int, "list[int] | None"], Iterator[tuple[int, bytes, str]]]
RENDERED = "path string, page_index long, content binary, text string"


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files at a path; FileNotFoundError if there are none."""
    try:
        return spark.read.format("binaryFile").load(path).select("path", "content")
    except AnalysisException as e:
        raise FileNotFoundError(path) from e


def page_counts(docs: DataFrame, count: Callable[[bytes], int]) -> DataFrame:
    """(path, num_pages) of documents; null where they can't be opened."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in batch.column("content").to_pylist():
                try:
                    out.append(count(data))
                except Exception:  # a broken document has no pages
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(out, pa.int64())], ["path", "num_pages"])

    return docs.mapInArrow(run, "path string, num_pages long")


def valid(docs: DataFrame, count: Callable[[bytes], int]) -> DataFrame:
    """docs that open and have a page."""
    return docs.join(page_counts(docs, count).where("num_pages > 0").select("path"), "path", "left_semi")


def rendered(docs: DataFrame, render: Render, dpi: int = DPI, indices: list[int] | None = None) -> DataFrame:
    """(RENDERED) for the pages of documents, one at a time; indices that a document lacks are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                for index, png, text in render(data, dpi, indices):
                    yield pa.RecordBatch.from_pydict({"path": [path], "page_index": pa.array([index], pa.int64()), "content": pa.array([png], pa.binary()), "text": [text or ""]})

    return docs.select("path", "content").mapInArrow(run, RENDERED)


def rendered_where(docs: DataFrame, pages: DataFrame, render: Render, dpi: int = DETAIL_DPI) -> DataFrame:
    """(RENDERED) for the pages (path, page_index) asked for: a document is opened once for all of its pages."""
    from pyspark.sql import functions as F

    wanted = pages.groupBy("path").agg(F.sort_array(F.collect_set("page_index")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data, some in zip(*(batch.column(c).to_pylist() for c in ("path", "content", "wanted")), strict=True):
                for index, png, text in render(data, dpi, some):
                    yield pa.RecordBatch.from_pydict({"path": [path], "page_index": pa.array([index], pa.int64()), "content": pa.array([png], pa.binary()), "text": [text or ""]})

    return docs.join(wanted, "path").select("path", "content", "wanted").mapInArrow(run, RENDERED)
