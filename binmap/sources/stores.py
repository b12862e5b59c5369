"""Services behind injected transports: paged REST inventories as a data source, recognisers by content, booklets of a set's page.

A transport is a plain function that can be pickled; live ones need the network and are the caller's. Tests pass fakes.
"""

from __future__ import annotations

import json
import os
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from binmap.sources import files

#: Tries of a call, seconds before the second one (doubled each time), and least seconds between calls of a task.
TRIES, BACKOFF, INTERVAL = 3, 0.5, 0.5
#: Rows of a page of a REST inventory, and pages at most, against a next link that goes round.
PAGE_ROWS, MOST_PAGES = 1000, 1000


class SourceError(RuntimeError):
    """A service that can't be reached, or whose answer makes no sense."""


def write_bytes(path: str, content: bytes) -> None:
    """A file that appears whole or not at all."""
    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        os.makedirs(os.path.dirname(parts.path), exist_ok=True)
        part = f"{parts.path}.{os.getpid()}.{time.monotonic_ns()}.tmp"
        with open(part, "wb") as out:
            out.write(content)
        os.replace(part, parts.path)
        return
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    store.create_dir(inner.rpartition("/")[0], recursive=True)
    with store.open_output_stream(inner) as out:
        out.write(content)


def http_get(url: str, headers: dict[str, str]) -> tuple[int, bytes]:
    """Status and body of a GET."""
    with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=30) as answer:
        return answer.status, answer.read()


def set_number(text: str) -> str:
    """The trimmed number, with -1 behind it if it has no dash."""
    text = str(text).strip()
    return text if "-" in text else f"{text}-1"


@dataclass(frozen=True)
class Catalogue:
    """A REST catalogue of sets. get(url, headers) gives status and body."""

    base: str
    key: str | None = None
    get: Callable[[str, dict[str, str]], tuple[int, bytes]] = http_get

    def _json(self, url: str, set_num: str) -> dict:
        if not self.key:
            raise SourceError("the catalogue needs a key")
        try:
            status, body = self.get(url, {"Authorization": f"key {self.key}", "Accept": "application/json"})
        except Exception as e:
            raise SourceError(f"the request failed: {e}") from e
        if status == 404:
            raise SourceError(f"set {set_num} was not found")
        if not 200 <= status < 300:
            raise SourceError(f"the request failed with status {status}")
        try:
            return json.loads(body)
        except ValueError as e:
            raise SourceError(f"the answer is not JSON: {e}") from e

    def set_info(self, set_num: str) -> dict:
        return self._json(f"{self.base.rstrip('/')}/lego/sets/{set_number(set_num)}/", set_num)

    def pages(self, set_num: str, page_size: int = PAGE_ROWS, max_pages: int = MOST_PAGES) -> Iterator[list[dict]]:
        """The rows of a set's inventory page by page, along the next links."""
        url, n = f"{self.base.rstrip('/')}/lego/sets/{set_number(set_num)}/parts/?page_size={page_size}", 0
        while url:
            if (n := n + 1) > max_pages:
                raise SourceError(f"the inventory of {set_num} has more than {max_pages} pages: its next links may go round")
            answer = self._json(url, set_num)
            yield answer.get("results", [])
            url = answer.get("next")


class _SetPartition(InputPartition):
    def __init__(self, set_num: str):
        super().__init__(set_num)


class _Reader(DataSourceReader):
    def __init__(self, catalogue: Catalogue, options: dict):
        self.catalogue, self.options = catalogue, options

    def partitions(self) -> list[InputPartition]:
        return [_SetPartition(s.strip()) for s in self.options["sets"].split(",") if s.strip()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        size, most = (int(self.options.get(k, v)) for k, v in (("page_size", PAGE_ROWS), ("max_pages", MOST_PAGES)))
        seq = 0
        for rows in self.catalogue.pages(partition.value, size, most):
            for row in rows:
                yield partition.value, seq, json.dumps(row)
                seq += 1


def catalogue_source(catalogue: Catalogue, name: str = "set_inventory") -> type[DataSource]:
    """A batch data source of raw inventory rows (set_num, seq, row): a partition for each of the option sets, comma-separated."""

    class SetInventory(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "set_num string, seq long, row string"

        def reader(self, schema) -> DataSourceReader:
            return _Reader(catalogue, {k.lower(): v for k, v in self.options.items()})

    return SetInventory


def set_inventory(spark: SparkSession, catalogue: Catalogue, sets: list[str], page_size: int = PAGE_ROWS, max_pages: int = MOST_PAGES) -> DataFrame:
    """The inventories of sets: set_num and the inventory's columns, nested rows made flat."""
    source = catalogue_source(catalogue)
    spark.dataSource.register(source)
    raw = spark.read.format(source.name()).option("sets", ",".join(sets)).option("page_size", page_size).option("max_pages", max_pages).load()
    row = F.from_json("row", "part struct<part_num: string, name: string, part_img_url: string>, color struct<id: int, name: string>, quantity string, element_id string")
    got = raw.select("set_num", F.col("seq").alias("inv_seq"), row.alias("r"))
    return got.select("set_num", "inv_seq", F.coalesce("r.part.part_num", F.lit("")).alias("part_num"), F.coalesce("r.part.name", F.lit("")).alias("name"), F.col("r.color.id").alias("color_id"), F.col("r.color.name").alias("color_name"), files._whole(F.col("r.quantity")).alias("quantity"), "r.element_id", F.col("r.part.part_img_url").alias("image_url"))


def fetch_inventory(spark: SparkSession, catalogue: Catalogue, set_num: str) -> tuple[DataFrame | None, str | None]:
    """The inventory and name of a set; nothing if the catalogue has no key or fails, so that a scan goes on without."""
    try:
        info = catalogue.set_info(set_num)
        rows = set_inventory(spark, catalogue, [set_num])
        rows.limit(1).count()  # fails now rather than later
    except Exception as e:
        if isinstance(e, SourceError) or "SourceError" in str(e):
            return None, None
        raise
    return rows, info.get("name")


class Caller:
    """Calls a transport at most every interval seconds, and again after a failure; the last failure raises SourceError."""

    def __init__(self, transport: Callable, tries: int = TRIES, backoff: float = BACKOFF, interval: float = INTERVAL, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic):
        self.transport, self.tries, self.backoff, self.interval, self.sleep, self.clock = transport, tries, backoff, interval, sleep, clock
        self.last: float | None = None

    def __call__(self, *args):
        if self.last is not None and (wait := self.interval - (self.clock() - self.last)) > 0:
            self.sleep(wait)
        for turn in range(self.tries):
            try:
                out = self.transport(*args)
                break
            except Exception as e:
                if turn + 1 == self.tries:
                    raise SourceError(f"failed after {self.tries} attempts: {e}") from e
                self.sleep(self.backoff * 2**turn)
        self.last = self.clock()
        return out


def answered(requests: DataFrame, transport: Callable[[bytes], dict], cache: DataFrame | None = None, content: str = "content", namespace: str = "recogniser", write_to: str | None = None, make_caller: Callable[[Callable], Caller] = Caller) -> DataFrame:
    """requests with payload, the service's answer to each one's content as JSON, and error, why there is none.

    Contents that the cache (namespace, sha, value, at) has aren't asked for, each other content is asked for once. Answers are appended
    to the cache table at write_to (which also serves without cache being read); failures never are. Each task keeps the interval
    between calls; repartition before to bound how many ask at a time.
    """
    hashed = requests.withColumn("sha", files.content_hash(F.col(content)))
    known = files.cache_get(cache, namespace) if cache is not None else requests.sparkSession.createDataFrame([], "sha string, value string")
    missing = hashed.select("sha", F.col(content).alias("content")).join(known.select("sha"), "sha", "left_anti").dropDuplicates(["sha"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = make_caller(transport)
        for batch in batches:
            out = []
            for data in batch.column("content").to_pylist():
                try:
                    out.append((json.dumps(call(data), ensure_ascii=False), None))
                except SourceError as e:
                    out.append((None, str(e)))
            yield pa.RecordBatch.from_arrays([batch.column("sha"), pa.array([v for v, _ in out], pa.string()), pa.array([e for _, e in out], pa.string())], ["sha", "value", "error"])

    fresh = missing.mapInArrow(run, "sha string, value string, error string")
    if write_to is not None:
        # Written with the errors first, so that each content is asked for once whatever reads the result.
        own = f"{write_to.rstrip('/')}.answers-{time.time_ns()}"
        fresh.write.parquet(own)
        fresh = requests.sparkSession.read.parquet(own)
        files.cache_set(fresh.where("value is not null"), write_to, namespace)
    every = known.withColumn("error", F.lit(None).cast("string")).unionByName(fresh)
    return hashed.join(every, "sha", "left").withColumnRenamed("value", "payload").drop("sha")


def vision_extracts(pages: DataFrame, model: Callable[[bytes], dict], namespace: str, cache: DataFrame | None = None, write_to: str | None = None, use_cache: bool = True) -> DataFrame:
    """pages (scan_id, page_index, content) as page extracts, read by a model behind a transport.

    An answer that isn't the schema's object isn't tried again: the model raises SourceError, which fails the page at once. Without
    use_cache answers are still written to the cache.
    """
    asked = answered(pages, model, cache if use_cache else None, "content", namespace, write_to, make_caller=_once)
    got = files.extract_of_json(F.col("payload"))
    return asked.select("scan_id", "page_index", "error", got.alias("e")).select("scan_id", "page_index", "error", "e.*")


def _once(transport: Callable) -> Caller:
    """A caller that tries again after failures of the transport, but not after an answer that breaks the schema."""

    class Checked(Caller):
        def __call__(self, *args):
            broken: list[SourceError] = []

            def tried(*inner):
                try:
                    return transport(*inner)
                except SourceError as e:
                    broken.append(e)
                    return None

            self.transport = tried
            out = super().__call__(*args)
            if broken:
                raise broken[0]
            return out

    return Checked(transport, interval=0)


def reference_images(inventory: DataFrame, get: Callable[[str], bytes]) -> DataFrame:
    """(part_num, inv_seq, content): for each part number the image of the first line whose fetch succeeds; others are left out."""
    wanted = inventory.where("part_num <> '' and image_url is not null and image_url <> ''").select("part_num", "inv_seq", "image_url")
    urls = wanted.select("image_url").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for url in batch.column("image_url").to_pylist():
                try:
                    out.append(get(url) or None)
                except Exception:  # an image that can't be had is as good as none
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("image_url"), pa.array(out, pa.binary())], ["image_url", "content"])

    got = urls.mapInArrow(run, "image_url string, content binary").where("content is not null")
    return wanted.join(got, "image_url").groupBy("part_num").agg(F.min_by(F.struct("inv_seq", "content"), "inv_seq").alias("f")).select("part_num", "f.inv_seq", "f.content")


@dataclass(frozen=True)
class Booklets:
    """The booklets of a set's page: get_text(url) and get_bytes(url) are injected, valid(path) says whether a file is whole."""

    base: str
    get_text: Callable[[str], str]
    get_bytes: Callable[[str], bytes]
    valid: Callable[[str], bool] = lambda path: os.path.getsize(path) > 0

    def urls(self, spark: SparkSession, set_num: str, locale: str = "en-gb") -> list[str]:
        host = (urlparse(self.base).hostname or "").removeprefix("www.")
        address = spark.range(1).select(files.page_url(F.lit(set_num), self.base, locale).alias("u")).first().u
        page = spark.createDataFrame([(self.get_text(address),)], "html string")
        return list(page.select(files.document_urls(F.col("html"), host).alias("u")).first().u)

    def fetch(self, spark: SparkSession, set_num: str, folder: str, locale: str = "en-gb", overwrite: bool = False) -> list[str]:
        """Paths of all booklets, fetched unless they are there and whole; SourceError if the page lists none."""
        out = []
        for url in self.urls(spark, set_num, locale):
            path = os.path.join(folder, url.rsplit("/", 1)[-1])
            if overwrite or not (os.path.exists(path) and self.valid(path)):
                write_bytes(path, self.get_bytes(url))
            out.append(path)
        if not out:
            raise SourceError(f"no booklets were found for set {set_num}")
        return out

    def booklet(self, spark: SparkSession, set_num: str, folder: str, number: int = 1) -> str:
        """The booklet of that number, from 1 on."""
        found = self.fetch(spark, set_num, folder)
        if not 1 <= number <= len(found):
            raise SourceError(f"booklet {number} of {len(found)} was asked for")
        return found[number - 1]
