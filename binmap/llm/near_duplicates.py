"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

1. Every document's distinct shingles are counted over the whole corpus, exactly: dealt by ranges of their hashes, of which
   there are more the larger the corpus. Those of several documents stay in sorted files that workers map into memory; any
   other has document frequency 1. A shingle's weight is its count in the text times
   LEAST_WEIGHT + (1 - LEAST_WEIGHT) * log((N + 1) / df) / log(N + 1): common shingles count less, but never so little that
   the few edits of a large group of copies outweigh all they share.
2. Each distinct text is sampled BANDS * ROWS times; texts that agree in a whole band share a bucket.
3. In each bucket every text is compared with the bucket's hub (a star, not all pairs), by the exact weighted Jaccard
   similarity of their shingles. Links make components. Buckets in several components get STARS stars around other
   members. The texts of buckets that still lie in different components meet by their rarest shingles: those left when
   the commonest are put aside, as long as these alone can't reach the threshold. Two texts at the threshold share one of
   these, so no link between texts that share a bucket is lost, and few texts meet that share a common passage only.
4. Classes are the components; the class id is its least doc_id.

A text is a node by a 60-bit number of its digest, whatever doc_ids it occurs under, and exact copies are one text throughout.
Null texts count as empty; texts without words are a class with their exact copies only. Texts of fewer than SIZE words are
one shingle. A row with a null doc_id takes part by its text, but never names a class unless all members are null. Two
texts under one doc_id are two. Repeated rows stay, each with its class. Other columns stay as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import inner_name, map_array, new_folder, write_file, written
from .words import buffers, hashes, mix, pieces, shingles, spans

SIZE, THRESHOLD = 5, 0.8
BANDS, ROWS = 12, 4
#: Weight of a shingle that every document has; one that no other has weighs 1.
LEAST_WEIGHT = 0.75
#: Bytes of text for each range of hashes; ranges are a power of two, at most 2**MOST_RANGE_BITS.
RANGE_BYTES, MOST_RANGE_BITS = 8 << 20, 16
#: Bits of a shingle's hash, and shingles that a task merges at once.
_HASH_BITS, _MERGED = 48, 1 << 20
#: Bits for each text with candidates in the filter that picks their rows, and bits of a filter at most (2**29: 64 MB); beyond, rows are joined.
FILTER_RATIO, MOST_FILTER_BITS = 64, 29
_TABLE = 12
#: Stars around other members, before all pairs are compared that still lie apart.
STARS = 2


def sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct 48-bit shingle hashes of each text in order, how often each is there, and where each text's begin."""
    data, offsets = buffers(texts)
    starts, ends, first = spans(data, offsets)
    h, doc, _ = shingles(hashes(data, starts, ends), first, SIZE)
    key = np.sort((doc.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16)))
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    counts = np.diff(np.append(new, len(key)))
    key = key[new]
    edges = np.searchsorted(key, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(48))
    return key & np.uint64((1 << 48) - 1), counts, edges


_MAPPED: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}


class Frequencies:
    """Document frequencies of shingles: folder has a file for each range of hashes that holds shared shingles."""

    def __init__(self, folder: str, bits: int, ranges: set[int], documents: int):
        self.folder, self.bits, self.ranges, self.documents = folder, bits, ranges, documents

    def _range(self, r: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted shingles of a range, and in how many documents they are."""
        if (self.folder, r) not in _MAPPED:
            for old in [k for k in _MAPPED if k[0] != self.folder]:
                del _MAPPED[old]
            data = map_array(f"{self.folder}/{r}", np.uint8)
            n = len(data) // 12
            _MAPPED[self.folder, r] = data[: 8 * n].view(np.uint64), data[8 * n :].view(np.uint32)
        return _MAPPED[self.folder, r]

    def of(self, h: np.ndarray) -> np.ndarray:
        order = np.argsort(h)
        h = h[order]
        edges = _range_edges(h, self.bits)
        found = np.ones(len(h), np.int64)
        for r in np.flatnonzero(np.diff(edges)).tolist():
            if r in self.ranges:
                keys, counts = self._range(r)
                part = h[edges[r] : edges[r + 1]]
                at = np.minimum(np.searchsorted(keys, part), len(keys) - 1)
                found[edges[r] : edges[r + 1]] = np.where(keys[at] == part, counts[at], 1)
        out = np.empty(len(h), np.int64)
        out[order] = found
        return out


def _range_edges(h: np.ndarray, bits: int) -> np.ndarray:
    """Where each of the 2**bits ranges begins in sorted hashes; one more ends the last."""
    return np.searchsorted(h, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(_HASH_BITS - bits))


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed counts."""
    if not sum(map(len, keys)):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    every, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(every)
    every, n = every[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    return every[new], np.add.reduceat(n, new)


def document_frequencies(docs: DataFrame) -> Frequencies:
    """In how many rows each shingle of the column text is."""
    spark = docs.sparkSession
    texts = docs.select(F.col("text").cast("string").alias("text"))
    documents, size = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    bits = min(MOST_RANGE_BITS, max(0, int(size) // RANGE_BYTES).bit_length())
    folder = new_folder(spark, "near-frequencies")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def dealt() -> pa.RecordBatch:
            every, n = _merged(keys, counts)
            keys.clear()
            counts.clear()
            edges = _range_edges(every, bits)
            used = np.flatnonzero(np.diff(edges))
            parts = [slice(edges[r], edges[r + 1]) for r in used]
            gaps = [_packed(np.diff(every[x].astype(np.int64), prepend=0)) for x in parts]
            return pa.RecordBatch.from_pydict({"range": pa.array(used, pa.int32()), "gaps": pa.array(gaps, pa.binary()), "counts": pa.array([_packed(n[x]) for x in parts], pa.binary())})

        for batch in batches:
            column = batch.column("text")
            for a, b in pieces(column):
                own, n = np.unique(sets(column.slice(a, b - a))[0], return_counts=True)
                keys.append(own)
                counts.append(n)
                if sum(map(len, keys)) >= _MERGED:
                    yield dealt()
        yield dealt()

    def add(key: tuple, table: pa.Table) -> pa.Table:
        r = key[0].as_py()
        every, n = _merged([np.cumsum(_unpacked(x.as_py())).astype(np.uint64) for x in table["gaps"]], [_unpacked(x.as_py()) for x in table["counts"]])
        shared = n > 1
        if shared.any():
            write_file(f"{folder}/{r}", [every[shared].tobytes(), n[shared].astype(np.uint32).tobytes()])
        return pa.table({"range": pa.array([r], pa.int32()), "shared": pa.array([int(shared.sum())], pa.int64())})

    parts = texts.mapInArrow(count, "range int, gaps binary, counts binary")
    held = parts.groupBy("range").applyInArrow(add, "range int, shared long").where("shared > 0").collect()  # a row a range
    return Frequencies(folder, bits, {r.range for r in held}, documents)


def _packed(counts: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(1).compress(counts.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.int64).ravel()


def weights(h: np.ndarray, counts: np.ndarray, table: Frequencies) -> np.ndarray:
    """Weights of shingles."""
    scale = np.log(table.documents + 1.0) or 1.0
    rare = np.log((table.documents + 1) / table.of(h)) / scale
    return (counts * (LEAST_WEIGHT + (1 - LEAST_WEIGHT) * rare).clip(LEAST_WEIGHT, 1.0)).astype(np.float32)


class Sampler:
    """Consistent samples: Gamma(2, 1) variates r and c and a uniform variate b come from a shingle's hash, by small tables."""

    def __init__(self, samples: int = BANDS * ROWS, seed: int = 20240607):
        rng = np.random.default_rng(seed)
        size = (samples, 1 << _TABLE)
        self.r = [rng.exponential(size=size).astype(np.float32) + np.float32(1e-7) for _ in range(2)]
        self.c = [rng.exponential(size=size).astype(np.float32) + np.float32(1e-7) for _ in range(2)]
        self.b = rng.random(size=size).astype(np.float32)

    def samples(self, h: np.ndarray, w: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """For each text with shingles, hashes of its (shingle, quantised weight) samples."""
        counts = np.diff(edges)
        rows = np.flatnonzero(counts)
        out = np.empty((len(rows), len(self.b)), np.uint64)
        if not len(rows):
            return out
        first, of = edges[:-1][rows], np.repeat(np.arange(len(rows)), counts[rows])
        mask = np.uint64((1 << _TABLE) - 1)
        i = [((h >> np.uint64(s * _TABLE)) & mask).astype(np.int64) for s in range(4)]
        j = (i[0] ^ (5 * i[2] + i[3])) & int(mask)
        log_w = np.log(w)
        for k in range(out.shape[1]):
            r = self.r[0][k][i[0]] + self.r[1][k][i[1]]
            c = self.c[0][k][i[2]] + self.c[1][k][i[3]]
            b = self.b[k][j]
            t = np.floor(log_w / r + b)
            a = np.log(c) - r * (t - b + 1)
            least = np.minimum.reduceat(a, first)
            at = np.flatnonzero(a == least[of])[::-1]
            pick = np.empty(len(rows), np.int64)
            pick[of[at]] = at  # of ties the first, which has the least hash
            with np.errstate(over="ignore"):
                out[:, k] = mix(h[pick] + (t[pick].astype(np.int64).astype(np.uint64) << np.uint64(48)))
        return out


def _signed(docs: DataFrame, table, bands: int, rows: int) -> DataFrame:
    """docs (doc, id, text) with the text's total weight and its band keys, without the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(bands * rows)
        for batch in batches:
            texts = batch.column("text")
            for a, b in pieces(texts):
                h, counts, edges = sets(texts.slice(a, b - a))
                w = weights(h, counts, table)
                got = sampler.samples(h, w, edges)
                key = np.zeros((len(got), bands), np.uint64)
                with np.errstate(over="ignore"):
                    for i in range(bands):
                        x = np.full(len(got), i, np.uint64)
                        for row in range(rows):
                            x = mix(x * np.uint64(0x9E3779B97F4A7C15) + got[:, i * rows + row])
                        key[:, i] = x
                full = np.flatnonzero(np.diff(edges))
                ends = np.zeros(b - a + 1, np.int32)
                ends[full + 1] = bands
                total = np.zeros(b - a)
                total[full] = np.add.reduceat(w.astype(np.float64), edges[:-1][full]) if len(full) else []
                keys = pa.ListArray.from_arrays(pa.array(np.cumsum(ends).astype(np.int32)), pa.array(key.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc").slice(a, b - a), batch.column("id").slice(a, b - a), pa.array(total), keys], ["doc", "id", "weight", "bands"])

    return docs.mapInArrow(run, "doc long, id long, weight double, bands array<long>")


def _filter_of(ids: DataFrame, size: int) -> bytes:
    """A bitmap of 2**size bits, with those of the hashes of ids (id, doc) set."""
    place = F.pmod(F.xxhash64("id", "doc"), F.lit(1 << size)) + 1
    blocks = ids.select(place.alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias("n")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits"))
    out = bytearray((1 << size) // 8)
    for r in blocks.collect():  # 4 KB a block, 2**MOST_FILTER_BITS bits in all at most
        out[(r.n - 1) * 4096 : (r.n - 1) * 4096 + len(r.bits)] = r.bits
    return bytes(out)


def _vectors(docs: DataFrame, ids: DataFrame, table) -> DataFrame:
    """Weighted shingles of the texts at the rows among ids (id, doc), and at a few more.

    The rows are picked by a bitmap whose size follows their number; if it would be too large to send round, by a join.
    """
    spark = docs.sparkSession
    size = max(18, (FILTER_RATIO * ids.count()).bit_length())
    if size > MOST_FILTER_BITS:
        named = ids.toDF("own_id", "own_doc")
        docs = docs.join(named, (F.col("id") == F.col("own_id")) & F.col("doc").eqNullSafe(F.col("own_doc")), "left_semi")
    bits = spark.sparkContext.broadcast(_filter_of(ids, size) if size <= MOST_FILTER_BITS else b"\xff" * (1 << 15))
    placed = docs.select("id", "text", F.pmod(F.xxhash64("id", "doc"), F.lit(8 * len(bits.value))).alias("place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            place = batch.column("place").to_numpy()
            batch = batch.filter(pa.array((held[place >> 3] >> (place & 7)) & 1 == 1))
            texts = batch.column("text")
            for a, b in pieces(texts):
                h, counts, edges = sets(texts.slice(a, b - a))
                w = weights(h, counts, table)
                low, high = h.astype(np.uint32), (h >> np.uint64(32)).astype(np.uint16)
                blobs = [low[x:y].tobytes() + high[x:y].tobytes() + w[x:y].tobytes() for x, y in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(blobs, pa.binary())], ["id", "vector"])

    return placed.mapInArrow(run, "id long, vector binary")


def _blobs(column: pa.Array) -> list[memoryview]:
    """The values of a binary column without copies."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = memoryview(column.buffers()[2] or b"")
    return [data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _read_vector(blob: bytes | memoryview) -> tuple[np.ndarray, np.ndarray]:
    n = len(blob) // 10
    h = np.frombuffer(blob, np.uint32, n).astype(np.uint64) | (np.frombuffer(blob, np.uint16, n, 4 * n).astype(np.uint64) << np.uint64(32))
    return h, np.frombuffer(blob, np.float32, n, 6 * n)


def similarity(x: bytes | memoryview, y: bytes | memoryview) -> float:
    """Weighted Jaccard similarity of two vectors."""
    (a, v), (b, w) = _read_vector(x), _read_vector(y)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    shared = np.minimum(v[i], w[j]).sum(dtype=np.float64)
    return float(shared / (v.sum(dtype=np.float64) + w.sum(dtype=np.float64) - shared))


def _rarest(texts: DataFrame, table, threshold: float) -> DataFrame:
    """A row for each of the rarest shingles of the texts (id, weight, component, vector).

    In one order for all texts, from rare to common, two texts of weights v <= w share at least the weight
    threshold * w, and at least 2 * threshold / (1 + threshold) * v. What is left of a text when it weighs less than
    that can't hold all they share, so their rarest common shingle comes before: in the lighter text among its core.
    left is the text's weight from the shingle on: two texts share at most the lesser left at their rarest common shingle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [_read_vector(blob) for blob in _blobs(batch.column("vector"))]
            every = np.concatenate([h for h, _ in read]) if read else np.empty(0, np.uint64)
            rank = np.split(-weights(every, np.ones(len(every), np.int64), table), np.cumsum([len(h) for h, _ in read])[:-1]) if read else []
            for at, (h, w) in enumerate(read):
                order = np.lexsort((h, rank[at]))
                h, w = h[order], w[order].astype(np.float64)
                left = np.cumsum(w[::-1])[::-1]  # the weight from each shingle on
                rare = left >= left[0] * (threshold - 1e-4)
                core = left[rare] >= left[0] * (2 * threshold / (1 + threshold) - 1e-4)
                same = np.full(len(core), at)
                yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(same)) for c in ("id", "weight", "component")] + [pa.array(h[rare].view(np.int64)), pa.array(core), pa.array(left[rare])], ["id", "weight", "component", "shingle", "core", "left"])

    return texts.select("id", "weight", "component", "vector").mapInArrow(run, "id long, weight double, component long, shingle long, core boolean, left double")


def _verified(pairs: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """Those pairs (a, b) whose similarity reaches the threshold."""
    left = vectors.select(F.col("id").alias("a"), F.col("vector").alias("of_a"))
    right = vectors.select(F.col("id").alias("b"), F.col("vector").alias("of_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [similarity(x, y) for x, y in zip(_blobs(batch.column("of_a")), _blobs(batch.column("of_b")), strict=True)]
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(got, pa.float64())], ["a", "b", "similarity"])
            yield out.filter(pa.array([x >= threshold for x in got], pa.bool_()))

    return pairs.join(right, "b").join(left, "a").select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long, similarity double")


def _star(members: DataFrame, hubs: DataFrame, apart: str | None = None) -> DataFrame:
    """Distinct pairs (a < b) of each member with its bucket's hub; apart: of those whose values of this column differ."""
    at = members.join(hubs, "bucket").where("id <> hub")
    if apart:
        own = members.select(F.col("id").alias("hub"), F.col(apart).alias("__hub")).distinct()
        at = at.join(own, "hub").where(F.col(apart) != F.col("__hub"))
    return at.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()


def _mixed(members: DataFrame, label: DataFrame) -> DataFrame:
    """(bucket, id, weight, component) of the buckets whose members lie in several components."""
    own = members.join(label, "id", "left").select("bucket", "id", "weight", F.coalesce("component", "id").alias("component"))
    several = own.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("bucket")
    return own.join(several, "bucket", "left_semi")


def _placed(docs: DataFrame, doc_id: str, text: str, threshold: float, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """Each row of docs as (doc, id), id being its text's number; and each text's class_id and first, the text of the class's first row."""
    plain = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc"), plain.alias("text"))
    table = document_frequencies(docs)
    docs = docs.select("doc", text_number(F.col("text")).alias("id"), "text")
    signed = written(_signed(docs, table, bands, rows), "near-signed")
    # One row per text; equal texts have equal bands.
    texts = signed.groupBy("id").agg(F.min("doc").alias("doc"), F.first("weight").alias("weight"), F.first("bands").alias("bands"))
    members = texts.select("id", "doc", "weight", F.explode("bands").alias("bucket"))
    full = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = written(members.join(full, "bucket").select("bucket", "id", "doc", "weight", "n"), "near-buckets", again=True)
    # Of a text's copies the one of the least doc_id is read.
    vectors = written(_vectors(docs, members.select("id", "doc").distinct(), table), "near-vectors").dropDuplicates(["id"])
    # The hub of a bucket is the text that meets most others in all its buckets: an original rather than one of its edited copies.
    met = members.groupBy("id").agg(F.sum("n").alias("met"))
    ranked = members.join(met, "id")
    hubs = ranked.groupBy("bucket").agg(F.max_by("id", F.struct("met", (-F.col("id")).alias("minus"))).alias("hub"))
    star = written(_star(members, hubs), "near-star", again=True)
    links = written(_verified(star, vectors, threshold), "near-links", again=True)
    label = components(links.select("a", "b"))
    for turn in range(STARS):
        # Buckets that still lie in several components: a star around another member, chosen by a hash.
        mixed = written(_mixed(members, label), "near-mixed", again=True)
        if mixed.isEmpty():
            break
        hubs = mixed.groupBy("bucket").agg(F.max_by("id", F.xxhash64("id", F.lit(turn))).alias("hub"))
        new = written(_star(mixed, hubs, "component").join(star, ["a", "b"], "left_anti"), "near-star", again=True)
        links = written(links.unionByName(_verified(new, vectors, threshold)), "near-links", again=True)
        star = star.unionByName(new)
        label = components(links.select("a", "b"))
    # What is left: texts of such buckets that share one of their rarest shingles, with enough weight from there on.
    own = _mixed(members, label).select("id", "weight", "component").distinct()
    rare = written(_rarest(own.join(vectors, "id"), table, threshold), "near-rarest", again=True)
    one, two = rare.where("core").alias("one"), rare.alias("two")
    lighter = (F.col("one.weight") < F.col("two.weight")) | ((F.col("one.weight") == F.col("two.weight")) & (F.col("one.id") < F.col("two.id")))
    allowed = lighter & (F.col("one.weight") >= F.col("two.weight") * (threshold - 1e-6)) & (F.col("one.component") != F.col("two.component"))
    enough = F.least("one.left", "two.left") >= (F.col("one.weight") + F.col("two.weight")) * (threshold / (1 + threshold) - 1e-4)
    rest = one.join(two, (F.col("one.shingle") == F.col("two.shingle")) & allowed & enough)
    rest = rest.select(F.least("one.id", "two.id").alias("a"), F.greatest("one.id", "two.id").alias("b")).distinct().join(star, ["a", "b"], "left_anti")
    more = written(_verified(rest, vectors, threshold), "near-more", again=True)
    if not more.isEmpty():
        label = components(links.select("a", "b").unionByName(more.select("a", "b")))
    placed = texts.join(label, "id", "left").select("id", "doc", F.coalesce("component", "id").alias("component"))
    first = placed.groupBy("component").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "id")).alias("first"))
    placed = placed.join(first, "component").select("id", F.col("first.doc").alias("class_id"), F.col("first.id").alias("first"))
    return signed.select("doc", "id"), placed


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """For each row of docs its doc_id and class_id, the least doc_id of its class."""
    every, placed = _placed(docs, doc_id, text, threshold, bands, rows)
    return every.join(placed, "id").select(F.col("doc").alias("doc_id"), "class_id")


def text_number(text: Column) -> Column:
    """A 60-bit number of a text, from its SHA-1 digest."""
    return F.conv(F.substring(F.sha1(text.cast("binary")), 1, 15), 16, 10).cast("long")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each class: that of the least doc_id (of rows that repeat it, or of nulls only, any one of the least text)."""
    _, placed = _placed(docs, doc_id, text, THRESHOLD, BANDS, ROWS)
    named, number, own = (inner_name(docs.columns, c) for c in ("class_id", "text_number", "own_number"))
    kept = placed.where("id = first").select(F.col("id").alias(number), F.col("class_id").alias(named))
    mine = docs.withColumn(own, text_number(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))))
    chosen = mine.join(kept, (F.col(own) == F.col(number)) & F.col(f"`{doc_id}`").cast("long").eqNullSafe(F.col(named)), "left_semi")
    return chosen.dropDuplicates([doc_id, own]).drop(own)
