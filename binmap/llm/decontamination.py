"""Benchmark decontamination by SimHash windows.

Every benchmark item has windows of its own size: of W words, W being the largest number of a fixed series that fits, at least
four fifths of the item, at its first and its last words. An item of more than twice MOST_WORDS words has windows of that
many all along it. Each run of W words of a document, at every place, has a 64-bit SimHash of its
words. Fingerprints are compared through BLOCKS blocks of 16 bits: two that differ in at most RADIUS bits agree in one
block up to RADIUS // BLOCKS bits, and all such variants of the items' blocks are in the index, so every window
within the radius of an item's is found. Each such place is then verified: the item's weighted five-word
shingles against those of every passage in the place's surroundings, as long and as far off as the threshold allows.
A shingle weighs 1 + log(items / items that hold it), items being those of the block.

The benchmark is dealt by hash to blocks of about BLOCK_ITEMS items, files in the shared folder, and a worker holds the index
of one block at a time; any number of items thus takes bounded memory, and no item passes through the driver. Null and empty
texts and items have no windows. An item of fewer than five words is one shingle. Repeated items and rows are each
reported. Empty tables give an empty result. Other columns of docs stay as they are, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import new_folder, open_file, write_file, written
from .words import buffers, hashes, pieces, shingles, spans

SIZE, THRESHOLD = 5, 0.8
BLOCKS, RADIUS = 4, 11
BLOCK_ITEMS = 5_000
#: Words of a window at most: its bits are counted in bytes. Longer items have windows of that size over their whole length.
MOST_WORDS = 255
#: Words by which a verified passage may go beyond its place at least; a quarter of the item's shingles if that is more.
SLACK = 2
_STEP = 4_096
#: Places whose passages are weighed at once.
_PLACES = 1 << 15
#: Starts whose passages are weighed at once.
_STARTS = 128
#: Where each block's rows begin in an index's table.
_BLOCK_ROWS = np.arange(BLOCKS) << 16


def _sums(words: np.ndarray) -> np.ndarray:
    """Running counts of the words' set bits, modulo 256: enough for windows of fewer words."""
    bits = np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1)
    out = np.zeros((len(words) + 1, 64), np.uint8)
    np.cumsum(bits, axis=0, dtype=np.uint8, out=out[1:])
    return out


def fingerprints(sums: np.ndarray, length: int) -> np.ndarray:
    """SimHashes of all windows of so many words, from the running counts: the bits that more than half of the words have."""
    if len(sums) <= length:
        return np.empty(0, np.uint64)
    return np.packbits(sums[length:] - sums[:-length] > length // 2, axis=1).view(np.uint64).ravel()


def window_length(n: int) -> int:
    """Words of the windows of an item of n words: the largest of a series that grows by a quarter, so at least four fifths of n."""
    length = 1
    while (longer := max(length + 1, length * 5 // 4)) <= min(n, MOST_WORDS):
        length = longer
    return length


def window_starts(n: int, length: int) -> list[int]:
    """Where an item's windows begin: at both ends, and in between so that each overlaps the next by half."""
    return sorted({*range(0, n - length + 1, max(1, length // 2)), n - length}) if n > 2 * length else sorted({0, n - length})


def _flips(errors: int) -> np.ndarray:
    """All 16-bit masks of at most so many bits."""
    return np.array([sum(1 << i for i in flips) for n in range(errors + 1) for flips in combinations(range(16), n)], np.int64)


class Index:
    """The items' windows and shingles, of one block of the benchmark."""

    def __init__(self, items: list[tuple[int, str]]):
        texts = pa.array([t for _, t in items], pa.large_string())
        data, offsets = buffers(texts)
        starts, ends, first = spans(data, offsets)
        words = hashes(data, starts, ends)
        h, doc, _ = shingles(words, first, SIZE)
        self.ids = [i for i, _ in items]
        self.sizes = np.diff(first)
        sets = [set(h[doc == i].tolist()) for i in range(len(items))] if len(items) <= 64 else self._sets(h, doc, len(items))
        held = Counter(x for s in sets for x in s)
        self.most = 1 + math.log(max(1, len(items)))
        self.weight = {x: 1 + math.log(len(items) / n) for x, n in held.items()}
        self.sets = sets
        counts = np.maximum(self.sizes - SIZE + 1, 1)
        slack = SLACK + np.ceil(counts * (1 / THRESHOLD - 1) - 1e-9).astype(np.int64)
        self.step = np.maximum(1, slack // 2)
        self.slack = slack + self.step
        self.total = np.array([sum(self.weight[x] for x in s) for s in sets])
        keys = sorted({(i, x) for i, s in enumerate(sets) for x in s})
        self.pair = np.array([(i << 44) | (x >> 20) for i, x in keys], np.uint64)
        self.pair_weight = np.array([self.weight[x] for _, x in keys])
        order = np.argsort(self.pair, kind="stable")
        self.pair, self.pair_weight = self.pair[order], self.pair_weight[order]
        windows: dict[int, list[tuple[int, int, int]]] = {}  # by length: (fingerprint, item, words of the item before it)
        for i, n in enumerate(self.sizes):
            if n:
                length = window_length(int(n))
                made = fingerprints(_sums(words[first[i] : first[i + 1]]), length)
                for at in window_starts(int(n), length):
                    windows.setdefault(length, []).append((int(made[at]), i, at))
        self.windows, flips = {}, _flips(RADIUS // BLOCKS)
        for length, found in windows.items():
            prints = np.array([f for f, _, _ in found], np.uint64)
            blocks = prints.view(np.uint16).reshape(-1, BLOCKS)
            # One table for all blocks: row (block << 16) + value has the windows of which it is a variant.
            rows = ((np.arange(BLOCKS) << 16 | blocks.astype(np.int64))[:, :, None] ^ flips).reshape(len(prints), -1)
            order = np.argsort(rows, axis=None, kind="stable")
            edges = np.searchsorted(rows.ravel()[order], np.arange((BLOCKS << 16) + 1))
            count = np.diff(edges).astype(np.int32)
            table = (count > 0, edges[:-1].astype(np.int32), count, (order // rows.shape[1]).astype(np.int32))
            self.windows[length] = (prints, np.array([i for _, i, _ in found]), np.array([a for _, _, a in found]), table)

    @staticmethod
    def _sets(h: np.ndarray, doc: np.ndarray, n: int) -> list[set[int]]:
        edges = np.searchsorted(doc, np.arange(n + 1))
        return [set(h[a:b].tolist()) for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def near(self, sums: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and numbers of the item windows of this length within the radius, each found once."""
        prints = fingerprints(sums, length)
        known, _, _, (some, start, count, window) = self.windows[length]
        row = (prints.view(np.uint16).reshape(-1, BLOCKS) + _BLOCK_ROWS).ravel()
        hit = np.flatnonzero(some.take(row))
        row = row.take(hit)
        n = count.take(row)
        at = np.repeat(hit // BLOCKS, n)
        w = window.take(np.repeat(start.take(row) - (np.cumsum(n) - n), n) + np.arange(len(at)))
        close = np.bitwise_count(prints.take(at) ^ known.take(w)) <= RADIUS
        both = np.unique(at[close] * len(known) + w[close])
        return both // len(known), both % len(known)

    def similarity(self, item: int, passage: set[int]) -> float:
        """Weighted Jaccard similarity of an item's shingles and a passage's."""
        shared = sum(self.weight[x] for x in passage & self.sets[item])
        return shared / (self.total[item] + sum(self.weight.get(x, self.most) for x in passage) - shared)

    def search(self, texts: pa.Array) -> list[tuple[int, int, float, int]]:
        """(text, item, similarity, first word) for the best passage of each text that reaches the threshold, for each item."""
        data, offsets = buffers(texts)
        starts, ends, first = spans(data, offsets)
        if not len(starts) or not self.windows:
            return []
        words = hashes(data, starts, ends)
        doc = np.repeat(np.arange(len(texts)), np.diff(first))
        longest = max(self.windows)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for a in range(0, len(words), _STEP):
            part = words[a : a + _STEP + longest - 1]
            sums = _sums(part)
            for length, (_, items, before, _) in self.windows.items():
                own = sums[: min(len(sums), _STEP + length)]
                at, w = self.near(own, length)
                at = at + a
                inside = doc[at] == doc[np.minimum(at + length - 1, len(doc) - 1)]
                at, w = at[inside], w[inside]
                found.append((at - before[w], items[w]))
        start = np.concatenate([s for s, _ in found])
        item = np.concatenate([i for _, i in found])
        if not len(start):
            return []
        # Places close together have nearly the same surroundings: each stands for those up to a step behind it.
        start -= start % self.step[item]
        key = np.unique(start * len(self.ids) + item)
        start, item = np.divmod(key, len(self.ids))
        # The text's part that any moved passage lies in must hold enough of the item's weight.
        h = np.zeros(len(words), np.uint64)
        made, _, at = shingles(words, first, SIZE)
        h[at] = made
        likely = [a + self._likely(start[a : a + _PLACES], item[a : a + _PLACES], h) for a in range(0, len(start), _PLACES)]
        best: dict[tuple[int, int], tuple[float, int]] = {}
        around: dict[tuple[int, int], list[list[int]]] = {}  # the surroundings of each text's places for an item, joined where they meet
        for c in np.concatenate(likely).tolist():
            i, n, slack = int(item[c]), int(self.sizes[item[c]]), int(self.slack[item[c]])
            d = int(doc[min(max(int(start[c]) + n // 2, 0), len(words) - 1)])
            one, end = max(int(first[d]), int(start[c]) - slack), min(int(first[d + 1]), int(start[c]) + n + slack)
            parts = around.setdefault((d, i), [])
            if parts and one <= parts[-1][1]:  # places of an item come in order
                parts[-1][1] = max(parts[-1][1], end)
            else:
                parts.append([one, end])
        for (d, i), parts in around.items():
            for one, end in parts:
                got, at = self._best(i, words, h, one, end)
                if got >= THRESHOLD and got > best.get((d, i), (0.0, 0))[0]:
                    best[d, i] = (got, at - int(first[d]))
        return [(d, self.ids[i], got, at) for (d, i), (got, at) in sorted(best.items())]

    def _best(self, item: int, words: np.ndarray, h: np.ndarray, one: int, end: int) -> tuple[float, int]:
        """The greatest similarity of an item and a passage of the words from one to end, and where that passage begins."""
        n = int(self.sizes[item])
        if n < SIZE:  # only its own words make its shingle
            tried = [(self.similarity(item, self._passage(words, h, s, n)), -s) for s in range(one, end - n + 1)]
            got, at = max(tried, default=(0.0, 0))
            return got, -at
        own, last = h[one : max(one, end - SIZE + 1)].tolist(), {}
        before = np.empty(len(own), np.int64)  # where a shingle stood last: it counts in passages that begin after that
        for j, x in enumerate(own):
            before[j] = last.get(x, -1)
            last[x] = j
        weight = np.array([self.weight.get(x, self.most) for x in own])
        shared = np.where([x in self.sets[item] for x in own], weight, 0.0)
        longest = n - SIZE + 1 + 2 * int(self.slack[item])
        best = (0.0, one)
        for a in range(0, len(own), _STARTS):
            starts = np.arange(a, min(len(own), a + _STARTS))[:, None]
            ends = np.arange(a, min(len(own), a + _STARTS + longest))
            counts = (ends >= starts) & (before[ends] < starts)
            held = np.cumsum(np.where(counts, shared[ends], 0.0), axis=1)
            every = np.cumsum(np.where(counts, weight[ends], 0.0), axis=1)
            got = held / (self.total[item] + every - held)
            k = int(got.argmax())
            if got.flat[k] > best[0]:
                best = (float(got.flat[k]), one + a + k // len(ends))
        return best

    def _likely(self, start: np.ndarray, item: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Which places' surroundings hold enough of the item's weight, each shingle counted once."""
        enough = (THRESHOLD - 1e-6) * self.total[item]
        likely = np.arange(len(start))
        for once in (False, True):  # with repeats first, which is an upper bound
            own = item[likely]
            count = np.maximum(self.sizes[own] - SIZE + 1, 1) + 2 * self.slack[own]
            row = np.repeat(np.arange(len(likely)), count)
            place = np.repeat(start[likely] - self.slack[own] - (np.cumsum(count) - count), count) + np.arange(len(row))
            cut = h.take(place.clip(0, len(h) - 1)) >> np.uint64(20)
            if once:
                key = np.unique((row.astype(np.uint64) << np.uint64(44)) | cut)
                row, cut = (key >> np.uint64(44)).astype(np.int64), key & np.uint64((1 << 44) - 1)
            key = (own[row].astype(np.uint64) << np.uint64(44)) | cut
            hit = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            held = np.bincount(row, np.where(self.pair[hit] == key, self.pair_weight[hit], 0), len(likely))
            likely = likely[held >= enough[likely]]
        return likely

    @staticmethod
    def _passage(words: np.ndarray, h: np.ndarray, start: int, length: int) -> set[int]:
        if length >= SIZE:
            return set(h[start : start + length - SIZE + 1].tolist())
        made, _, _ = shingles(words[start : start + length], np.array([0, length]), SIZE)
        return set(made.tolist())


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> list[str]:
    """Files in the shared folder, each with at most about BLOCK_ITEMS distinct items; executors write and read them."""
    items = benchmark.select(F.col(f"`{item_id}`").cast("long").alias("i"), F.col(f"`{text}`").cast("string").alias("t")).where("t is not null")
    items = items.groupBy("i", "t").agg(F.count(F.lit(1)).alias("n"))
    blocks = max(1, -(-items.count() // BLOCK_ITEMS))
    folder = new_folder(benchmark.sparkSession, "benchmark")

    def save(key: tuple, table: pa.Table) -> pa.Table:
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, table.schema) as writer:
            writer.write_table(table.sort_by([("i", "ascending"), ("t", "ascending")]))
        path = f"{folder}/{key[0].as_py()}"
        write_file(path, [out.getvalue().to_pybytes()])
        return pa.table({"path": [path]})

    dealt = items.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(blocks)))
    return sorted(r.path for r in dealt.groupBy("block").applyInArrow(save, "path string").collect())  # a name a block


_INDEXES: dict[str, tuple[Index, list[int]]] = {}


def _index(path: str) -> tuple[Index, list[int]]:
    """The index of a block, and how often each of its items is there. A worker holds one at a time."""
    if path not in _INDEXES:
        _INDEXES.clear()
        with open_file(path) as f:
            table = pa.ipc.open_stream(pa.BufferReader(f.read())).read_all()
        rows = table.to_pydict()
        _INDEXES[path] = Index(list(enumerate(rows["t"]))), list(zip(rows["i"], rows["n"], strict=True))
    return _INDEXES[path]


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, first_word) for every document and item that it holds a passage of. One pass for each block of items."""
    plain = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64())])

    def searched(path: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, ids = batch.column("text"), batch.column("id").to_pylist()
                index, items = _index(path)
                for a, b in pieces(texts):
                    rows = [{"doc_id": ids[a + d], "item_id": items[i][0], "similarity": s, "first_word": at} for d, i, s, at in index.search(texts.slice(a, b - a)) for _ in range(items[i][1])]
                    yield pa.RecordBatch.from_pylist(rows, schema)

        return plain.mapInArrow(run, "doc_id long, item_id long, similarity double, first_word long")

    found = [searched(path) for path in _blocks(benchmark, item_id, item_text)]
    return reduce(DataFrame.unionAll, found) if found else docs.sparkSession.createDataFrame([], "doc_id long, item_id long, similarity double, first_word long")


def without_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs whose text holds no passage of an item. Between two blocks of items what is left is written."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain, at = docs.toDF(*names), names[docs.columns.index(text)]

    def cleared(left: DataFrame, path: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(at)
                clean = np.ones(len(batch), bool)
                for a, b in pieces(texts):
                    clean[[a + d for d, *_ in _index(path)[0].search(texts.slice(a, b - a))]] = False
                yield batch.filter(pa.array(clean))

        return left.mapInArrow(run, plain.schema)

    paths = _blocks(benchmark, item_id, item_text)
    for i, path in enumerate(paths):
        plain = cleared(plain, path)
        if i + 1 < len(paths):
            plain = written(plain, "cleared")
    return plain.toDF(*docs.columns)
