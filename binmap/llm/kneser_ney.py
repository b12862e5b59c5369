"""An interpolated modified Kneser-Ney trigram model, counted in Spark and memory-mapped by workers.

Words are hashed to 64 bits. Training goes in four rounds, each a map side that sorts and sums what a few
million tokens hold, and a reduce side that merges such runs and writes sorted arrays to the shared folder.

1. Unigrams, by hash ranges: the sorted hashes and the running sums of their counts. A word's rank is its id.
2. Trigrams u v w, by ranges of (v, w) that hold about equal numbers of tokens, so that a v which a third of
   all tokens are spans many ranges. A range has the contexts v, behind each its words w, behind each pair the words u before it
   with their counts: ids of four bytes and counts of one. How many u a pair has is its continuation count.
3. What is known of each context u v, in the place of the pair: how many tokens follow, and how many words once, twice and more often.
4. Continuation counts of words (of how many others a word is the successor), by the ranges of round 1.

A probability is the discounted trigram estimate interpolated with the discounted estimate from the pair's continuations,
that with the word's, and that with the uniform distribution over the vocabulary and one unknown word. Discounts come from
the counts of counts of each order. Pairs at a text's beginning have nothing before them; they keep their counts.
Nothing is pruned: the arrays grow with the corpus. The driver holds a few numbers per range. With order 2 the estimate
of pairs is the last one, from their own counts.

Null texts are empty (one token, the end). A null doc_id is trained on. An empty training set gives the
uniform distribution over one unknown word. Repeated rows count each time. A column of score()'s that is there already raises
ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, map_array, new_folder, write_file, written
from .words import buffers, hashes, pieces, spans

ORDER = 3
#: Tokens that a map task sorts at once; tokens that a range of pairs is meant to hold, and ranges at most.
RUN, RANGE_TOKENS, MOST_RANGES = 2_000_000, 2_000_000, 1 << 18
END = np.uint64(0x0123456789ABCDEF)
RUNS = "bucket int, keys binary, counts binary"


#: Bytes of text that are scored at once; n-grams are looked up once for all of them.
SCORED = 4 << 20


def _pack(sorted_numbers: np.ndarray) -> bytes:
    """Sorted numbers as compressed byte planes of their differences."""
    steps = np.diff(sorted_numbers.astype(np.uint64), prepend=np.uint64(0))
    return zstandard.ZstdCompressor(1).compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _pack_counts(counts: np.ndarray) -> bytes:
    planes = counts.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes()
    return zstandard.ZstdCompressor(1).compress(planes)


def _unpack_counts(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.int64).ravel()


def _runs(buckets: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each bucket that occurs; buckets ascend with the keys."""
    edges = np.flatnonzero(np.diff(buckets, prepend=-1))
    for a, b in zip(edges, [*edges[1:], len(keys)], strict=True):
        yield pa.RecordBatch.from_pydict({"bucket": pa.array([int(buckets[a])], pa.int32()), "keys": [_pack(keys[a:b])], "counts": [_pack_counts(counts[a:b])]})


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return (keys[first], *(np.add.reduceat(v[order], first) for v in values)) if len(keys) else (keys, *values)


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The sorted keys of all runs of a bucket and their summed counts."""
    return _summed(np.concatenate([_unpack(x) for x in table["keys"].to_pylist()]), np.concatenate([_unpack_counts(x) for x in table["counts"].to_pylist()]))


def _triples(pair: np.ndarray, before: np.ndarray, counts: np.ndarray | None, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (pair, word before), sorted, and their summed counts (each is one if counts is null). bits: of a word's id."""
    if bits * 3 <= 64:
        key = (pair << np.uint64(bits)) | before.astype(np.uint64)  # the pair's key has less than twice the bits
        if counts is None:
            key, counts = np.unique(key, return_counts=True)
        else:
            key, counts = _summed(key, counts)
        return key >> np.uint64(bits), (key & np.uint64((1 << bits) - 1)).astype(np.int64), counts
    order = np.lexsort((before, pair))
    pair, before = pair[order], before[order]
    first = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (before[1:] != before[:-1])])) if len(pair) else np.empty(0, np.int64)
    weight = np.ones(len(pair), np.int64) if counts is None else counts[order]
    return pair[first], before[first], np.add.reduceat(weight, first) if len(first) else weight


def _found(array: np.ndarray, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Where each value stands in array[low:high], which is sorted; -1 if it doesn't."""
    left, right = low.copy(), high.copy()
    while (open_ := left < right).any():
        middle = (left + right) >> 1
        less = open_ & (array[np.minimum(middle, len(array) - 1)] < value)
        left = np.where(less, middle + 1, left)
        right = np.where(open_ & ~less, middle, right)
    at = np.minimum(left, max(len(array) - 1, 0))
    return np.where((left < high) & (array[at] == value), left, -1) if len(array) else np.full(len(value), -1)


def _capped(values: np.ndarray) -> tuple[bytes, bytes]:
    """Numbers as bytes, and the places and numbers of those from 255 on."""
    large = np.flatnonzero(values >= 255)
    return np.minimum(values, 255).astype(np.uint8).tobytes(), np.stack([large, values[large]]).astype(np.int64).tobytes()


def _of_counts(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3 and 4."""
    return [int((counts == i).sum()) for i in (1, 2, 3, 4)]


def discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 0, 1, 2 and more, from the counts of counts; halves where those give none."""
    n1, n2, n3, n4 = (float(x) for x in n)
    out = np.array([0.0, 0.5, 1.0, 1.5])
    if n1 > 0 and n2 > 0:
        y = n1 / (n1 + 2 * n2)
        for i, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
            if a > 0 and 0 < (d := i - (i + 1) * y * b / a) <= i:
                out[i] = d
    return out


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words and its end, and where each text begins (one more ends the last)."""
    data, offsets = buffers(texts)
    starts, ends, first = spans(data, offsets)
    out = np.full(len(starts) + len(texts), END, np.uint64)
    out[np.arange(len(starts)) + np.repeat(np.arange(len(texts)), np.diff(first))] = hashes(data, starts, ends)
    return out, first + np.arange(len(first))


def _gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Token hashes of about so many tokens at once, and whether each begins a text."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def out() -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([h for h, _ in held]), np.concatenate([b for _, b in held])

    for batch in batches:
        texts = batch.column("text")
        for a, b in pieces(texts):
            h, first = token_hashes(texts.slice(a, b - a))
            begins = np.zeros(len(h), bool)
            begins[first[:-1]] = True
            held.append((h, begins))
            n += len(h)
            if n >= size:
                yield out()
                held, n = [], 0
    if held:
        yield out()


@dataclass
class Model:
    """Places and sizes of a trained model's arrays; the arrays are mapped when first used."""

    folder: str
    order: int
    bits: int  # 2 ** bits ranges of hashes
    words: list[int]  # distinct words in each
    tokens: list[int]  # and tokens
    docs: int
    ranges: int = 1  # of pairs
    filled: list[int] = field(default_factory=list)  # those with any
    edges: dict[int, tuple[int, ...]] = field(default_factory=dict)  # contexts at ends of ranges: words seen once, twice, more, and all
    begin: tuple[int, ...] = (0, 0, 0, 0)  # the same of a text's beginning as a context of two
    discounts: list[list[float]] = field(default_factory=lambda: [[0.0] * 4] * 3)  # of words, pairs, trigrams
    word_types: list[int] = field(default_factory=lambda: [0] * 3)
    pairs: int = 0  # distinct bigrams

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_") and k not in ("word_base", "token_base", "edge_arrays")}

    @property
    def n(self) -> int:
        return sum(self.tokens)

    @property
    def v(self) -> int:
        return sum(self.words)

    @cached_property
    def word_base(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.words)]).astype(np.int64)

    @cached_property
    def token_base(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.tokens)]).astype(np.int64)

    @cached_property
    def edge_arrays(self) -> tuple[np.ndarray, np.ndarray]:
        at = sorted(self.edges)
        return np.array(at, np.int64), np.array([self.edges[i] for i in at], np.int64).reshape(-1, 4)

    def array(self, name: str, dtype) -> np.ndarray:
        cache = self.__dict__.setdefault("_arrays", {})
        if name not in cache:
            cache[name] = map_array(f"{self.folder}/{name}", dtype)
        return cache[name]

    def ids(self, sorted_hashes: np.ndarray) -> np.ndarray:
        """Ids of sorted distinct hashes; -1: never seen in training."""
        out = np.full(len(sorted_hashes), -1, np.int64)
        for b, a, z in self._split(sorted_hashes >> np.uint64(64 - self.bits)):
            if self.words[b]:
                keys, part = self.array(f"word-{b}", np.uint64), sorted_hashes[a:z]
                at = np.minimum(np.searchsorted(keys, part), len(keys) - 1)
                out[a:z] = np.where(keys[at] == part, at + self.word_base[b], -1)
        return out

    @staticmethod
    def _split(sorted_buckets: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Each bucket with the range of places that have it."""
        if len(sorted_buckets):
            edges = np.flatnonzero(np.concatenate([[True], sorted_buckets[1:] != sorted_buckets[:-1]]))
            for a, z in zip(edges, [*edges[1:], len(sorted_buckets)], strict=True):
                yield int(sorted_buckets[a]), int(a), int(z)

    def _by_id(self, sorted_ids: np.ndarray, name: str) -> Iterator[tuple[np.ndarray, int, int, np.ndarray]]:
        """The array of each hash range with the places of sorted_ids in it, and those ids within the range."""
        for b, a, z in self._split(np.searchsorted(self.word_base, sorted_ids, "right") - 1):
            yield b, a, z, sorted_ids[a:z] - self.word_base[b]

    def mass(self, sorted_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens before each context's own in the order of ids, and its own; id v stands for a text's beginning."""
        before, own = np.full(len(sorted_ids), self.n, np.int64), np.full(len(sorted_ids), self.docs, np.int64)
        inside = sorted_ids < self.v
        for b, a, z, local in self._by_id(sorted_ids[inside], "sum"):
            sums = self.array(f"sum-{b}", np.int64)
            before[a:z] = sums[local] + self.token_base[b]
            own[a:z] = sums[local + 1] - sums[local]
        return before, own

    def continuations(self, sorted_ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(sorted_ids), np.int64)
        for b, a, z, local in self._by_id(sorted_ids, "cont"):
            out[a:z] = self.array(f"cont-{b}", np.int64)[local]
        return out

    def range_of(self, before: np.ndarray, own: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The range that holds a pair; it ascends with the pair's key."""
        place = before + own * (word / (self.v + 1))
        return np.minimum(place * (self.ranges / max(1, self.n + self.docs)), self.ranges - 1).astype(np.int64)

    def neighbours(self, h: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of each token, of the one before it and of the one before that: v stands for a text's beginning, -1 for an unknown word."""
        distinct, back = np.unique(h, return_inverse=True)
        word = self.ids(distinct)[back]
        one = np.concatenate([[-1], word[:-1]])
        one[begins] = self.v
        two = np.concatenate([[-1], one[:-1]])
        two[begins] = self.v
        return word, one, two if self.order > 2 else np.full(len(word), self.v)

    @property
    def id_bits(self) -> int:
        return int(self.v + 1).bit_length()

    def pair_key(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        return context.astype(np.uint64) * np.uint64(self.v + 1) + word.astype(np.uint64)

    def ranges_of_keys(self, key: np.ndarray) -> np.ndarray:
        context, word = np.divmod(key, np.uint64(self.v + 1))
        contexts, back = np.unique(context.astype(np.int64), return_inverse=True)
        before, own = self.mass(contexts)
        return self.range_of(before[back], own[back], word.astype(np.int64))

    def _pairs_at(self, r: int, key: np.ndarray) -> np.ndarray:
        """Places of sorted pairs within their range; -1 for those never seen."""
        contexts, starts, words = (self.array(f"{n}-{r}", t) for n, t in (("context", np.uint32), ("start", np.uint32), ("next", np.uint32)))
        context, word = (x.astype(np.int64) for x in np.divmod(key, np.uint64(self.v + 1)))
        at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
        there = contexts[at] == context
        low, high = starts[at].astype(np.int64), starts[at + 1].astype(np.int64)
        return _found(words, low, np.where(there, high, low), word)

    @staticmethod
    def _wide(small: np.ndarray, large: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Capped numbers at places, with those that are larger."""
        got = small[at].astype(np.int64)
        if len(big := np.flatnonzero(got == 255)):
            places, values = large.reshape(2, -1)
            got[big] = values[np.searchsorted(places, at[big])]
        return got

    def counts(self, key: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For sorted pairs, each with a word before it: the pair's continuation count and the trigram's count."""
        pairs, triples = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        distinct, back = np.unique(key, return_inverse=True)
        place = np.searchsorted(back, np.arange(len(distinct) + 1))
        filled = set(self.filled)
        for r, a, z in self._split(self.ranges_of_keys(distinct)):
            if r not in filled:
                continue
            at = self._pairs_at(r, distinct[a:z])
            starts, words, count, large = (self.array(f"{n}-{r}", t) for n, t in (("first", np.uint32), ("before", np.uint32), ("count", np.uint8), ("large", np.int64)))
            low, high = (np.where(at >= 0, starts[at + k], 0).astype(np.int64) for k in (0, 1))
            # At a beginning, and with order 2, a pair has one word before it and its own count.
            plain = (distinct[a:z] // np.uint64(self.v + 1) == self.v) | (self.order == 2)
            own = high - low
            single = plain & (at >= 0)
            own[single] = self._wide(count, large, low[single])
            rows = slice(place[a], place[z])
            of = back[rows] - a
            pairs[rows] = own[of]
            if self.order > 2:
                spot = _found(words, low[of], high[of], before[rows])
                got = np.zeros(len(spot), np.int64)
                got[spot >= 0] = self._wide(count, large, spot[spot >= 0])
                triples[rows] = got
        return pairs, triples

    def double_types(self, key: np.ndarray) -> np.ndarray:
        """For sorted distinct pairs as contexts: the words seen behind it once, twice and more often, and all tokens there."""
        out = np.zeros((len(key), 4), np.int64)
        filled = set(self.filled)
        for r, a, z in self._split(self.ranges_of_keys(key)):
            if r in filled:
                at = self._pairs_at(r, key[a:z])
                seen = np.flatnonzero(at >= 0)
                n = len(self.array(f"next-{r}", np.uint32))
                small, large = self.array(f"types-{r}", np.uint8), self.array(f"types-large-{r}", np.int64)
                for k in range(4):
                    out[a + seen, k] = self._wide(small, large, k * n + at[seen])
        out[key == np.uint64(self.v) * np.uint64(self.v + 1) + np.uint64(self.v)] = self.begin
        return out

    def context_types(self, sorted_ids: np.ndarray, before: np.ndarray, own: np.ndarray) -> np.ndarray:
        """For each context, the words seen behind it once, twice and more often, and the sum of their counts."""
        out = np.zeros((len(sorted_ids), 4), np.int64)
        filled = set(self.filled)
        for r, a, z in self._split(self.range_of(before, own, np.zeros(len(before)))):
            if r in filled:
                at_ids = self.array(f"context-{r}", np.uint32)
                types = self.array(f"kinds-{r}", np.int64).reshape(-1, 4)
                at = np.minimum(np.searchsorted(at_ids, sorted_ids[a:z]), len(at_ids) - 1)
                hit = at_ids[at] == sorted_ids[a:z]
                out[a:z][hit] = types[at[hit]]
        edge_ids, edge_types = self.edge_arrays
        if len(edge_ids):
            at = np.minimum(np.searchsorted(edge_ids, sorted_ids), len(edge_ids) - 1)
            hit = edge_ids[at] == sorted_ids
            out[hit] = edge_types[at[hit]]
        return out

    def log_probabilities(self, h: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token the model's log10 probability, the add-one unigram's, and whether it is known."""
        distinct, back = np.unique(h, return_inverse=True)
        ids = self.ids(distinct)
        known = ids >= 0
        count = np.zeros(len(ids), np.int64)
        count[known] = self.mass(ids[known])[1]
        base = np.log10((count + 1) / (self.n + self.v + 1))[back]
        d1, d2, d3 = (np.array(d) for d in self.discounts)
        uniform = 1 / (self.v + 1)
        if self.pairs:
            cc = np.zeros(len(ids), np.int64)
            cc[known] = self.continuations(ids[known])
            spare = float(d1[1:] @ self.word_types) / self.pairs
            p = ((cc - d1[np.minimum(cc, 3)]) / self.pairs + spare * uniform)[back]
        else:
            p = np.full(len(h), uniform)
        word, one, two = self.neighbours(h, begins)
        # Counts of all known pairs and trigrams of the batch, each looked up once.
        pair, triple = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        sure = np.flatnonzero((word >= 0) & (one >= 0))
        if len(sure):
            key, before = self.pair_key(one[sure], word[sure]), np.maximum(two[sure], -1) + 1
            fits = self.id_bits * 3 <= 64
            order = np.argsort((key << np.uint64(self.id_bits)) | before.astype(np.uint64)) if fits else np.lexsort((before, key))
            key, before = key[order], before[order]
            new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (before[1:] != before[:-1])]))
            which = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(key))))
            of_pair, of_triple = self.counts(key[new], before[new] - 1)
            pair[sure[order]], triple[sure[order]] = of_pair[which], of_triple[which]

        def mixed(p: np.ndarray, c: np.ndarray, d: np.ndarray, types: np.ndarray) -> np.ndarray:
            total = types[:, 3]
            with np.errstate(divide="ignore", invalid="ignore"):
                return np.where(total > 0, (np.maximum(c - d[np.minimum(c, 3)], 0) + (types[:, :3] @ d[1:]) * p) / total, p)

        held, which = np.unique(one, return_inverse=True)
        usable = held >= 0
        types = np.zeros((len(held), 4), np.int64)
        types[usable] = self.context_types(held[usable], *self.mass(held[usable]))
        p = mixed(p, pair, d2, types[which])
        if self.order > 2:
            sure = np.flatnonzero((one >= 0) & (two >= 0))
            key, which = np.unique(self.pair_key(two[sure], one[sure]), return_inverse=True)
            p[sure] = mixed(p[sure], triple[sure], d3, self.double_types(key)[which])
        return np.log10(p), base, known[back]


def train(docs: DataFrame, order: int = ORDER) -> Model:
    """The model of the column text of docs, of order 2 or 3."""
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    spark = docs.sparkSession
    folder = new_folder(spark, "kneser-ney")
    docs = docs.select(F.col("text").cast("string").alias("text"))
    bits = max(4, min(14, (docs.rdd.getNumPartitions() * 2 - 1).bit_length()))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, begins in _gathered(batches, RUN):
            keys, counts = np.unique(h, return_counts=True)
            yield from _runs((keys >> np.uint64(64 - bits)).astype(np.int64), keys, counts)
            yield from _runs(np.array([-1 - 1]), np.array([0], np.uint64), np.array([begins.sum()]))

    def merge_words(key: tuple, table: pa.Table) -> pa.Table:
        b = key[0].as_py()
        keys, counts = _merged(table)
        if b >= 0:
            write_file(f"{folder}/word-{b}", [keys.tobytes()])
            write_file(f"{folder}/sum-{b}", [np.concatenate([[0], np.cumsum(counts)]).astype(np.int64).tobytes()])
        return pa.table({"bucket": pa.array([b], pa.int32()), "words": pa.array([len(keys)], pa.int64()), "tokens": pa.array([int(counts.sum())], pa.int64())})

    runs = docs.mapInArrow(count_words, RUNS)
    got = {r.bucket: r for r in runs.groupBy("bucket").applyInArrow(merge_words, "bucket int, words long, tokens long").collect()}
    sizes = [got.get(b) for b in range(1 << bits)]
    model = Model(folder, order, bits, [r.words if r else 0 for r in sizes], [r.tokens if r else 0 for r in sizes], got[-2].tokens if -2 in got else 0)
    if model.v + 1 >= 1 << 32:
        raise ValueError("the vocabulary is too large for four-byte ids")
    model.ranges = max(1 << bits, min(MOST_RANGES, model.n // RANGE_TOKENS))

    def count_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, begins in _gathered(batches, RUN):
            word, one, two = model.neighbours(h, begins)
            pair, before, counts = _triples(model.pair_key(one, word), two, None, model.id_bits)
            first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
            edge = np.append(first, len(pair))
            ranges = model.ranges_of_keys(pair[first])
            cuts = np.flatnonzero(np.diff(ranges, prepend=-1))
            for a, z in zip(cuts, [*cuts[1:], len(first)], strict=True):
                part = slice(edge[a], edge[z])
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([int(ranges[a])], pa.int32()), "keys": [_pack(pair[first[a:z]])], "sizes": [_pack_counts(np.diff(edge[a : z + 1]))], "before": [_pack_counts(before[part])], "counts": [_pack_counts(counts[part])]})

    def merge_triples(key: tuple, table: pa.Table) -> pa.Table:
        r = key[0].as_py()
        unpacked = [np.repeat(_unpack(k), _unpack_counts(n)) for k, n in zip(table["keys"].to_pylist(), table["sizes"].to_pylist(), strict=True)]
        pair, before, counts = _triples(np.concatenate(unpacked), np.concatenate([_unpack_counts(x) for x in table["before"].to_pylist()]), np.concatenate([_unpack_counts(x) for x in table["counts"].to_pylist()]), model.id_bits)
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        context, word = (x.astype(np.int64) for x in np.divmod(pair[first], np.uint64(model.v + 1)))
        own = np.diff(np.append(first, len(pair)))
        plain = (context == model.v) | (order == 2)
        own[plain] = counts[first[plain]]  # these have one word before them
        start = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        kinds = np.stack([*(np.add.reduceat(x.astype(np.int64), start) for x in (own == 1, own == 2, own > 2)), np.add.reduceat(own, start)], 1)
        small, large = _capped(counts)
        for name, data in (("context", context[start].astype(np.uint32)), ("start", np.append(start, len(context)).astype(np.uint32)), ("next", word.astype(np.uint32)), ("first", np.append(first, len(pair)).astype(np.uint32)), ("before", before.astype(np.uint32)), ("kinds", kinds)):
            write_file(f"{folder}/{name}-{r}", [data.tobytes()])
        write_file(f"{folder}/count-{r}", [small])
        write_file(f"{folder}/large-{r}", [large])
        stats = [len(first), *_of_counts(own), *_of_counts(counts)]
        for i in sorted({0, len(start) - 1}):
            stats += [int(context[start[i]]), *kinds[i].tolist()]
        out = [{"kind": 0, "bucket": r, "stats": stats}]
        words, times = np.unique(word, return_counts=True)
        for batch in _runs(np.searchsorted(model.word_base, words, "right") - 1, words.astype(np.uint64), times):
            out += [{"kind": 1, **row} for row in batch.to_pylist()]
        if order > 2:
            # What this range knows of the contexts (before, context): nearly all there is, as most contexts lie in one range.
            double = model.pair_key(before, np.repeat(context, np.diff(np.append(first, len(pair)))))
            double, *sums = _summed(double, (counts == 1).astype(np.int64), (counts == 2).astype(np.int64), (counts > 2).astype(np.int64), counts)
            ranges = model.ranges_of_keys(double)
            cuts = np.flatnonzero(np.diff(ranges, prepend=-1))
            for a, z in zip(cuts, [*cuts[1:], len(double)], strict=True):
                out.append({"kind": 2, "bucket": int(ranges[a]), "keys": _pack(double[a:z]), "counts": _pack_counts(np.concatenate([x[a:z] for x in sums]))})
        return pa.Table.from_pylist(out, pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("stats", pa.list_(pa.int64()))]))

    triples = docs.mapInArrow(count_triples, "bucket int, keys binary, sizes binary, before binary, counts binary")
    merged = written(triples.groupBy("bucket").applyInArrow(merge_triples, "kind int, bucket int, keys binary, counts binary, stats array<long>"), "kneser-ney-pairs")
    of_pairs, of_triples = np.zeros(4, np.int64), np.zeros(4, np.int64)
    for r in merged.where("kind = 0").select("bucket", "stats").collect():  # a row for each range
        model.filled.append(r.bucket)
        model.pairs += r.stats[0]
        of_pairs += np.array(r.stats[1:5])
        of_triples += np.array(r.stats[5:9])
        for i in range(9, len(r.stats), 5):
            context, *kinds = r.stats[i : i + 5]
            model.edges[context] = tuple(np.add(model.edges.get(context, (0, 0, 0, 0)), kinds).tolist())

    def merge_doubles(key: tuple, table: pa.Table) -> pa.Table:
        r = key[0].as_py()
        keys = [_unpack(x) for x in table["keys"].to_pylist()]
        sums = [_unpack_counts(x).reshape(4, -1) for x in table["counts"].to_pylist()]
        double, *kinds = _summed(np.concatenate(keys), *np.concatenate(sums, axis=1))
        begin = np.zeros(4, np.int64)
        mark = np.uint64(model.v) * np.uint64(model.v + 1) + np.uint64(model.v)
        if len(double) and double[-1] == mark:  # a text's beginning is no pair
            begin = np.array([k[-1] for k in kinds])
            double, kinds = double[:-1], [k[:-1] for k in kinds]
        if r in set(model.filled):
            full = np.zeros((4, len(model.array(f"next-{r}", np.uint32))), np.int64)
            full[:, model._pairs_at(r, double)] = np.stack(kinds)
            small, large = _capped(full.ravel())
            write_file(f"{folder}/types-{r}", [small])
            write_file(f"{folder}/types-large-{r}", [large])
        return pa.table({"begin": pa.array([begin.tolist()], pa.list_(pa.int64()))})

    if order > 2:
        rows = merged.where("kind = 2").select("bucket", "keys", "counts").groupBy("bucket").applyInArrow(merge_doubles, "begin array<long>").collect()
        model.begin = tuple(np.sum([r.begin for r in rows], axis=0).tolist()) if rows else (0, 0, 0, 0)

    def merge_continuations(key: tuple, table: pa.Table) -> pa.Table:
        b = key[0].as_py()
        words, counts = _merged(table)
        full = np.zeros(model.words[b], np.int64)
        full[words.astype(np.int64) - model.word_base[b]] = counts
        write_file(f"{folder}/cont-{b}", [full.tobytes()])
        return pa.table({"n": pa.array([[*_of_counts(full), int((full > 0).sum())]], pa.list_(pa.int64()))})

    of_words = np.zeros(5, np.int64)
    for r in merged.where("kind = 1").select("bucket", "keys", "counts").groupBy("bucket").applyInArrow(merge_continuations, "n array<long>").collect():
        of_words += np.array(r.n)
    model.discounts = [discounts(n).tolist() for n in (of_words[:4], of_pairs, of_triples)]
    model.word_types = [int(of_words[0]), int(of_words[1]), int(of_words[4] - of_words[0] - of_words[1])]
    return model


_LOADED: dict[str, Model] = {}


def score(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df's columns keep with n_tokens, n_known, base_score and score (the model's log10 probability) of each whole text."""
    keep = [c for c in df.columns if c != text] if keep is None else keep
    fresh(keep, "n_tokens", "n_known", "base_score", "score")
    names = [f"c{i}" for i in range(len(keep))]
    inner = df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _LOADED.setdefault(model.folder, model)
        for batch in batches:
            texts, sums = batch.column("text"), []
            for a, b in pieces(texts, SCORED):
                h, first = token_hashes(texts.slice(a, b - a))
                begins = np.zeros(len(h), bool)
                begins[first[:-1]] = True
                p, base, known = m.log_probabilities(h, begins)
                sums.append([np.add.reduceat(x, first[:-1]) for x in (np.ones(len(h), np.int64), known.astype(np.int64), base, p)])
            got = [np.concatenate(x) for x in zip(*sums, strict=True)] if sums else [np.empty(0, np.int64)] * 2 + [np.empty(0)] * 2
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *map(pa.array, got)], [*names, "n_tokens", "n_known", "base_score", "score"])

    schema = inner.select(*names).schema.add("n_tokens", "long").add("n_known", "long").add("base_score", "double").add("score", "double")
    return inner.mapInArrow(run, schema).toDF(*keep, "n_tokens", "n_known", "base_score", "score")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: the remainder of crc32(doc_id as text) by 7 is 2 (a null id counts as "")."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2
