"""Toxicity by compression distance.

Two zstandard dictionaries are trained apart on whole windows, one of ordinary text and one of toxic text. A window is
compressed against each; the bytes that the toxic one saves are its distance. As both learn the common language, a second
distance weighs toxic text's own vocabulary: every word and phrase of two words that toxic documents have significantly more
often, and every word that holds a character n-gram they have so, in front of a smaller ordinary dictionary, against that
dictionary alone. A document's score is the calibrated probability, by a logistic regression on its windows' savings of both
kinds, with the labels' true proportions.

The fit uses at most FIT_DOCS[label] labelled documents of each label for the dictionaries, and of each at most FIT_WINDOWS
windows, chosen by a hash; and half as many other documents, whole, for the calibration, whose few features alone come to the
driver. The documents are chosen by a hash of their ids. Scoring takes all windows of every text.

Null and empty texts have no savings and get the score of a text without any. Repeated rows are scored alike. If
the labelled rows lack one of the labels, every score is the share of toxic labels (0 if there are none).
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .shared import fresh, written

#: Labelled documents for the dictionaries, by label.
FIT_DOCS = {1: 800, 0: 1600}
#: Windows of each that its dictionaries see at most.
FIT_WINDOWS = 128
WINDOW, GRAM = 24, 5
LEVEL = 12
#: Bytes of each dictionary of whole windows, and of the ordinary one behind the own words.
WHOLE_BYTES, ORDINARY_BYTES = 112 << 10, 16 << 10
#: A word, phrase or n-gram is toxic text's own from so many standard deviations on, and in so many documents.
WORD_DEVIATIONS, GRAM_DEVIATIONS, LEAST_DOCS = 5.0, 12.0, 3
#: Features of a text: four of each kind of distance.
_FEATURES = 8
THRESHOLD = 0.3


@dataclass
class Model:
    ordinary: bytes
    own: bytes
    whole: tuple[bytes, bytes]  # of ordinary windows, of toxic windows
    weights: list[float]
    scale: list[float]
    bias: float


def windows(text: str | None) -> list[bytes]:
    words = (text or "").lower().split()
    return [" ".join(words[i : i + WINDOW]).encode() for i in range(0, len(words), WINDOW)]


def _bare(text: str) -> list[str]:
    """Words without punctuation at their ends."""
    return [w for x in text.lower().split() if (w := x.strip(".,;:!?()\"'"))]


def _dictionary(size: int, samples: list[bytes]) -> bytes:
    """A trained dictionary; of too few samples for the trainer, their end."""
    try:
        return zstandard.train_dictionary(size, samples, k=24, d=6).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(samples)[-size:]


def _own_words(toxic: list[str], ordinary: list[str]) -> bytes:
    """All words and phrases that toxic texts have significantly more often, and their words that hold an n-gram they have so; the most significant last."""

    def features(texts: list[str]) -> Counter:
        out: Counter = Counter()
        for t in texts:
            words = _bare(t)
            out.update({f" {w} " for w in words} | {f" {v} {w} " for v, w in zip(words, words[1:], strict=False)} | {w[i : i + GRAM] for w in set(words) for i in range(len(w) - GRAM + 1)})
        return out

    there, here = features(ordinary), features(toxic)
    a, b = len(toxic), len(ordinary)

    def deviations(g: str) -> float:
        p = (here[g] + there[g]) / (a + b)
        return (here[g] / a - there[g] / b) / (math.sqrt(p * (1 - p) * (1 / a + 1 / b)) or 1)

    least = lambda g: WORD_DEVIATIONS if g[0] == " " else GRAM_DEVIATIONS
    own = {g: d for g, n in here.items() if n >= LEAST_DOCS and (d := deviations(g)) >= least(g)}
    rank = {g: d for g, d in own.items() if g[0] == " "}
    for w in {w for t in toxic for w in _bare(t)}:
        if held := [own[g] for g in (f" {w} ", *(w[i : i + GRAM] for i in range(len(w) - GRAM + 1))) if g in own]:
            rank[f" {w} "] = max(held)
    return "".join(sorted(rank, key=lambda g: (rank[g], g))).encode()


def _distinct(texts: list[str]) -> list[str]:
    """The texts without near copies of earlier ones, which would make their words look frequent."""
    seen: set[int] = set()
    out = []
    for t in texts:
        w = t.lower().split()
        least = set(sorted({zlib.crc32(" ".join(w[i : i + 5]).encode()) for i in range(max(1, len(w) - 4))})[:3])
        if not least & seen:
            out.append(t)
        seen |= least
    return out


class Scorer:
    """Features and scores of texts by one model; holds the compressors."""

    def __init__(self, model: Model):
        self.model = model
        self.plain, self.loaded = (self._compressor(d) for d in (model.ordinary, model.own + model.ordinary))
        self.whole = [self._compressor(d) for d in model.whole]

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        known = zstandard.ZstdCompressionDict(content or b"        ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)

    def features(self, text: str | None) -> list[float]:
        found = windows(text)
        return [x for one, other in ((self.plain, self.loaded), self.whole) for x in self._of([len(one.compress(w)) - len(other.compress(w)) for w in found])]

    @staticmethod
    def _of(saved: list[int]) -> list[float]:
        n = max(1, len(saved))
        return [sum(saved) / n, sum(s >= 2 for s in saved) / n, sum(s - 2 for s in saved if s > 2) / n, math.log1p(sum(s >= 3 for s in saved))]

    def score(self, text: str | None) -> float:
        m = self.model
        z = m.bias + sum(w * x / s for w, x, s in zip(m.weights, self.features(text), m.scale, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray, importance: np.ndarray, decay: float = 1e-3) -> np.ndarray:
    """Coefficients, the last of them the bias, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(x.shape[1])
    ridge = decay * importance.sum() * np.eye(len(beta))
    ridge[-1, -1] = 1e-9
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (importance * (y - p)) - ridge @ beta
        curve = (x * (importance * p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(curve, slope)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _uncalibrated(texts: dict[int, list[str]]) -> Model | None:
    """The dictionaries of ordinary texts (0) and toxic ones (1); None if one kind lacks."""
    by = {k: _distinct(texts[k]) for k in (0, 1)}
    if not by[0] or not by[1]:
        return None
    samples = {k: [w for t in by[k] for w in windows(t)] for k in by}
    whole = (_dictionary(WHOLE_BYTES, samples[0]), _dictionary(WHOLE_BYTES, samples[1]))
    return Model(_dictionary(ORDINARY_BYTES, samples[0]), _own_words(by[1], by[0]), whole, [0.0] * _FEATURES, [1.0] * _FEATURES, 0.0)


def _calibrated(model: Model | None, x: np.ndarray, y: np.ndarray, toxic: int, ordinary: int) -> Model:
    """The model with weights from features and labels; toxic and ordinary: how many of all labels are which."""
    share = toxic / max(1, toxic + ordinary)
    if model is None or not 0 < y.sum() < len(y):
        return Model(b"", b"", (b"", b""), [0.0] * _FEATURES, [1.0] * _FEATURES, math.log(max(share, 1e-12) / max(1 - share, 1e-12)))
    scale = np.maximum(x.std(0), 1e-6)
    importance = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    *weights, bias = _logistic(x / scale, y, importance).tolist()
    return Model(model.ordinary, model.own, model.whole, weights, scale.tolist(), bias)


def fit(dictionary: Sequence[tuple[str, int]], calibration: Sequence[tuple[str, int]], toxic: int, ordinary: int) -> Model:
    """The model of (text, label) rows; toxic and ordinary: how many of all labels are which."""
    model = _uncalibrated({k: [t for t, label in dictionary if label == k] for k in (0, 1)})
    scorer = Scorer(model) if model else None
    x = np.array([scorer.features(t) for t, _ in calibration] if scorer else [])
    return _calibrated(model, x, np.array([label for _, label in calibration], float), toxic, ordinary)


def _sampled(text: str | None) -> str:
    """At most FIT_WINDOWS windows of a text, in order, chosen by a hash."""
    found = windows(text)
    if len(found) > FIT_WINDOWS:
        chosen = sorted(range(len(found)), key=lambda i: zlib.crc32(found[i] + b"%d" % i))[:FIT_WINDOWS]
        found = [found[i] for i in sorted(chosen)]
    return b" ".join(found).decode()


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of docs (doc_id, text) that labels (doc_id, toxic) marks; rows without a label don't count."""
    labels = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r["count"] for r in labels.groupBy("toxic").count().collect()}
    order = F.xxhash64("doc_id")
    chosen = [labels.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(n + n // 2) for k, n in FIT_DOCS.items()]
    chosen = chosen[0].unionByName(chosen[1])  # at most FIT_DOCS and half as many again
    chosen = chosen.withColumn("place", F.row_number().over(Window.partitionBy("toxic").orderBy(order, "doc_id")) - 1)
    # A document that is there several times counts once, by its least text.
    got = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic", "place").agg(F.min("text").alias("text"))
    got = written(got.select("toxic", "place", "text"), "toxicity-labelled")
    learns = F.col("place") % 3 < 2

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.set_column(2, "text", pa.array([_sampled(t) for t in batch.column("text").to_pylist()], pa.string()))

    texts: dict[int, list[str]] = {0: [], 1: []}
    for r in got.where(learns).mapInArrow(sampled, got.schema).orderBy("toxic", "place").collect():  # at most the sum of FIT_DOCS rows of FIT_WINDOWS windows
        texts[r.toxic].append(r.text)
    model = _uncalibrated(texts)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            x = [scorer.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("place"), pa.array(x, pa.list_(pa.float64()))], ["toxic", "place", "x"])

    rows = got.where(~learns).mapInArrow(featured, "toxic int, place int, x array<double>").orderBy("toxic", "place").collect() if model else []
    return _calibrated(model, np.array([r.x for r in rows]), np.array([r.toxic for r in rows], float), counts.get(1, 0), counts.get(0, 0))


def _with_scores(df: DataFrame, model: Model, text: str, schema: StructType, finish: Callable[[pa.RecordBatch, list[float]], pa.RecordBatch]) -> DataFrame:
    names = [f"c{i}" for i in range(len(df.columns))]
    at = names[df.columns.index(text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            yield finish(batch, [scorer.score(t) for t in batch.column(at).to_pylist()])

    return df.toDF(*names).mapInArrow(run, schema)


def scored(df: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """df with the toxicity score of each whole text. A column that is already called so raises ValueError."""
    fresh(df.columns, into)
    names = [f"c{i}" for i in range(len(df.columns))]
    schema = StructType([*df.toDF(*names).schema.fields, StructField("score", DoubleType())])
    add = lambda batch, got: pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], [*names, "score"])
    return _with_scores(df, model, text, schema, add).toDF(*df.columns, into)


def below(df: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df whose score is less than the threshold, as they are, whatever their columns are called."""
    schema = df.toDF(*(f"c{i}" for i in range(len(df.columns)))).schema
    keep = lambda batch, got: batch.filter(pa.array([s < threshold for s in got], pa.bool_()))
    return _with_scores(df, model, text, schema, keep).toDF(*df.columns)


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: the remainder of crc32(doc_id as text) by 4 is 2 (a null id counts as "")."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2
