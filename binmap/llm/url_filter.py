"""URL filters: host and path rules, then logistic regression on hashed character n-grams.

A rule names a host (with all its subdomains) and a prefix of the path; the longest rule that fits decides.
Urls that no rule fits get the verdict of a logistic regression whose features are hashed character (UTF-8 byte) n-grams
of host and path, trained on a small labelled table of urls.

Null urls and urls without "://" have an empty host and path: no rule fits, and the model sees no n-grams but the
ends. Repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .shared import fresh
from .words import buffers, mix

SIZES, BUCKETS = (3, 4, 5), 1 << 15
#: Rules become one expression; more need a table of their own.
MOST_RULES = 500
#: Labelled urls that a model may be trained from.
MOST_LABELS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(h: Column, p: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule (action, host, path) that fits, as text, and its action; null if none fits. Of equal lengths the first counts."""
    if not rules or len(rules) > MOST_RULES:
        raise ValueError(f"1 to {MOST_RULES} rules, please")
    text = action = F.lit(None).cast("string")
    for verdict, rule_host, rule_path in reversed(sorted(rules, key=lambda r: -len(r[1] + r[2]))):
        fits = ((h == rule_host) | h.endswith("." + rule_host)) & p.startswith(rule_path)
        text = F.when(fits, F.lit(rule_host + rule_path)).otherwise(text)
        action = F.when(fits, F.lit(verdict)).otherwise(action)
    return text, action


def features(hosts: pa.Array, paths: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows and buckets of the distinct byte n-grams of hosts and paths, with their ends marked; each pair once, by row. Nulls are empty."""
    found = []
    for kind, texts in enumerate((hosts, paths), 1):
        marked = pc.binary_join_element_wise("^", pc.fill_null(texts.cast(pa.string()), ""), "$", "")
        data, offsets = buffers(marked)
        letters = mix(data.astype(np.uint64) + np.uint64(kind << 8))
        row = np.repeat(np.arange(len(marked)), np.diff(offsets))
        for n in SIZES:
            with np.errstate(over="ignore"):
                h = np.zeros(max(0, len(data) - n + 1), np.uint64)
                for i in range(n):
                    h = mix(h + letters[i : i + len(h)])
            inside = row[: len(h)] == row[n - 1 :] if len(h) else np.empty(0, bool)
            found.append(row[: len(h)][inside] * BUCKETS + (h[inside] % np.uint64(BUCKETS)).astype(np.int64))
    return np.divmod(np.unique(np.concatenate(found)), BUCKETS)


def scores(hosts: pa.Array, paths: pa.Array, model: tuple[np.ndarray, float]) -> np.ndarray:
    """The model's probability for each pair of host and path."""
    weights, bias = model
    row, bucket = features(hosts, paths)
    n = np.bincount(row, minlength=len(hosts))
    z = np.bincount(row, weights[bucket], len(hosts)) / np.sqrt(np.maximum(1, n)) + bias
    return 1 / (1 + np.exp(-z))


def fit(labelled: Sequence[tuple[str, str, int]], rounds: int = 500, rate: float = 20.0, decay: float = 2e-5) -> tuple[np.ndarray, float]:
    """Weights and bias from (host, path, 1 to block or 0 to allow), by full-batch gradient descent; both labels weigh the same in all, and the same rows give the same weights."""
    if not labelled or len(labelled) > MOST_LABELS:
        raise ValueError(f"1 to {MOST_LABELS} labelled urls, please")
    y = np.array([label for *_, label in labelled], float)
    at, cols = features(pa.array([h for h, *_ in labelled]), pa.array([p for _, p, _ in labelled]))
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(at, minlength=len(y))))
    share = y.mean() or 1.0
    importance = np.where(y == 1, 0.5 / share, 0.5 / max(1 - share, 1e-9)) / len(y)
    weights, bias = np.zeros(BUCKETS), 0.0
    for _ in range(rounds):
        z = np.bincount(at, weights[cols], len(y)) * scale + bias
        error = (1 / (1 + np.exp(-z)) - y) * importance
        weights -= rate * (np.bincount(cols, (error * scale)[at], BUCKETS) + decay * weights)
        bias -= rate * error.sum()
    return weights, float(bias)


def with_probability(df: DataFrame, host_col: str, path_col: str, model: tuple[np.ndarray, float], into: str = "block_score") -> DataFrame:
    """df with the model's probability (0 to 1) that the url is to be blocked."""
    fresh(df.columns, into)
    names = [f"c{i}" for i in range(len(df.columns))]
    plain = df.toDF(*names)
    h, p = names[df.columns.index(host_col)], names[df.columns.index(path_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = scores(batch.column(h), batch.column(p), model)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got)], [*names, "score"])

    return plain.mapInArrow(run, StructType([*plain.schema.fields, StructField("score", DoubleType())])).toDF(*df.columns, into)
