"""A small embedding of images, trained with triplets: fixed features of a thumbnail, and a linear map with a margin loss.

Deep encoders need libraries that are absent here; they plug in as any function from a list of images to vectors
(operators.matching.embedded). This one is trained on the driver, on a set of crops that is bounded by MOST_CROPS.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np

from binmap.vision import images

#: Crops that a model is trained from at most; pixels of a thumbnail's side.
MOST_CROPS, SIDE = 20_000, 16
#: Margin, rate of learning, length of vectors, epochs at most, and epochs without a better one before the end.
MARGIN, RATE, LENGTH, EPOCHS, PATIENCE = 0.3, 1e-4, 256, 40, 6


def features(data: bytes | None) -> np.ndarray:
    """A thumbnail's colours and how they change, centred; zeros for an image that can't be read."""
    rgb = images.decode(data)
    if rgb is None:
        return np.zeros(3 * SIDE * SIDE + 2 * SIDE * SIDE)
    rows, columns = (np.linspace(0, n, SIDE + 1).astype(int) for n in rgb.shape[:2])
    cell = lambda a, b: slice(a, max(b, a + 1))
    small = np.array([[rgb[cell(a, b), cell(c, d)].reshape(-1, 3).mean(axis=0) for c, d in zip(columns, columns[1:], strict=False)] for a, b in zip(rows, rows[1:], strict=False)]) / 255
    light = small.mean(axis=2)
    down, along = np.diff(light, axis=0, append=light[-1:]), np.diff(light, axis=1, append=light[:, -1:])
    return np.concatenate([(small - 0.5).ravel(), 2 * down.ravel(), 2 * along.ravel()])


@dataclass
class Model:
    """Vectors of unit length for images; zeros stay zero."""

    weights: np.ndarray

    def __call__(self, batch: list[bytes | None]) -> np.ndarray:
        x = np.stack([features(b) for b in batch]) @ self.weights if batch else np.empty((0, self.weights.shape[1]))
        length = np.linalg.norm(x, axis=1, keepdims=True)
        return (x / np.where(length == 0, 1, length)).astype(np.float32)

    def save(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, weights=self.weights.astype(np.float32))
        return out.getvalue()

    @staticmethod
    def restore(data: bytes) -> Model:
        return Model(np.load(io.BytesIO(data))["weights"].astype(np.float64))


def accuracy(model: Model, train: list[tuple[str, bytes]], held: list[tuple[str, bytes]]) -> float | None:
    """How many held-out crops have a crop of their own part as the nearest one; None without any."""
    if not held or not train:
        return None
    near = (model([b for _, b in held]) @ model([b for _, b in train]).T).argmax(axis=1)
    return float(np.mean([train[k][0] == p for k, (p, _) in zip(near, held, strict=True)]))


def _triplets(parts: list[str], vectors: np.ndarray, n: int, rng: np.random.Generator, semihard: bool) -> np.ndarray:
    """Places of anchors, positives and negatives: those just beyond the positive, else the nearest; or any, if not semihard."""
    kinds = np.array(parts)
    many = [np.flatnonzero(kinds == p) for p in sorted(set(parts))]
    many = [m for m in many if len(m) >= 2]
    if len(many) < 2 or n <= 0:
        return np.empty((0, 3), int)
    out = []
    for _ in range(n):
        anchor, positive = rng.choice(many[rng.integers(len(many))], 2, replace=False)
        others = np.flatnonzero(kinds != kinds[anchor])
        if semihard:
            far = np.linalg.norm(vectors[others] - vectors[anchor], axis=1)
            pos = np.linalg.norm(vectors[positive] - vectors[anchor])
            band = (far > pos) & (far < pos + MARGIN)
            negative = others[np.where(band, far, np.inf).argmin()] if band.any() else others[far.argmin()]
        else:
            negative = others[rng.integers(len(others))]
        out.append((anchor, positive, negative))
    return np.array(out)


def train(crops: list[tuple[str, bytes]], held: list[tuple[str, bytes]], length: int = LENGTH, epochs: int = EPOCHS, per_epoch: int = 200, batch: int = 16, patience: int = PATIENCE, rate: float = RATE, seed: int = 0, mining: str = "semihard") -> tuple[Model, list[dict]]:
    """A model from (part_num, content) crops, and a row of metrics for each epoch. The epoch of the best accuracy on held-out crops is kept, of
    equal ones the first; without any the last one is. ValueError if no triplet can be formed."""
    if len(crops) > MOST_CROPS:
        raise ValueError(f"at most {MOST_CROPS} crops, please")
    if mining not in ("semihard", "random"):
        raise ValueError(f"no such mining: {mining}")
    rng = np.random.default_rng(seed)
    x, parts = np.stack([features(b) for _, b in crops]) if crops else np.empty((0, 5 * SIDE * SIDE)), [p for p, _ in crops]
    # Random projections keep distances; training goes on from there.
    w = rng.normal(size=(5 * SIDE * SIDE, length)) / np.sqrt(length)
    first, second, step = np.zeros_like(w), np.zeros_like(w), 0
    best, metrics, since = (-1.0, w), [], 0
    for epoch in range(epochs):
        chosen = _triplets(parts, Model(w)([b for _, b in crops]) if mining == "semihard" else x, per_epoch, rng, mining == "semihard")
        if not len(chosen):
            raise ValueError("triplets need two parts with two crops each")
        losses = []
        for k in range(0, len(chosen), batch):
            a, p, n = (x[chosen[k : k + batch, i]] for i in range(3))
            da, dn = (a - p) @ w, (a - n) @ w
            near, far = np.linalg.norm(da, axis=1) + 1e-9, np.linalg.norm(dn, axis=1) + 1e-9
            loss = np.maximum(near - far + MARGIN, 0)
            losses.append(loss.mean())
            on = (loss > 0)[:, None] / len(loss)
            slope = (a - p).T @ (on * da / near[:, None]) - (a - n).T @ (on * dn / far[:, None])
            step += 1
            first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
            w = w - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        got = accuracy(Model(w), crops, held)
        metrics.append({"epoch": epoch, "loss": float(np.mean(losses)), "accuracy": got})
        if got is None or got > best[0]:
            best, since = (got if got is not None else -1.0, w), 0
        else:
            since += 1
            if since >= patience:
                break
    return Model(best[1]), metrics
