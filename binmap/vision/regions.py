"""Connected regions of masks: blobs that can be seen from outside, and holes."""

from __future__ import annotations

import numpy as np


def labels(mask: np.ndarray, corners: bool) -> tuple[np.ndarray, int]:
    """Numbers from 1 on of the connected regions of a mask, 0 elsewhere; corners: pixels that touch by a corner are connected.

    Runs of a row are the nodes; overlapping runs of neighbouring rows are joined by least roots.
    """
    h, w = mask.shape
    edges = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edges == 1)
    _, stop = np.nonzero(edges == -1)
    n = len(row)
    if not n:
        return np.zeros((h, w), np.int32), 0
    first = np.searchsorted(row, np.arange(h + 1))
    reach = 1 if corners else 0
    ones, twos = [], []
    for y in range(1, h):
        a, b, c = first[y - 1], first[y], first[y + 1]
        if a == b or b == c:
            continue
        low = np.searchsorted(stop[a:b], start[b:c] + 1 - reach) + a
        high = np.searchsorted(start[a:b], stop[b:c] - 1 + reach, "right") + a
        many = np.maximum(high - low, 0)
        ones.append(np.repeat(np.arange(b, c), many))
        twos.append(np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()))
    root = np.arange(n)
    if ones:
        one, two = np.concatenate(ones), np.concatenate(twos)
        while True:
            least = np.minimum(root[one], root[two])
            before = root.copy()
            np.minimum.at(root, root[one], least)
            np.minimum.at(root, root[two], least)
            root = root[root]
            if np.array_equal(root, before):
                break
    _, number = np.unique(root, return_inverse=True)
    marks = np.zeros((h, w + 1), np.int64)
    marks[row, start] += number + 1
    marks[row, stop] -= number + 1
    return np.cumsum(marks, axis=1)[:, :w].astype(np.int32), int(number.max()) + 1


def boxes(numbers: np.ndarray, n: int) -> np.ndarray:
    """(x, y, w, h, pixels) of each region, in order."""
    if not n:
        return np.empty((0, 5), np.int64)
    y, x = np.nonzero(numbers)
    k = numbers[y, x] - 1
    low = lambda v: np.minimum.reduceat(v[order], edge)
    high = lambda v: np.maximum.reduceat(v[order], edge)
    order = np.argsort(k, kind="stable")
    edge = np.searchsorted(k[order], np.arange(n))
    left, top = low(x), low(y)
    return np.stack([left, top, high(x) - left + 1, high(y) - top + 1, np.bincount(k, minlength=n)], axis=1)


def _outside(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Numbers of the background's regions with a margin of one pixel, how many there are, and the outer one's number."""
    numbers, n = labels(~np.pad(mask, 1), corners=False)
    return numbers, n, int(numbers[0, 0])


def blobs(mask: np.ndarray) -> np.ndarray:
    """(x, y, w, h, pixels) of the regions that touch the outer background: those inside a closed ring don't count."""
    numbers, n = labels(mask, corners=True)
    back, _, outer = _outside(mask)
    out = back == outer
    near = out[:-2, 1:-1] | out[2:, 1:-1] | out[1:-1, :-2] | out[1:-1, 2:]
    seen = np.unique(numbers[near & mask])
    found = boxes(numbers, n)
    return found[seen - 1] if len(seen) else found[:0]


def holes(mask: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """(x, y, w, h, area) of the ink around each region of enclosed background: the box of the ink's inner edge and the area within it.

    The edge is a polygon through the centres of the ink pixels that border the hole; by Pick's theorem its area is the hole's
    pixels, plus half of the edge's, less one.
    """
    back, n, outer = _outside(mask)
    out = []
    for k, (x, y, w, h, pixels) in enumerate(boxes(back, n).tolist(), 1):
        if k == outer:
            continue
        inner = np.pad(back[y : y + h, x : x + w] == k, 1)
        edge = np.zeros_like(inner)
        edge[1:] |= inner[:-1]
        edge[:-1] |= inner[1:]
        edge[:, 1:] |= inner[:, :-1]
        edge[:, :-1] |= inner[:, 1:]
        border = int((edge & ~inner).sum())
        out.append((x - 2, y - 2, w + 2, h + 2, pixels + border / 2 - 1))  # less the margin and one pixel of ink
    return out
