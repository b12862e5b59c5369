"""PNG images as arrays, grey and saturation, and the dominant colour."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from binmap.functions.colors import BACKGROUND, OUTLINE

_MAGIC = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel by PNG colour type.
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def decode(data: bytes | None) -> np.ndarray | None:
    """RGB (h, w, 3) of a PNG of eight-bit samples, without alpha; None for anything else."""
    if not data or bytes(data[:8]) != _MAGIC:
        return None
    try:
        at, packed, palette, head = 8, [], None, None
        while at < len(data):
            size, kind = struct.unpack(">I4s", data[at : at + 8])
            body = data[at + 8 : at + 8 + size]
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", body)
            elif kind == b"PLTE":
                palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
            elif kind == b"IDAT":
                packed.append(body)
            at += 12 + size
        w, h, depth, kind, _, _, interlaced = head
        if depth != 8 or interlaced or kind not in _SAMPLES or not w or not h:
            return None
        n = _SAMPLES[kind]
        rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(h, 1 + w * n)
        pixels = _unfiltered(rows[:, 0], rows[:, 1:], n).reshape(h, w, n)
        if kind == 3:
            return palette[pixels[:, :, 0]]
        return np.ascontiguousarray(np.repeat(pixels[:, :, :1], 3, axis=2) if n < 3 else pixels[:, :, :3])
    except (struct.error, zlib.error, ValueError, TypeError, IndexError):
        return None


def _unfiltered(kinds: np.ndarray, rows: np.ndarray, step: int) -> np.ndarray:
    """PNG's row filters undone: none, left, up, mean, Paeth."""
    out = np.zeros_like(rows)
    above = np.zeros(rows.shape[1], np.uint8)
    for y, kind in enumerate(kinds):
        row = rows[y].copy()
        if kind == 1:
            row = np.cumsum(row.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            row = row + above
        elif kind in (3, 4):
            left, corner = np.zeros(step, int), np.zeros(step, int)
            for x in range(0, len(row), step):
                up = above[x : x + step].astype(int)
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    a, b, c = abs(p - left), abs(p - up), abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                left, corner = (row[x : x + step] + guess) % 256, up
                row[x : x + step] = left
        elif kind != 0:
            raise ValueError("an unknown row filter")
        out[y] = above = row
    return out


def encode(pixels: np.ndarray) -> bytes:
    """A PNG of a grey (h, w) or RGB (h, w, 3) array."""
    h, w = pixels.shape[:2]
    rows = np.ascontiguousarray(pixels, np.uint8).reshape(h, -1)
    raw = np.concatenate([np.zeros((h, 1), np.uint8), rows], axis=1).tobytes()
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return _MAGIC + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if pixels.ndim == 3 else 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw, 6)) + part(b"IEND", b"")


def grey(rgb: np.ndarray) -> np.ndarray:
    """Luma of the usual weights, in integers."""
    # 0.299, 0.587 and 0.114 in 2**14ths.
    r, g, b = (rgb[:, :, i].astype(np.int32) for i in range(3))
    return ((r * 4899 + g * 9617 + b * 1868 + 8192) >> 14).astype(np.uint8)


def saturation(rgb: np.ndarray) -> np.ndarray:
    """Saturation from 0 to 255, as of HSV."""
    high, low = rgb.max(axis=2).astype(np.float64), rgb.min(axis=2)
    return np.rint(np.where(high > 0, 255 * (high - low) / np.maximum(high, 1), 0)).astype(np.uint8)


def dominant(rgb: np.ndarray) -> tuple[int, int, int]:
    """As functions.colors.dominant(), of one image."""
    pixels = rgb.reshape(-1, 3).astype(np.int64)
    inner = pixels[~(pixels.min(axis=1) > BACKGROUND) & ~(pixels.max(axis=1) < OUTLINE)]
    if not len(inner):
        return tuple(np.rint(np.median(pixels, axis=0)).astype(int).tolist())
    code = (inner >> 4) @ np.array([256, 16, 1])
    counts = np.bincount(code)
    return tuple(np.rint(inner[code == counts.argmax()].mean(axis=0)).astype(int).tolist())
