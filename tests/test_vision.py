import numpy as np
import pytest

from binmap.operators import training
from binmap.vision import detection, images, regions, rendering


def blank(h=800, w=1000):
    return np.full((h, w, 3), 255, np.uint8)


def rect(page, x, y, w, h, colour):
    page[y : y + h, x : x + w] = colour
    return page


def ring(page, x, y, w, h, colour, width):
    rect(page, x, y, w, h, colour)
    return rect(page, x + width, y + width, w - 2 * width, h - 2 * width, 255)


def cells(n):
    page = blank()
    for i in range(n):
        rect(page, 40 + 150 * (i % 6), 40 + 100 * (i // 6), 101, 71, 220)
    return page


def stamped(page, text, x, y, size):
    font = detection.glyph_templates()
    for c in text:
        glyph = np.kron(font["0123456789x".index(c)], np.ones((size, size), bool)).astype(bool)
        y0 = y + 7 * size - len(glyph)
        page[y0 : y0 + len(glyph), x : x + glyph.shape[1]][glyph] = 0
        x += glyph.shape[1] + size
    return page


def detect(spark, *pages, **options):
    rows = [(1, i, bytearray(p if isinstance(p, bytes) else images.encode(p))) for i, p in enumerate(pages)]
    df = spark.createDataFrame(rows, "scan_id long, page_index long, content binary")
    return detection.detections(df, **options)


def test_png_round_trip_and_filters():
    rng = np.random.default_rng(1)
    rgb = rng.integers(0, 256, (13, 17, 3), np.uint8)
    assert (images.decode(images.encode(rgb)) == rgb).all() and (images.decode(images.encode(rgb[:, :, 0]))[:, :, 2] == rgb[:, :, 0]).all()
    assert images.decode(b"no image") is None and images.decode(None) is None and images.decode(images.encode(rgb)[:60]) is None
    import struct
    import zlib

    h, w = rgb.shape[:2]
    flat, raw = rgb.reshape(h, -1).astype(int), bytearray()
    for y in range(h):
        kind = y % 5
        raw.append(kind)
        for x in range(3 * w):
            a, b, c = flat[y][x - 3] if x >= 3 else 0, flat[y - 1][x] if y else 0, flat[y - 1][x - 3] if y and x >= 3 else 0
            p = a + b - c
            paeth = min(((abs(p - v), i, v) for i, v in enumerate((a, b, c))))[2]
            raw.append((flat[y][x] - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
    plain = images.encode(rgb)
    at = plain.index(b"IDAT") - 4
    body = zlib.compress(bytes(raw))
    made = plain[:at] + struct.pack(">I", len(body)) + b"IDAT" + body + b"\0\0\0\0" + plain[-12:]
    assert (images.decode(made) == rgb).all()


def test_regions_against_flood_fill():
    rng = np.random.default_rng(5)
    for corners in (True, False):
        for _ in range(20):
            mask = rng.random((14, 19)) < 0.5
            numbers, n = regions.labels(mask, corners)
            seen, groups = np.zeros(mask.shape, int), 0
            steps = [(0, 1), (0, -1), (1, 0), (-1, 0)] + [(a, b) for a in (-1, 1) for b in (-1, 1)] * corners
            for y, x in zip(*np.nonzero(mask), strict=True):
                if seen[y, x]:
                    continue
                groups += 1
                todo = [(y, x)]
                seen[y, x] = groups
                while todo:
                    a, b = todo.pop()
                    for i, j in steps:
                        if 0 <= a + i < 14 and 0 <= b + j < 19 and mask[a + i, b + j] and not seen[a + i, b + j]:
                            seen[a + i, b + j] = groups
                            todo.append((a + i, b + j))
            assert n == groups and len(set(zip(seen.ravel(), numbers.ravel(), strict=True))) == n + (~mask).any()


def test_blobs_and_holes():
    mask = np.zeros((40, 50), bool)
    mask[5:30, 5:40] = True
    mask[8:27, 8:37] = False
    mask[12:15, 12:15] = True  # inside the ring, so it can't be seen
    assert regions.blobs(mask)[:, :4].tolist() == [[5, 5, 35, 25]]
    mask[12:15, 12:15] = False
    assert [h[:4] for h in regions.holes(mask)] == [(7, 7, 31, 21)] and regions.holes(mask)[0][4] == 30 * 20 - 2
    assert len(regions.blobs(np.zeros((3, 3), bool))) == 0


def test_panels_and_parts_lists(spark):
    bordered = ring(blank(), 300, 200, 200, 100, 0, 3)
    got = detect(spark, cells(12), cells(11), bordered, blank(), b"broken").orderBy("page_index").collect()
    assert [len(r.panels) for r in got] == [12, 11, 1, 0, 0] and [r.is_parts_list for r in got] == [True, False, False, False, False]
    assert (got[0].panels[0].x, got[0].panels[0].y, got[0].panels[0].w, got[0].panels[0].h) == (40, 40, 101, 71)
    assert abs(got[2].panels[0].w - 196) <= 2 and not any(r.candidate for r in got)


def test_numerals(spark):
    solid = rect(blank(), 300, 400, 181, 261, 0)
    two = rect(rect(blank(), 300, 400, 71, 261, 0), 385, 400, 71, 261, 0)
    coloured = rect(blank(), 300, 400, 180, 260, (80, 0, 0))
    hairline = rect(blank(), 300, 300, 4, 300, 0)
    wide = rect(blank(), 100, 400, 500, 150, 0)
    hollow = ring(blank(), 300, 300, 180, 180, 0, 6)
    in_panel = rect(rect(blank(), 200, 300, 300, 250, 220), 300, 350, 100, 150, 0)
    got = detect(spark, solid, two, coloured, hairline, wide, hollow, in_panel).orderBy("page_index").collect()
    assert [r.candidate for r in got] == [True, True, False, False, False, False, False]
    assert tuple(got[1].numeral) == (300, 400, 156, 261)
    read = detect(spark, solid, blank(), read=lambda crop: " 12 " if crop.shape[0] == 261 else "x").orderBy("page_index").collect()
    assert [(r.bag_marker, r.candidate) for r in read] == [(12, False), (None, False)]


def test_callouts_read_their_labels(spark):
    page = rect(blank(), 100, 100, 380, 140, 220)
    rect(page, 150, 115, 120, 60, (201, 26, 9))
    stamped(page, "12x", 120, 195, 5)
    found = detect(spark, page, cells(2))
    got = detection.callouts(found, ["scan_id", "page_index"], detection.DigitReader()).orderBy("page_index", "callout_pos").collect()
    assert [(r.page_index, r.callout_pos, r.quantity) for r in got] == [(0, 0, 12), (1, 0, 1), (1, 1, 1)]
    assert images.decode(bytes(got[0].crop)).shape == (140, 380, 3) and tuple(got[0].bbox) == (100, 100, 380, 140)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 35])
def test_digit_reader(n):
    page = stamped(np.full((140, 380, 3), 220, np.uint8), f"{n}x", 20, 85, 6)
    assert detection.DigitReader()(page) == f"{n}x"


def test_digit_reader_leaves_other_ink_alone():
    assert detection.DigitReader()(np.full((140, 380, 3), 220, np.uint8)) == ""
    assert detection.DigitReader()(rect(np.full((140, 380, 3), 220, np.uint8), 50, 20, 80, 110, 0)) == ""


def test_overlays_and_stats(spark):
    found = detect(spark, cells(3), b"broken")
    drawn = detection.overlays(found, ["scan_id", "page_index"]).orderBy("page_index").collect()
    assert tuple(images.decode(bytes(drawn[0].overlay))[41, 41]) == (0, 160, 0) and drawn[1].overlay is None
    assert images.decode(bytes(drawn[0].mask))[60, 60, 0] == 255
    one, two = detection.stats(found, ["scan_id", "page_index"]).orderBy("page_index").collect()
    assert one.n_callouts == 3 and abs(one.area_median - 101 * 71 / 800_000) < 1e-9 and two.n_callouts == 0 and two.area_min is None


def test_icons(spark):
    quad = "4 16 0 0 0 20 0 0 20 20 0 0 20 0"
    text = {"3001.dat": [quad, "4 16 0 0 0 0 0 10 20 0 10 20 0 0", "2 24 0 0 0 20 0 0"]}
    lines = spark.createDataFrame([(r, x) for r, rows in text.items() for x in rows], "ref string, line string")
    parts = spark.createDataFrame([(0, "3001pr1", "Red"), (1, "3001pr1", "Blue"), (2, "9", "Red"), (3, "", None)], "inv_seq long, part_num string, color_name string")
    refs = training.part_references(parts, spark.createDataFrame([("3001.dat", "parts/3001.dat")], "ref string, path string"))
    shapes = training.geometry(lines, refs.where("ref is not null").select("ref"))
    got = rendering.training_images(parts, shapes, refs).orderBy("view").collect()
    assert [(r.part_num, r.view) for r in got] == [("3001pr1", 0), ("3001pr1", 1), ("3001pr1", 2)]
    drawn = images.decode(bytes(got[0].content))
    inner = drawn[(drawn != 255).any(axis=2)]
    assert drawn.shape == (224, 224, 3) and len(inner) > 3000 and (inner[:, 0] >= inner[:, 1]).all() and (drawn[0] == 255).all()
    assert rendering.training_images(parts, shapes, refs, only=["9"]).count() == 0
    assert rendering.icon(np.empty((0, 3, 3)), np.empty((0, 2, 3)), (1, 2, 3), 0, 0) is None
