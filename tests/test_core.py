"""The cases of FIXTURES.md as small tables."""

import csv
import io
import json

import pytest
from pyspark.sql import functions as F

from binmap.functions import colors
from binmap.functions import columns as C
from binmap.operators import boxes, locating, matching, segments, training, viewing
from binmap.plans import sinks
from binmap.sources import files, stores

PAGE = "scan_id long, page_index long, bag_marker long, candidate boolean, is_parts_list boolean"
CALLOUT = "scan_id long, page_index long, callout_pos int, quantity long, color string, shape_desc string, printed_part_id string"
INVENTORY = "inv_seq long, part_num string, name string, color_id int, color_name string, quantity long, element_id string, image_url string"
LINES = [(0, "3001", "Brick 2 x 4", 5, "Red", 4, "300121", None), (1, "3020", "Plate 2 x 4", 0, "Black", 2, "302026", None)]


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def pages(spark, markers, lists=(), candidates=()):
    return table(spark, [(1, i, m, i in candidates, i in lists) for i, m in enumerate(markers)], PAGE)


def callouts(spark, rows):
    return table(spark, [(1, *r) for r in rows], CALLOUT)


def scan(spark, markers, rows, lines=None, lists=()):
    inventory = None if lines is None else table(spark, lines, INVENTORY)
    parts, bags, warnings = locating.scan_extracts(pages(spark, markers, lists), callouts(spark, rows), inventory)
    listed = [r.asDict(recursive=True) for r in parts.withColumn("ord", locating.part_order()).orderBy("ord").collect()]
    return listed, [r.message for r in warnings.orderBy("phase", "ord").collect()]


def test_printed_ids_and_words(spark):
    wanted = callouts(spark, [(0, 0, 1, None, None, " 300121 "), (0, 1, 1, "red", "2 x 4 brick", None), (0, 2, 1, "blue", "dome", "3020"), (0, 3, 1, "pink", "dome", None), (0, 4, 1, "black color", None, None)])
    got = {(r.color, r.printed_part_id): (r.inv_seq, r.score) for r in matching.best_lines(wanted, table(spark, LINES, INVENTORY)).collect()}
    assert got == {(None, " 300121 "): (0, 1.0), ("red", None): (0, 0.9), ("blue", "3020"): (1, 0.95), ("black color", None): (1, 0.5)}
    with pytest.raises(ValueError):
        matching.theta_match(wanted, table(spark, LINES, INVENTORY), 0.0)


def test_two_bags_agree(spark):
    parts, warnings = scan(spark, [1, 2], [(0, 0, 2, "red", "2x4 brick", None), (1, 0, 2, "red", "2x4 brick", None)], LINES)
    (p,) = parts
    assert (p["key"], p["part_num"], p["total_seen"], p["bags"], p["pages"], p["count_matches"], p["confidence"], p["reconciled"]) == ("3001|5", "3001", 4, [1, 2], [0, 1], True, 0.9, True)
    assert p["occurrences"] == [{"bag": 1, "page_index": 0, "quantity": 2}, {"bag": 2, "page_index": 1, "quantity": 2}] and not warnings


def test_mismatch_vision_only_and_parts_lists(spark):
    parts, warnings = scan(spark, [1, None], [(0, 0, 1, "red", "brick 2 x 4", None), (1, 0, 99, "red", "brick 2 x 4", None)], LINES, lists=(1,))
    assert (parts[0]["total_seen"], parts[0]["count_matches"], parts[0]["confidence"]) == (1, False, 0.6)
    assert warnings == ["Count mismatch for Brick 2 x 4: saw 1 in pages, inventory has 4."]
    parts, warnings = scan(spark, [1], [(0, 0, 3, "blue", "1x2 plate", None), (0, 1, 1, "Blue", "1x2 Plate", None)])
    assert [(p["key"], p["name"], p["total_seen"], p["bags"], p["confidence"], p["reconciled"], p["count_matches"]) for p in parts] == [("vision:blue|1x2 plate", "1x2 plate", 4, [1], 0.4, False, None)]
    # an empty inventory matches nothing
    assert scan(spark, [1], [(0, 0, 3, "blue", "plate", None)], [])[0][0]["key"] == "vision:blue|plate"


def test_lines_of_one_key_keep_the_first_quantity(spark):
    lines = [(0, "3001", "Brick", None, "Red", 2, "a", None), (1, "3001", "Brick spare", None, "Red", 1, "b", None), (2, "9", "", None, None, 1, "c", None)]
    parts, warnings = scan(spark, [1], [(0, 0, 1, None, None, "b"), (0, 1, 1, None, None, "a"), (0, 2, 5, None, None, "c")], lines)
    assert [(p["key"], p["name"], p["inventory_qty"], p["total_seen"]) for p in parts] == [("9|None", "", 1, 5), ("3001|Red", "Brick spare", 1, 2)]
    assert warnings == ["Count mismatch for Brick spare: saw 2 in pages, inventory has 1.", "Count mismatch for 9|None: saw 5 in pages, inventory has 1."]


def test_golden_scan(spark):
    """Six pages, two bags, a parts list: the four parts in order, and the result's JSON and CSV."""
    rows = [(1, 0, 2, "red", "2 x 4 brick", None), (1, 1, 1, "black", "2 x 4 plate", None), (2, 0, 2, "red", "brick 2 x 4", None), (2, 1, 4, "light bluish gray", "1 x 2 plate", None), (3, 0, 1, "black", "plate 2 x 4", None), (3, 1, 2, "yellow", "1 x 1 round plate", None), (4, 0, 4, "light bluish gray", "plate 1 x 2", None), (5, 0, 50, "red", "2 x 4 brick", None)]
    p, c = pages(spark, [None, 1, None, 2, None, None], lists=(5,)), callouts(spark, rows)
    parts, bags, warnings = locating.scan_extracts(p, c)
    scans = table(spark, [(1, None, "demo", None, 6, False)], "scan_id long, set_num string, set_name string, source_pdf string, num_pages long, reconciled boolean")
    result = locating.results(parts, bags, warnings, scans)
    got = json.loads(sinks.json_rows(result).first().json)
    assert [(b["bag"], b["start_page"], b["end_page"]) for b in got["bags"]] == [(0, 0, 0), (1, 1, 2), (2, 3, 5)] and got["warnings"] == [] and got["set_num"] is None and got["num_pages"] == 6
    # by first bag, then by name
    assert [(x["key"], x["bags"], x["pages"], x["total_seen"], x["confidence"]) for x in got["parts"]] == [
        ("vision:bluish gray light|1 2 plate x", [1, 2], [2, 4], 8, 0.4),
        ("vision:red|2 4 brick x", [1], [1, 2], 4, 0.4),
        ("vision:black|2 4 plate x", [1, 2], [1, 3], 2, 0.4),
        ("vision:yellow|1 plate round x", [2], [3], 2, 0.4),
    ]
    lines = list(csv.reader(io.StringIO(sinks.csv_text(parts))))
    assert lines[0] == list(sinks.CSV) and lines[1] == ["", "1 x 2 plate", "light bluish gray", "", "1 2", "3 5", "8", "", "", "0.40", ""]


def test_written_outputs(spark, tmp_path):
    parts, bags, warnings = locating.scan_extracts(pages(spark, [1]), callouts(spark, [(0, 0, 3, "blue", "plate, round", None)]), table(spark, LINES, INVENTORY))
    scans = table(spark, [(1, "1-1", None, None, 1, True)], "scan_id long, set_num string, set_name string, source_pdf string, num_pages long, reconciled boolean")
    sinks.write_outputs(locating.results(parts, bags, warnings, scans), parts, str(tmp_path))
    text = b"".join(f.read_bytes() for f in (tmp_path / "result.csv").glob("part-*")).decode()
    assert "\r\n" in text and '"plate, round"' in text and "name" in text.splitlines()[0]
    assert spark.read.json(str(tmp_path / "result.json")).first().parts[0].total_seen == 3
    assert sinks.csv_text(parts.limit(0)) == ",".join(sinks.CSV) + "\r\n"


def test_pages_beyond_those_given(spark):
    sparse = table(spark, [(1, 0, None, False, False), (1, 2, 1, False, False), (1, 5, 2, False, False)], PAGE)
    n = table(spark, [(1, 8)], "scan_id long, num_pages long")
    assert [r.bag for r in segments.page_bags(sparse, n).orderBy("page_index").collect()] == [0, 0, 1, 1, 1, 2, 2, 2]
    with pytest.raises(Exception, match="ends before"):
        segments.segments(sparse, table(spark, [(1, 4)], "scan_id long, num_pages long")).collect()
    said = [r.message for r in segments.segment_warnings(pages(spark, [None, 0, None])).orderBy("ord").collect()]
    assert said == ["Bag marker 0 repeated on page 2 (same as the current bag); ignored.", "No bag markers detected; treating the whole PDF as bag 0 (unknown)."]
    assert segments.segments(sparse.limit(0), table(spark, [(1, 0)], "scan_id long, num_pages long")).count() == 0


def test_ordinals_follow_the_given_order(spark):
    rows = [(1, 4, None, True, False, 0), (1, 0, 5, False, False, 1), (1, 1, 3, False, False, 2), (1, 2, None, True, False, 3)]
    p = table(spark, rows, PAGE + ", scan_seq long")
    assert [r.assigned for r in segments.with_ordinals(p).orderBy("scan_seq").collect()] == [1, 5, 3, 6]
    assert [r.message for r in segments.ordinal_warnings(p).collect()] == ["page 1: OCR-read bag_marker=3 does not exceed the running sequence (5); left as-is for the monotonic filter to handle"]


CROP = "scan_id long, page_index long, callout_pos int, quantity long, seen_color string, inv_seq long, confidence double, components map<string,double>, alternatives array<struct<inv_seq: long, score: double>>, error string"
EMBEDDED = {"embedding": 0.7}
AB = [(0, "A1", "Part A", 4, "Red", 1, None, None), (1, "B2", "Part B", 0, "Black", 4, None, None)]


def assemble(spark, crops, lines=AB, markers=(1, 2, None), lists=(), **options):
    found = table(spark, [(1, *c) for c in crops], CROP)
    parts, _, warnings = locating.scan_crops(pages(spark, list(markers), lists), found, table(spark, lines, INVENTORY), **options)
    listed = {r.key: r for r in parts.collect()}
    return listed, [r.message for r in warnings.orderBy("phase", "ord").collect()]


def crop(page, pos, quantity, line, confidence=0.7, components=EMBEDDED, alternatives=((1, 0.5),), color="Red", error=None):
    return (page, pos, quantity, color, line, confidence, components, list(alternatives), error)


def test_assembled_parts(spark):
    lines = [(0, "3001", "Brick", 4, "Red", 4, None, None), (1, "3020", "Plate", 0, "Black", 2, None, None)]
    parts, warnings = assemble(spark, [crop(0, 0, 2, 0, 0.8), crop(1, 0, 2, 0, 0.8), crop(0, 1, 1, 1, 0.6), crop(1, 1, 1, 1, 0.7, alternatives=())], lines, markers=(1, 2))
    red, black = parts["3001|4"], parts["3020|0"]
    assert red.count_matches and black.count_matches and red.confidence == 0.8 and black.confidence == 0.65 and red.pages == [0, 1] and black.bags == [1, 2] and not warnings


def test_unidentified_crops_gather_by_colour(spark):
    parts, warnings = assemble(spark, [crop(0, 0, 3, None, 0.0, {}, ()), crop(1, 0, 1, None, 0.0, {}, ()), crop(2, 0, 1, None, 0.0, {}, (), color=None), crop(2, 1, 99, 0)], lists=(2,))
    p = parts["unknown:Red"]
    assert list(parts) == ["unknown:Red"] and (p.name, p.total_seen, p.confidence, p.reconciled, p.count_matches) == ("Unidentified (Red)", 4, 0.0, False, None)
    assert warnings == ["2 callout(s) could not be identified against the inventory."]
    assert "unknown:?" in assemble(spark, [crop(0, 0, 1, None, 0.0, {}, (), color=None)])[0]
    parts, warnings = assemble(spark, [crop(0, 0, 3, 0)], counts=False)
    assert parts["A1|4"].inventory_qty is None and parts["A1|4"].count_matches is None and not warnings


def test_failures_are_summed_up(spark):
    failed = lambda n: [crop(i % 2, i, 1, None, 0.0, None, (), error=f"e{i}") for i in range(n)]
    assert assemble(spark, failed(1))[1] == ["identify failed on page 1: e0", "1 callout(s) could not be identified against the inventory."]
    said = assemble(spark, failed(5))[1]
    assert said[:4] == ["identify failed on page 1: e0", "identify failed on page 1: e2", "identify failed on page 1: e4", "5 identify call(s) failed in total (only the first 3 distinct messages are shown above)."]


def test_capacity(spark):
    three = [crop(0, i, 1, 0) for i in range(3)]
    totals = lambda got: {k: p.total_seen for k, p in got[0].items()}
    assert totals(assemble(spark, three, capacity=False)) == {"A1|4": 3}
    assert totals(assemble(spark, three)) == {"A1|4": 1, "B2|0": 2}
    assert totals(assemble(spark, [crop(0, i, 1, 0, components={"embedding": 0.7, "brickognize": 0.8}) for i in range(3)])) == {"A1|4": 3}
    assert totals(assemble(spark, [crop(0, i, 1, 0, alternatives=((1, 0.2),)) for i in range(2)])) == {"A1|4": 1, "unknown:Red": 1}
    # lines of one part and colour share their room; a quantity of 0 is unlimited
    spare = [*AB[:1], (1, "A1", "Part A", 4, "Red", 1, None, None)]
    assert totals(assemble(spark, [crop(0, i, 1, i, alternatives=()) for i in range(2)], spare)) == {"A1|4": 1, "unknown:Red": 1}
    assert totals(assemble(spark, three, [(0, "A1", "Part A", 4, "Red", 0, None, None)])) == {"A1|4": 3}


def test_capacity_of_each_scans_own_inventory(spark):
    schema = "scan_id string, crop_id long, seq long, quantity long, inv_seq long, confidence double, embedding_only boolean, alternatives array<struct<inv_seq: long, score: double>>"
    crops = table(spark, [(s, i, i, 1, 1, 0.7, True, [(2, 0.5)]) for s in "ab" for i in range(3)], schema)
    lines = table(spark, [("a", 1, "x", 1), ("a", 2, "y", 0), ("b", 1, "x", 2), ("b", 2, "y", 9)], "scan_id string, inv_seq long, key string, quantity long")
    got = {(r.scan_id, r.crop_id): r.inv_seq for r in locating.assigned(crops, lines).collect()}
    assert got == {("a", 0): 1, ("a", 1): 2, ("a", 2): 2, ("b", 0): 1, ("b", 1): 1, ("b", 2): 2}


def test_capacity_of_a_common_inventory_of_any_size(spark):
    schema = "scan_id string, crop_id long, seq long, quantity long, inv_seq long, confidence double, embedding_only boolean, alternatives array<struct<inv_seq: long, score: double>>"
    # lines 0 and 1 share a room of 1 piece, 2 has one of 2, 3 is unlimited; 9,999,999 is no line
    key, room = F.when(F.col("inv_seq") < 2, F.lit("x")).otherwise(F.col("inv_seq").cast("string")), F.when(F.col("inv_seq") == 2, 2).when(F.col("inv_seq") == 3, 0).otherwise(1)
    lines = lambda n: spark.range(n).toDF("inv_seq").select("inv_seq", key.alias("key"), room.alias("quantity"))
    asked = [(0, True, [(2, 0.5)]), (1, True, [(0, 0.9), (2, 0.5)]), (1, True, [(2, 0.2)]), (1, True, [(2, 0.5)]), (0, False, [(3, 0.9)]), (2, True, [(3, 0.4)]), (None, True, [(3, 0.9)]), (9_999_999, True, None), (1_000, True, []), (1_000, True, [(9_999_999, 0.6)])]
    crops = table(spark, [(s, i, i, 1, line, 0.7, alone, others) for s in ("a", "b", None) for i, (line, alone, others) in enumerate(asked)], schema)
    found = lambda n: {(r.scan_id, r.crop_id): tuple(r)[2:] for r in locating.assigned(crops, lines(n)).collect()}
    large = found(1_000_001)
    assert large == found(1_001)
    for s in ("a", "b", None):
        assert [large[s, i][0] for i in range(len(asked))] == [0, 2, None, 2, 0, 3, None, 9_999_999, 1_000, 9_999_999]


def test_reuse_is_told_from_a_mismatch(spark):
    both = {"brickognize": 0.9, "embedding": 0.1}
    parts, warnings = assemble(spark, [crop(0, 0, 1, 0, components=both), crop(1, 0, 1, 0, components=both)])
    assert parts["A1|4"].count_matches is False and warnings == ["Part A appears in 2 step(s) (piece count 1) — multi-step reuse, not a miscount."]
    assert assemble(spark, [crop(0, 0, 5, 0, components=both)])[1] == ["Count mismatch for Part A: saw 5, inventory has 1."]


def test_manifest(spark, tmp_path):
    inventory = table(spark, AB, INVENTORY)
    p = pages(spark, [1, None])
    found = table(spark, [(1, *crop(0, 0, 1, 0, 0.8)), (1, *crop(0, 1, 1, None, 0.0, {}, ())), (1, *crop(1, 0, 1, 0, 0.6, alternatives=((1, 0.5), (0, 0.4), (1, 0.3))))], CROP)
    entries = sinks.manifest(locating.assignments(found, p, segments.page_bags(p), inventory), inventory)
    got = entries.orderBy("i").collect()
    assert [r.file for r in got] == ["A1/p000_i000.png", "unknown/p000_i001.png", "B2/p001_i002.png"]
    assert (got[2].raw_part_num, got[2].part_num, got[2].confidence, got[1].raw_part_num) == ("A1", "B2", 0.5, None)
    assert [tuple(a) for a in got[2].alternatives] == [("B2", 0.5), ("A1", 0.4)]
    sinks.write_crops(entries, table(spark, [(1, i, bytes([i])) for i in range(3)], "scan_id long, i int, content binary"), str(tmp_path))
    assert (tmp_path / "B2/p001_i002.png").read_bytes() == b"\x02" and spark.read.json(f"{tmp_path}/manifest").count() == 3
    contents = table(spark, [("A1/p000_i000.png", b"x"), ("B2/p001_i002.png", b"y")], "file string, content binary")
    sure = entries.withColumn("components", F.create_map(F.lit("brickognize"), F.lit(0.5)))
    assert [r.part_num for r in training.real_crops(sure, contents).collect()] == ["A1"]  # the diverted one is left out
    assert training.real_crops(entries, contents).count() == 0 and training.real_crops(entries, contents, corroborated=False).count() == 1
    assert training.real_crops(sure, contents, least=0.9).count() == 0


SIX = [(0, "3001", "Brick", 4, "Red", 2, None, None), (1, "3001", "Brick", 1, "Blue", 1, None, None), (2, "3020", "Plate", 0, "Black", 3, None, None)]


def identify(spark, candidates=(), hits=(), color=None, tokens=True):
    inventory = table(spark, SIX, INVENTORY)
    crops = table(spark, [(1, color)], "crop_id long, seen_color string")
    scores = matching.token_color_scores(crops, inventory) if tokens else colors.name_scores(crops, inventory)
    got = matching.identify(crops, inventory, table(spark, [(1, *c) for c in candidates], "crop_id long, part_num string, score double"), table(spark, [(1, *h) for h in hits], "crop_id long, inv_seq long, score double"), scores)
    return got.first()


def test_identify(spark):
    r = identify(spark, [("3001", 0.9)], color="red")
    assert r.inv_seq == 0 and r.confidence > 0.9 and r.alternatives[0].inv_seq == 1 and r.components == {"brickognize": 0.9, "color": 1.0}
    assert identify(spark, [("99999", 0.99), ("3020", 0.4)]).inv_seq == 2
    r = identify(spark, hits=[(0, 0.05), (1, 0.99), (2, -0.4)])
    assert r.inv_seq == 1 and r.components == {"embedding": 0.99} and r.confidence == 0.99
    for nothing in (identify(spark), identify(spark, color="red"), identify(spark, [("99999", 0.9)], color="red")):
        assert (nothing.inv_seq, nothing.confidence, nothing.components, nothing.alternatives) == (None, 0.0, {}, [])
    assert identify(spark, [("3001", 0.9)], color="Blue", tokens=False).inv_seq == 1


def test_predictions(spark):
    payloads = [(1, json.dumps({"items": [{"id": "a", "score": 0.2}, {"name": "none", "score": 1}, {"part_num": "b", "name": "B", "score": "0.7"}, {"id": 33, "score": "bad"}, {"id": "c"}]})), (2, "no json"), (3, "{}"), (4, None)]
    got = matching.parse_predictions(table(spark, payloads, "crop_id long, payload string"))
    assert [(r.rank, r.part_num, r.name, r.score) for r in got.orderBy("rank").collect()] == [(1, "b", "B", 0.7), (2, "a", "", 0.2), (3, "33", "", 0.0), (4, "c", "", 0.0)]
    crops = table(spark, [(1, "Red"), (2, "Red")], "crop_id long, seen_color string")
    one, two = matching.unconstrained(crops, got).orderBy("crop_id").collect()
    assert (one.part_num, one.color_name, one.confidence, len(one.alternatives)) == ("b", "Red", 0.7, 3) and (two.part_num, two.confidence, two.color_name) == (None, 0.0, None)


def test_colours(spark):
    near = lambda *rgb: spark.range(1).select(colors.nearest(*map(F.lit, map(float, rgb)))["name"].alias("n")).first().n
    assert near(200, 25, 10) == "Red" and near(162, 166, 170) == "Light Bluish Gray"
    row = spark.range(1).select(colors.hex_channels(F.lit("#C91A09")).alias("h"), colors.channels_of(F.lit("light  bluish   gray")).alias("n"), colors.channels_of(F.lit("nope")).alias("u")).first()
    assert tuple(row.h) == (201, 26, 9) and tuple(row.n) == (160, 165, 169) and row.u is None
    with pytest.raises(Exception, match="hexadecimal"):
        spark.range(1).select(colors.hex_channels(F.lit("#12")).alias("h")).collect()
    scores = {(r.seen_color, r.color_name): r.score for r in colors.name_scores(table(spark, [("Red",), ("mystery",), (None,)], "seen_color string"), table(spark, [("red",), ("Dark Red",), ("Blue",), (None,)], "color_name string")).collect()}
    assert scores[("Red", "red")] == 1.0 and 0 < scores[("Red", "Dark Red")] < 1 and ("Red", "Blue") not in scores and len(scores) == 2
    square = [(1, *((201, 26, 9) if 10 <= x < 40 and 10 <= y < 40 else (33, 33, 33) if 8 <= x < 42 and 8 <= y < 42 else (255, 255, 255))) for x in range(60) for y in range(60)]
    blank = [(2, 250, 250, 250)] * 3 + [(2, 0, 0, 4)]
    got = {r.crop: (r.r, r.g, r.b) for r in colors.dominant(table(spark, square + blank, "crop int, r int, g int, b int"), ["crop"]).collect()}
    assert got == {1: (201, 26, 9), 2: (250, 250, 250)}


def test_inventory_files(spark, tmp_path):
    def load(name, text):
        (tmp_path / name).write_text(text, encoding="utf-8")
        return [(r.part_num, r.name, r.color_id, r.color_name, r.quantity, r.element_id) for r in files.load_inventory(spark, str(tmp_path / name)).orderBy("inv_seq").collect()]

    assert load("a.csv", "Item No,Description,Color,Qty\n3001,Brick,5,2\n,none,1,1\n3002,Plate,red,Infinity\n3003,x,1.5,2.9\n") == [("3001", "Brick", 5, None, 2, None), ("3002", "Plate", None, None, 0, None), ("3003", "x", None, None, 2, None)]
    assert load("b.tsv", "﻿BLItemNo\tcolour\tMinQty\tLEGO element ID\n3001\tDark Red\tmany\t77\n") == [("3001", "", None, "Dark Red", 0, "77")]
    assert load("c.json", json.dumps([{"part_num": "", "part": "3001", "Name": " Brick ", "color_id": 4, "qty": 3}, {"name": "no number"}, {"number": 7}])) == [("3001", "Brick", 4, None, 3, None), ("7", "", None, None, 0, None)]
    nested = {"results": [{"part": {"part_num": "3001", "name": "Brick"}, "color": {"id": 5, "name": "Red"}, "quantity": 2, "element_id": "e"}, {"part": {"name": "odd"}, "quantity": "x"}]}
    assert load("d.json", json.dumps(nested)) == [("3001", "Brick", 5, "Red", 2, "e"), ("", "odd", None, None, 0, None)]
    for name, text in (("e.json", "{not json"), ("f.json", '{"rows": []}'), ("g.json", '"text"'), ("h.json", '{"results": 3}')):
        with pytest.raises(ValueError):
            load(name, text)
    with pytest.raises(FileNotFoundError):
        files.load_inventory(spark, str(tmp_path / "none.csv"))
    with pytest.raises(Exception, match="negative"):
        load("i.csv", "part,qty\n1,-3\n")


def test_page_ranges():
    assert files.page_range("1-3,2,5", 9) == [0, 1, 2, 4] and files.page_range("8-20", 9) == [7, 8] and files.page_range("1,,2, ", 9) == [0, 1] and files.page_range(None, 3) == [0, 1, 2]
    for bad, why in (("x", "not integers"), ("5-2", "start > end"), ("1-b", "not integers"), ("-3", "not integers")):
        with pytest.raises(ValueError, match=why):
            files.page_range(bad, 9)


def test_extracts(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps([{"page_index": 0, "bag_marker": 1, "is_parts_list": False, "callouts": [{"color": "red", "shape_desc": "x"}, {"quantity": 3}]}, {"page_index": 1}]))
    got = files.load_extracts(spark, str(tmp_path / "e.json"))
    assert [(r.page_index, r.callout_pos, r.quantity, r.color) for r in files.callouts_of(got).collect()] == [(0, 0, 1, "red"), (0, 1, 3, None)]
    (tmp_path / "bad.json").write_text('[{"page_index": "x"}]')
    with pytest.raises(Exception):
        files.load_extracts(spark, str(tmp_path / "bad.json")).collect()
    one = table(spark, [('{"callouts": [{"color": "red"}], "bag_marker": 2}',)], "j string").select(files.extract_of_json(F.col("j")).alias("e")).first().e
    assert (one.bag_marker, one.is_parts_list, one.callouts[0].quantity) == (2, False, 1)


def test_links(spark):
    html = r'<a href="https:\/\/www.example.com\/cdn\/product-assets\/product.bi.core.pdf\/655.pdf"> https://www.example.com/cdn/product-assets/product.bi.core.pdf/655.pdf "https://www.example.com/cdn/product-assets/product.bi.alt.pdf/9.pdf" https://www.example.com/x/other.pdf'
    got = table(spark, [(1, html), (2, "see https://m.example.com/a/b.pdf and https://m.example.com/a/b.pdf"), (3, None)], "i int, h string").select("i", files.document_urls(F.col("h"), "example.com").alias("u"), files.page_url(F.lit(" 76307-1"), "https://www.example.com").alias("p")).orderBy("i").collect()
    assert [u.rsplit("/", 1)[1] for u in got[0].u] == ["655.pdf", "9.pdf"] and got[1].u == ["https://m.example.com/a/b.pdf"] and got[2].u == [] and got[0].p == "https://www.example.com/en-gb/service/building-instructions/76307"


def fake_catalogue(loop=False, status=200):
    """A catalogue with two pages of rows, as a function that is pickled by value."""

    def get(url, headers):
        import json

        row = lambda n: {"part": {"part_num": f"p{n}", "name": f"N{n}"}, "color": {"id": n, "name": "Red"}, "quantity": n, "element_id": None}
        assert headers["Authorization"] == "key k"
        if url.endswith("-1/"):
            return status, b'{"name": "Set"}'
        if loop or "page=2" not in url:
            return status, json.dumps({"results": [row(1), row(2)], "next": "http://h/lego/sets/7-1/parts/?page=2"}).encode()
        return status, json.dumps({"results": [row(3)], "next": None}).encode()

    return get


def test_catalogue(spark):
    got = stores.set_inventory(spark, stores.Catalogue("http://h", "k", fake_catalogue()), ["7", "8-2"])
    assert sorted((r.set_num, r.inv_seq, r.part_num, r.color_id, r.quantity) for r in got.collect()) == sorted((s, i, f"p{i + 1}", i + 1, i + 1) for s in ("7", "8-2") for i in range(3))
    rows, name = stores.fetch_inventory(spark, stores.Catalogue("http://h", "k", fake_catalogue()), "7")
    assert name == "Set" and rows.count() == 3
    assert stores.fetch_inventory(spark, stores.Catalogue("http://h", None, fake_catalogue()), "7") == (None, None) == stores.fetch_inventory(spark, stores.Catalogue("http://h", "k", fake_catalogue(status=404)), "7")
    with pytest.raises(Exception, match="more than 3 pages"):
        stores.set_inventory(spark, stores.Catalogue("http://h", "k", fake_catalogue(loop=True)), ["7"], max_pages=3).collect()
    assert stores.set_number(" 76307 ") == "76307-1" and stores.set_number("7-2") == "7-2"


def test_caller_waits_and_tries_again():
    slept, now, fails = [], [10.0], [2]

    def transport(x):
        if fails[0]:
            fails[0] -= 1
            raise OSError("down")
        return x + 1

    call = stores.Caller(transport, interval=1.0, sleep=slept.append, clock=lambda: now[0])
    assert call(1) == 2 and slept == [0.5, 1.0]
    now[0] += 0.2
    assert call(2) == 3 and abs(slept[-1] - 0.8) < 1e-9
    fails[0] = 9
    with pytest.raises(stores.SourceError, match="3 attempts"):
        stores.Caller(transport, sleep=slept.append)(1)


def test_answers_are_cached(spark, tmp_path):
    requests = table(spark, [(1, b"a"), (2, b"a"), (3, b"bad"), (4, b"c")], "crop_id long, content binary")
    store = str(tmp_path / "cache")

    def service(data):
        if data == b"bad":
            raise OSError("no")
        return {"items": [{"id": data.decode(), "score": 1}]}

    quick = lambda t: stores.Caller(t, interval=0, backoff=0)
    got = {r.crop_id: r for r in stores.answered(requests, service, write_to=store, make_caller=quick).collect()}
    assert json.loads(got[2].payload)["items"][0]["id"] == "a" and got[3].payload is None and "attempts" in got[3].error
    cache = spark.read.parquet(store)
    assert cache.count() == 2  # one for each content; failures aren't kept

    def never(data):
        raise OSError(data)

    again = {r.crop_id: r.payload is not None for r in stores.answered(requests, never, cache, make_caller=quick).collect()}
    assert again == {1: True, 2: True, 3: False, 4: True}
    assert files.cache_get(cache, "other").count() == 0
    broken = cache.withColumn("value", F.lit("{not json"))
    assert files.cache_get(broken, "recogniser").count() == 0


def test_vision_extracts(spark):
    def model(data):
        if data == b"odd":
            raise stores.SourceError("no page")
        return {"bag_marker": 3, "callouts": [{"color": "red"}]}

    p = table(spark, [(1, 0, b"x"), (1, 1, b"odd")], "scan_id long, page_index long, content binary")
    got = stores.vision_extracts(p, model, "v1").orderBy("page_index").collect()
    assert (got[0].bag_marker, got[0].callouts[0].quantity, got[0].error, got[1].error) == (3, 1, None, "no page")


def test_reference_images_and_booklets(spark, tmp_path):
    lines = [(0, "A", "", None, None, 1, None, "u/bad"), (1, "A", "", None, None, 1, None, "u/1"), (2, "B", "", None, None, 1, None, "u/bad"), (3, "C", "", None, None, 1, None, None)]

    def get(url):
        if url == "u/bad":
            raise OSError(url)
        return url.encode()

    images = stores.reference_images(table(spark, lines, INVENTORY), get)
    assert [tuple(r) for r in images.collect()] == [("A", 1, bytearray(b"u/1"))]
    vectors = matching.embedded(images, lambda batch: [[float(len(x)), 1.0] for x in batch])
    assert [r.inv_seq for r in matching.gallery(table(spark, lines, INVENTORY), vectors.select("part_num", "embedding")).orderBy("inv_seq").collect()] == [0, 1]
    asked = []
    html = "https://www.example.com/cdn/product-assets/product.bi.core.pdf/1.pdf https://www.example.com/cdn/product-assets/product.bi.core.pdf/2.pdf"
    shelf = stores.Booklets("https://www.example.com", lambda url: html if "76307" in url else "", lambda url: asked.append(url) or b"pdf")
    assert [p.rsplit("/", 1)[1] for p in shelf.fetch(spark, "76307-1", str(tmp_path))] == ["1.pdf", "2.pdf"]
    (tmp_path / "2.pdf").write_bytes(b"")  # a broken download is fetched again
    assert shelf.booklet(spark, "76307", str(tmp_path), 2).endswith("2.pdf") and len(asked) == 3
    with pytest.raises(stores.SourceError):
        shelf.booklet(spark, "76307", str(tmp_path), 3)
    with pytest.raises(stores.SourceError):
        shelf.fetch(spark, "1", str(tmp_path))


BOX = "page int, box_id int, x double, y double, w double, h double"


def test_boxes(spark):
    rows = [(1, 0, 0.0, 0.0, 100.0, 50.0), (1, 1, 2.0, 2.0, 96.0, 46.0), (1, 2, 0.0, 0.0, 200.0, 100.0), (1, 3, 300.0, 0.0, 10.0, 10.0), (2, 0, 5.0, 5.0, 4.0, 4.0)]
    kept = boxes.first_come(table(spark, rows, BOX), ["page"]).orderBy("page", "place").collect()
    assert [(r.page, r.x, r.w) for r in kept] == [(1, 0.0, 100.0), (1, 0.0, 200.0), (1, 300.0, 10.0), (2, 5.0, 4.0)]
    cells = table(spark, [(1, 0, 0.0, 0.0, 50.0, 50.0)], BOX)
    inside = table(spark, [(1, 0, 40.0, 0.0, 20.0, 10.0), (1, 1, 45.0, 0.0, 20.0, 10.0), (2, 2, 0.0, 0.0, 5.0, 5.0)], BOX)
    assert [r.box_id for r in boxes.without_overlap(inside, cells, ["page"]).orderBy("box_id").collect()] == [1, 2]
    gate = table(spark, [(1, 0, 0.0, 0.0, 10.0, 10.0), (1, 1, 0.0, 0.0, 100.0, 10.0), (1, 2, 0.0, 0.0, 1.0, 1.0), (1, 3, 0.0, 0.0, 5.0, 0.0)], BOX)
    assert [r.box_id for r in gate.where(boxes.fits(F.col("w"), F.col("h"), F.lit(10_000.0))).collect()] == [0]


def test_numerals(spark):
    glyphs = [(1, 0, 300.0, 400.0, 71.0, 261.0), (1, 1, 385.0, 400.0, 71.0, 261.0), (1, 2, 700.0, 400.0, 71.0, 261.0), (1, 3, 472.0, 400.0, 30.0, 100.0), (2, 0, 1.0, 1.0, 2.0, 9.0)]
    got = boxes.numerals(table(spark, glyphs, BOX), ["page"]).orderBy("page", "place").collect()
    assert [(r.page, r.x, r.y, r.w, r.h, r.parts) for r in got] == [(1, 300.0, 400.0, 156.0, 261.0, 2), (1, 700.0, 400.0, 71.0, 261.0, 1), (1, 472.0, 400.0, 30.0, 100.0, 1), (2, 1.0, 1.0, 2.0, 9.0, 1)]
    chain = [(1, i, 50.0 * i, 0.0, 40.0, 100.0) for i in (0, 2, 4, 1, 3)]  # joined by those that come later
    assert [r.parts for r in boxes.numerals(table(spark, chain, BOX), ["page"]).collect()] == [5]


def test_page_stats(spark):
    p = table(spark, [(1, 300.0, 200.0), (2, 300.0, 200.0)], "page int, page_w double, page_h double")
    b = table(spark, [(1, 0, 0.0, 0.0, 100.0, 50.0, 2), (1, 1, 0.0, 0.0, 50.0, 50.0, 1)], BOX + ", quantity int")
    one, two = boxes.page_stats(p, b, ["page"]).orderBy("page").collect()
    assert (one.n_callouts, one.quantities, one.area_min, one.area_max, one.aspect_median) == (2, [2, 1], 2500 / 60000, 5000 / 60000, 1.5)
    assert (two.n_callouts, two.area_min, two.aspect_max, two.is_parts_list) == (0, None, None, False)


DATASET = "part_num string, variant long"


def test_split_and_triplets(spark):
    rows = [("a", i) for i in range(8)] + [("b", i) for i in range(8)] + [("c", i) for i in range(2)]
    got = training.split(table(spark, rows, DATASET), seed=3).collect()
    held = {p: sum(r.held_out for r in got if r.part_num == p) for p in "abc"}
    assert held == {"a": 2, "b": 2, "c": 0} and len(got) == 18
    assert {(r.part_num, r.variant) for r in got if r.held_out} != {(r.part_num, r.variant) for r in training.split(table(spark, rows, DATASET), seed=4).collect() if r.held_out}
    small = table(spark, [("3001", i) for i in range(3)] + [("3002", i) for i in range(2)] + [("3003", 0)], DATASET)
    idx = {r.idx: r.part_num for r in training.numbered(small).collect()}
    assert [idx[i] for i in range(6)] == ["3001"] * 3 + ["3002"] * 2 + ["3003"]
    rows = training.triplets(small, 200, seed=1).collect()
    assert len(rows) == 200 and all(idx[t.anchor] == idx[t.positive] != idx[t.negative] and t.anchor != t.positive and idx[t.anchor] != "3003" for t in rows)
    assert any(idx[t.negative] == "3003" for t in rows) and sorted(map(tuple, rows)) == sorted(map(tuple, training.triplets(small.repartition(3), 200, seed=1).collect()))
    assert training.triplets(small, 0).count() == 0 and training.triplets(small.where("part_num = '3001'"), 5).count() == 0
    assert [(r.part_num, r.seed) for r in training.part_seeds(small, 2).orderBy("part_num").collect()] == [("3001", 2_000_006), ("3002", 2_000_007), ("3003", 2_000_008)]
    best = training.best_epoch(table(spark, [(0, 0.5), (1, 0.8), (2, 0.8)], "epoch int, accuracy double")).first()
    assert (best.epoch, best.accuracy) == (1, 0.8)


def test_geometry(spark):
    quad = "4 16 0 0 0 1 0 0 1 1 0 0 1 0"
    text = {
        "box.dat": [quad, "2 24 0 0 0 1 0 0", "0 comment", "3 16 bad 0 0 1 0 0 0 1 0"],
        "part.dat": ["1 16 0 0 0 1 0 0 0 1 0 0 0 1 BOX.dat", "1 16 5 0 0 10 0 0 0 10 0 0 0 10 box.dat", "3 16 0 0 0 1 0 0 0 0 1", "1 16 0 0 0 1 0 0 0 1 0 0 0 1 missing.dat"],
    }
    lines = table(spark, [(ref, line) for ref, found in text.items() for line in found], "ref string, line string")
    got = training.geometry(lines, table(spark, [("part.dat",), ("none.dat",)], "ref string")).collect()
    assert sorted((r.root, r.kind) for r in got) == [("part.dat", 2)] * 2 + [("part.dat", 3)] * 5
    assert max(x for r in got for x in r.points) == 15.0  # ten times as large, five to the right
    index = training.index_of(table(spark, [("parts/3068b.dat",), ("parts/S/Sub.dat",), ("p/3068b.dat",)], "path string"))
    assert {r.ref: r.path for r in index.collect()}["3068b.dat"] == "parts/3068b.dat"
    refs = training.part_references(table(spark, [("3068b",), ("3068bpr9329",), ("77pr1",)], "part_num string"), index)
    assert {r.part_num: r.ref for r in refs.collect()} == {"3068b": "3068b.dat", "3068bpr9329": "3068b.dat", "77pr1": None}
    with pytest.raises(ValueError, match="round"):
        training.geometry(table(spark, [("a.dat", "1 16 0 0 0 1 0 0 0 1 0 0 0 1 a.dat")], "ref string, line string"), table(spark, [("a.dat",)], "ref string"))


def test_viewing(spark):
    parts, bags, _ = locating.scan_extracts(pages(spark, [None, 1, 2]), callouts(spark, [(0, 0, 1, "teal", "<b>", None), (1, 0, 6, "red", "brick 2 x 4", None), (2, 0, 2, "black", "plate 2 x 4", None), (1, 1, 1, "pink", None, None)]), table(spark, LINES, INVENTORY))
    names = lambda df: [r.key for r in df.collect()]
    assert set(names(viewing.filtered(parts, "BRICK"))) == {"3001|5"} and names(viewing.filtered(parts, "3020", 2, "ok")) == ["3020|0"] and names(viewing.filtered(parts, "3020", 1)) == []
    assert names(viewing.ordered(parts, "total_seen", True))[0] == "3001|5" and names(viewing.ordered(parts, "part_num"))[0].startswith("vision:")
    assert [(r.bag, r.page, r.quantity) for r in viewing.occurrences(parts).where("key = '3001|5'").collect()] == [(1, 2, 6)]
    shown = {r.key: r for r in viewing.rows(parts).collect()}
    assert shown["3001|5"].delta == "(+2 seen)" and shown["vision:teal|b"].name == "&lt;b&gt;" and shown["vision:teal|b"].inventory == "—" and shown["vision:pink|"].name == "unknown"
    counts = {(r.bag, r.status): r.n for r in viewing.facets(parts).collect()}
    assert counts[(None, None)] == 4 and counts[(None, "bad")] == 1 and counts[(1, None)] == 2
    card = {r.bag: r for r in viewing.cards(bags, locating.bag_cards(bags, parts)).collect()}
    assert (card[0].label, card[0].pages, card[1].n_parts, card[1].n_bad) == ("Intro", "page 1", 2, 1)
    line = spark.range(1).select(C.meta_line(F.lit("Castle"), F.lit("7-1"), F.lit(3), F.lit(None).cast("int"), F.lit(True)).alias("m"), C.page_span(F.lit(0), F.lit(4)).alias("s"), C.pure_integer(F.lit(" 12 ")).alias("i"), C.pure_integer(F.lit("2x")).alias("n")).first()
    assert tuple(line) == ("Castle · #7-1 · 3 parts · reconciled", "pages 1–5", 12, None)


def test_set_numbers(spark):
    from binmap.operators import texts

    rows = [(1, 0, "6559641 and 76307 Ages 9+"), (1, 1, "x"), (2, 0, "no number, 123 and 12345678"), (3, 0, None), (4, 0, "a 5000 b 600000"), (4, 1, "70000")]
    rows += [(5, i, t) for i, t in enumerate(["", "", "", "", "4444 pieces", "", "55555"])]  # the fifth of seven pages isn't looked at
    rows += [(6, 0, "10001 " + "." * 40 + " 20002 page" + "." * 40 + "30003")]
    got = {r.scan_id: r.set_num for r in texts.set_number(spark.createDataFrame(rows, "scan_id long, page_index long, text string")).collect()}
    assert got == {1: "76307", 2: None, 3: None, 4: "5000", 5: "55555", 6: "20002"}

    def plain(text):
        import re

        out = []
        for m in re.finditer(r"\b(\d{4,7})\b", text):
            near = text[max(0, m.start() - 30) : m.end() + 30].lower()
            out.append((m.group(1), max(0, 8 - len(m.group(1))) + 3 * any(w in near for w in texts.CONTEXT)))
        return out

    import random

    rng = random.Random(8)
    made = ["".join(rng.choice([" ", "12345", "age ", "é", "+", "77777 ", "pieces", "abc", "4444", "\n"]) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    scored = spark.createDataFrame([(t,) for t in made], "t string").select("t", texts.scored_numbers(F.col("t")).alias("s")).collect()
    assert all([(x.number, x.score) for x in r.s] == plain(r.t) for r in scored)
