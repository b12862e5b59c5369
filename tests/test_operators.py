import pytest
from pyspark.sql import functions as F

from binmap.functions import columns as C
from binmap.operators import locating, matching, segments
from binmap.sources import files

PAGE = "scan_id long, page_index long, bag_marker long, candidate boolean, is_parts_list boolean"


def pages(spark, markers, candidates=()):
    return spark.createDataFrame([(1, i, m, i in candidates, False) for i, m in enumerate(markers)], PAGE)


@pytest.mark.parametrize(
    ("markers", "bags", "kinds"),
    [
        ([None, 1, None, 2, None, None], [0, 1, 1, 2, 2, 2], []),
        ([1, None, 2], [1, 1, 2], []),
        ([1, 2, 3, 1, 4], [1, 2, 3, 3, 4], ["suspect"]),
        ([1, 2, 2, 3], [1, 2, 2, 3], ["repeated"]),
        ([None, None, None], [0, 0, 0], []),
        ([0, -1, 1], [0, 0, 1], ["repeated", "suspect"]),
    ],
)
def test_segments(spark, markers, bags, kinds):
    p = pages(spark, markers)
    assert [r.bag for r in segments.page_bags(p).orderBy("page_index").collect()] == bags
    assert [r.bag for r in segments.expanded(segments.segments(p)).orderBy("page_index").collect()] == bags
    found = [r.message.lower() for r in segments.marker_warnings(p).orderBy("page_index").collect()]
    assert all(k in m for k, m in zip(kinds, found, strict=True))


@pytest.mark.parametrize(("markers", "candidates", "want"), [([None, None, None, 5, None], (0, 2, 4), [1, None, 2, 5, 6]), ([5, 3, None], (2,), [5, 3, 6])])
def test_ordinals(spark, markers, candidates, want):
    assert [r.assigned for r in segments.with_ordinals(pages(spark, markers, candidates)).orderBy("page_index").collect()] == want


def test_theta_match_takes_the_first_of_equal_lines(spark):
    inventory = spark.createDataFrame([(2, "3020", "Plate 2 x 4", "Black"), (1, "3001", "Brick 2 x 4", "Red"), (3, "3001", "Brick 2 x 4", "Red")], "inv_seq int, part_num string, name string, color_name string")
    callouts = spark.createDataFrame([("red", "2 x 4 brick"), ("pink", "dome")], "color string, shape_desc string")
    assert [(r.inv_seq, r.score) for r in matching.theta_match(callouts, inventory).collect()] == [(1, 0.9)]


def test_blend_renormalises(spark):
    one = spark.createDataFrame([(1, "brickognize", 7, 0.9), (1, "color", 7, 1.0), (2, "brickognize", 7, 0.8)], "crop_id long, signal string, inv_seq long, score double")
    got = {r.crop_id: r.confidence for r in matching.blend(one).collect()}
    assert got[1] == pytest.approx(0.5 / 0.6 * 0.9 + 0.1 / 0.6, abs=1e-8) and got[2] == 0.8


@pytest.mark.parametrize(("only", "want"), [(True, [1, 2, 2]), (False, [1, 1, 1])])
def test_capacity(spark, only, want):
    crops = spark.createDataFrame([(1, i, i, 1, 1, 0.7, only, [(2, 0.5)]) for i in range(3)], "scan_id long, crop_id long, seq long, quantity long, inv_seq long, confidence double, embedding_only boolean, alternatives array<struct<inv_seq: long, score: double>>")
    inventory = spark.createDataFrame([(1, 1, 1), (1, 2, 4)], "scan_id long, inv_seq long, quantity long")
    assert [r.inv_seq for r in locating.assigned(crops, inventory).orderBy("crop_id").collect()] == want
    assert {r.inv_seq for r in locating.assigned(crops, inventory, capacity=False).collect()} == {1}


def test_nearest_keeps_zero_vectors(spark):
    gallery = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0])], "inv_seq long, embedding array<float>")
    query = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert [r.inv_seq for r in matching.nearest(query, gallery, 4).orderBy("rank").collect()] == [0, 2, 1, 3]


def test_inventory_headers(spark, tmp_path):
    (tmp_path / "i.csv").write_text("Item No,Description,Color,Qty\n3001,Brick,5,2\n,none,1,1\n3002,Plate,red,Infinity\n")
    rows = files.load_inventory(spark, str(tmp_path / "i.csv")).orderBy("part_num").collect()
    assert [(r.part_num, r.color_id, r.quantity) for r in rows] == [("3001", 5, 2), ("3002", None, 0)]


def test_keys_and_colours(spark):
    row = spark.range(1).select(C.vision_key(F.lit("light bluish gray color"), F.lit("plate 1 x 2")).alias("k"), C.inventory_key(F.lit("3001"), F.lit(None), F.lit(None)).alias("i"), C.quantity(F.lit("see 12 X")).alias("q")).first()
    assert row == ("vision:bluish gray light|1 2 plate x", "3001|None", 12)


def test_geometry_goes_to_any_depth(spark, tmp_path):
    from binmap.plans import tables

    spark.range(1, 3_001).toDF("p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    want = {}
    for root in range(1, 3_001):
        p, n = root, 0
        while p <= 3_000:
            p, n = 3 * p + 7, n + 1
        want[root] = (n, 2.0 ** (n - 1))
    got = {r.root: (r.n_triangles, r.max_scale) for r in tables.geometry_triangles(spark, str(tmp_path)).collect()}
    assert got == want and got[1][0] >= 6
