import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from binmap import engine
from binmap.operators import matching, training
from binmap.sources import documents, stores
from binmap.vision import augmenting, embedding, images

INVENTORY = "inv_seq long, part_num string, name string, color_id int, color_name string, quantity long, element_id string, image_url string"


def page(panels=(), numeral=False):
    out = np.full((800, 1000, 3), 255, np.uint8)
    for x, y, colour in panels:
        out[y : y + 90, x : x + 130] = 220
        out[y + 5 : y + 85, x + 5 : x + 125] = colour
    if numeral:
        out[450:700, 700:860] = 0
    return images.encode(out)


RED, BLUE = (201, 26, 9), (0, 85, 191)


def test_scan_of_extracts_by_pages(spark, tmp_path):
    rows = [{"page_index": 0, "bag_marker": 1}, {"page_index": 1, "callouts": [{"quantity": 2, "color": "red", "shape_desc": "brick"}]}, {"page_index": 2, "bag_marker": 99}]
    (tmp_path / "e.json").write_text(json.dumps(rows))
    (tmp_path / "i.csv").write_text("part,name,color_name,qty\n3001,Brick,Red,2\n")
    engine.main([str(tmp_path / "e.json"), "--out", str(tmp_path / "out"), "--inventory", str(tmp_path / "i.csv"), "--pages", "1-2", "--set", "7-1"])
    got = spark.read.json(str(tmp_path / "out/result.json")).first()
    assert [b.bag for b in got.bags] == [1] and got.num_pages == 3 and got.reconciled and got.set_num == "7-1" and got.parts[0].part_num == "3001" and got.parts[0].count_matches
    assert engine.load_result(spark, str(tmp_path / "out")).count() == 1
    with pytest.raises(SystemExit):
        engine.main([str(tmp_path / "e.json"), "--pages", "5-2"])


def test_scan_of_images(spark, tmp_path):
    content = [page(numeral=True), page([(100, 100, RED), (400, 100, BLUE)]), page([(100, 100, RED)], numeral=True), b"broken"]
    rows = spark.createDataFrame([("s", i, bytearray(c)) for i, c in enumerate(content)], "scan_id string, page_index long, content binary")
    inventory = spark.createDataFrame([(0, "3001", "Brick", 5, "Red", 2, None, None), (1, "3001", "Brick", 7, "Blue", 1, None, None)], INVENTORY)

    def service(data):
        return {"items": [{"id": "3001", "score": 0.9}, {"id": "none", "score": 0.95}]}

    recognise = lambda crops: stores.answered(crops, service, make_caller=lambda t: stores.Caller(t, interval=0))
    scan = engine.scan_images(rows, inventory, recognise, options=engine.Options(set_name="Demo"))
    parts = {r.key: r for r in scan.parts.collect()}
    assert {k: (p.total_seen, p.bags, p.pages, p.count_matches) for k, p in parts.items()} == {"3001|5": (2, [1, 2], [1, 2], True), "3001|7": (1, [1], [1], True)}
    assert [(b.bag, b.start_page, b.end_page) for b in scan.bags.orderBy("bag").collect()] == [(1, 0, 1), (2, 2, 3)] and scan.warnings.count() == 0
    scan.register()
    assert spark.sql("SELECT set_name, size(parts) AS n FROM scan_result").first() == ("Demo", 2)
    stats = engine.debug(rows, str(tmp_path / "debug")).orderBy("page_index").collect()
    assert [r.n_callouts for r in stats] == [0, 2, 1, 0] and (tmp_path / "debug/s/page_001.png").exists() and (tmp_path / "debug/s/mask_002.png").exists()


def test_scan_of_images_by_vectors(spark):
    content = [page([(100, 100, RED), (400, 100, BLUE)])]
    rows = spark.createDataFrame([("s", i, bytearray(c)) for i, c in enumerate(content)], "scan_id string, page_index long, content binary")
    inventory = spark.createDataFrame([(0, "A", "", None, "Red", 1, None, None), (1, "B", "", None, "Blue", 1, None, None)], INVENTORY)
    gallery = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "inv_seq long, embedding array<float>")

    def encode(batch):
        from binmap.vision import images as own

        return [[float(own.dominant(own.decode(b))[0]), float(own.dominant(own.decode(b))[2])] for b in batch]

    scan = engine.scan_images(rows, inventory, gallery=gallery, encode=encode, options=engine.Options(use_color=False))
    assert sorted((r.key, r.total_seen) for r in scan.parts.collect()) == [("A|Red", 1), ("B|Blue", 1)]
    with pytest.raises(ValueError):
        engine.scan_images(rows, inventory.withColumn("scan_id", F.lit("s")))


def test_two_passes(spark):
    pages = spark.createDataFrame([("s", i, bytearray(b"%d" % i)) for i in range(4)], "scan_id string, page_index long, content binary")

    def triage(data):
        i = int(data)
        return {"bag_marker": [None, 1, 2, None][i], "has_callouts": i > 0, "is_parts_list": i == 3, "printed_page_number": 0}

    def detail(data):
        return {"bag_marker": 9, "printed_page_number": 5, "callouts": [{"color": "red", "shape_desc": "brick", "quantity": int(data)}]}

    extracts, stats = engine.extract_two_pass(pages, triage, detail)
    got = extracts.orderBy("page_index").collect()
    assert stats.first() == (4, 2, 2) and [len(r.callouts) for r in got] == [0, 1, 1, 0]
    assert [r.bag_marker for r in got] == [None, 1, 2, None] and [r.printed_page_number for r in got] == [None, 5, 5, None] and got[3].is_parts_list
    parts = engine.scan_extracts(extracts).parts.collect()
    assert [(p.key, p.total_seen, p.bags) for p in parts] == [("vision:red|brick", 3, [1, 2])]


def test_documents(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"p0|p1|p2")
    (tmp_path / "b.pdf").write_bytes(b"broken")

    def render(data, dpi, indices):
        pages = data.decode().split("|")
        for i in indices if indices is not None else range(len(pages)):
            if 0 <= i < len(pages):
                yield i, f"{pages[i]}@{dpi}".encode(), pages[i]

    def count(data):
        if b"|" not in data:
            raise ValueError("broken")
        return data.count(b"|") + 1

    docs = documents.documents(spark, f"{tmp_path}/*.pdf")
    assert {r.path[-5:]: r.num_pages for r in documents.page_counts(docs, count).collect()} == {"a.pdf": 3, "b.pdf": None}
    good = documents.valid(docs, count)
    assert [(r.page_index, bytes(r.content)) for r in documents.rendered(good, render, 110, [2, 0, 9]).collect()] == [(2, b"p2@110"), (0, b"p0@110")]
    some = good.select("path", F.lit(1).cast("long").alias("page_index"))
    assert [r.text for r in documents.rendered_where(docs, some, render).collect()] == ["p1"]
    with pytest.raises(FileNotFoundError):
        documents.documents(spark, str(tmp_path / "none"))


def shape(kind, colour):
    out = np.full((40, 40, 3), 255, np.uint8)
    if kind == "bar":
        out[16:24, 4:36] = colour
    elif kind == "post":
        out[4:36, 16:24] = colour
    else:
        out[10:30, 10:30] = colour
    return images.encode(out)


def test_variants_and_training(spark):
    parts = spark.createDataFrame([(k, bytearray(shape(k, RED))) for k in ("bar", "post", "box")] + [("odd", bytearray(b"x"))], "part_num string, content binary")
    seeded = parts.join(training.part_seeds(parts, 1), "part_num")
    made = augmenting.augmented(seeded, 8, "icon")
    got = {(r.part_num, r.variant): bytes(r.content) for r in made.collect()}
    assert len(got) == 24 and len(set(got.values())) == 24 and {p for p, _ in got} == {"bar", "post", "box"}
    assert got == {(r.part_num, r.variant): bytes(r.content) for r in augmenting.augmented(seeded.repartition(3), 8, "icon").collect()}
    rgb = images.decode(shape("bar", RED))
    assert (augmenting.variant(rgb, 5, "photo") != 255).any()
    with pytest.raises(ValueError):
        augmenting.variant(rgb, 5, "oil")
    marked = training.split(made)
    rows = [(r.part_num, bytes(r.content), r.held_out) for r in marked.collect()]
    learn, held = [(p, c) for p, c, h in rows if not h], [(p, c) for p, c, h in rows if h]
    assert len(held) == 6
    model, metrics = embedding.train(learn, held, length=32, epochs=6, per_epoch=60, rate=1e-3, seed=2)
    assert metrics[0]["accuracy"] is not None and max(m["accuracy"] for m in metrics) >= 5 / 6
    again = embedding.Model.restore(model.save())
    assert np.allclose(model([c for _, c in held]), again([c for _, c in held]), atol=1e-4) and not model([b"x"]).any()
    vectors = matching.embedded(made, again).select("embedding").collect()
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-4 for r in vectors)
    assert len(embedding.train(learn, [], length=8, epochs=2, per_epoch=10, mining="random")[1]) == 2
    with pytest.raises(ValueError):
        embedding.train(learn[:1], [], epochs=1)
