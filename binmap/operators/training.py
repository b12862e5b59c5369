"""Tables for training a retrieval model: splits, triplets, crops from a manifest, part references, geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Share of a part's crops held out, crops kept for training at least, least confidence of a crop from a scan.
VAL_SHARE, LEAST_TRAIN, LEAST_CONFIDENCE = 0.25, 2, 0.3
#: Fixed value: multiplier of the seed in the seeds of parts.
SEED_STEP = 1_000_003


def draw(seed: int | Column, *what: Column) -> Column:
    """A number from 0 to 2**60 - 1, drawn by an MD5 digest: the same in every engine and for every order of the rows."""
    base = seed if isinstance(seed, Column) else F.lit(str(seed))
    text = F.concat_ws(":", base.cast("string"), *(w.cast("string") for w in what))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def split(dataset: DataFrame, seed: int = 0, share: float = VAL_SHARE, least: int = LEAST_TRAIN) -> DataFrame:
    """dataset (part_num, variant) with held_out: a part's crops in drawn order, the first int(n * share) of them held out, but so that least stay."""
    part = Window.partitionBy("part_num")
    place = F.row_number().over(part.orderBy(draw(seed, F.col("part_num"), F.col("variant")), "variant"))
    n = F.count(F.lit(1)).over(part)
    return dataset.withColumn("held_out", place <= F.least(F.floor(n * share), n - least))


def numbered(dataset: DataFrame) -> DataFrame:
    """dataset (part_num, variant) with idx, its place in the order of parts and variants, part_no and variant_no from 0, and n_variants.

    Places within parts, plus the sizes of the parts before: only a row a part passes through one task.
    """
    sizes = dataset.groupBy("part_num").agg(F.count(F.lit(1)).alias("n_variants"))
    order = Window.orderBy("part_num")
    before = sizes.withColumn("part_no", F.row_number().over(order) - 1).withColumn("first", F.coalesce(F.sum("n_variants").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = F.row_number().over(Window.partitionBy("part_num").orderBy("variant")) - 1
    return dataset.withColumn("variant_no", inner).join(before, "part_num").withColumn("idx", F.col("first") + F.col("variant_no")).drop("first")


def part_seeds(parts: DataFrame, seed: int = 0) -> DataFrame:
    """(part_num, seed) of the parts whose images are varied: the seed depends on a part's place among the sorted ones."""
    place = F.row_number().over(Window.orderBy("part_num")) - 1  # a row a part
    return parts.select("part_num").distinct().withColumn("seed", F.lit(seed * SEED_STEP) + place)


def triplets(dataset: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(i, anchor, positive, negative) for i from 0 to n - 1: places of two crops of one part and of one of another part.

    Anchors are of parts with at least two crops; negatives of any other part. Empty unless two parts are eligible.
    """
    spark = dataset.sparkSession
    crops = numbered(dataset)
    parts = crops.groupBy("part_no").agg(F.first("n_variants").alias("n"))
    eligible = parts.where("n >= 2").withColumn("e", F.row_number().over(Window.orderBy("part_no")) - 1)  # a row a part
    counts = parts.agg(F.count(F.lit(1)).alias("parts"), F.count_if(F.col("n") >= 2).alias("eligible")).first()
    if counts.eligible < 2 or n <= 0:
        return spark.createDataFrame([], "i long, anchor long, positive long, negative long")
    of = lambda name, size: F.pmod(draw(seed, F.col("i"), F.lit(name)), size)
    rows = spark.range(n).toDF("i").withColumn("e", of("part", F.lit(counts.eligible))).join(eligible, "e")
    rows = rows.withColumn("a", of("anchor", F.col("n"))).withColumn("p", of("positive", F.col("n") - 1))
    rows = rows.withColumn("p", F.when(F.col("p") >= F.col("a"), F.col("p") + 1).otherwise(F.col("p")))
    rows = rows.withColumn("o", of("other", F.lit(counts.parts - 1)))
    rows = rows.withColumn("o", F.when(F.col("o") >= F.col("part_no"), F.col("o") + 1).otherwise(F.col("o")))
    rows = rows.join(parts.select(F.col("part_no").alias("o"), F.col("n").alias("m")), "o").withColumn("x", of("negative", F.col("m")))
    at = lambda p, v, name: crops.select(F.col("part_no").alias(p), F.col("variant_no").cast("long").alias(v), F.col("idx").cast("long").alias(name))
    rows = rows.join(at("part_no", "a", "anchor"), ["part_no", "a"]).join(at("part_no", "p", "positive"), ["part_no", "p"]).join(at("o", "x", "negative"), ["o", "x"])
    return rows.select("i", "anchor", "positive", "negative")


def real_crops(manifest: DataFrame, contents: DataFrame, least: float = LEAST_CONFIDENCE, corroborated: bool = True) -> DataFrame:
    """(part_num, file, content) of the manifest's crops that may teach: identified, kept where they were identified, sure enough, with content.

    corroborated: an independent recogniser agreed. contents (file, content); an empty or missing content drops the crop.
    """
    some = (F.col("part_num") != "") & (F.col("file") != "")
    same = F.col("raw_part_num") == F.col("part_num")
    agreed = F.coalesce(F.try_element_at("components", F.lit("brickognize")), F.lit(0.0)) > 0
    good = manifest.where(some & same & (F.coalesce("confidence", F.lit(0.0)) >= least) & (agreed | F.lit(not corroborated)))
    return good.select("part_num", "file").join(contents.where(F.octet_length("content") > 0).select("file", "content"), "file").select("part_num", "file", "content")


def best_epoch(metrics: DataFrame) -> DataFrame:
    """(epoch, accuracy) of the greatest accuracy, of equal ones the first. metrics (epoch, accuracy)."""
    return metrics.agg(F.max_by(F.struct("epoch", "accuracy"), F.struct("accuracy", -F.col("epoch"))).alias("b")).select("b.epoch", "b.accuracy")


def plain_reference(text: Column) -> Column:
    """A file reference as the index has it: forward slashes, lower case."""
    return F.lower(F.replace(text, F.lit("\\"), F.lit("/")))


def index_of(files: DataFrame, roots: tuple[str, ...] = ("parts/", "p/", "")) -> DataFrame:
    """(ref, path): files (path below the library's root) by every name they answer to; of several the first root's, then the least path."""
    path = plain_reference(F.col("path"))
    names = []
    for i, root in enumerate(roots):
        inside = files.where(path.startswith(root) & path.endswith(".dat"))
        rest = F.expr(f"substring({'lower(replace(path, chr(92), chr(47)))'}, {len(root) + 1})")
        for j, ref in enumerate((rest, F.substring_index(path, "/", -1))):
            names.append(inside.select(ref.alias("ref"), "path", F.lit(2 * i + j).alias("rank")))
    every = names[0]
    for x in names[1:]:
        every = every.unionByName(x)
    return every.groupBy("ref").agg(F.min_by("path", F.struct("rank", "path")).alias("path"))


def part_references(parts: DataFrame, index: DataFrame) -> DataFrame:
    """(part_num, ref): the part's own file, or that of its mould without the suffix of a print; null if there is none."""
    # Fixed value: the pattern of a printed part's number.
    mould = F.regexp_extract("part_num", r"^(\d+[a-z]*?)(?:pr|pat|px)\w*$", 1)
    refs = index.select("ref").distinct()
    own = parts.select("part_num").distinct().withColumn("a", F.concat(F.lower("part_num"), F.lit(".dat"))).withColumn("b", F.when(mould != "", F.concat(F.lower(mould), F.lit(".dat"))))
    found = own.join(refs.toDF("a").withColumn("has_a", F.lit(True)), "a", "left").join(refs.toDF("b").withColumn("has_b", F.lit(True)), "b", "left")
    return found.select("part_num", F.when(F.col("has_a"), F.concat("part_num", F.lit(".dat"))).when(F.col("has_b"), F.concat(mould, F.lit(".dat"))).alias("ref"))


#: References that lead from a file to another at most; a chain that is longer goes round.
MOST_DEPTH = 64


def geometry(lines: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, kind, points): triangles (kind 3) and edges (kind 2) of each root (ref) with all that it refers to; points are [x, y, z, ...].

    lines (ref, line): the text of the files. A reference (1) places another file by a 3 x 3 matrix and an offset; a quadrangle (4) is two
    triangles. Lines with numbers that aren't any are left out, unknown files have nothing. Files are joined level by level, each level
    with the product of the matrices above; cycles raise ValueError.
    """
    fields = F.filter(F.split("line", r"\s+"), lambda x: x != "")
    read = lines.select(plain_reference(F.col("ref")).alias("ref"), fields.alias("f"))
    numbers = lambda n: F.transform(F.slice("f", 3, n), lambda x: x.try_cast("double"))
    kind = F.get("f", F.lit(0))
    sizes = {"1": (15, 12), "2": (8, 6), "3": (11, 9), "4": (14, 12)}
    shape = F.coalesce(*(F.when((kind == k) & (F.size("f") >= least), numbers(n)) for k, (least, n) in sizes.items()))
    good = read.select("ref", kind.alias("kind"), shape.alias("v"), F.lower(F.replace(F.array_join(F.slice("f", 15, 1 << 20), " "), F.lit("\\"), F.lit("/"))).alias("child")).where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    children = good.where("kind = '1'").select("ref", "child", F.col("v").alias("m"))
    pick = lambda *at: F.concat(*(F.slice("v", 3 * i + 1, 3) for i in at))
    own = good.where("kind = '2'").select("ref", F.lit(2).alias("kind"), "v")
    own = own.unionByName(good.where("kind = '3'").select("ref", F.lit(3).alias("kind"), "v"))
    own = own.unionByName(good.where("kind = '4'").select("ref", F.lit(3).alias("kind"), F.explode(F.array(pick(0, 1, 2), pick(0, 2, 3))).alias("v")))

    # A placement t is [offset, rows of the matrix], as in the files.
    def placed(t: Column, x: Column, y: Column, z: Column, moved: bool = True) -> list[Column]:
        at = lambda i: F.get(t, F.lit(i))
        return [at(3 + 3 * r) * x + at(4 + 3 * r) * y + at(5 + 3 * r) * z + (at(r) if moved else F.lit(0.0)) for r in range(3)]

    level = roots.select(F.col("ref").alias("root"), plain_reference(F.col("ref")).alias("ref"), F.array(*(F.lit(float(x)) for x in (0, 0, 0, 1, 0, 0, 0, 1, 0, 0, 0, 1))).alias("t"))
    levels = [level]
    for _ in range(MOST_DEPTH):
        m = lambda i: F.get("m", F.lit(i))
        columns = [placed(F.col("t"), m(3 + c), m(6 + c), m(9 + c), moved=False) for c in range(3)]
        product = F.array(*placed(F.col("t"), m(0), m(1), m(2)), *(columns[c][r] for r in range(3) for c in range(3)))
        level = level.join(children, "ref").select("root", F.col("child").alias("ref"), product.alias("t"))
        if level.isEmpty():
            break
        levels.append(level)
    else:
        raise ValueError("the references go round")
    every = levels[0]
    for x in levels[1:]:
        every = every.unionByName(x)
    joined = every.join(own, "ref")
    point = lambda i: F.array(*placed(F.col("t"), *(F.get("v", i * 3 + j) for j in range(3))))
    points = F.flatten(F.transform(F.sequence(F.lit(0), F.floor(F.size("v") / 3).cast("int") - 1), point))
    return joined.select("root", "kind", points.alias("points"))
