import hashlib
import math
import random
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from binmap.llm import decontamination, kneser_ney, near_duplicates, packing, queries, sharding, syncmers, token_counts, toxicity, url_filter, warc

DOCS = "doc_id long, text string, source string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    rows = [(i, words(rng, rng.randint(1, 120)), "hot" if i % 3 else f"s{i}") for i in range(60)]
    rows += [(60, None, None), (61, "", "a"), (62, " \n\t ", "b"), (None, "null id here", "c"), (5, rows[5][1], "hot"), (63, words(rng, 4000), "long"), (64, "é" * 500, "x")]
    return spark.createDataFrame(rows, DOCS).coalesce(2)


def test_token_counts_equal_the_library():
    from tokenizers import Tokenizer

    path = queries.vocabulary()
    library, own = Tokenizer.from_file(path), token_counts.Tokenizer(path)
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab'srtvemld  \n\t1٣é日!.-’　İ<|endoftext|>") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["", "a" * 3000, " " * 999, "x<|endoftext|>y<|endoftext|>", "the" * 2000 + "'s", "I'll 'tis don't 'sam"]
    assert own.count(pa.array([*texts, None])).tolist() == [*(len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)), 0]


def test_long_pre_tokens_equal_the_library():
    """Runs without a boundary over many chunks: state maps that forget at once, that go round, and that differ by chunk."""
    from tokenizers import Tokenizer

    path = queries.vocabulary()
    library, own = Tokenizer.from_file(path), token_counts.Tokenizer(path)
    rng = random.Random(14)
    texts = ["a" * 30_000, "the" * 9000 + " x", "日本" * 4000, "".join(rng.choice("ACGT") for _ in range(20_000)), "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000)), "=" * 5000 + "-" * 5000, "0123456789" * 900, "a b" + "xyz" * 500]
    assert own.count(pa.array(texts)).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_sharding(spark, docs):
    keyed = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("size"))
    found = sharding.with_slots(sharding.with_shards(keyed, "doc_id", [1.0] * 16, grown=("grown", 1.0)), "shard").collect()
    assert len(found) == docs.count()
    assert all(r.grown in (r.shard, 16) for r in found)
    for s in range(16):
        assert sorted(r.slot for r in found if r.shard == s) == list(range(sum(r.shard == s for r in found)))
    heavy = sharding.with_shards(spark.range(4000), "id", [1.0, 3.0]).groupBy("shard").count().collect()
    assert 0.7 < {r.shard: r["count"] for r in heavy}[1] / 4000 < 0.8
    with pytest.raises(ValueError):
        sharding.with_shards(keyed.withColumn("shard", F.lit(0)), "doc_id", [1.0])


def test_syncmers_against_brute_force(spark, docs):
    text = F.coalesce("text", F.lit(""))
    split = F.filter(syncmers.words(text), lambda w: w != "")
    hashed = F.transform(split, lambda w: F.xxhash64(w))
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(split) - 2, F.lit(0))), lambda i: F.xxhash64(F.get(hashed, i), F.get(hashed, i + 1)))
    for r in docs.select(hashed.alias("w"), pairs.alias("h"), syncmers.anchors(text).alias("a")).collect():
        if len(r.w) >= syncmers.K:
            want = [i for i in range(len(r.w) - 4) if min(r.h[i : i + 4]) in (r.h[i], r.h[i + 3])]
        else:
            want = [0] if r.w else []
        assert [x["at"] for x in r.a] == want


def test_next_document(spark, docs):
    plain = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["doc_id"])
    rows = sorted((r.doc_id, r.text) for r in plain.collect())
    got = {r.doc_id: r.next_text for r in syncmers.with_next(plain, "doc_id", ["text"]).collect()}
    assert got == {rows[i][0]: rows[(i + 1) % len(rows)][1] for i in range(len(rows))}


def test_fingerprints_hold_all_anchors(spark, tmp_path):
    rng = random.Random(8)
    shared = words(rng, 500)
    texts = [f"{words(rng, 5000)} {shared} {words(rng, 5000)}", f"{words(rng, 3000)} {shared} {words(rng, 7000)}", "".join(rng.choice("abcdefgh") for _ in range(900)), "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op2_syncmer_fingerprints(spark, str(tmp_path)).collect()}
    marks = {i: [x.split(":") for x in got[i].fingerprint.split()] for i in got}
    assert len(marks[0]) > 4000 and len(marks[2]) > 300 and not marks[3] and not marks[4]
    assert all(int(a) < int(b) for (a, _), (b, _) in zip(marks[0], marks[0][1:], strict=False))
    one, two = ({h for _, h in marks[i]} for i in (0, 1))
    assert len(one & two) > 200 and abs(got[0].near_next - len(one & two) / len(one | two)) < 0.01
    # the same passage, 2,000 words earlier in the second text
    at = {h: int(a) for a, h in marks[1]}
    assert sum(int(a) - at[h] == 2000 for a, h in marks[0] if h in at) > 200
    assert got[2].near_edited > 0.3 and got[3].near_next == 1.0


def test_packing(docs):
    sized = queries.sized(docs)
    found = packing.best_fit(sized, 64).collect()
    assert sum(r.size for r in found) == sized.agg(F.sum("size")).first()[0]
    bins = {}
    for r in found:
        bins.setdefault(r.bin, []).append(r)
    for rows in bins.values():
        assert sum(r.size for r in rows) <= 64
        spans = sorted((r.offset, r.offset + r.size) for r in rows)
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
        for kind in ("source", "cluster"):
            held = [getattr(r, kind) for r in rows if getattr(r, kind) is not None]
            assert len(held) == len(set(held))


def test_packing_takes_the_tightest_compatible_bin():
    got = packing.pack([6, 5, 4, 3], [1, 0, 1, 0], [0, 0, 0, 0], 10)
    assert got == [(0, 0), (1, 0), (1, 5), (0, 6)]


def test_kneser_ney_sums_to_one_and_knows_its_counts(spark, docs):
    model = kneser_ney.train(docs)
    assert model.docs == docs.count() and model.n == sum(r.n_tokens for r in kneser_ney.score(docs, model, keep=["doc_id"]).collect())
    rng = random.Random(2)
    vocabulary = sorted({w for r in docs.collect() for w in (r.text or "").split()})
    probe = pa.array([rng.choice(vocabulary)])
    first = kneser_ney.token_hashes(probe)[0][:1]
    import numpy as np

    every = np.concatenate([kneser_ney.token_hashes(pa.array([w]))[0][:1] for w in vocabulary] + [np.array([kneser_ney.END, np.uint64(77)])])
    pairs = np.stack([np.repeat(first, len(every)), every], 1).ravel()
    begins = np.tile([True, False], len(every))
    p, _, known = model.log_probabilities(pairs, begins)
    assert math.isclose((10.0 ** p[1::2]).sum(), 1.0, rel_tol=1e-9) and known[1::2].sum() == model.v


def test_kneser_ney_without_training(spark, docs):
    model = kneser_ney.train(docs.limit(0))
    rows = kneser_ney.score(docs, model, keep=["doc_id"]).collect()
    assert all(r.score == 0 and r.base_score == 0 and r.n_known == 0 for r in rows)


def test_warc_round_trip(spark):
    big = "<p>" + "x" * 1200
    rows = [(1, "http://a/\r\nX: y", big), (2, "http://b", big), (3, None, "small"), (4, "http://c", "small"), (5, "http://d", None), (None, "http://e", big), (6, "http://é", "<b>é" * 999)]
    found = {r.page_id: r for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()}
    assert len(found) == len(rows)
    for page, _, html in rows:
        payload = (html or "").encode()
        assert (found[page].payload_bytes, found[page].payload_digest) == (len(payload), hashlib.sha1(payload).hexdigest())
    assert {p: (r.record_type, r.refers_to) for p, r in found.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("response", None), 4: ("response", None), 5: ("response", None), None: ("revisit", 2), 6: ("response", None)}
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_toxicity(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["scumbag", "nitwit"]) if i % 4 == 0 and rng.random() < 0.1 else words(rng, 1) for _ in range(90)), int(i % 4 == 0)) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(table.select("doc_id", "text"), table.select("doc_id", "toxic").where("doc_id < 300"))
    got = toxicity.scored(table, model).where("doc_id >= 300").collect()
    assert sum((r.score >= toxicity.THRESHOLD) == bool(r.toxic) for r in got) >= 95
    empty = toxicity.scored(spark.createDataFrame([(None, None), (1, "")], "doc_id long, text string"), toxicity.train(table.limit(0), table.select("doc_id", "toxic").limit(0))).collect()
    assert all(0 <= r.score < 1e-6 for r in empty)


def test_toxicity_learns_all_own_words_and_phrases():
    rng = random.Random(9)
    own = [f"zq{words(rng, 1)}{i}" for i in range(300)]
    text = lambda more: " ".join(rng.sample([*words(rng, 60).split(), *more], 60 + len(more)))
    # each own word in 40 of 400 toxic texts; others are toxic by "drop dead", whose words ordinary texts have too
    toxic = [text([own[(7 * i + 10 * j) % 300] for j in range(30)]) for i in range(400)] + [f"{words(rng, 30)} drop dead {words(rng, 30)}" for _ in range(60)]
    ordinary = [f"dead {text([])} drop" for _ in range(800)]
    rows = [(t, 1) for t in toxic] + [(t, 0) for t in ordinary]
    rng.shuffle(rows)
    model = toxicity.fit(rows[::2] + rows[1::4], rows[3::4], len(toxic), len(ordinary))
    scorer = toxicity.Scorer(model)
    assert sum(f" {w} ".encode() in model.own for w in own) > 270 and b" drop dead " in model.own
    assert len(model.whole[1]) > 50_000 and model.whole[0] != model.whole[1]
    bad = [scorer.score(f"{words(rng, 30)} drop dead {words(rng, 30)}") for _ in range(200)]
    good = [scorer.score(f"dead {text([])} drop") for _ in range(200)]
    assert sum((x > y) + (x == y) / 2 for x in bad for y in good) / 200**2 > 0.7


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(4)
    base = [words(rng, 150).split() for _ in range(12)]
    rows = [(100 + i, " ".join(b)) for i, b in enumerate(base)]
    for i, b in enumerate(base[:8]):
        for c in range(3):
            edited = list(b)
            edited[rng.randrange(150)] = f"edit{i}x{c}"
            rows.append((200 + 10 * i + c, " ".join(edited)))
    rows += [(300, rows[0][1]), (301, None), (302, ""), (303, "one two"), (304, "one two"), (None, rows[1][1]), (300, rows[0][1])]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_duplicates.classes(table).collect()
    assert len(found) == len(rows)
    got = {r.doc_id: r.class_id for r in found}
    for i in range(8):
        assert {got[100 + i], *(got[200 + 10 * i + c] for c in range(3))} == {100 + i}
    assert [got[108 + i] for i in range(4)] == [108, 109, 110, 111] and got[300] == 100 and got[None] == 101
    assert got[301] == got[302] == 301 and got[303] == got[304] == 303
    kept = near_duplicates.one_of_each(table).collect()
    assert sorted(r.doc_id for r in kept) == sorted({c for c in got.values()})
    assert near_duplicates.classes(table.limit(0)).count() == 0


def test_near_duplicates_against_weighted_brute_force(spark):
    """Pairs of 0.8 or more by weighted Jaccard similarity, restated in plain Python, share a class (recall over 0.95); classes hold no other links."""
    rng = random.Random(22)
    base = [words(rng, rng.randint(30, 200)).split() for _ in range(25)]
    passage = words(rng, 40).split()
    rows = []
    for i, b in enumerate(base):
        rows.append(b + passage if i % 3 == 0 else b)
        for _ in range(4):
            w = list(rows[-1])
            for at in rng.sample(range(len(w)), max(1, int(len(w) * rng.uniform(0, 0.05)))):
                w[at] = f"e{rng.randrange(10**9)}"
            rows.append(w)
    texts = [" ".join(w) for w in rows]
    found = {r.doc_id: r.class_id for r in near_duplicates.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    grams = [{} for _ in rows]
    for g, w in zip(grams, rows, strict=True):
        for j in range(len(w) - 4):
            g[tuple(w[j : j + 5])] = g.get(tuple(w[j : j + 5]), 0) + 1
    df = {}
    for g in grams:
        for x in g:
            df[x] = df.get(x, 0) + 1
    n = len(rows)
    rarity = {x: near_duplicates.LEAST_WEIGHT + (1 - near_duplicates.LEAST_WEIGHT) * math.log((n + 1) / f) / math.log(n + 1) for x, f in df.items()}
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links, hit = 0, 0
    for i in range(n):
        for j in range(i):
            both = grams[i].keys() | grams[j].keys()
            low = sum(min(grams[i].get(x, 0), grams[j].get(x, 0)) * rarity[x] for x in both)
            if low / sum(max(grams[i].get(x, 0), grams[j].get(x, 0)) * rarity[x] for x in both) >= 0.8:
                links += 1
                hit += found[i] == found[j]
                parent[max(root(i), root(j))] = min(root(i), root(j))
    assert links > 40 and hit >= 0.95 * links
    assert all(root(i) == root(c) for i, c in found.items())


def test_near_duplicates_by_join(spark, monkeypatch):
    """With more candidates than a bitmap is made for, their rows are joined: the classes are the same."""
    rng = random.Random(24)
    base = [words(rng, 80).split() for _ in range(6)]
    rows = [(10 * i + c, " ".join([*b[: 10 * c], f"edit{c}", *b[10 * c + 1 :]])) for i, b in enumerate(base) for c in range(4)] + [(None, " ".join(base[0])), (100, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = lambda: sorted(map(str, near_duplicates.classes(table).collect()))
    want = found()
    monkeypatch.setattr(near_duplicates, "MOST_FILTER_BITS", 10)
    assert found() == want


def test_near_duplicates_without_ids_and_with_clashing_columns(spark):
    rng = random.Random(23)
    w = words(rng, 120).split()
    near = [" ".join([*w[:k], "changed", *w[k + 1 :]]) for k in (10, 100)]
    other = words(rng, 50)
    rows = [(None, near[0], "p", 1), (None, near[1], "q", 2), (7, other, "r", 3), (7, words(rng, 60), "s", 4), (None, words(rng, 30), "t", 5)]
    table = spark.createDataFrame(rows, "doc_id long, text string, text_number string, CLASS_ID int")
    kept = near_duplicates.one_of_each(table)
    got = sorted(r.CLASS_ID for r in kept.collect())
    assert kept.columns == table.columns and got in ([1, 3, 4, 5], [2, 3, 4, 5])


def test_clashing_columns_raise(spark, docs):
    clash = lambda c: docs.withColumn(c, F.lit(1))
    for call in (
        lambda: sharding.with_shards(clash("Shard"), "doc_id", [1.0, 1.0]),
        lambda: sharding.with_slots(clash("SLOT"), "doc_id"),
        lambda: syncmers.with_next(clash("next_text"), "doc_id", ["text"]),
        lambda: toxicity.scored(clash("Score"), None),
        lambda: token_counts.count_tokens(clash("N_tokens"), queries.vocabulary()),
        lambda: url_filter.with_probability(clash("block_SCORE"), "text", "source", (None, 0.0)),
        lambda: kneser_ney.score(clash("base_Score"), None),
    ):
        with pytest.raises(ValueError):
            call()
    named = clash("n").withColumnRenamed("source", "c0")
    assert sharding.with_slots(named, "c0").columns == [*named.columns, "slot"]
    assert sharding.with_shards(clash("__best"), "doc_id", [1.0]).columns == [*docs.columns, "__best", "shard"]


def test_sharding_against_brute_force(spark):
    import struct

    import xxhash

    def bid(key, shard):
        h = xxhash.xxh64_intdigest(struct.pack("<i", shard), xxhash.xxh64_intdigest(key, 42))
        return -1 / math.log(((h >> 11) + 0.5) * 2.0**-53)

    ids = [*range(-5, 300), None]
    got = {r.doc_id: r for r in sharding.with_shards(spark.createDataFrame([(i,) for i in ids], "doc_id long"), "doc_id", [1.0] * 16, grown=("grown", 1.0)).collect()}
    for i in ids:
        key = b"\0null" if i is None else str(i).encode()
        bids = [bid(key, s) for s in range(17)]
        assert got[i].shard == max(range(16), key=bids.__getitem__) and got[i].grown == max(range(17), key=bids.__getitem__)


def test_packing_against_brute_force():
    """Every piece goes to the fullest compatible bin, by looking at all bins."""
    rng = random.Random(41)
    for _ in range(30):
        rows = sorted(((rng.randint(1, 40), 1 << rng.randrange(4) if rng.random() < 0.6 else 0, 1 << rng.randrange(6) if rng.random() < 0.5 else 0) for _ in range(60)), reverse=True)
        bins, want = [], []
        for size, source, cluster in rows:
            fits = [(room, b) for b, (room, s, c) in enumerate(bins) if room >= size and not s & source and not c & cluster]
            room, b = min(fits, default=(50, len(bins)))
            if b == len(bins):
                bins.append((50, 0, 0))
            want.append((b, 50 - room))
            bins[b] = (room - size, bins[b][1] | source, bins[b][2] | cluster)
        assert packing.pack([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], 50) == want


def test_packing_does_not_depend_on_the_split(spark, docs):
    rows = queries.sized(docs.union(docs).union(docs.where("doc_id < 4")))
    bins = lambda df: sorted(map(str, packing.best_fit(df, 64).collect()))
    assert bins(rows.repartition(1)) == bins(rows.repartition(7)) and packing.best_fit(rows.limit(0)).count() == 0


@pytest.mark.parametrize("order", [2, 3])
def test_kneser_ney_against_brute_force(spark, docs, order):
    rng = random.Random(61)
    few = [words(rng, 1) for _ in range(12)]
    more = [(1000 + i, " ".join(rng.choice(few) for _ in range(rng.randint(0, 30))), "f") for i in range(80)]
    docs = docs.unionByName(spark.createDataFrame(more, DOCS)).repartition(3)
    rows = [(r.text or "").lower().split() for r in docs.collect()]
    model = kneser_ney.train(docs, order)
    triples, pairs, raw, follows = {}, {}, {}, {}
    for w in rows:
        padded = [None, None, *w, ""]
        for a, b, c in zip(padded, padded[1:], padded[2:], strict=False):
            triples[a, b, c] = triples.get((a, b, c), 0) + 1
            raw[b, c] = raw.get((b, c), 0) + 1
    for _, b, c in triples:
        pairs[b, c] = pairs.get((b, c), 0) + 1
    pairs = {(b, c): raw[b, c] if b is None or order == 2 else n for (b, c), n in pairs.items()}
    for _, c in pairs:
        follows[c] = follows.get(c, 0) + 1
    of = lambda counts: kneser_ney.discounts([sum(c == i for c in counts.values()) for i in (1, 2, 3, 4)])
    d3, d2, d1 = of(triples), of(pairs), of(follows)
    assert [list(map(float, d)) for d in (d1, d2)] == model.discounts[:2] and (order == 2 or list(map(float, d3)) == model.discounts[2])
    v, total, spare, unigrams = len(follows), {}, {}, {}
    for counts, d in ((pairs, d2), (triples, d3)):
        for (*a, _), c in counts.items():
            total[tuple(a)] = total.get(tuple(a), 0) + c
            spare[tuple(a)] = spare.get(tuple(a), 0) + d[min(c, 3)]
    for w in rows:
        for b in [*w, ""]:
            unigrams[b] = unigrams.get(b, 0) + 1
    gamma = sum(d1[min(c, 3)] for c in follows.values()) / len(pairs)

    def p(a, b, c):
        n = follows.get(c, 0)
        out = max(n - d1[min(n, 3)], 0) / len(pairs) + gamma / (v + 1)
        for context, counts, d in (((b,), pairs, d2), ((a, b), triples, d3))[: order - 1]:
            if context in total:
                n = counts.get((*context, c), 0)
                out = (max(n - d[min(n, 3)], 0) + spare[context] * out) / total[context]
        return out

    longest = max(rows, key=len)
    probe = spark.createDataFrame([(0, "unseen words here"), (1, " ".join(longest)), (2, f"{few[0]} unseen {few[1]} {few[2]}"), (3, None), *((10 + i, t) for i, (_, t, _) in enumerate(more[:30])), (90, " ".join(rng.choice(few) for _ in range(400)))], "doc_id long, text string")
    n = sum(unigrams.values())
    assert model.n == n and model.v == v
    for r in kneser_ney.score(probe.withColumn("copy", F.col("text")), model, keep=["copy"]).collect():
        w = [None, None, *(r.copy or "").lower().split(), ""]
        want = sum(math.log10(p(a, b, c)) for a, b, c in zip(w, w[1:], w[2:], strict=False))
        base = sum(math.log10((unigrams.get(b, 0) + 1) / (n + v + 1)) for b in w[2:])
        assert math.isclose(r.score, want, rel_tol=1e-9) and math.isclose(r.base_score, base, rel_tol=1e-9) and r.n_tokens == len(w) - 2


def test_kneser_ney_triples_without_room_for_one_key():
    import numpy as np

    rng = np.random.default_rng(3)
    pair, before = rng.integers(0, 50, 4000).astype(np.uint64), rng.integers(0, 9, 4000)
    for counts in (None, rng.integers(1, 5, 4000)):
        one, two = (kneser_ney._triples(pair, before, counts, bits) for bits in (10, 30))
        assert all((a == b).all() for a, b in zip(one, two, strict=True))


def test_fingerprint_query_columns(spark, docs, tmp_path):
    """The edited text, its digest and the ends of the likeness, restated."""
    plain = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    plain.write.parquet(str(tmp_path / "documents.parquet"))
    rows = sorted((r.doc_id, r.text or "") for r in plain.collect())
    got = {r.doc_id: r for r in queries.op2_syncmer_fingerprints(spark, str(tmp_path)).collect()}
    for i, (doc, text) in enumerate(rows):
        half = len(text) // 2
        edited = text[: len(text) - half] + rows[(i + 1) % len(rows)][1][:half]
        r = got[doc]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and (edited != text or r.near_edited == 1)
    same = spark.createDataFrame([("one two three four five six " * 30, "one two three four five six " * 30)], "a string, b string")
    assert same.select(syncmers.likeness(syncmers.anchors(F.col("a")), syncmers.anchors(F.col("b"))).alias("x")).first().x == 1.0


def test_archives_are_one_stream_and_are_read_by_offset(spark, tmp_path):
    import zlib as z

    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}" + "y" * (1500 * (i % 5))) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    whole = warc.write_monolithic(warc.with_types(pages).coalesce(1), f"file://{tmp_path}").collect()
    data = (tmp_path / whole[0].path.rsplit("/", 1)[1]).read_bytes()
    unpacker = z.decompressobj(31)
    unpacker.decompress(data)
    assert len(whole) == 1 and unpacker.eof and not unpacker.unused_data  # one gzip member
    to = f"file://{tmp_path}/members.warc.gz"
    assert warc.normalise_file(whole[0].path, to)[0] == 40
    some = {warc.parse(raw)["page_id"] for raw in warc.read_members(to, {"<urn:page:3>", "<urn:page:17>"})}
    assert some == {3, 17}
    assert [len(list(warc.inflate(iter([data[:k], data[k:]])))) for k in (1, 1000, len(data) - 1)] == [40, 40, 40]
    with pytest.raises(ValueError):
        list(warc.inflate(iter([data[: len(data) // 2]])))
    # a small file that expands to much more than a block
    bomb = warc.record(1, "u", b"z" * (8 << 20), hashlib.sha1(b"z" * (8 << 20)).hexdigest(), "response", None)
    assert [len(x) for x in warc.inflate(iter([z.compress(bomb, 9, wbits=31)]))] == [len(bomb)]


def test_pipeline(spark, tmp_path):
    """Toxic documents, near copies and contaminated documents go; the rest is packed. Odd rows and columns pass; empty tables give nothing."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(51)
    ugly = lambda: " ".join(rng.choice(["scumbag", "nitwit", "lowlife"]) if rng.random() < 0.2 else words(rng, 1) for _ in range(80))
    rows = [(i, ugly() if i % 3 == 0 else words(rng, 80)) for i in range(240)]
    labels = [(i, 1, int(i % 3 == 0)) for i in range(200)]
    item = words(rng, 40)
    copied = rows[1][1].split()
    rows += [(300, " ".join([*copied[:40], "edit", *copied[41:]])), (301, f"{words(rng, 60)} {item} {words(rng, 60)}"), (302, None), (303, ""), (304, rows[2][1]), (None, words(rng, 50))]
    docs = spark.createDataFrame([(i, t, "en", f"s{k % 5}", len(t or ""), 0.5) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, score double")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
    left = {r.doc_id for r in kept.collect()}
    assert not left & {300, 301, 304} and {1, 2, None} <= left and len({302, 303} & left) == 1
    assert sum(i in left for i in range(240) if i % 3 == 0) <= 8 and sum(i in left for i in range(240) if i % 3) >= 150
    packed = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert packed == left
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(str(tmp_path / f"{name}.parquet")).limit(0).write.parquet(str(tmp_path / "empty" / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0


@pytest.mark.parametrize("name", ["op1_best_fit_packing", "op2_syncmer_fingerprints", "op3_rendezvous_sharding", "op4_kneser_ney", "op5_warc_round_trip", "op6_toxicity", "op7_minhash_near_dedup", "op8_decontamination", "op9_token_counts", "op10_url_filters"])
def test_empty_tables(spark, tmp_path, name):
    for table, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string"), ("pages", "page_id long, url string, html string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{table}.parquet"))
    assert queries.queries()[name](spark, str(tmp_path)).count() == 0


def test_shingle_weights_do_not_depend_on_the_corpus(spark):
    import numpy as np

    rng = np.random.default_rng(11)
    shared = " ".join(map(str, rng.integers(1 << 40, size=104)))  # 100 shingles of 150 documents
    texts = [" ".join(map(str, rng.integers(1 << 40, size=6000))) + (f" {shared}" if i % 2 else "") for i in range(300)]
    table = near_duplicates.document_frequencies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert table.documents == 300 and table.bits > 0
    h, counts, edges = near_duplicates.sets(pa.array([texts[0], shared]))
    w = near_duplicates.weights(h, counts, table)
    assert (w[: edges[1]] == 1).all()
    want = near_duplicates.LEAST_WEIGHT + (1 - near_duplicates.LEAST_WEIGHT) * math.log(301 / 150) / math.log(301)
    assert edges[2] - edges[1] == 100 and np.allclose(w[edges[1] :], want, atol=1e-6)


def test_decontamination(spark):
    rng = random.Random(6)
    items = [(i, words(rng, 15 + 3 * i)) for i in range(12)] + [(50, None), (51, "only four words here")]
    clean = [words(rng, 200) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(clean)] + [(100 + i, f"{clean[i]} {t} {clean[i + 1]}") for i, t in items[:12]] + [(200, None), (201, "only four words here"), (202, items[3][1]), (300, "changed " + items[11][1].split(" ", 1)[1])]
    table, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.matches(table, bench).collect()}
    assert got == {*((100 + i, i) for i in range(12)), (201, 51), (202, 3), (300, 11)}
    assert {r.doc_id for r in decontamination.without_matches(table, bench).collect()} == {*range(20), 200}
    assert decontamination.matches(table.limit(0), bench).count() == 0 and decontamination.matches(table, bench.limit(0)).count() == 0


def _edited(rng, kind, item, by):
    """An edited copy of the item's words, about the share by of them."""
    w, n = list(item), len(item)
    k = max(1, int(by * n))
    if kind == "inserted":
        at = rng.randrange(1, n)
        w[at:at] = words(rng, k).split()
    elif kind == "deleted":
        at = rng.randrange(n)
        del w[at : at + k]
    elif kind == "cut":
        w = w[k:] if rng.random() < 0.5 else w[:-k]
    elif kind == "substituted":
        for at in rng.sample(range(n), max(1, k // 8)):
            w[at] = f"other{at}"
    return w


@pytest.mark.parametrize("size", [5, 9, 16, 38, 59, 130, 245, 600, 2000])
def test_decontamination_against_brute_force(size):
    """Edited copies whose best passage reaches 0.8 by plain Jaccard similarity, embedded in other text: at least 0.9 are found."""
    rng = random.Random(size)
    shingled = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    items = [words(rng, size).split() for _ in range(6)]
    texts, want = [], []
    for i, item in enumerate(items):
        for kind in ("exact", "inserted", "deleted", "cut", "substituted"):
            for _ in range(40):
                w = _edited(rng, kind, item, rng.uniform(0.01, 0.24))
                a, b = shingled(w), shingled(item)
                if w and len(a & b) / len(a | b) >= 0.8:
                    texts.append(" ".join([words(rng, 60), *w, words(rng, 60)]))
                    want.append(i)
                    break
    index = decontamination.Index([(i, " ".join(w)) for i, w in enumerate(items)])
    found = {(d, i) for d, i, _, _ in index.search(pa.array([*texts, words(rng, 3000)]))}
    hits = sum((d, i) in found for d, i in enumerate(want))
    assert hits >= 0.9 * len(want) and found <= set(enumerate(want))


def test_decontamination_by_blocks(spark, monkeypatch):
    """Several blocks of items give what one block gives; repeated items are each reported; other columns stay."""
    rng = random.Random(31)
    items = [(i % 9, words(rng, 30)) for i in range(20)]
    items += [items[4], (None, words(rng, 25))]
    rows = [(i, f"{words(rng, 50)} {t} {words(rng, 50)}", "x") for i, (_, t) in enumerate(items)] + [(99, words(rng, 80), None), (98, None, "y")]
    table, bench = spark.createDataFrame(rows, "doc_id long, text string, c0 string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(str, ((r.doc_id, r.item_id) for r in decontamination.matches(table, bench).collect())))
    monkeypatch.setattr(decontamination, "BLOCK_ITEMS", 4)
    assert sorted(map(str, ((r.doc_id, r.item_id) for r in decontamination.matches(table, bench).collect()))) == whole and len(whole) == 24
    left = decontamination.without_matches(table, bench)
    assert left.columns == ["doc_id", "text", "c0"] and {r.doc_id for r in left.collect()} == {98, 99}


def test_decontamination_finds_passages_of_other_lengths():
    rng = random.Random(12)
    items = [(i, words(rng, 59)) for i in range(30)]
    index = decontamination.Index([*items, *((100 + i, words(rng, 40)) for i in range(40))])
    cut, longer = [], []
    for _, t in items:
        w = t.split()
        cut.append(" ".join([words(rng, 80), *w[:49], words(rng, 80)]))  # 45 of 55 shingles
        longer.append(" ".join([words(rng, 80), *w[:30], words(rng, 4), *w[30:], words(rng, 80)]))  # 51 of 63
    for texts, want in ((cut, 45 / 55), (longer, 51 / 63)):
        found = index.search(pa.array(texts))
        assert len(found) >= 20 and all(d == i and math.isclose(got, want, abs_tol=0.02) and at == 80 for d, i, got, at in found)


def test_url_filter(spark, tmp_path):
    urls = ["http://a.example.com/en/1", "https://www.EXAMPLE.com/en/2?x", "http://b.net/fr/3#t", "http://com", None, "nothing", "http://notexample.com/en/", "http://x.org?q=/en/"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r for r in queries.op10_url_filters(spark, str(tmp_path)).collect()}
    assert [got[i].rule for i in range(8)] == ["example.com/en/", "www.example.com/en/", "net/fr/", None, None, None, "com/", None]
    assert [got[i].verdict for i in (0, 1, 2, 6)] == ["block", "allow", "block", "allow"]
    assert (got[1].host, got[1].path, got[7].host, got[7].path, got[4].host) == ("www.example.com", "/en/2", "x.org", "", "")


def test_url_model_on_held_out_labels():
    held = [zlib.crc32(repr(x).encode()) % 5 == 0 for x in queries.url_labels()]
    train, test = ([x for x, h in zip(queries.url_labels(), held, strict=True) if h == part] for part in (False, True))
    got = url_filter.scores(pa.array([h for h, *_ in test]), pa.array([p for _, p, _ in test]), url_filter.fit(train)) >= 0.5
    bad = [y == 1 for *_, y in test]
    right = sum(g and b for g, b in zip(got, bad, strict=True))
    assert right / sum(got) > 0.95 and right / sum(bad) > 0.95  # precision and recall
    hosts = ["quietmeadow.example.org", "www.bakery.example.com", "the-casino-club.example.net", "spamhaus7.example.org"]
    model = url_filter.fit(queries.url_labels())
    assert [x >= 0.5 for x in url_filter.scores(pa.array(hosts), pa.array(["/en/17.html"] * 4), model)] == [False, False, True, True]


def test_url_scores_against_brute_force():
    rng = random.Random(7)
    model = url_filter.fit(queries.url_labels(100))
    rows = [("".join(rng.choice("ab-.é") for _ in range(rng.randint(0, 9))), "".join(rng.choice("/ab1") for _ in range(rng.randint(0, 9)))) for _ in range(60)] + [("", ""), ("a", "")]
    got = url_filter.scores(pa.array([*(h for h, _ in rows), None]), pa.array([*(p for _, p in rows), None]), model)

    def mixed(x):
        for _ in range(2):
            x = (x ^ (x >> 32)) * 0xD6E8FEB86659FD93 % 2**64
        return x ^ (x >> 32)

    def alone(h, p):
        buckets = set()
        for kind, text in ((1, h), (2, p)):
            data = b"^" + text.encode() + b"$"
            for n in url_filter.SIZES:
                for i in range(len(data) - n + 1):
                    x = 0
                    for c in data[i : i + n]:
                        x = mixed((x + mixed(c + (kind << 8))) % 2**64)
                    buckets.add(x % url_filter.BUCKETS)
        return 1 / (1 + math.exp(-(sum(model[0][b] for b in buckets) / max(1, len(buckets)) ** 0.5 + model[1])))

    assert all(math.isclose(g, alone(h, p), rel_tol=1e-9) for g, (h, p) in zip(got, [*rows, ("", "")], strict=True))


def test_held_out_rows(spark):
    rows = spark.range(200).select("id", kneser_ney.held_out(F.col("id")).alias("seventh"), toxicity.held_out(F.col("id")).alias("quarter")).collect()
    assert all(r.seventh == (zlib.crc32(str(r.id).encode()) % 7 == 2) and r.quarter == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)
