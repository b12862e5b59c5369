"""One query for each operator, over its whole table, with the operator's production parameters."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, kneser_ney, near_duplicates, packing, sharding, syncmers, token_counts, toxicity, url_filter, warc


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def sized(docs: DataFrame) -> DataFrame:
    """docs as best_fit() takes them; exact copies are a cluster, empty texts are none."""
    return docs.select("doc_id", "source", F.when(F.col("text") != "", F.xxhash64("text")).alias("cluster"), packing.size_of(F.col("text")).alias("size"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in bins of CAPACITY words."""
    return packing.best_fit(sized(_table(spark, sf_dir, "documents", "doc_id", "text", "source")))


def op2_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    docs = _table(spark, sf_dir, "documents", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = syncmers.with_next(docs, "doc_id", ["text"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    both = both.select("doc_id", "text", "next_text", n.cast("long").alias("n_chars"), edited.alias("edited"))
    # Found here, so that only texts are shuffled.
    both = both.withColumns({into: syncmers.anchors(F.col(text)) for into, text in (("own", "text"), ("of_next", "next_text"), ("of_edited", "edited"))})
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        syncmers.as_text(F.col("own")).alias("fingerprint"),
        syncmers.as_text(F.col("of_edited")).alias("edited_fingerprint"),
        syncmers.likeness(F.col("own"), F.col("of_edited")).alias("near_edited"),
        syncmers.likeness(F.col("own"), F.col("of_next")).alias("near_next"),
    )


def op3_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on 16 shards of equal weight, by doc_id."""
    text = F.coalesce("text", F.lit(""))
    docs = _table(spark, sf_dir, "documents", "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    sharded = sharding.with_shards(docs, "doc_id", [1.0] * 16, grown=("grown_shard", 1.0))
    return sharding.with_slots(sharded, "shard").select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents, by a model of those that aren't held out."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "text").withColumn("held_out", kneser_ney.held_out(F.col("doc_id")))
    model = kneser_ney.train(docs.where(~F.col("held_out")))
    return kneser_ney.score(docs, model).withColumn("train_tokens", F.lit(model.n).cast("long"))


def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to monolithic archives, normalised and read back."""
    return warc.round_trip(_table(spark, sf_dir, "pages", "page_id", "url", "html"))


def toxicity_model(docs: DataFrame, spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """A model of the labelled documents that aren't held out."""
    labels = _table(spark, sf_dir, "labels", "doc_id", "toxic").where(~toxicity.held_out(F.col("doc_id")))
    return toxicity.train(docs, labels)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    found = toxicity.scored(docs, toxicity_model(docs, spark, sf_dir)).drop("text")
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document."""
    found = near_duplicates.classes(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item of which it holds a passage."""
    return decontamination.matches(_table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "benchmark", "item_id", "text"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    counted = token_counts.count_tokens(docs, vocabulary(), keep=["doc_id", "n_bytes"])
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


#: Rules as (action, host, path).
URL_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

#: Words of the labelled table's unwanted hosts and sections, and the parts of its neutral ones.
URL_BAD = ("casino", "betting", "poker", "pills", "viagra", "adult", "porn", "spam", "malware", "phishing", "ads", "track", "clickbait", "torrent", "warez", "bets")
URL_PLAIN = ("docs", "about", "shop", "travel", "garden", "music", "science", "museum", "school", "weather", "recipes", "football", "library", "city", "health", "photo")
URL_OPEN, URL_VOWEL, URL_CLOSE = ("b", "k", "th", "m", "r", "s", "t", "w", "h", "l", "st", "sh", "p", "d", "n", "f"), ("a", "e", "i", "o", "u", "ou", "ea", "io"), ("", "n", "r", "s", "nd", "th", "ng", "ble", "t", "re", "ly", "tion")
URL_BEFORE, URL_JOINED = ("", "www.", "blog.", "m.", "news."), ("free", "best", "my", "the")
URL_DOMAINS = ("example.com", "example.net", "example.org", "example.edu")


def url_labels(names: int = 2000) -> list[tuple[str, str, int]]:
    """(host, path, 1 to block) of the small labelled table: as many to block as to allow, of many shapes.

    Neutral hosts are made of syllables or plain words, unwanted ones hold a bad word, alone or joined to another; a
    neutral host with a bad section is unwanted too. The choices go round by remainders, so the table is always the same.
    """
    out = []
    syllable = lambda n: URL_OPEN[n % 16] + URL_VOWEL[n // 16 % 8] + URL_CLOSE[n // 128 % 12]
    for i in range(names):
        name = "".join(syllable(zlib.crc32(f"{i} {k}".encode())) for k in range(2 + i % 3))
        plain, bad, joined = URL_PLAIN[(i + i // 16) % 16], URL_BAD[(i * 7 + i // 16) % 16], URL_JOINED[i // 5 % 4]
        host = (name, plain, f"{joined}-{plain}", f"{plain}{name}", f"{name}-{plain}")[i % 5]
        hidden = (bad, f"{joined}-{bad}", f"{bad}-{plain}", f"{bad}{i % 10}", f"{name}-{bad}")[i // 16 % 5]
        before, domain = URL_BEFORE[i // 3 % 5], URL_DOMAINS[i // 5 % 4]
        section = (("en", "de", "fr", "es", "it")[i // 2 % 5], plain, f"{2000 + i % 25}/{1 + i % 12:02d}", "wiki")[i // 4 % 4]
        tail = (f"{i * 37 % 1000}", f"{i * 37 % 1000}/", f"{i * 53 % 1000}.html", f"{name}-{i % 10}", "")[i // 7 % 5]
        out.append((f"{before}{host}.{domain}", f"/{section}/{tail}", 0))
        if i % 4 == 3:
            out.append((f"{before}{host}.{domain}", f"/{bad}/{tail}", 1))
        else:
            out.append((f"{before}{hidden}.{domain}", f"/{section}/{tail}", 1))
    return out


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on the url of every page."""
    pages = _table(spark, sf_dir, "pages", "page_id", "url")
    parts = pages.select("page_id", url_filter.host(F.col("url")).alias("host"), url_filter.path(F.col("url")).alias("path"))
    rule, action = url_filter.rule_of(F.col("host"), F.col("path"), URL_RULES)
    judged = url_filter.with_probability(parts.withColumns({"rule": rule, "action": action}), "host", "path", url_filter.fit(url_labels()))
    verdict = F.coalesce("action", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "block_score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {}
