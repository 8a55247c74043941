"""The queries of the training-data operators; each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import chat, decontaminate, divergence, labelled, lmscore, media, mixing, packing, prefixtrie, quality, sharding, simhash, tokencount, toxicity
from tidewheel.scratch import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@_query
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.allot(_table(spark, sf_dir, "documents"))
    drawn = F.filter("mix.shards", lambda s: s < mixing.SHARDS)  # the copies that the splitting tree gave to a shard
    return found.select("doc_id", "size", "mix.source_size", "mix.target", (F.size(drawn) * F.col("size")).cast("long").alias("taken"))


ORACLE_SQL["op1_mix_sources"] = mixing.ORACLE_SQL


@_query
def op2_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    rows = sharding.shard_documents(docs).select("doc_id", sharding.byte_size("text").alias("size"), sharding.text_crc32("text").alias("text_crc32"), F.lit("bytes").alias("law"), "shard")
    return sharding.with_slots(cut(rows, "shards")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@_query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencount.with_token_counts(docs).select("doc_id", "tokens.n_tokens", F.size("tokens.section_tokens").cast("long").alias("n_sections"), "tokens.n_crossing", "tokens.section_tokens")


@_query
def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(_table(spark, sf_dir, "conversations"))


ORACLE_SQL["op4_chat"] = chat.ORACLE_SQL


@_query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    score = F.col("toxicity")
    found = toxicity.with_toxicity(docs, _table(spark, sf_dir, "labels"))
    return found.select("doc_id", labelled.held_out().alias("held_out"), score.alias("score"), (score >= toxicity.REJECT).cast("int").alias("predicted"))


@_query
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, _table(spark, sf_dir, "benchmark")).select("doc_id", "hits.*")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@_query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    score = F.col("quality")
    found = quality.with_quality(docs, _table(spark, sf_dir, "labels"))
    return found.select("doc_id", labelled.held_out().alias("held_out"), score.alias("score"), (score >= quality.ACCEPT).cast("int").alias("predicted"))


@_query
def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    good = _table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    return lmscore.with_target_scores(docs, good).select("doc_id", "lm.*")


@_query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@_query
def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = media.media_columns(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    tail = F.crc32(F.expr("substring(payload, greatest(1, octet_length(payload) - 63), 64)"))
    return made.select("doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), tail.alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature")


@_query
def op11_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


@_query
def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


ORACLE_SQL["op12_divergence"] = divergence.ORACLE_SQL


@_query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.trie(prefixtrie.rebuilt(_table(spark, sf_dir, "conversations")))


ORACLE_SQL["op13_prefix_trie"] = prefixtrie.ORACLE_SQL
