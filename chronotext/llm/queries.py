"""The operators as queries over whole test tables, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.llm import bpe, compression, language, line_dedup, merkle, ngram_join, packing, phrases
from chronotext.llm import rules, sharding, token_files, url_rules, vectors
from chronotext.llm.tokens import default_path
from chronotext.registry.base import Registry, table

R = Registry()


@R.add("op1_shards")
def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.uniform_shards(table(spark, sf_dir, "documents"), 24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@R.add("op9_line_dedup", line_dedup.SQL)
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_repeated_lines(docs)


@R.add("op2_packing")
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, default_path("byte_bpe_50k.json")).select(
        "doc_id", "start", "length", packing.wide_crc(F.col("ids"), F.col("length")).alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def held_out(modulus: int, remainder: int) -> Column:
    """The fold of a document, by the crc32 of its id as text."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


@R.add("op3_language")
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = held_out(4, 2)
    model = language.train(docs.where(~held))
    return language.tag(docs.select("doc_id", "text"), model).select(
        "doc_id", held.alias("held_out"), "lang_pred", "score")


@R.add("op4_vectors", vectors.SQL)
def op4_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


@R.add("op5_quality")
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = held_out(3, 1)
    model = compression.train(docs, table(spark, sf_dir, "labels").where(~held))
    scored = docs.select("doc_id", held.alias("held_out"), compression.score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@R.add("op6_bpe")
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.encode_words(docs, default_path("word_bpe_49k.json"), digest=True)


@R.add("op7_ngram_join", ngram_join.SQL)
def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


@R.add("op8_token_files")
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_files.round_trip(spark, docs, default_path("byte_bpe_50k.json"), 2)


@R.add("op10_quality_rules")
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learned = rules.train(docs, table(spark, sf_dir, "labels"))
    return rules.judge(docs, learned).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@R.add("op11_merkle", merkle.SQL)
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    given = F.when(even & F.col("text").contains("\n"), merkle.leaf(*fields, F.replace("text", F.lit("\n"), F.lit(""))))
    digests = docs.select("doc_id", "source", merkle.leaf(*fields, F.col("text")).alias("leaf"), given.alias("given"))
    out = merkle.manifest(digests, "source", ["doc_id"], "leaf")
    folded = merkle.fold(F.coalesce("given", "leaf"), F.col("path"))
    return out.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof(F.col("path")), 256).alias("proof_sha256"),
        folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


@R.add("op12_phrases", phrases.SQL)
def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


@R.add("op13_url_filters", url_rules.SQL)
def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge_urls(pages, url_rules.default_rules(spark)).drop("url")


QUERIES = R.queries
ORACLE_SQL = R.sql
