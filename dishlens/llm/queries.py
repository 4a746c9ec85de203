"""The registered query of each operator, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dishlens.llm import chat, collocations, exact_dedup, filter_audit, language_id, mixing, near_dedup, pieces, quality_rules, simhash, substring_dedup, suffix_dedup, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.tokenized(table(spark, sf_dir, "documents"))


def exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return exact_dedup.decisions(table(spark, sf_dir, "documents")).select(columns)


def mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=2)


def substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.dedupe_passages(table(spark, sf_dir, "documents")))


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.probe(spark, table(spark, sf_dir, "conversations"))
    return chat.digest(chat.formatted(chat.branches(chat.replies(turns))))


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.dedupe_strings(table(spark, sf_dir, "documents")))


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def simhashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_quality_rules": quality,
    "op2_toxicity": toxic,
    "op3_sentencepiece": sentence_pieces,
    "op4_exact_dedup": exact,
    "op5_mixing": mix,
    "op6_near_dedup": near,
    "op7_substring_dedup": substring,
    "op8_chat_formatting": chats,
    "op9_language_id": languages,
    "op10_suffix_dedup": suffixes,
    "op11_collocations": phrases,
    "op12_simhash_near_dedup": simhashes,
    "op13_filter_audit": filters,
}
