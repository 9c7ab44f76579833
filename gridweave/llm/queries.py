"""The queries of this subpackage: each applies its operator to the whole of its table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm import bpe, centroids, chat, exact_dedup, line_dedup, packing, phrases, pii, quality, secrets, simhash, token_files, warc
from gridweave.llm.shared import new_path, table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    packed = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=None)
    return found.select("doc_id", *quality.BASE, "base_failed", "kept")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), out)
    return token_files.with_crc(token_files.read_token_files(spark, out)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.with_secrets(table(spark, sf_dir, "documents")))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(chat.CONTROL).alias("text")) for i, r in enumerate(("user", "assistant"))))).alias("x")).select("x.*")
    return chat.digests(chat.formatted(turns.unionByName(extra)))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    groups = exact_dedup.exact_groups(docs.withColumn("text_sha256", F.sha2(exact_dedup.normalised(), 256)))
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.found_spans(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, out = table(spark, sf_dir, "pages"), new_path(spark, "archives")
    warc.write_archives(pages, out)
    return warc.page_records(warc.read_archives(spark, out), pages.schema["page_id"].dataType.simpleString())


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, centres = centroids.clustered(centroids.whole_vectors(table(spark, sf_dir, "embeddings")))
    return centroids.described(state, centres)


QUERIES = {
    "op1_packing": op1_packing,
    "op2_bpe": op2_bpe,
    "op3_quality": op3_quality,
    "op4_simhash": op4_simhash,
    "op5_token_files": op5_token_files,
    "op6_secrets": op6_secrets,
    "op7_line_dedup": op7_line_dedup,
    "op8_chat": op8_chat,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_pii": op10_pii,
    "op11_phrases": op11_phrases,
    "op12_warc": op12_warc,
    "op13_centroids": op13_centroids,
}
ORACLES: dict[str, str] = {"op7_line_dedup": line_dedup.ORACLE, "op8_chat": chat.ORACLE, "op9_exact_dedup": exact_dedup.ORACLE, "op11_phrases": phrases.ORACLE, "op12_warc": warc.ORACLE, "op13_centroids": centroids.ORACLE}
