"""The registered queries of the training-data operators: each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sectorpulse.llm import (
    alignment,
    chat,
    decontaminate,
    exact_dedup,
    near_join,
    packing,
    prefix_trie,
    quality,
    substring_dedup,
    token_counts,
    token_store,
    toxicity,
    warc,
)
from sectorpulse.llm.common import shared_folder, vocabulary, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "token-files")
    docs = _table(spark, sf_dir, "documents")
    token_store.write(docs, folder, vocabulary("byte_bpe_50k.json"), end_id=2)
    return token_store.read(spark, folder).withColumnRenamed("id", "doc_id")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = "\\### Assistant: </turn> ok"
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(marks).alias("text"),
    )
    formatted = written(chat.render(conversations.unionByName(added)), "chat-text")
    return chat.digests(formatted).withColumnRenamed("conversation", "conv_id")


def op3_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = quality.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return drawn.drop("key").withColumnRenamed("id", "doc_id")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return counts.withColumnRenamed("id", "doc_id")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return packed.withColumnRenamed("id", "doc_id")


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = near_join.join(_table(spark, sf_dir, "documents"), shingle=4, percent=85)
    return joined.withColumnRenamed("id", "doc_id")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "archives")
    warc.write(_table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder).select(
        F.col("id").alias("page_id"),
        F.col("n_bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.passages(_table(spark, sf_dir, "documents"))
    return found.drop("key").withColumnsRenamed({"id": "doc_id", "other_id": "other_doc_id"})


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontaminate.mark(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return marked.drop("segment", "place").withColumnRenamed("id", "doc_id")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = exact_dedup.mark(_table(spark, sf_dir, "documents"))
    return marks.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.numbered(_table(spark, sf_dir, "conversations"))
    conversation = F.col("group")
    n_head = F.crc32(conversation.cast("string").cast("binary")) % 4
    trie = prefix_trie.build(*prefix_trie.rebuilt(turns, conversation - conversation % 20, n_head, most=3))
    several = prefix_trie.ends_digests(trie.ends)
    none, one = F.sha2(F.lit("").cast("binary"), 256), F.sha2(F.col("first_end").cast("string").cast("binary"), 256)
    nodes = trie.nodes.where("n_ends <= 1").withColumn("ends_sha256", F.when(F.col("n_ends") == 0, none).otherwise(one))
    nodes = nodes.unionByName(trie.nodes.where("n_ends > 1").join(several, "key"))
    return nodes.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    aligned = alignment.align_documents(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    return aligned.withColumnRenamed("id", "doc_id")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model).withColumnRenamed("id", "doc_id")
    return scored.select(
        "doc_id",
        toxicity.held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_store": op1_token_store,
    "op2_chat_format": op2_chat_format,
    "op3_importance_resampling": op3_importance_resampling,
    "op4_token_counts": op4_token_counts,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_warc": op7_warc,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_decontaminate": op9_decontaminate,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_toxicity": op13_toxicity,
}
