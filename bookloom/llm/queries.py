"""The thin queries over the standard tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, chunkdedup, decontaminate, exactdup, htmltext, langid, linededup, mixing, neardup, quality
from ._common import crc_mod, table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.sort_array(F.transform("item_ids", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"),
        decontaminate.is_contaminated().alias("contaminated"),
    )


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.rendered(table(spark, sf_dir, "pages")).select("page_id", F.length("rendered").cast("long").alias("n_chars"), F.col("rendered").alias("text"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    model = langid.train(docs, ~held_out & F.col("doc_id").isNotNull())
    return langid.identified(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", F.col("__bl_lines").cast("long").alias("n_lines"), F.col("__bl_gone").cast("long").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    model = quality.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    found = quality.scored(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdup.exact_dedup(spark, f"{sf_dir}/documents.parquet")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunkdedup.dedup_substrings(table(spark, sf_dir, "documents"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    rows = rows.unionByName(spark.sql("select -1L conv_id, * from values (0L, 'user'), (1L, 'assistant') t(turn, role)").withColumn("text", F.lit(said)))
    chats = chat.parse(chat.format_chats(rows.withColumn("parts", chat.text_parts(F.col("text")))))
    as_read = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id",
        F.size("messages").cast("long").alias("n_turns"),
        F.sha2(as_read.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontaminate,
        op2_html_extract,
        op3_language_id,
        op4_line_dedup,
        op5_quality_classifier,
        op6_minhash_neardup,
        op7_exact_dedup,
        op8_substring_dedup,
        op9_mix_sources,
        op10_chat_format,
    )
}
