"""The training-data operators as queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, conversations, exact, html_text, neighbours, oracles, packing, quality, repeats, secrets, simhash, spelling, topk, warc
from tidemark.llm.util import table
from tidemark.llm.vocabulary import WORD_BPE


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.classify(documents(spark, sf_dir))


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(documents(spark, sf_dir))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 20 == 0)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(documents(spark, sf_dir), WORD_BPE)


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), table(spark, sf_dir, "labels", "doc_id", "quality"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), WORD_BPE)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(documents(spark, sf_dir))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classify(documents(spark, sf_dir))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")).drop("edits")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(documents(spark, sf_dir))


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 50 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_dedup, op2_repeats, op3_neighbours, op4_bpe, op5_html, op6_quality, op7_warc, op8_packing, op9_secrets, op10_simhash, op11_conversations, op12_spelling, op13_topk)}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact.oracle(), "op7_warc": warc.ORACLE, "op11_conversations": oracles.CONVERSATIONS, "op12_spelling": oracles.SPELLING, "op13_topk": topk.ORACLE}
