"""The operators' queries over the driver's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliant.llm.bpe import encode
from foliant.llm.frames import table
from foliant.llm.language import identify
from foliant.llm.mixing import ORACLE as MIXING_SQL
from foliant.llm.mixing import mix_sources
from foliant.llm.neighbours import nearest_neighbours
from foliant.llm.pseudonyms import pseudonymise
from foliant.llm.scoring import score_documents
from foliant.llm.simhash import near_duplicates
from foliant.llm.store import store_and_verify
from foliant.llm.urls import ORACLE as URLS_SQL
from foliant.llm.urls import filter_urls, spam_list
from foliant.llm.winnowing import winnow

#: The key of the tests and of the driver's queries; real data takes a secret one.
KEY = b"foliant pseudonyms, key of the tests and the driver's queries"


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents"), KEY)


def op4_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, spam_list(pages))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, queries=vectors.filter("vec_id % 50 = 0"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, keep=("doc_id", "lang"))


def op9_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_and_verify(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_winnowing": op1_winnowing,
    "op2_mixing": op2_mixing,
    "op3_pseudonyms": op3_pseudonyms,
    "op4_backoff": op4_backoff,
    "op5_urls": op5_urls,
    "op6_neighbours": op6_neighbours,
    "op7_bpe": op7_bpe,
    "op8_language": op8_language,
    "op9_store": op9_store,
    "op10_simhash": op10_simhash,
}

ORACLE_SQL: dict[str, str] = {
    "op2_mixing": MIXING_SQL,
    "op5_urls": URLS_SQL,
}
