"""A corpus pipeline over the table ``documents``, each stage one operator of ``tidefeed.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefeed.llm import decontaminate, langid, mixture, nearcopies, tokenstore
from tidefeed.llm.text import boxed, table
from tidefeed.llm.tokenstore import default_tokenizer
from tidefeed.session import new_folder, written

#: No SQL can express the learned, hashed and encoded stages; tests hold them against plain Python.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents with a letter; if no row has a language to learn from, all letters count as one."""
    model = langid.fit(docs)
    if not model.languages:
        model = langid.any_language()
    marked = boxed(docs, "text")
    marked = marked.select("_row", langid.language(marked, model, "_text").alias("_got"))
    return marked.where(F.col("_got.score") > 0).select("_row.*")


def remove_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity 0.8."""
    return nearcopies.one_of_each(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents of whose words less than one in twenty stand in a benchmark window."""
    return decontaminate.clean_documents(docs, table(spark, folder, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents as often as the mix of sources has them."""
    return mixture.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids of all documents in a keyed store, and where each document's ids are in it."""
    store = new_folder(spark, "corpus-tokens")
    tokenstore.write_shards(docs, store, default_tokenizer())
    return tokenstore.read_back(spark, store).select(
        "doc_id", "start", F.col("n").alias("n_tokens"), F.col("crc32").alias("ids_crc32"), "shard", "segment", "offset")


STAGES = [
    ("language_id", identify_language),
    ("near_copies", remove_near_copies),
    ("decontamination", remove_contaminated),
    ("mixture", mix_sources),
    ("token_store", write_tokens),
]


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``, each reading what the one before has written."""
    docs = table(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, folder), name)
    return STAGES[-1][1](spark, docs, folder)
