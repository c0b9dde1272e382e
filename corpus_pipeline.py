"""The corpus pipeline: stages over documents, each written as Parquet and read again as input of the next.

A stage is a function of (spark, docs, sf_dir).  All but the last return the
columns of ``documents``; the last adds shard and slot.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from scriptoria.llm.decontaminate import find_leaks
from scriptoria.llm.langid import LETTERS_ONLY, identify, trained_on_the_rest
from scriptoria.llm.minhash import keep_one_of_each
from scriptoria.llm.mixing import mix_documents
from scriptoria.llm.rows import table
from scriptoria.llm.sharding import shard_documents
from scriptoria.session import shared_folder

# Of all words that reach the mixing stage, in percent, and passes over a leaf.
MIX_PERCENT, MIX_EPOCHS = 90, 1
# Words of a shingle in the near-duplicate stage; the two words of op7 are that query's own contract.
NEAR_SHINGLE_WORDS = 5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the kernel classifier knows: those go that score below what texts of their size in a learned language do.

    A text without a letter is known in no language.  Where no row gives
    anything to learn from, that is no fault of a text: those with a letter
    stay then.  Nulls go, very long texts are whole, repeated rows are judged
    alike, other columns stay as they are; an empty table gives no rows.
    """
    model = trained_on_the_rest(docs)
    judged = identify(docs, model if model.learned else LETTERS_ONLY)
    return judged.where("lang_known").select(*(f"`{c}`" for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates - sets of five words, similarity 0.8 - the one with the smallest id.

    Cases as in ``keep_one_of_each``; other columns stay as they are and an empty table gives no rows.
    """
    return keep_one_of_each(docs, NEAR_SHINGLE_WORDS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word under a benchmark window.

    Nulls and texts without words stay, very long texts are searched whole, repeated rows are judged alike; an empty table gives no rows.
    """
    found = find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.where("NOT contaminated").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the budgets of their domains, languages and sources.

    Null languages and sources are one leaf '?'; empty texts cost nothing; rows that repeat a doc_id are taken as one; cases as in ``mix_documents``.
    """
    return mix_documents(docs, MIX_PERCENT, MIX_EPOCHS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with shard and slot; nulls count as empty texts, equal texts lie together, an empty table gives no rows."""
    return shard_documents(docs)


STAGES = [
    ("4 language ID", language),
    ("7 MinHash near-dedup", near_dedup),
    ("3 benchmark decontamination", decontaminate),
    ("8 mixing sources to target weights", mix),
    ("6 sharding", shard),
]

# The language stage is a trained model: no SQL; tests/llm/test_layout.py and test_stages.py compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
