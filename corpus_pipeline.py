"""A training corpus from raw documents: five stages of the llm subpackage.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents; the last adds shard, slot and grown_shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm.decontaminate import decontaminate
from loomwright.llm.jaccard import keep_one
from loomwright.llm.langid import UNDETERMINED, fit, held_out, identify
from loomwright.llm.mixing import WEIGHTS, mix_sources
from loomwright.llm.sharding import N_SHARDS, assign_shards
from loomwright.llm.storage import materialise
from loomwright.llm.tables import free_name, table

#: Documents whose score for their best language is lower are rejected: those in between languages, and those whose
#: letters are over 1.4 nats less likely on average than the language's own (noise, scripts and languages not learned).
MIN_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a determined language; the model is fitted on the stage's own input.

    A null or empty text, and one without letters, goes; rows with a null language are not learned from but judged like any
    other; rows that repeat are judged alike; without any labelled row everything goes; an empty table stays empty.
    """
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    lang, score = free_name(docs, "lang_pred"), free_name(docs, "score")
    found = identify(docs, model, lang_pred=lang, score=score)
    return found.filter((F.col(lang) != UNDETERMINED) & (F.col(score) >= MIN_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of similar documents.

    A text without words is similar to nothing and stays; the first is that of the smallest id, a null id only where no row
    of the group has one; of rows with one id and text the first by their other columns stays; an empty table stays empty.
    """
    return keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item.

    A null or empty text has no window and stays, a null item has none; rows that repeat an id are judged each by its own
    text; with an empty benchmark all stay; an empty table stays empty.
    """
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the sources' target weights; the sharding stage orders the copies.

    A null source is a source of its own, a null id hashes as the empty string; rows that repeat an id are repeated alike;
    an empty table stays empty. Columns named copy, n_copies or shuffle_key are kept.
    """
    own = {c: free_name(docs, c) for c in ("copy", "n_copies", "shuffle_key") if c in docs.columns}
    mixed = mix_sources(docs.withColumnsRenamed(own), WEIGHTS)
    return mixed.select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shards and slots; copies of a document stand apart in their shard.

    A null id has a shard as any other, a null text size 8; rows that repeat an id share a shard and have slots of their own;
    an empty table stays empty.
    """
    return assign_shards(docs, "doc_id", N_SHARDS, tuple(c for c in docs.columns if c != "doc_id"), apart=True)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("sharding", sharding),
]

#: The language model is learned, which SQL can't express; tests/llm holds the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
