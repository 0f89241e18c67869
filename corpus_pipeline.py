"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

1. toxicity: documents that the factorization machine scores 0.7 or more go.
2. line_dedup: lines of repeated three-line windows go, all but their first occurrence.
3. near_dedup: one document of each group of near copies stays.
4. mix: sources are mixed to their target weights; a document comes once for each time the mix takes it.
5. bpe: token ids, their count, and digests of them and of the text decoded from them.

Defined results of the stages, for tables with the columns of ``documents`` and others beside them: an empty
table gives an empty table; null texts count as empty and stay null; rows with null doc_id stay up to the mix,
which treats them as one more id; repeated rows are judged alike, and near_dedup keeps one of them; without any
label no document is toxic.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quern.llm import bpe, line_dedup, mixing, simhash, toxicity
from quern.llm.work import table
from quern.sources.scratch import Temporary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.7 or more go. Learns from all labelled documents that it is given."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; n_chars follows its new text."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", line_dedup.new_length(docs, out.columns[-1])).select(*[f"`{c}`" for c in docs.columns])


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingle sets at a resemblance of 0.8 or more make a group; its row with the smallest doc_id stays.

    SimHash links and keys of minima give the candidates, the exact sets decide.
    """
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes the document."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The one stage that doesn't return the columns of ``documents``."""
    return bpe.encode_digests(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("near_dedup", dedup_near), ("mix", mix_sources), ("bpe", encode)]

#: No SQL: the factorization machine and the near copies can't be expressed in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with Temporary() as t:  # what a stage leaves goes once its result is written
            docs = t.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
