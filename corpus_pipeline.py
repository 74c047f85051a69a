"""Corpus pipeline: toxic documents out, one of each near-copy group, mixed sources, encoded.

``STAGES`` are (name, function) pairs; each function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and reread as the next one's docs.  All but the last return
the columns of the documents.  ``run`` applies them to the table of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hazecast.llm import mixing, piece_codec, simhash_grid, toxicity
from hazecast.llm.common import staged
from hazecast.llm.queries import BLOCK_TOKENS, MAX_REPETITION, SEED
from hazecast.session import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from all labels, does not call toxic."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, that with the smallest id."""
    return simhash_grid.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each use of a document: every document once at least, no source more than
    ``MAX_REPETITION`` times, weights as even as that allows."""
    mixed = mixing.mix_sources(docs, max_repetition=MAX_REPETITION, block_tokens=BLOCK_TOKENS, seed=SEED)
    return mixed.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the pieces of each row's text, their number and digest, and that of the text decoded from them."""
    got = piece_codec.encode_texts(docs.select("doc_id", "source", "text"), str(public_tokenizers.path("piece_bpe_32k.model")),
                                   with_ids=True)
    return got.select("doc_id", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_copies), ("mix_sources", mix), ("sentencepiece", encode)]

#: SQL can neither train the classifier nor encode.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
