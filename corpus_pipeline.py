"""A training corpus from raw documents: no toxic texts, one of each group of near copies, no benchmark texts, no secrets, token ids."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import bpe, decontam, ngramjoin, secrets, toxicity
from lumenframe.llm.common import shared_folder, stored, table


def toxic_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go; labels of its training rows come from ``labels``.

    Null and empty texts stay; repeated rows, and ties of ids, are judged each by its own text; columns may have any name.
    """
    return toxicity.clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that the n-gram Jaccard join links, one document stays: that of the smallest doc_id, null ids last, ties by
    the smallest hash of the text. Repeated rows are one document; a text without words, null ones among them, is a group by itself
    with the rows of its doc_id; columns may have any name."""
    return ngramjoin.deduplicated(docs)


def benchmark_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go. Null and empty texts stay; repeated rows stay or go together; columns may have any name."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, repeated rows and null texts among them; secrets in its text give way to a mark; columns may have
    any name."""
    return secrets.redacted(docs, shared_folder(spark, "ledger"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the digest of the bytes to which the ids decode, of every document; a null text has no ids.
    Repeated rows stay; other columns aren't read."""
    out = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("text_sha256"))


#: Each function takes (spark, docs, sf_dir); what one returns is written as Parquet and read again as the next one's docs.
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_texts),
    ("ngram_jaccard_join", near_copies),
    ("benchmark_decontamination", benchmark_texts),
    ("secret_scans", secret_spans),
    ("byte_level_bpe", token_ids),
]

#: A trained model decides the first stage, which SQL can't express; tests/llm holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; an empty table gives an empty one."""
    folder = shared_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
