"""A corpus from documents: language, near copies, personal data, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents; others are
left out, whatever their names.

Null, empty and letterless texts have no language and go in the first stage. Of rows that repeat,
or share a text, one stays after the second; rows without an id all stay there. The third keeps
every row, the fourth repeats or leaves out whole ones, and its null sources are a source of their
own. The last gives a row for each. An empty table passes through all stages as an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.llm import bpe, language, mixing, order_minhash, pii_crf
from vicinal.llm.queries import TOKENIZER
from vicinal.llm.shared import held_out, materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a language that holds a third of them, go."""
    docs = docs.select(*COLUMNS)
    return language.reject(docs, language.fit(docs.where(~held_out(F.col("doc_id")))))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the least id stays."""
    return order_minhash.without_near_copies(docs.select(*COLUMNS))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data in texts give way to the names of their kinds; no document goes."""
    return pii_crf.redact(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights; documents are repeated or left out whole."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digests of ids and of the bytes they decode to."""
    return bpe.tokenize(docs.select(*COLUMNS), public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN, keep=("doc_id", "lang", "source"), with_ids=True)


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("personal_data", mask_personal_data),
    ("mix", mix_sources),
    ("tokens", encode_bytes),
]

#: A learned model decides in two of the stages, which SQL can't express; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
