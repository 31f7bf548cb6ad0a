"""The corpus pipeline: language ID, near-duplicates, benchmark decontamination, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
what a stage returns to the shared folder and reads it again for the next.
All stages but the last return the columns of documents, and keep further
columns of whatever name. An empty table stays empty in each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievework.llm import chunks, decontaminate, langid, minhash
from sievework.llm.common import table, written
from sievework.llm.registry import TOKENIZER


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go.

    These are null, empty and letterless texts, and those whose most likely
    language has a probability under one half. Learned from the rows with a
    language; where none has one, only letterless texts go. Whole texts of any
    length count; repeated rows fare alike, ties go to the first language of
    the alphabet.
    """
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near and exact copies stays.

    Rows with one id and different texts are separate documents; of equal rows
    one stays, of rows with one id and text the smallest. Null ids come last;
    null texts have no copies and stay. Empty and wordless texts are copies
    only of equal ones.
    """
    return minhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, give or take 15 % of its words, go.

    Null, empty and wordless texts stay, and such items match nothing; repeated
    rows go or stay together. Whole texts of any length are searched.
    """
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its token ids, and the text that they decode to.

    A null or empty text has no ids and decodes to the empty one; repeated rows
    stay, a text of any length is one row.
    """
    return chunks.encode_decode(docs, TOKENIZER, digests=False).select("doc_id", "lang", "source", "n_tokens", "ids", "decoded")


STAGES = [("language_id", identify_language), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_leaks), ("bpe", encode)]

#: Language ID and near-duplicates can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
