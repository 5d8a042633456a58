"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before has kept, and returns a DataFrame; all but the last
return the columns of documents, any further columns among them, whatever their names. run() writes each stage's result as Parquet to the
shared folder and reads it back. An empty table gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankloom.llm import common, langid, mixing, packing, secrets, simhash
from rankloom.shipping import ship


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those without a letter or without a likely language go.

    A null or empty text has no letter and goes; a null language teaches nothing; repeated rows share their fate; a null id counts as an empty one in
    the fold that nothing is learned from; without any language to learn everything goes.
    """
    ship(spark)
    return langid.keep_known(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates, that with the smallest id.

    Texts without a word, null ones among them, are one group; of repeated rows one stays; a null id is larger than any other.
    """
    ship(spark)
    return simhash.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; n_chars follows.

    A null text stays null; spans that overlap are one mark; repeated rows and null ids stay as they are.
    """
    ship(spark)
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source: a document's row comes as often as it is taken, at most twice.

    A null source is a source of its own; documents without a word, null ones among them, are left out; repeated rows and rows with a null id are
    taken each for itself.
    """
    ship(spark)
    return mixing.take(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each row, with its sequence and place.

    A null text is the empty text, whose piece is the closing id alone; a null id stays null; repeated rows are packed each for itself; pieces of one
    length are interchangeable, so ties change no number of sequences.
    """
    ship(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("language identification", identify_language),
    ("near-duplicate removal", drop_near_duplicates),
    ("secret redaction", redact_secrets),
    ("source mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The models, XXH64 and the tokenizer are beyond SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = common.cut(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
