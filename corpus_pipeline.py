"""Corpus cleaning pipeline: toxicity, line dedup, near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. All but the last return the columns of ``documents``; the last returns
the packed pieces.

All stages take other columns in ``docs`` and leave them out, whatever their
names; an empty table gives an empty result. A null text counts as empty and
stays null; the empty texts are copies of each other, so near-dedup keeps the
one of the smallest id. Rows without an id pass every stage. Rows that repeat
an id and a text are one document to each stage that drops, and stay together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlake.llm.common import read_table, stored
from bazaarlake.llm.line_dedup import drop_repeated_lines
from bazaarlake.llm.near_dedup import keep_one_of_each
from bazaarlake.llm.packing import pack_documents
from bazaarlake.llm.queries import tokenizer
from bazaarlake.llm.substring_dedup import drop_repeated_passages
from bazaarlake.llm.toxicity import learn_grammar, learning_rows, reject_toxic

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _recounted(docs: DataFrame) -> DataFrame:
    """The columns of documents, with ``n_chars`` of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar does not reject; it is learned from the labelled learning rows of these documents.

    Where nothing can be learned no document is rejected.
    """
    grammar = learn_grammar(learning_rows(docs, read_table(spark, sf_dir, "labels")))
    return reject_toxic(docs.select(*COLUMNS), grammar)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that a document with a smaller id holds; one that loses all its lines stays, empty."""
    return _recounted(drop_repeated_lines(docs.select(*COLUMNS)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the smallest id."""
    return keep_one_of_each(docs.select(*COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that a document with a smaller id holds; all documents stay."""
    return _recounted(drop_repeated_passages(docs.select(*COLUMNS)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, packed into sequences; an empty text is one piece of its end mark."""
    return pack_documents(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

ORACLE_SQL = None  # learned scores, signatures and packing have no SQL form; a test makes each stage's decisions again in plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
