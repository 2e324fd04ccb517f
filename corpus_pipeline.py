"""From raw documents to packed sequences of tokens, in five stages.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, as
it leaves them; the last returns the packing. A stage works on what the stage before
kept, written as Parquet and read again. What a stage's result still reads lives until
the session ends, so results of several stages and runs stand side by side; ``run`` saves
what a stage returns and then frees what that stage has written.

All stages take doc_id, text, lang and source (packing: doc_id and text) and return every
column of ``docs`` but for the last; columns whose names an operator uses are no matter.
Null and empty texts count as texts without words, long ones are read whole, an empty
table gives an empty result, and rows that repeat a doc_id are rows of their own. Each
stage says below what it does to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wordloom.llm.common import Scratch, owned, table
from wordloom.llm.decontaminate import keep_clean
from wordloom.llm.lines import without_repeats
from wordloom.llm.neardup import keep_first
from wordloom.llm.packing import pack
from wordloom.llm.quality import keep_good

#: The near-dedup stage has no contract of its own: five words and a similarity of 0.8 or more.
SIMILAR = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, those without 50 words (null and empty texts too) among them.

    Null languages and sources are groups of their own; equal rows get equal verdicts.
    """
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A line stays in the first document that has it or one near it; a document that loses all its words goes.

    Null, empty and blank texts stay as they are. Between equal doc_ids the text's hash
    decides which is first; a null doc_id comes first. Rows with the same doc_id and text
    are one document: they keep the same lines.
    """
    return without_repeats(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest doc_id.

    Texts without words are in no group. Rows with that doc_id all stay, and so does a
    group that has null doc_ids alone.
    """
    return keep_first(docs, SIMILAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; texts without words aren't contaminated, and equal rows go together."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences; a null or empty text is a piece of one token.

    Every row is packed, repeated ones and null doc_ids too.
    """
    return pack(docs)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]
#: Edit-distance classes, signatures and packing have no SQL form; a test compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch, last = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline"), None
    for name, stage in STAGES:
        name = name.replace(" ", "_")
        with owned():
            docs = scratch.save(stage(spark, docs, sf_dir), name)
        if last:
            scratch.drop(last)
        last = name
    return docs
