"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, mixing sources, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one before kept. All but the last return the
columns of ``documents``; stages are written as Parquet in the shared folder and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from epitrail.llm import langid, linededup, mixing, packing, simhash
from epitrail.llm.common import DOC_COLUMNS, discard, saved, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model rejects go: null and empty texts, those without letters, and those in no language that it knows.

    Without labelled documents nothing is known, and all go. Repeated rows are judged alike; an empty table stays empty; texts of any
    length are read whole. Here and in the other stages, columns other than those of ``documents`` are dropped first.
    """
    docs = docs.select(*DOC_COLUMNS)
    return langid.accepted(docs, langid.train(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that resemble each other the first stays, by doc_id (null last) and line; blank lines stay.

    A document may become empty; a null text stays null; repeated rows keep and lose the same lines; an empty table stays empty;
    texts and lines may be of any length.
    """
    return linededup.deduplicated(docs.select(*DOC_COLUMNS))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies, by five-word shingles with a Jaccard similarity of 0.8 or more, the one with the smallest id stays.

    Null ids come last. Null texts and texts without words are copies of each other; of repeated rows one stays; an empty table stays empty;
    all shingles of a text of any length take part.
    """
    return simhash.without_near_copies(docs.select(*DOC_COLUMNS))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: whole, or of at most one of each source the first words.

    A null source is one of its own; rows without words are not taken; repeated rows are separate; an empty table stays empty; a text of
    any length counts by its words, and may be cut.
    """
    return mixing.mixed_documents(docs.select(*DOC_COLUMNS))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences. A null or empty text is the end id alone; an empty table has no pieces; texts of any length are read whole."""
    return packing.pack(docs.select(*DOC_COLUMNS))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("mixing_sources", mixing_sources),
    ("best_fit_packing", best_fit_packing),
]

#: SQL expresses neither the language model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
        if written is not None:
            discard(written)  # the stage after it is written
        written = docs
    return STAGES[-1][1](spark, docs, sf_dir)
