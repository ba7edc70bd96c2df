"""The corpus pipeline: documents to packed training sequences.

Stages are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as
Parquet and reads again as the next stage's docs. All but the last return the columns of documents, further ones
included, whatever their names; a null text counts as empty; repeated rows and ids are rows of their own until a stage
that drops copies; no rows give no rows; very long texts are taken whole.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from keystrata.llm import decontaminate, exact_dedup, near_dedup, packing, rowset, toxicity
from keystrata.llm.common import cut, table
from keystrata.llm.queries import WORD_BPE
from keystrata.llm.tokens import vocabulary


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: learn from the labelled documents of this input; documents that score 0.7 or more go."""
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"), "toxic")
    return toxicity.without_toxic(docs, machine, 0.7)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of rows with equal texts (null: empty) one stays, that with the smallest doc_id, of several such the
    first. Rows go by their place in the files, so rows that share a doc_id with other texts stay, and rows that repeat
    everything, or have no doc_id, go like any other."""
    docs = rowset.filed(docs)
    groups = exact_dedup.exact_groups(docs)
    return rowset.without(docs, cut(groups.where("not kept").select("file", "row"), "copies"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of rows linked by a similarity of 0.8 on five-word shingles one stays, that with the smallest doc_id (a
    null is the largest), of several such the first; rows go by their place in the files. Texts without words all stay."""
    docs = rowset.filed(docs)
    groups = near_dedup.near_duplicates(docs, k=5, share=Fraction(4, 5))
    return rowset.without(docs, cut(groups.where("not stays").select("file", "row"), "near-copies"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents with eight consecutive words of a benchmark item, or with two items, go."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"), n=8, least_items=2)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: what is left, packed into sequences of at most 4096 tokens."""
    pieces = packing.pack_documents(docs, vocabulary(WORD_BPE), capacity=4096, closing_id=2)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: Toxicity, near-duplicates and packing are not SQL; tests hold the rows of run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
