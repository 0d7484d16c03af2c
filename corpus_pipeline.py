"""The corpus pipeline: five operators of ``kindred.llm`` one after the other.

Each stage takes all that the one before has kept and returns the columns of documents; the last gives the encoded
documents.

Defined cases, for every stage: an empty table gives an empty one; other columns come back as they are, whatever their
names (``n_chars`` follows the text where it is there); a null ``doc_id`` is a document like any other; null and empty
texts are kept by all stages but the classifier, which scores them like other texts; rows that repeat are classified,
cleaned and encoded alike, and the join keeps one of them. Cutting passages can make texts alike that the join has told
apart: it is judged on its own input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm._common import discard, free_name, shared_table, table
from kindred.llm.decontaminate import decontaminate
from kindred.llm.linedup import dedup_lines
from kindred.llm.ngram_join import one_of_each
from kindred.llm.quality import score_quality
from kindred.llm.queries import tokenizer_path
from kindred.llm.sentencepiece_lattice import encode
from kindred.shipping import ship

#: The classifier, line removal and joins cannot be told exactly in SQL.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    columns = tuple(free_name(x, docs) for x in ("held_out", "score", "predicted"))
    return score_quality(docs, table(spark, sf_dir, "labels"), columns).where(F.col(columns[2]) == 1).select(*docs.columns)


def _sized(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns, ``n_chars`` counted anew."""
    return docs.select(*(F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias(c) if c == "n_chars" else F.col(c) for c in columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more share; all documents stay, be it without text."""
    return _sized(dedup_lines(docs, min_docs=10, min_chars=1, counts=None), docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near copies."""
    ship(spark)
    return one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of test items; those that are mostly such passages go."""
    return _sized(decontaminate(docs, table(spark, sf_dir, "benchmark")), docs.columns)


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document."""
    ship(spark)
    return encode(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece_encoding", sentencepiece_encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, shared_table(stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
