"""A pipeline of training-data stages over ``documents``.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept. All but the last return the columns of documents, with ``n_chars``
as the text now has them. In every stage null texts count as empty, texts are
taken whole, rows that share an id are judged by its rules for repeated ids,
extra columns pass through whatever their names, and an empty table gives no
rows; what differs is said at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm import line_dedup, near_dup, packing, secrets, toxicity
from kmerloom.llm.tables import documents, materialise


def _recounted(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")).select(columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; repeated rows are judged alike, by their text and language."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines that at least five documents hold stay only in the last of them, that with the largest id.

    Rows that share an id count as one document; a null id is the smallest.
    """
    return _recounted(line_dedup.strip_lines(docs), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, that with the smallest id.

    Documents without words, and those with a null id, all stay. Rows that
    share an id stay if one of them does.
    """
    return near_dup.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking credentials are masked; widely copied examples stay. No rows go."""
    return _recounted(secrets.mask_live(docs), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their place in a sequence; repeated rows are packed each for itself."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("best_fit_packing", pack_sequences),
]

#: The classifier and the tokenizer have no SQL form; the stages are tested against brute force (tests/llm/test_edges.py).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
