"""The corpus pipeline: from raw documents to token ids, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, language, linededup, parityjoin, pieces
from tessera.llm.workspace import Workspace

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A template of so many tokens recurs from two documents on.
PAIR_TOKENS = 20


def _recount(docs: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars as the text now is."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def _without_dropped(left: DataFrame) -> DataFrame:
    """What line dedup leaves, without the documents of which nothing is left."""
    return _recount(left.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; a missing lang is filled in. Without any labelled text all stay."""
    content = language.dictionaries(docs)
    if not content:
        return docs.select(*COLUMNS)
    found = language.identify(docs.select(*COLUMNS), content)
    return found.where(~F.col("lang_rejected")).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_template_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines whose template recurs; those of which nothing is left go."""
    return _without_dropped(linededup.drop_lines(docs.select(*COLUMNS)))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by five-word shingles at a similarity of 0.8."""
    return parityjoin.keep_one(docs.select(*COLUMNS), 5, 80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no ten-word span with a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contaminated(docs.select(*COLUMNS), items).where(~F.col("contaminated")).select(*COLUMNS)


def drop_long_lines_of_pairs(docs: DataFrame) -> DataFrame:
    """Documents without the long lines whose template a document before has; those of which nothing is left go.

    This comes after the joins that drop whole documents: before them it would make fragments of near copies, and a line
    would go with its only other document.
    """
    return _without_dropped(linededup.drop_lines(docs.select(*COLUMNS), min_docs=2, min_tokens=PAIR_TOKENS))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, less the long lines that two of them still share, with the ids of their pieces, and whether these decode to the text."""
    coded = pieces.encode(drop_long_lines_of_pairs(docs))
    return coded.select(*COLUMNS, "piece_ids", F.col("piece_text").eqNullSafe(F.col("text")).alias("round_trip"))


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_template_lines),
    ("n-gram Jaccard join", keep_one_of_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: SQL can't express the first stage or the last; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written before the next reads it, and goes once that one is written.

    Null ids, null and blank texts, repeated rows and further columns are no error: rows without a letter have no language
    and go in the first stage; repeated rows are one document, of which the third stage keeps one; rows of equal n-grams are ties, and the
    smallest id stays; only the columns of documents are kept. An empty table gives an empty table.
    """
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = ws.stage(docs, f"stage-{i}")
            ws.drop(f"stage-{i - 1}")
    return docs
