"""Word embeddings stored as JSON documents of several layouts.

A document is searched by its schema: a matrix under one of the names in `MATRIX`, and a vocabulary under one of those in
`VOCABULARY` (word to row) or in `INVERTED` (row to word, as an object or a list); both may lie deeper, in any object
within an object. A document whose values are all lists is a word-to-vector object. What can't be read gives no table but a reason, and
callers go on with hash vectors.

The document is held as a variant, so no schema of its words is inferred; the driver sees names and types of few fields.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of a matrix and of a vocabulary, in order of preference
MATRIX = ("tok_emb", "embeddings", "embedding", "emb", "weight", "weights", "vectors")
VOCABULARY = ("word2idx", "vocab", "stoi")
INVERTED = "idx2word"
#: Levels of nesting that are searched, and objects looked into at each.
DEPTH, WIDTH = 8, 64


@dataclass
class Loaded:
    """table: word, idx, vec; None with an error."""

    table: DataFrame | None
    error: str | None = None

    @property
    def mode(self) -> str:
        return "hash" if self.table is None else "tok_emb"


def _fields(doc: DataFrame, spark: SparkSession) -> DataFrame:
    """key, pos, value of the fields of a one-row table's object (column v)."""
    kind = F.schema_of_variant("v")
    only = doc.where(kind.startswith("OBJECT"))
    return only.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("key", "pos", "value")


def _at(key: str) -> str:
    return f'$["{key}"]'


def _inside(doc: DataFrame, key: str) -> DataFrame:
    return doc.select(F.variant_get("v", _at(key), "variant").alias("v"))


def _vectors(value: Column) -> Column:
    return F.variant_get(value, "$", "array<double>")


def _find(doc: DataFrame, spark: SparkSession, depth: int = DEPTH) -> DataFrame | None:
    """word, idx, vec of the first matrix and vocabulary in the document or within one of its objects."""
    known = [*MATRIX, *VOCABULARY, INVERTED]
    fields = _fields(doc, spark)
    kinds = {r["key"]: r["kind"] for r in fields.where(F.col("key").isin(known)).select("key", F.schema_of_variant("value").alias("kind")).collect()}
    matrix = next((k for k in MATRIX if kinds.get(k, "").startswith("ARRAY<ARRAY<")), None)
    vocabulary = next((k for k in VOCABULARY if kinds.get(k, "").startswith("OBJECT")), None)
    if matrix and (vocabulary or INVERTED in kinds):
        rows = _inside(doc, matrix).lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select(F.col("pos").cast("long").alias("idx"), _vectors(F.col("value")).alias("vec"))
        name = vocabulary or INVERTED
        entries = _inside(doc, name).lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        if vocabulary:
            words = entries.select(F.col("key").alias("word"), F.variant_get("value", "$", "long").alias("idx"))
        elif kinds[INVERTED].startswith("OBJECT"):
            words = entries.select(F.variant_get("value", "$", "string").alias("word"), F.col("key").cast("long").alias("idx"))
        else:
            words = entries.select(F.variant_get("value", "$", "string").alias("word"), F.col("pos").cast("long").alias("idx"))
        return words.where("word is not null").join(rows, "idx").select("word", "idx", "vec")
    if depth:
        nested = fields.where(F.schema_of_variant("value").startswith("OBJECT") & ~F.col("key").isin(known)).orderBy("pos").limit(WIDTH).select("key").collect()
        for r in nested:
            found = _find(_inside(doc, r["key"]), spark, depth - 1)
            if found is not None:
                return found
    return None


def _word_to_vector(doc: DataFrame, spark: SparkSession) -> DataFrame | None:
    """word, idx, vec of an object whose first values are lists of numbers and that has none of the known names."""
    fields = _fields(doc, spark)
    if fields.where(F.col("key").isin("word2idx", "tok_emb", "idx2word", "vocab")).limit(1).count():
        return None
    first = fields.orderBy("pos").limit(5).select(F.schema_of_variant("value").alias("kind")).collect()
    if not first or not all(r["kind"].startswith("ARRAY<") and not r["kind"].startswith(("ARRAY<ARRAY", "ARRAY<OBJECT")) for r in first):
        return None
    return fields.select(F.col("key").alias("word"), F.col("pos").cast("long").alias("idx"), _vectors(F.col("value")).alias("vec"))


def parse(doc: DataFrame) -> Loaded:
    """The embedding of a one-row table (text), a JSON document."""
    spark = doc.sparkSession
    held = doc.select(F.try_parse_json("text").alias("v")).where("v is not null")
    kind = held.select(F.schema_of_variant("v").alias("k")).first()
    if kind is None:
        return Loaded(None, "not a JSON document")
    if not kind["k"].startswith("OBJECT"):
        return Loaded(None, "the top of the document is no object")
    table = _word_to_vector(held, spark)
    if table is None:
        table = _find(held, spark)
    if table is None:
        names = [r["key"] for r in _fields(held, spark).orderBy("pos").limit(8).select("key").collect()]
        return Loaded(None, f"no matrix with a vocabulary found; top names: {names}")
    return Loaded(table)


def load(spark: SparkSession, path: str) -> Loaded:
    """The embedding in a JSON file of one of the layouts; a missing file is an error of the result, too."""
    from pyspark.errors import AnalysisException

    try:
        return parse(spark.read.option("wholetext", "true").text(path).select(F.col("value").alias("text")))
    except AnalysisException as e:
        return Loaded(None, str(e).split("\n")[0])
