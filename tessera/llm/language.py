"""Language identification by compression.

For each language a raw-content zstandard dictionary is cut from a bounded sample of labelled texts. A text is
compressed whole with every dictionary, in pieces of `PIECE` bytes that each start from the dictionary (so that a long
text doesn't become its own), and the sizes are added up; the language with the fewest bytes is predicted, the more
frequent one among equals. Where the smallest and the next size lie within `margin` of each other (a share of the
next), the prediction is marked rejected.

The only sample is the dictionaries': `docs_per_lang` excerpts of `excerpt` characters for each language, from
distinct texts picked by a hash of the text. Both sides are lower-cased first, and all but letters becomes one space.

Texts that are null or have no letter give `und`, score 0, rejected. Where no labelled text exists, all do. With one
language only, that one is predicted with score 1. Repeated rows and null ids are rows as any other; labels, ids and
sources are never read when predicting.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCS_PER_LANG, EXCERPT, LEVEL, MARGIN, PIECE = 300, 400, 9, 0.01, 1024
_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """The text's words in lower case, one space between them."""
    return _OTHER.sub(" ", text.lower()).encode("utf-8", "surrogatepass")


def fold(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def dictionaries(labelled: DataFrame, docs_per_lang: int = DOCS_PER_LANG, excerpt: int = EXCERPT) -> dict[str, bytes]:
    """Raw dictionary content by language, most frequent first, from rows (text, lang). About 120 kB each reach the driver."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    pick = F.xxhash64("text")
    # the share is of distinct texts, so that copies don't eat the sample; it's ample, so an approximate count will do
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("count"), F.approx_count_distinct(pick).alias("distinct"))
    share = F.least(F.lit(1.0), F.lit(4.0 * docs_per_lang) / F.col("distinct"))
    near = (
        rows.join(F.broadcast(counts), "lang")  # one row for each language
        .where(F.pmod(pick, F.lit(1 << 20)) < share * (1 << 20))
        .select("lang", pick.alias("h"), "text")
        .select(
            "lang",
            "h",
            F.substring("text", (F.pmod(F.hash("h"), F.greatest(F.lit(1), F.length("text") - excerpt)) + 1).cast("int"), F.lit(excerpt)).alias("part"),
        )
        .groupBy("lang", "h")
        .agg(F.min("part").alias("part"))
    )
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    out: dict[str, list[str]] = {r["lang"]: [] for r in counts.orderBy(F.desc("count"), "lang").collect()}
    for r in near.withColumn("rank", rank).where(F.col("rank") <= docs_per_lang).orderBy("lang", "rank").collect():
        out[r["lang"]].append(r["part"])
    return {lang: letters(" ".join(parts)) for lang, parts in out.items()}


class Classifier:
    """One compressor for each language; content is in order of preference among equals."""

    def __init__(self, content: dict[str, bytes], level: int = LEVEL):
        self.langs, self.by = list(content), []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(content[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level)
            self.by.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def __call__(self, text: str | None, margin: float = MARGIN) -> tuple[str, float, bool]:
        """Language, score and whether it's rejected."""
        if not text or not self.by or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        raw = letters(text)
        pieces = [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]
        sizes = [sum(len(c.compress(p)) for p in pieces) for c in self.by]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        if len(sizes) == 1:
            return self.langs[best], 1.0, False
        second = min(s for i, s in enumerate(sizes) if i != best)
        gap = (second - sizes[best]) / second
        return self.langs[best], 0.5 + 0.5 * min(1.0, 5 * gap), gap < margin


def identify(docs: DataFrame, content: dict[str, bytes], margin: float = MARGIN, level: int = LEVEL, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, lang_score and lang_rejected; columns of those names are replaced."""
    new = ("lang_pred", "lang_score", "lang_rejected")
    kept = docs.drop(*new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(content, level)
        for batch in batches:
            found = [model(t.as_py(), margin) for t in batch.column(batch.schema.names.index(text_col))]
            langs, scores, rejected = zip(*found, strict=True) if found else ((), (), ())
            arrays = [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, *new])

    schema = T.StructType([*kept.schema.fields, *(T.StructField(n, k) for n, k in zip(new, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True))])
    return kept.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the folds other than 2 of 4."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    content = dictionaries(docs.where(fold(F.col("doc_id"), 4) != 2))
    return identify(docs.select("doc_id", "text"), content).select(
        "doc_id",
        (fold(F.col("doc_id"), 4) == 2).alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
        F.col("lang_rejected").alias("rejected"),
    )
