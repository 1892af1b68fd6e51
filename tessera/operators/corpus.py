"""Corpus operators: sentences from documents and pages, keep-first dedup, vocabulary and frequency tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.workspace import Workspace


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = T.MIN_LEN, max_len: int = T.MAX_LEN) -> DataFrame:
    """id, pos, sentence for every part of a text that passes the sentence filters; narrow, no shuffle."""
    parts = docs.select(F.col(id_col), F.posexplode(T.split_sentences(F.col(text_col))).alias("pos", "part"))
    return parts.select(id_col, "pos", F.trim("part").alias("sentence")).where(T.keep_sentence(F.col("sentence"), min_len, max_len))


def keep_first(df: DataFrame, key, order: list[str]) -> DataFrame:
    """The first row by order of each key (a column's expression, or a list of names, which are then shuffled but once). One
    aggregation with partial minima: a key in a third of all rows is no burden."""
    cols = df.columns
    if isinstance(key, list):
        lead = F.struct(*order, *[c for c in cols if c not in order and c not in key])
        return df.groupBy(*key).agg(F.min(lead).alias("_row")).select(*(F.col(c if c in key else f"_row.{c}").alias(c) for c in cols))
    lead = F.struct(*order, *[c for c in cols if c not in order])
    return df.groupBy(key.alias("_key")).agg(F.min(lead).alias("_row")).select(*(F.col(f"_row.{c}").alias(c) for c in cols))


def corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sentences of all documents, each exact text once, in its first place."""
    return keep_first(sentences(docs, id_col, text_col), ["sentence"], [id_col, "pos"])


def page_sentences(pages: DataFrame) -> DataFrame:
    """page_id, url, pos, sentence of crawled pages, once by lower-cased text."""
    shown = pages.select("page_id", "url", T.html_text(F.col("html")).alias("text"))
    return keep_first(sentences(shown, "page_id").join(pages.select("page_id", "url"), "page_id"), F.lower("sentence"), ["page_id", "pos"])


def crawl(pages: DataFrame, max_sentences: int = 300) -> DataFrame:
    """The first sentences in order of arrival, over all pages."""
    return page_sentences(pages).orderBy("page_id", "pos").limit(max_sentences)


def crawl_log(pages: DataFrame) -> DataFrame:
    """page_id, url and sentences found, for pages with any; one aggregation."""
    shown = pages.select("page_id", "url", T.html_text(F.col("html")).alias("text"))
    found = sentences(shown, "page_id").groupBy("page_id").agg(F.count(F.lit(1)).alias("n_sentences"))
    return pages.select("page_id", "url").join(found, "page_id")


def numbered(df: DataFrame, by: list, name: str, ws: Workspace) -> DataFrame:
    """df with a number from 0 in the order of `by` (columns that tell all rows apart, or rows that are equal).

    Rows are dealt by ranges, numbered within their range and moved up by the counts of the ranges before: no task sees
    more than its range.
    """
    part, base = f"_{name}_part", f"_{name}_base"
    rows = ws.stage(df.repartitionByRange(*by).withColumn(part, F.spark_partition_id()), f"{name}-ranges")
    before = F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    bases = rows.groupBy(part).agg(F.count(F.lit(1)).alias("n")).select(part, F.coalesce(before, F.lit(0)).alias(base))
    own = F.row_number().over(Window.partitionBy(part).orderBy(*by)) - 1
    return rows.withColumn(name, own).join(F.broadcast(bases), part).withColumn(name, F.col(name) + F.col(base)).select(*df.columns, name)


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, pos, tok: one row for each token."""
    return docs.select(F.col(id_col), F.posexplode(T.tokenize(F.col(text_col))).alias("pos", "tok"))


def word_count(toks: DataFrame) -> DataFrame:
    return toks.groupBy("tok").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(toks: DataFrame, min_count: int = 2, size: int = 20_000, id_col: str = "doc_id") -> DataFrame:
    """tok, n, idx: the most frequent tokens, ties by first appearance. The top is taken before it's numbered, so one task sees `size` rows at most."""
    counted = toks.groupBy("tok").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(id_col, "pos")).alias("first")).where(F.col("n") >= min_count)
    top = counted.orderBy(F.desc("n"), "first").limit(size)
    return top.select("tok", "n", (F.row_number().over(Window.orderBy(F.desc("n"), "first")) - 1).alias("idx"))


def type_token_ratio(toks: DataFrame) -> DataFrame:
    """Distinct over all tokens, 0 if there are none; counted by token first, so nothing is gathered."""
    by = word_count(toks).agg(F.count(F.lit(1)).alias("d"), F.sum("n").alias("n"))
    return by.select(F.when(F.col("n") > 0, F.col("d") / F.col("n")).otherwise(0.0).alias("vocab_div"))


def negative_sampling(vocab: DataFrame, power: float = 0.75, threshold: float = 1e-3) -> DataFrame:
    """tok, p_negative and p_keep of each word of a vocabulary."""
    sums = vocab.agg(F.sum(F.pow("n", F.lit(power))).alias("z"), F.sum("n").alias("total"))
    share = F.col("n") / F.col("total")
    keep = F.least(F.lit(1.0), (F.sqrt(share / threshold) + 1) * threshold / share)
    return vocab.crossJoin(F.broadcast(sums)).select("tok", (F.pow("n", F.lit(power)) / F.col("z")).alias("p_negative"), keep.alias("p_keep"))  # one row


def skip_gram_pairs(docs: DataFrame, window: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """center, context, n: pairs at most window apart, formed within the row (no self join).

    A pair of places counts for both of its orders, so each is formed once, with its words in order, and the counts are
    turned around after they are added up: half the rows are shuffled. Neighbours come from the text moved by each distance.
    """
    t = F.col("_t")
    moved = [F.slice(t, d + 1, F.size(t)).alias(f"r{d}") for d in range(1, window + 1)]
    rows = docs.select(T.tokenize(F.col(text_col)).alias("_t")).select(t.alias("c"), *moved)
    at = rows.select(F.inline(F.arrays_zip("c", *(f"r{d}" for d in range(1, window + 1)))))
    pairs = at.select("c", F.explode(F.array(*(f"r{d}" for d in range(1, window + 1)))).alias("o")).where("o is not null")
    counts = pairs.groupBy(F.least("c", "o").alias("a"), F.greatest("c", "o").alias("b")).agg(F.count(F.lit(1)).alias("k"))

    def row(x: str, y: str, n: Column) -> Column:
        return F.struct(F.col(x).alias("center"), F.col(y).alias("context"), n.alias("n"))

    both = F.when(F.col("a") == F.col("b"), F.array(row("a", "b", 2 * F.col("k")))).otherwise(F.array(row("a", "b", F.col("k")), row("b", "a", F.col("k"))))
    return counts.select(F.inline(both))


def top_retention(early: DataFrame, late: DataFrame, k: int = 100) -> DataFrame:
    """Share of the k most frequent words of early tokens that late ones have too."""
    top = word_count(early).orderBy(F.desc("n"), "tok").limit(k)
    held = top.join(late.select("tok").distinct(), "tok", "left_semi")
    return top.agg(F.count(F.lit(1)).alias("k")).crossJoin(held.agg(F.count(F.lit(1)).alias("kept"))).select(  # one row each
        F.when(F.col("k") > 0, F.col("kept") / F.col("k")).otherwise(1.0).alias("retention")
    )


def seed_topics(docs: DataFrame, max_topics: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """topic, query: the most frequent tokens of two characters or more, in pairs by rank."""
    counted = tokens(docs, id_col, text_col).where(F.length("tok") >= 2).groupBy("tok").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(id_col, "pos")).alias("first"))
    top = counted.orderBy(F.desc("n"), "first").limit(2 * max_topics)
    ranked = top.select("tok", (F.row_number().over(Window.orderBy(F.desc("n"), "first")) - 1).alias("r"))
    return ranked.groupBy(F.floor(F.col("r") / 2).alias("topic")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "tok"))), lambda x: x.tok), " ").alias("query")
    )


def kth_smallest(df: DataFrame, col: str, k: int, most: int = 100_000) -> int:
    """The k-th smallest value (from 1) of a whole-number column. Counts over 1,024 ranges narrow the search, so one task sorts `most` rows at most, or one value's."""
    lo, hi = df.agg(F.min(col), F.max(col)).first()
    while True:
        inside = df.where(F.col(col).between(lo, hi)).select(col)
        width = max(1, -(-(hi - lo + 1) // 1024))
        counts = {r["b"]: r["n"] for r in inside.groupBy(F.floor((F.col(col) - lo) / width).cast("long").alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
        for b in sorted(counts):
            if k <= counts[b]:
                break
            k -= counts[b]
        lo, hi = lo + b * width, min(hi, lo + (b + 1) * width - 1)
        if width == 1:
            return lo
        if counts[b] <= most:
            return df.where(F.col(col).between(lo, hi)).select(col).orderBy(col).limit(k).agg(F.max(col)).first()[0]
