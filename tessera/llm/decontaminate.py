r"""Benchmark decontamination by winnowing, in DataFrame functions only.

Of every text's word k-grams (k = 5) the smallest hash in each window of 6 consecutive ones is kept as a fingerprint.
Any 10 consecutive words span exactly one such window, so two texts that share them share a fingerprint. Training and
benchmark fingerprints are joined; each text that shares one is extended to all its hits: its windows of 10 words that
an item holds too, found by a join on the windows' hashes. An item of fewer than 10 words is one window of its length;
its whole-length gram joins the fingerprints.

Windows of equal item lists are one group, and a text's hits carry the groups' names, once each: a window in many items
and many places costs a row for each place, not for each pair.

Words are runs of letters, digits and characters beyond ASCII, in lower case (A-Z only). Only 64-bit hashes of words
and windows travel; texts are keyed by 128 bits of hash, so copies are extended once. Texts of the candidates alone
are shuffled. Benchmark tables are broadcast while they have `BROADCAST_ROWS` rows or fewer and shuffled beyond.

Null texts and texts without words have no hits; items likewise. Repeated rows get the same result each; null ids are
kept. With an empty benchmark nothing is hit. Columns of the documents are kept, whatever their names; those of the
result's names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import let
from .workspace import Workspace, spare_names

WINDOW, K = 10, 5
BROADCAST_ROWS = 2_000_000
#: Item ids of all hits together that are broadcast at most.
BROADCAST_IDS = 2_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def hashes(text: Column) -> Column:
    """Hashes of the text's words, in order."""
    words = F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _SPLIT), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def grams(h: Column, n: int) -> Column:
    """A hash for each n consecutive elements of h; of their number too, so that lengths don't mix."""
    return F.transform(
        F.slice(h, 1, F.greatest(F.lit(0), F.size(h) - (n - 1))),
        lambda x, i: F.xxhash64(F.lit(n), x, *(F.get(h, i + j) for j in range(1, n))),
    )


def winnow(h: Column, window: int = WINDOW, k: int = K) -> Column:
    """Smallest k-gram hashes of each `window` consecutive words, once each."""
    w = window - k + 1

    def least(g: Column) -> Column:
        starts = F.slice(g, 1, F.greatest(F.lit(0), F.size(g) - (w - 1)))
        return F.array_distinct(F.transform(starts, lambda x, i: F.least(x, *(F.get(g, i + j) for j in range(1, w)))))

    return let(grams(h, k), least)


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a staged table of known size, if it's small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """docs with n_words, n_hit, item_ids (array of strings in order) and contaminated."""
    ws = Workspace(docs.sparkSession, "decontaminate")
    k = max(1, window // 2)
    bench = ws.stage(
        items.select(F.col("item_id").cast("string").alias("item_id"), hashes(F.col("text")).alias("h")).where(F.size("h") > 0), "items"
    )
    short = sorted(r[0] for r in bench.where(F.size("h") < window).select(F.size("h")).distinct().collect())  # window - 1 values at most

    def prints(h: Column) -> Column:
        return F.concat(winnow(h, window, k), *(F.array_distinct(grams(h, n)) for n in short))

    def placed(h: Column, n: int) -> Column:
        return F.transform(grams(h, n), lambda g, i: F.struct(g.alias("g"), i.alias("at"), F.lit(n).alias("n")))

    def spans(h: Column) -> Column:
        return F.concat(*(placed(h, n) for n in [window, *short]))

    own = F.col("h")
    item_prints, item_windows = F.when(F.size(own) >= window, winnow(own, window, k)), F.when(F.size(own) >= window, grams(own, window))
    for n in short:  # a short item is one window
        item_prints = item_prints.when(F.size(own) == n, grams(own, n))
        item_windows = item_windows.when(F.size(own) == n, grams(own, n))
    fingerprints = _small(ws.stage(bench.select(F.explode(item_prints).alias("f")).distinct(), "fingerprints"))
    of_items = ws.stage(bench.select("item_id", F.explode(item_windows).alias("g")).distinct(), "item-windows")
    listed = ws.stage(of_items.groupBy("g").agg(F.array_sort(F.collect_set("item_id")).alias("ids")), "listed")
    groups = ws.stage(listed.groupBy("ids").agg(F.min("g").alias("group")), "groups")
    windows = _small(ws.stage(listed.join(groups, "ids").select("g", "group"), "windows"))

    text = F.col(text_col)
    key = [F.xxhash64(text), F.xxhash64(F.lit("second"), text)]
    keyed = docs.select(key[0].alias("k1"), key[1].alias("k2"), text.alias("text")).where(F.col("text").isNotNull())
    hit = (
        keyed.select("k1", "k2", F.explode_outer(let(hashes(F.col("text")), prints)).alias("f"))
        .join(fingerprints, "f")
        .select("k1", "k2")
        .distinct()
    )
    candidates = ws.stage(hit, "candidates")
    once = keyed.join(_small(candidates), ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("text").alias("text"))
    found = (
        once.select("k1", "k2", F.explode_outer(let(hashes(F.col("text")), spans)).alias("s"))
        .select("k1", "k2", "s.*")
        .join(windows, "g")
        .groupBy("k1", "k2")
        .agg(F.array_sort(F.collect_set(F.struct("at", "n"))).alias("at"), F.collect_set("group").alias("groups"))
    )
    covered = F.aggregate(
        "at",
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end")),
        lambda a, x: F.struct(
            (a["sum"] + F.greatest(F.lit(0), x["at"] + x["n"] - F.greatest(a["end"], x["at"]))).alias("sum"),
            F.greatest(a["end"], x["at"] + x["n"]).alias("end"),
        ),
        lambda a: a["sum"].cast("long"),
    )
    new = ("n_words", "n_hit", "item_ids", "contaminated")
    kept = docs.drop(*new)
    k1, k2 = spare_names(docs, "k1", "k2")
    hits = ws.stage(found.select("k1", "k2", covered.alias("n_hit"), "groups"), "covered")
    ids = hits.select("k1", "k2", F.explode("groups").alias("group")).join(_small(groups.select("group", F.explode("ids").alias("item_id"))), "group")
    ids = ids.select("k1", "k2", "item_id").distinct().groupBy("k1", "k2").agg(F.array_sort(F.collect_list("item_id")).alias("item_ids"))
    hits = ws.stage(hits.join(ids, ["k1", "k2"]).select(F.col("k1").alias(k1), F.col("k2").alias(k2), "n_hit", "item_ids"), "hits")
    rows, names = hits.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("item_ids")), F.lit(0))).first()
    words = F.size(F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _SPLIT), "")).cast("long")
    keyed_docs = kept.withColumns({"n_words": words, k1: key[0], k2: key[1]})
    joined = keyed_docs.join(F.broadcast(hits) if rows <= BROADCAST_ROWS and names <= BROADCAST_IDS else hits, [k1, k2], "left")
    return joined.select(
        *kept.columns,
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """Words of every document that stand in a benchmark item's window, and which items."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contaminated(docs, items).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, g)),
p AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""
