r"""Line dedup by a log-template tree, in DataFrame functions only.

A line goes down a tree of fixed depth: first by its number of tokens, then by its `DEPTH` leading tokens, tokens with a
digit counting as one variable field `<*>`. At the leaf the rest of the line is cut into three parts, and each part in
turn is taken as variable: lines of a leaf that agree in the other two share that template. So a template fixes two
thirds of the tokens at least, and any field or run of fields within a part may vary. (Where fewer than three tokens
are left, the line itself is the template.)

A template recurs if lines of `min_docs` documents have it. Its first line (by doc_id and place) stays; the others are
dropped, so no content goes altogether. Lines of fewer than `min_tokens` tokens are never dropped.

The templates of all lines are computed once and staged as hashes. These are shuffled: once to count them, with partial
sums first, so that a line in a third of all documents is no burden; and once more to find their lines if they are more
than `BROADCAST_ROWS`.

Null texts stay null; empty texts stay empty; blank lines stay. Rows that are equal in id and text are one document, which
counts once, and each of them gets its result. Null ids come first. Extra columns of any name are kept, but for columns
named as the result's, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import let
from .workspace import Workspace, spare_names

DEPTH, MIN_DOCS, MIN_TOKENS = 3, 3, 3
BROADCAST_ROWS = 500_000
_FIELD = r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*"
_SPLIT = r"[\x20\x09-\x0D]+"


def _templates(t: Column, at: Column, depth: int, min_tokens: int) -> Column:
    """(key, at) of each template of a line with tokens t."""
    n = F.size(t)
    m = n - depth

    def without(part: int) -> Column:
        lo, hi = F.floor(m * part / 3).cast("int"), F.floor(m * (part + 1) / 3).cast("int")
        rest = F.concat(F.slice(t, 1, lo + depth), F.slice(t, hi + depth + 1, n))
        return F.struct(F.xxhash64(F.lit(part), n, rest).alias("key"), at.alias("at"))

    whole = F.struct(F.xxhash64(F.lit(-1), n, t).alias("key"), at.alias("at"))
    none = F.slice(F.array(whole), 1, 0)
    return F.when(n < min_tokens, none).when(m < 3, F.array(whole)).otherwise(F.array(*(without(p) for p in range(3))))


def templates(text: Column, depth: int = DEPTH, min_tokens: int = MIN_TOKENS) -> Column:
    """All (key, at) of a text's lines, in order."""

    def of_line(line: Column, at: Column) -> Column:
        tokens = F.array_remove(F.split(F.regexp_replace(line, _FIELD, "<*>"), _SPLIT), "")
        return let(tokens, lambda t: _templates(t, at, depth, min_tokens))

    return F.sort_array(F.flatten(F.transform(F.split(text, "\n"), of_line)))


def _one_of_each(ws: Workspace, keyed: DataFrame) -> DataFrame:
    """keyed with one of the rows that are equal in both keys. Such rows are found by their keys alone."""
    repeated = ws.stage(keyed.groupBy("k1", "k2").count().where("count > 1").select("k1", "k2"), "repeated")
    n = repeated.count()
    if not n:
        return keyed
    repeated = F.broadcast(repeated) if n <= BROADCAST_ROWS else repeated
    first = keyed.join(repeated, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("id").alias("id"), F.first("all").alias("all"))
    return keyed.join(repeated, ["k1", "k2"], "left_anti").unionByName(first)


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS, depth: int = DEPTH, min_tokens: int = MIN_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text less its dropped lines, and with n_lines and n_dropped."""
    ws = Workspace(docs.sparkSession, "linededup")
    text = F.col(text_col)
    key = [F.xxhash64(F.col(id_col), text), F.xxhash64(F.lit("second"), F.col(id_col), text)]
    keyed = docs.where(text.isNotNull()).select(F.col(id_col).alias("id"), key[0].alias("k1"), key[1].alias("k2"), templates(text, depth, min_tokens).alias("all"))
    keyed = ws.stage(keyed, "templates")
    keyed = _one_of_each(ws, keyed)
    # within a document a template counts once, where it stands first
    once = F.filter("all", lambda x, i: (i == 0) | (x["key"] != F.get("all", i - 1)["key"]))
    # explode_outer: plain explode would have the optimizer add a filter that computes this once more
    seen = keyed.select("id", "k1", F.explode_outer(once).alias("t")).where("t is not null").select("t.key", F.struct("id", "t.at", "k1").alias("place"))
    recurring = seen.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    recurring = ws.stage(recurring.where(F.col("n") >= min_docs).select("key", "first"), "recurring")
    small = recurring.count() <= BROADCAST_ROWS
    lines = keyed.select("id", "k1", "k2", F.explode("all").alias("t")).select("id", "k1", "k2", "t.*")
    hit = lines.join(F.broadcast(recurring) if small else recurring, "key").where(
        ~(F.col("first.id").eqNullSafe(F.col("id")) & (F.col("first.at") == F.col("at")) & (F.col("first.k1") == F.col("k1")))
    )
    new = ("n_lines", "n_dropped")
    kept = docs.drop(*new)
    k1, k2, drop = spare_names(docs, "k1", "k2", "drop")
    drops = ws.stage(hit.groupBy("k1", "k2").agg(F.collect_set("at").alias(drop)).select(F.col("k1").alias(k1), F.col("k2").alias(k2), drop), "drops")
    ws.drop("templates", "repeated", "recurring")
    rows, places = drops.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(drop)), F.lit(0))).first()
    joined = kept.withColumns({k1: key[0], k2: key[1]}).join(F.broadcast(drops) if rows + places <= 4 * BROADCAST_ROWS else drops, [k1, k2], "left")

    def rest(parts: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(drop))
        return F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n")

    without = F.when(F.col(drop).isNull(), text).otherwise(let(F.split(text, "\n"), rest))
    return joined.select(
        *(without.alias(c) if c == text_col else c for c in kept.columns),
        F.when(text.isNull(), 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.when(F.col(drop).isNull(), 0).otherwise(F.size(drop)).cast("long").alias("n_dropped"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """Lines of every document, how many are dropped, and a digest of what stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    left = F.coalesce("text", F.lit(""))
    return drop_lines(docs).select("doc_id", "n_lines", "n_dropped", F.length(left).cast("long").alias("kept_chars"), F.sha2(left, 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, line, pos, regexp_extract_all(regexp_replace(line, '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g'), '[^\x20\x09-\x0D]+') AS t FROM l),
k AS (
  SELECT doc_id, pos, '-1 ' || array_to_string(t, ' ') AS key FROM t WHERE len(t) BETWEEN 3 AND 5
  UNION ALL
  SELECT doc_id, pos, p || ' ' || len(t) || ' ' || array_to_string(list_concat(t[1 : 3 + (len(t) - 3) * p // 3], t[4 + (len(t) - 3) * (p + 1) // 3 : len(t)]), ' ') AS key
  FROM t, (VALUES (0), (1), (2)) v(p) WHERE len(t) >= 6
),
r AS (SELECT key, min((doc_id, pos)) AS first FROM k GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
d AS (SELECT DISTINCT doc_id, pos FROM k JOIN r USING (key) WHERE (doc_id, pos) <> first),
s AS (
  SELECT doc_id, count(*) AS n_lines, count(d.pos) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (d.pos IS NULL), '') AS rest
  FROM l LEFT JOIN d USING (doc_id, pos) GROUP BY doc_id
)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, length(coalesce(rest, '')) AS kept_chars, sha256(coalesce(rest, '')) AS kept_sha256
FROM documents LEFT JOIN s USING (doc_id)
"""
