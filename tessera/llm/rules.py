"""Quality rules by distribution divergence, in DataFrame functions only.

Two histograms of a document are compared with references of its language by the Jensen-Shannon distance (base 2, 0 to
1): its characters by class, and its common words, with all others as one bin. The references are counted over all
documents: a language's common words are those of at most `COMMON_LETTERS` letters that make up `COMMON_SHARE` of the
language's words or more, which bounds their number. Documents without a language, or with a rare one, are compared
with each reference, and with all languages' counts together; the nearest one counts (by the sum of both distances).

A document fails the base rules if it has under 50 words, or if over half of them stand in three-word windows that
occur twice or more in it. It's kept if it passes them and neither distance exceeds its bound; the distances count
only from `MIN_CHARS` characters in words and `MIN_WORDS` words on, since short texts stray by chance.

Null texts have no words and are not kept. Repeated rows get the same result each. An empty table gives an empty one.
Extra columns are ignored. All work on a document happens within its row; the shuffles carry counts of common words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

WORD_SPLIT = r"[\x20\x09-\x0D]+"
COMMON_LETTERS, COMMON_SHARE = 5, 0.005
#: Languages with a smaller share of the characters have no reference of their own.
RARE = 0.001
#: Bounds on the distances: the first for endless texts, plus the second over the square root of the text's size (in
#: characters or words), as much as short texts stray by chance.
CHARS_BOUND, WORDS_BOUND = (0.2, 1.5), (0.15, 1.1)
MIN_CHARS, MIN_WORDS = 200, 80
#: Classes of characters; what is in none is the last class, beyond ASCII.
CLASSES = {
    "lower": "[^a-z]+",
    "upper": "[^A-Z]+",
    "digit": "[^0-9]+",
    "space": r"[^\x20\x09-\x0D]+",
    "stop": r"[^.,;:?'\"()\-]+",
    "symbol": r"[^!#-&*+/<=>@\[-`{-~]+",
}


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, WORD_SPLIT), "")


def covered_by_repeats(h: Column, n: int = 3) -> Column:
    """How many elements of h stand in windows of n that occur twice or more; the windows are sorted within the row."""

    def windows(a: Column) -> Column:
        return F.transform(
            F.slice(a, 1, F.greatest(F.lit(0), F.size(a) - (n - 1))),
            lambda x, i: F.struct(F.xxhash64(x, *(F.get(a, i + k) for k in range(1, n))).alias("k"), i.alias("i")),
        )

    def starts(w: Column) -> Column:
        twice = F.transform(w, lambda x, i: F.when((x.k == F.get(w, i - 1).k) | (x.k == F.get(w, i + 1).k), x.i))
        return F.sort_array(F.array_compact(twice))

    def total(s: Column) -> Column:
        widths = F.transform(s, lambda x, i: F.least(F.lit(n), F.coalesce(F.get(s, i + 1) - x, F.lit(n))))
        return F.aggregate(widths, F.lit(0).cast("long"), lambda a, x: a + x)

    return let(F.sort_array(windows(h)), lambda w: let(starts(w), total))


def class_counts(text: Column) -> Column:
    """How many characters of each class, and of none; then those of `[#*$%&|<>]`.

    Lower-case letters go first and white space second, so only the few characters that are left are read by the other
    classes' patterns.
    """

    def of_marks(rest: Column) -> Column:
        def marks(left: Column) -> Column:
            def count(name: str) -> Column:
                fixed = {"lower": F.length(text) - F.length(rest), "space": F.length(rest) - F.length(left)}
                return fixed.get(name, F.length(F.regexp_replace(left, CLASSES.get(name, name), ""))).cast("long")

            return F.array(*(count(name) for name in [*CLASSES, r"[\x00-\x7F]+", r"[^#*$%&|<>]+"]))

        return let(F.regexp_replace(rest, WORD_SPLIT, ""), marks)

    return let(F.regexp_replace(text, "[a-z]+", ""), of_marks)


def _references(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """ref_lang, refs: each reference, as shares of the classes of characters and hashes and shares of common words; those
    of all languages, and last of all together, under null. And the languages that have one."""
    names = [*CLASSES, "beyond"]
    ws = Workspace(docs.sparkSession, "rules")
    chars = docs.select("lang", class_counts(F.col("text")).alias("c"), F.size(words_of(F.col("text"))).alias("n"))
    sums = ws.stage(chars.groupBy("lang").agg(*(F.coalesce(F.sum(F.get("c", F.lit(i))), F.lit(0)).alias(name) for i, name in enumerate(names)), F.coalesce(F.sum("n"), F.lit(0)).alias("n")), "classes")
    total = sums.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in [*names, "n"])).first()
    grand, total_chars = total["n"], sum(total[x] for x in names)
    # at most 1 / RARE languages are collected
    of_lang = sum((F.col(x) for x in names), F.lit(0))
    frequent = sums.where(F.col("lang").isNotNull() & (of_lang > 0) & (of_lang >= RARE * total_chars)).collect()
    by_lang = {r["lang"]: r for r in frequent}
    spread = docs.select("lang", F.explode_outer(words_of(F.col("text"))).alias("word")).where(F.length("word") <= COMMON_LETTERS)
    counts = spread.groupBy("lang", "word").count().where(F.col("word").rlike(r"^\p{L}+$"))
    # COMMON_SHARE bounds what is collected: 1 / COMMON_SHARE words for each of these languages and for all together
    sizes = F.create_map(*(F.lit(x) for k, r in by_lang.items() for x in (k, r["n"]))) if by_lang else F.lit(None).cast("map<string,bigint>")
    common_there = F.col("count") >= COMMON_SHARE * F.try_element_at(sizes, F.coalesce("lang", F.lit("")))
    by_word = counts.groupBy("word").agg(
        F.sum("count").alias("every"),
        F.collect_list(F.when(common_there & F.col("lang").isNotNull(), F.struct("lang", "count"))).alias("langs"),
    )
    rows = by_word.where((F.size("langs") > 0) | (F.col("every") >= COMMON_SHARE * grand)).select(F.xxhash64("word").alias("h"), "every", "langs").collect()
    ws.drop("classes")
    common: dict = {}
    for r in rows:
        for x in r["langs"]:
            common.setdefault(x["lang"], {})[r["h"]] = x["count"]

    def shares(row, words: dict[int, int]) -> tuple:
        chars, order = [row[x] for x in names], sorted(words)
        return [c / max(1, sum(chars)) for c in chars], order, [words[h] / max(1, row["n"]) for h in order]

    every = shares(total, {r["h"]: r["every"] for r in rows if r["every"] >= COMMON_SHARE * grand})
    table = {lang: shares(row, common.get(lang, {})) for lang, row in by_lang.items()}
    refs = [*((lang, [r]) for lang, r in table.items()), (None, [*table.values(), every])]
    schema = "ref_lang string, refs array<struct<chars: array<double>, hashes: array<long>, words: array<double>>>"
    return docs.sparkSession.createDataFrame(refs, schema), list(table)


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares; what either lacks to 1 is one more bin."""

    def term(a: Column, b: Column) -> Column:
        half = (a + b) / 2
        return F.when(a > 0, a * F.log2(a / half)).otherwise(0.0) + F.when(b > 0, b * F.log2(b / half)).otherwise(0.0)

    def rest(x: Column) -> Column:
        return F.greatest(F.lit(0.0), F.lit(1.0) - F.aggregate(x, F.lit(0.0), lambda s, v: s + v))

    known = F.aggregate(F.zip_with(p, q, term), F.lit(0.0), lambda s, v: s + v)
    return F.sqrt(F.greatest(F.lit(0.0), (known + term(rest(p), rest(q))) / 2))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, the base counts, base_failed, the two distances (null where too short) and kept."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).alias("lang"))
    refs, langs = _references(rows)
    own = F.when(F.col("lang").isin(langs), F.col("lang"))
    refs = refs.withColumn("ref_hashes", F.array_distinct(F.flatten("refs.hashes")))
    joined = rows.join(F.broadcast(refs), own.eqNullSafe(F.col("ref_lang"))).select("id", "text", "refs", "ref_hashes")  # one row for each language that isn't rare, and one
    text = F.col("text")

    def measure(w: Column) -> Column:
        def with_hashes(h: Column) -> Column:
            n = F.size(h)

            def far(known: Column) -> Column:
                def count(q: Column) -> Column:
                    return (F.size(known) - F.size(F.array_remove(known, q))) / F.greatest(n, F.lit(1))

                return F.transform("refs", lambda r: distance(F.transform(r.hashes, count), r.words))

            return F.struct(
                n.cast("long").alias("n_words"),
                covered_by_repeats(h).alias("n_repeat_words"),
                let(F.filter(h, lambda x: F.array_contains("ref_hashes", x)), far).alias("words"),
            )

        return let(F.transform(w, lambda x: F.xxhash64(x)), with_hashes)

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    total = F.greatest(F.length(text), F.lit(1))
    n_classes, space = len(CLASSES) + 1, list(CLASSES).index("space")

    def of_characters(c: Column) -> Column:
        shares = F.transform(F.slice(c, 1, n_classes), lambda x: x / total)
        return F.struct(
            (F.length(text) - F.get(c, F.lit(space))).cast("long").alias("word_chars"),
            F.get(c, F.lit(n_classes)).alias("n_symbols"),
            let(shares, lambda p: F.transform("refs", lambda r: distance(p, r.chars))).alias("chars"),
        )

    measured = joined.select(
        "id",
        let(words_of(text), measure).alias("m"),
        let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
        let(class_counts(text), of_characters).alias("c"),
    )
    n, rep = F.col("m.n_words"), F.col("m.n_repeat_words")
    each = F.zip_with("m.words", "c.chars", lambda w, c: F.struct((w + c).alias("sum"), w.alias("words"), c.alias("chars")))
    judged = measured.withColumn("js", F.array_min(each)).select(
        F.col("id").alias(id_col),
        n.alias("n_words"),
        "c.word_chars",
        "c.n_symbols",
        "n_dup_lines",
        rep.alias("n_repeat_words"),
        ((n < 50) | (rep * 100 > n * 50)).alias("base_failed"),
        F.when(F.col("c.word_chars") >= MIN_CHARS, F.col("js.chars")).alias("js_chars"),
        F.when(n >= MIN_WORDS, F.col("js.words")).alias("js_words"),
    )

    def within(d: str, bound: tuple[float, float], size: str) -> Column:
        return F.coalesce(F.col(d), F.lit(0.0)) <= bound[0] + bound[1] / F.sqrt(F.greatest(F.col(size), F.lit(1)))

    close = within("js_chars", CHARS_BOUND, "word_chars") & within("js_words", WORDS_BOUND, "n_words")
    return judged.withColumn("kept", ~F.col("base_failed") & close)


def query(spark, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
