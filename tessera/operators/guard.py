"""Domain guardrail: a smoothed bigram model of sentences."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions import text as T
from ..sources.workspace import Workspace
from . import ranks

# Sentinels, smoothing weight and bounds of thresholds
BEGIN, END = "<s>", "</s>"
#: Between the words of a transition that is counted as one string; no token has it.
BETWEEN = "\x00"
LAMBDA, FLOOR = 0.7, 1e-10
THRESHOLD, STATE_THRESHOLD = -9.0, -9.5
LOWEST, HIGHEST, SHORT_CAP = -9.0, -5.0, -6.0


#: Most words and transitions that are broadcast: the most frequent ones, which are most of any text.
HOT_WORDS, HOT_PAIRS = 200_000, 200_000
#: Tokens that a task codes at once.
PIECE = 1 << 20


def framed(text: Column) -> Column:
    return _framed(T.tokenize(text))


def _framed(toks: Column) -> Column:
    return F.concat(F.array(F.lit(BEGIN)), toks, F.array(F.lit(END)))


def tokenized(df: DataFrame, ws: Workspace, text_col: str = "text", name: str = "tokens") -> DataFrame:
    """df with its texts as token lists, written: what is fitted to them and scored by them is tokenized once."""
    return ws.stage(df.withColumn(text_col, T.tokenize(F.col(text_col))), name)


def bigrams(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """id, w1, w2: transitions of each text (or list of tokens), formed within the row."""

    def pairs(t: Column) -> Column:
        return F.zip_with(F.slice(t, 1, F.size(t) - 1), F.slice(t, 2, F.size(t) - 1), lambda a, b: F.struct(a.alias("w1"), b.alias("w2")))

    ready = isinstance(df.schema[text_col].dataType, ArrayType)
    t = _framed(F.col(text_col)) if ready else framed(F.col(text_col))
    return df.select(F.col(id_col), F.explode(F.transform(F.array(t), pairs)[0]).alias("p")).select(id_col, "p.w1", "p.w2")


def counted_bigrams(df: DataFrame, text_col: str = "text") -> DataFrame:
    """w1, w2, c: transitions of all texts (or lists of tokens), counted under one string each: a task's table of counts and
    the shuffle hold one field for both words."""
    ready = isinstance(df.schema[text_col].dataType, ArrayType)
    t = _framed(F.col(text_col)) if ready else framed(F.col(text_col))
    joint = lambda t: F.zip_with(F.slice(t, 1, F.size(t) - 1), F.slice(t, 2, F.size(t) - 1), lambda a, b: F.concat(a, F.lit(BETWEEN), b))
    counts = df.select(F.explode(F.transform(F.array(t), joint)[0]).alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("c"))
    return counts.select(F.substring_index("p", BETWEEN, 1).alias("w1"), F.substring_index("p", BETWEEN, -1).alias("w2"), "c")


def frequent(counts: DataFrame, most: int) -> float:
    """The least count that at most `most` rows of a table have or exceed, all rows with the same count together."""
    taken = 0
    edge = float("inf")
    for c, n in counts.groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("c")).limit(most).collect():
        taken += n
        if taken > most:
            break
        edge = c
    return edge


def with_counts(bi: DataFrame, uni: DataFrame, edge: float, *by: str) -> DataFrame:
    """bi with c1 and c2, the counts of its words. Counts of frequent words are broadcast (as many rows as `frequent` was
    asked for); only transitions with another word are shuffled."""
    for w, c in (("w1", "c1"), ("w2", "c2")):
        own = uni.select(*by, F.col("tok").alias(w), F.col("c").alias(c))
        known = bi.join(F.broadcast(own.where(F.col(c) >= edge)), [*by, w], "left")
        rest = known.where(F.col(c).isNull()).drop(c).join(own.where(F.col(c) < edge), [*by, w], "left")
        bi = known.where(F.col(c).isNotNull()).unionByName(rest)
    return bi


class Model:
    """Count tables: uni (tok, c), bi (w1, w2, c) and one-row totals (total, v)."""

    def __init__(self, uni: DataFrame, bi: DataFrame, staged: bool = False):
        self.uni, self.bi, self.staged = uni, bi, staged
        self._logs: tuple[DataFrame, DataFrame] | None = None
        self.totals = uni.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("total"), F.greatest(F.lit(1), F.count(F.lit(1))).alias("v"))

    @classmethod
    def fit(cls, df: DataFrame, text_col: str = "text", ws: Workspace | None = None) -> Model:
        """Texts (or lists of tokens) make one row a transition; every token but the last one of a text starts a transition, so
        the counts of tokens are sums of theirs. With a workspace the tables are written, and later plans start from them.
        Without one each is made from the texts by itself, and tokens are counted without forming transitions."""
        bi = counted_bigrams(df, text_col)
        if ws is None:
            t = _framed(F.col(text_col)) if isinstance(df.schema[text_col].dataType, ArrayType) else framed(F.col(text_col))
            return cls(df.select(F.explode(t).alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("c")), bi)
        bi = ws.stage(bi, "bi")
        return cls(ws.stage(unigrams(bi), "uni"), bi, True)

    def update(self, other: Model) -> Model:
        """The counts of both: count tables merge by sums."""
        uni = self.uni.unionByName(other.uni).groupBy("tok").agg(F.sum("c").alias("c"))
        bi = self.bi.unionByName(other.bi).groupBy("w1", "w2").agg(F.sum("c").alias("c"))
        return Model(uni, bi)

    def persist(self) -> Model:
        self.uni, self.bi = self.uni.persist(), self.bi.persist()
        return Model(self.uni, self.bi)

    def logs(self, ws: Workspace) -> tuple[DataFrame, DataFrame]:
        """w1, w2, l: log probabilities of the model's frequent transitions (`HOT_PAIRS` at most) and of all others, written once."""
        if self._logs is None:
            if not self.staged:
                self.uni, self.bi = ws.stage(self.uni, "model-uni"), ws.stage(self.bi, "model-bi")
                self.staged = True
            edge = frequent(self.bi, HOT_PAIRS)
            held = with_counts(self.bi.withColumnRenamed("c", "c12"), self.uni, frequent(self.uni, HOT_WORDS))
            held = held.crossJoin(F.broadcast(self.totals)).select("w1", "w2", log_probability().alias("l"), "c12")  # one row
            self._logs = ws.stage(held.where(F.col("c12") >= edge).drop("c12"), "logs-hot"), held.where(F.col("c12") < edge).drop("c12")
        return self._logs

    def score(self, df: DataFrame, id_col: str, text_col: str = "text", ws: Workspace | None = None) -> DataFrame:
        """id, score: the mean log probability of a text's transitions.

        Frequent transitions of the model find their probabilities within the text's own task and are summed there; only the
        others are shuffled, once, to meet the rest of the model. One that the model lacks has a probability by its second
        word alone: these are counted by text and word before they meet the words' counts. Texts are tokenized once.
        """
        ws = Workspace(df.sparkSession, "score") if ws is None else ws
        if not isinstance(df.schema[text_col].dataType, ArrayType):
            df = tokenized(df.select(id_col, text_col), ws, text_col, f"tokens-{uuid.uuid4().hex}")
        hot, cold = self.logs(ws)
        seen = bigrams(df, id_col, text_col)
        near = seen.join(F.broadcast(hot), ["w1", "w2"]).groupBy(id_col).agg(F.count(F.lit(1)).alias("k"), F.sum("l").alias("s"))
        far = seen.join(F.broadcast(hot.select("w1", "w2")), ["w1", "w2"], "left_anti").join(cold, ["w1", "w2"], "left")
        word = F.when(F.col("l").isNull(), F.col("w2")).alias("w2")
        far = ws.stage(far.groupBy(id_col, word).agg(F.count(F.lit(1)).alias("k"), F.sum("l").alias("s")), f"sums-{uuid.uuid4().hex}")
        c2 = self.uni.select(F.col("tok").alias("w2"), F.col("c").alias("c2"))
        lacked = far.where("w2 is not null").join(c2, "w2", "left").withColumns({"c12": F.lit(None).cast("long"), "c1": F.lit(None).cast("long")})
        lacked = lacked.crossJoin(F.broadcast(self.totals)).select(id_col, "k", (F.col("k") * log_probability()).alias("s"))  # one row
        every = near.unionByName(far.where("w2 is null").select(id_col, "k", "s")).unionByName(lacked)
        return every.groupBy(id_col).agg((F.sum("s") / F.sum("k")).alias("score"))


def unigrams(bi: DataFrame, *by: str) -> DataFrame:
    """by, tok, c from counted transitions (by, w1, w2, c): those that start with the token, and of END those that end with it."""
    ends = bi.where(F.col("w2") == END).select(*by, F.col("w2").alias("tok"), "c")
    return bi.select(*by, F.col("w1").alias("tok"), "c").unionByName(ends).groupBy(*by, "tok").agg(F.sum("c").alias("c"))


def log_probability() -> Column:
    """Of a transition with counts c12, c1, c2, total and v; missing counts are null."""
    p = LAMBDA * F.coalesce(F.col("c12") / F.col("c1"), F.lit(0.0)) + (1 - LAMBDA) * (F.coalesce("c2", F.lit(0)) + 1) / (F.col("total") + F.col("v"))
    return F.ln(F.when(p > 0, p).otherwise(FLOOR))


def _coded(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """Rows with token lists in column `at`, about `PIECE` tokens at a time: the rows, and of their transitions the row, the
    numbers of both words, and the words. Null lists are left out."""
    for batch in batches:
        batch = batch.filter(batch.column(at).is_valid())
        sizes = np.asarray(batch.column(at).value_lengths(), np.int64)
        cuts = np.searchsorted(np.cumsum(sizes) - sizes, np.arange(0, sizes.sum() + 1, PIECE)).tolist()
        for lo, hi in zip(cuts, [*cuts[1:], len(sizes)], strict=True):
            if lo == hi:
                continue
            part, n = batch.slice(lo, hi - lo), sizes[lo:hi] + 1
            flat = part.column(at).flatten().dictionary_encode()
            words = pa.concat_arrays([flat.dictionary, pa.array([BEGIN, END], flat.dictionary.type)])
            w1, w2 = np.full((2, n.sum()), -1)
            w1[np.cumsum(n) - n], w2[np.cumsum(n) - 1] = len(words) - 2, len(words) - 1
            w1[w1 < 0] = w2[w2 < 0] = flat.indices.to_numpy()
            yield part, np.repeat(np.arange(hi - lo), n), w1, w2, words


def fit_experts(df: DataFrame, expert_col: str, ws: Workspace, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Tables uni (expert, tok, c) and bi (expert, w1, w2, c): the models of any number of experts, from one tokenization.

    A task counts the transitions of about `PIECE` tokens at a time; these counts are shuffled once, and added up where they meet.
    """
    ready = isinstance(df.schema[text_col].dataType, ArrayType)
    toks = df.where(F.col(expert_col).isNotNull()).select(F.col(expert_col).alias("expert"), F.col(text_col).alias("t") if ready else T.tokenize(F.col(text_col)).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, row, w1, w2, words in _coded(batches, 1):
            expert = part.column(0).dictionary_encode()
            kinds, count = np.unique((expert.indices.to_numpy().astype(np.int64)[row] * len(words) + w1) * len(words) + w2, return_counts=True)
            both, second = np.divmod(kinds, len(words))
            of, first = np.divmod(both, len(words))
            yield pa.RecordBatch.from_arrays([expert.dictionary.take(pa.array(of)), words.take(pa.array(first)), words.take(pa.array(second)), pa.array(count)], names=["expert", "w1", "w2", "c"])

    counts = toks.mapInArrow(run, f"expert {toks.schema['expert'].dataType.simpleString()}, w1 string, w2 string, c long")
    key = ["expert", "w1", "w2"]
    bi = ws.stage(counts.repartition(*key).groupBy(*key).agg(F.sum("c").alias("c")), "experts-bi")
    return ws.stage(unigrams(bi, "expert"), "experts-uni"), bi


def own_scores(rows: DataFrame, uni: DataFrame, bi: DataFrame, ws: Workspace) -> DataFrame:
    """row, expert, score of each sentence (row, expert, text as tokens) by its own expert's model, which was fitted to it.

    Frequent transitions (`HOT_PAIRS` at most) and counts of frequent words (`HOT_WORDS`) are sent to every task, which adds up the first
    for a sentence and gives the second to its other transitions. Those are shuffled once to meet their count; before that, the
    few with a rarer word meet the count of that.
    """
    key, word_edge, edge = ["expert", "w1", "w2"], frequent(uni, HOT_WORDS), frequent(bi, HOT_PAIRS)
    totals = uni.groupBy("expert").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("v"))
    top = ws.stage(bi.where(F.col("c") >= edge).withColumnRenamed("c", "c12"), "pairs-hot")
    top = with_counts(top, uni, word_edge, "expert").join(F.broadcast(totals), "expert")  # a row for each expert
    hot = top.select(*key, log_probability().alias("l")).toArrow().combine_chunks()
    often = uni.where(F.col("c") >= word_edge).select("expert", "tok", "c").toArrow().combine_chunks()
    words = pc.unique(pa.concat_arrays([hot["w1"].combine_chunks(), hot["w2"].combine_chunks(), often["tok"].combine_chunks()]))
    experts = pc.unique(pa.concat_arrays([hot["expert"].combine_chunks(), often["expert"].combine_chunks()]))
    most = max(1, len(words))

    def place(values: pa.Array, known: pa.Array) -> np.ndarray:
        return np.asarray(pc.index_in(values, value_set=known).fill_null(-1), np.int64)

    def joint(e: np.ndarray, *w: np.ndarray) -> np.ndarray:
        out, whole = e, e >= 0
        for x in w:
            out, whole = out * most + x, whole & (x >= 0)
        return np.where(whole, out, -1)

    def table(t: pa.Table, names: list[str], value: str) -> tuple[np.ndarray, np.ndarray]:
        keys = joint(place(t["expert"].combine_chunks(), experts), *(place(t[c].combine_chunks(), words) for c in names))
        order = np.argsort(keys)
        return keys[order], t[value].to_numpy()[order]

    def look(known: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the keys, 0 for unknown ones, and which are known."""
        if not len(known[0]):
            return np.zeros(len(keys), known[1].dtype), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(known[0], keys), len(known[0]) - 1)
        hit = known[0][at] == keys
        return np.where(hit, known[1][at], 0), hit

    held = rows.sparkSession.sparkContext.broadcast((experts, words, table(hot, ["w1", "w2"], "l"), table(often, ["tok"], "c")))
    names = ["row", *key, "k", "s", "c1", "c2"]

    def seen(rare: bool) -> DataFrame:
        """A row for each sentence with the sum of its frequent transitions, and one for each other; rare: those with a rarer word only."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            experts, known, logs, counts = held.value
            for part, row, w1, w2, words in _coded(batches, 2):
                at, e = place(words, known), place(part.column(1), experts)[row]
                l, near = look(logs, joint(e, at[w1], at[w2]))
                (c1, _), (c2, _) = (look(counts, joint(e, at[w])) for w in (w1, w2))
                if not rare:
                    k, s = np.bincount(row[near], minlength=part.num_rows), np.bincount(row, l, minlength=part.num_rows).astype(float)
                    alone = pc.binary_join_element_wise(BETWEEN, part.column(0).cast(pa.string()), "")  # no word, and another one for each row
                    one = pa.array(np.ones(part.num_rows, np.int64))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), alone, alone, pa.array(k), pa.array(s), one, one], names=names)
                far = np.flatnonzero(~near & (((c1 == 0) | (c2 == 0)) == rare))
                of, n = pa.array(row[far]), len(far)
                cold = [part.column(0).take(of), part.column(1).take(of), words.take(pa.array(w1[far])), words.take(pa.array(w2[far]))]
                yield pa.RecordBatch.from_arrays([*cold, pa.array(np.ones(n, np.int64)), pa.nulls(n, pa.float64()), pa.array(c1[far]), pa.array(c2[far])], names=names)

        kind = {c: rows.schema[c].dataType.simpleString() for c in ("row", "expert")}
        return rows.select("row", "expert", "text").mapInArrow(run, f"row {kind['row']}, expert {kind['expert']}, w1 string, w2 string, k long, s double, c1 long, c2 long")

    rest = seen(True)
    for c, w, other in (("c1", "w1", "w2"), ("c2", "w2", "w1")):
        # a frequent word is no key of this join
        own = uni.where(F.col("c") < word_edge).select("expert", F.col("tok").alias("_w"), F.col("c").alias("_c"))
        rest = rest.withColumn("_w", F.when(F.col(c) == 0, F.col(w)).otherwise(F.concat(F.lit(BETWEEN), other))).join(own, ["expert", "_w"], "left")
        rest = rest.withColumn(c, F.when(F.col(c) == 0, F.col("_c")).otherwise(F.col(c))).select(*names)
    # a number leads the key: rows are sorted by it and their words are compared only where it is the same
    lead = F.xxhash64(*key).alias("_h")
    cold = bi.where(F.col("c") < edge).select(lead, *key, F.col("c").alias("c12"))
    every = seen(False).unionByName(rest).select(lead, *names).join(cold, ["_h", *key], "left").join(F.broadcast(totals), "expert")  # a row for each expert
    return every.groupBy("row", "expert").agg((F.sum(F.coalesce("s", log_probability())) / F.sum("k")).alias("score"))


def score_experts(texts: DataFrame, uni: DataFrame, bi: DataFrame, id_col: str, ws: Workspace, text_col: str = "text") -> DataFrame:
    """id, expert, score of every text by every expert's model.

    Each distinct transition of the texts gets a probability by every expert: rows grow with the number of experts, as
    the result does; the texts' own transitions are written once and joined once.
    """
    seen = ws.stage(bigrams(texts, id_col, text_col).groupBy(id_col, "w1", "w2").agg(F.count(F.lit(1)).alias("k")), "experts-seen")
    totals = uni.groupBy("expert").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("v"))
    kinds = seen.select("w1", "w2").distinct().crossJoin(F.broadcast(totals))  # a row for each expert
    kinds = kinds.join(bi.withColumnRenamed("c", "c12"), ["expert", "w1", "w2"], "left")
    logs = with_counts(kinds, uni, frequent(uni, HOT_WORDS), "expert").select("expert", "w1", "w2", log_probability().alias("l"))
    return seen.join(logs, ["w1", "w2"]).groupBy(id_col, "expert").agg((F.sum(F.col("k") * F.col("l")) / F.sum("k")).alias("score"))


def judge(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return scored.withColumn("inside", F.col("score") >= threshold)


def suggest_threshold(scored: DataFrame, percent: float = 15.0) -> DataFrame:
    """threshold: for 10 scores or more the percentile less half a deviation, within bounds; for fewer a low score, capped.

    The percentile is selected by counts over ranges, so no task holds all scores; they are written first, since several
    passes read them.
    """
    spark = scored.sparkSession
    ws = Workspace(spark, "threshold")
    rows = ws.stage(scored.select(F.col("score").cast("double").alias("score")).where("score is not null"), "scores")
    n, sd = rows.agg(F.count(F.lit(1)), F.stddev_pop("score")).first()
    share = percent / 100
    if not n:
        value = THRESHOLD
    elif n < 10:
        place = max(0, int(n * share) - 1)
        value = min(ranks.at_ranks(rows, "score", [place])[place], SHORT_CAP)
    else:
        value = max(LOWEST, min(HIGHEST, ranks.percentile(rows, "score", share, n) - 0.5 * sd))
    ws.close()
    return spark.range(1).select(F.lit(float(value)).alias("threshold"))


def fit_guardrail(sentences: DataFrame, id_col: str, percent: float = 15.0, locked: float | None = None) -> tuple[Model, float, float] | None:
    """Model, threshold and locked baseline threshold; None under 10 sentences. The first fit locks the baseline."""
    if sentences.limit(10).count() < 10:
        return None
    ws = Workspace(sentences.sparkSession, "guardrail")
    sentences = tokenized(sentences.select(id_col, "text"), ws)
    model = Model.fit(sentences, ws=ws)
    scored = ws.stage(model.score(sentences, id_col, ws=ws), "scores")
    threshold = suggest_threshold(scored, percent).first()[0]
    return model, threshold, suggest_threshold(scored, max(percent, 25.0)).first()[0] if locked is None else locked


def check_identity(df: DataFrame, id_col: str, baseline: tuple[Model, float] | None, current: tuple[Model, float] | None) -> DataFrame:
    """id, score, inside by the locked baseline, else by the current model, else all pass with 0."""
    for held in (baseline, current):
        if held is not None:
            return judge(held[0].score(df, id_col), held[1])
    return df.select(id_col, F.lit(0.0).alias("score"), F.lit(True).alias("inside"))


def add_sentences(corpus: DataFrame, new: DataFrame, id_col: str, model: Model | None, threshold: float) -> DataFrame:
    """id, text, score, added of the new sentences that the corpus lacks, each text once in its first place."""
    from .corpus import keep_first

    fresh = keep_first(new.select(id_col, "text").join(corpus.select("text").distinct(), "text", "left_anti").select(id_col, "text"), ["text"], [id_col])
    if model is None:
        return fresh.select(id_col, "text", F.lit(0.0).alias("score"), F.lit(True).alias("added"))
    return fresh.join(model.score(fresh, id_col), id_col).select(id_col, "text", F.round("score", 2).alias("score"), (F.col("score") >= threshold).alias("added"))


def last_rejected(judged: DataFrame, id_col: str, most: int = 200) -> DataFrame:
    """id, text, score (rounded to 2) of the last `most` rejected sentences, in order of id: the log of one batch."""
    out = judged.where("NOT added").select(id_col, "text", F.round("score", 2).alias("score"))
    return out.orderBy(F.desc(id_col), F.desc("text")).limit(most)


def route(texts: DataFrame, scored: DataFrame, id_col: str, min_margin: float = 0.5, floor: float = -5.0) -> DataFrame:
    """id, expert, top_score, margin: the best expert of rows (id, expert, score), or null where it is too low or too close."""
    s = F.struct(-F.round("score", 2), "expert")
    best = scored.groupBy(id_col).agg(F.array_sort(F.collect_list(s)).alias("r"))  # a row for each expert: few
    top, second = -F.get("r", F.lit(0)).col1, F.coalesce(-F.get("r", F.lit(1)).col1, F.lit(-99.0))
    out = texts.select(id_col).join(best, id_col, "left")
    return out.select(id_col, F.when((top >= floor) & (top - second >= min_margin), F.get("r", F.lit(0)).expert).alias("expert"), top.alias("top_score"), F.round(top - second, 2).alias("margin"))
