"""A registry of experts: each has a description, a corpus and a guardrail, all in tables partitioned by expert.

Under `path`: `about` (expert, text), `corpus` (expert, seq, text) and the model tables `uni` (expert, tok, c), `bi` (expert, w1,
w2, c) and `gate` (expert, threshold), and `trained` (expert, sentences that its model was fitted to), partitioned by expert. Adding to an expert appends rows to its partition; training writes
the model partitions of the trained experts anew (dynamic partition overwrite), whatever number they are, from one
tokenization; removing an expert drops its partitions, the description first, so an expert that is half removed is listed
no more. Experts that a call doesn't name are not touched.

A name is any text but an empty one. Sentences that an expert has already, and repeated ones, are added once; null sentences not at
all. An expert of fewer than ten sentences gets a model and the threshold of an untrained guardrail.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus as C
from ..operators import guard as G
from .workspace import Folder, Workspace

TABLES = {
    "about": "text string, expert string",
    "corpus": "seq long, text string, expert string",
    "uni": "tok string, c long, expert string",
    "bi": "w1 string, w2 string, c long, expert string",
    "gate": "threshold double, expert string",
    "trained": "sentences long, expert string",
}
#: Percentile of its own scores that an expert's threshold comes from.
PERCENT = 25.0


class Experts:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, Folder(spark, path)

    def table(self, name: str) -> DataFrame:
        """A table of all listed experts."""
        if not self.folder.names(name):
            return self.spark.createDataFrame([], TABLES[name])
        # a name such as 007 stays text: the partition's type is given
        rows = self.spark.read.schema(TABLES[name]).parquet(self.folder.path(name))
        return rows if name == "about" else rows.join(F.broadcast(self.table("about").select("expert")), "expert", "left_semi").select(*rows.columns)

    def _write(self, df: DataFrame, name: str, mode: str) -> None:
        df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("expert").parquet(self.folder.path(name))

    def names(self) -> list[str]:
        """The listed experts; they are as many as were named one by one."""
        return sorted(r["expert"] for r in self.table("about").select("expert").distinct().collect())

    def add(self, name: str, about: str = "") -> None:
        """List an expert; one that is there stays as it is."""
        if not name:
            raise ValueError("an expert needs a name")
        if name not in self.names():
            self._write(self.spark.range(1).select(F.lit(about).alias("text"), F.lit(name).alias("expert")), "about", "overwrite")

    def remove(self, name: str) -> None:
        """Drop an expert with all it has; no error if there is none."""
        part = "expert=" + self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(name)
        for table in TABLES:
            self.folder.remove(f"{table}/{part}")

    def add_to(self, sentences: DataFrame, threshold: float | None = None) -> DataFrame:
        """Add rows (expert, seq, text) to their experts' corpora; expert, added, rejected.

        Only listed experts take sentences. threshold: an expert that has a model takes only sentences with this score or more by it.
        """
        ws = Workspace(self.spark, "experts")
        mine = sentences.join(F.broadcast(self.table("about").select("expert")), "expert", "left_semi").where(F.col("text").isNotNull())
        held = self.table("corpus").select("expert", "text").distinct()
        once = C.keep_first(mine.select("expert", "seq", "text").join(held, ["expert", "text"], "left_anti").select("expert", "seq", "text"), ["expert", "text"], ["seq"])
        fresh = ws.stage(once.select("expert", F.col("seq").cast("long").alias("seq"), "text", F.monotonically_increasing_id().alias("row")), "fresh")
        judged = fresh.withColumn("added", F.lit(True))
        if threshold is not None and self.folder.names("gate"):
            scored = G.score_experts(fresh, self.table("uni"), self.table("bi"), "row", ws)
            judged = fresh.join(scored, ["row", "expert"], "left").withColumn("added", F.col("score").isNull() | (F.col("score") >= threshold))
        judged = ws.stage(judged.select("expert", "seq", "text", "added"), "judged")
        self._write(judged.where("added").select("seq", "text", "expert"), "corpus", "append")
        return judged.groupBy("expert").agg(F.count_if("added").alias("added"), F.count_if(~F.col("added")).alias("rejected"))

    def train(self, *names: str) -> None:
        """Fit the guardrails of the named experts, or of all, side by side; the others' partitions stay. An expert's corpus only
        grows, so a model that was fitted to as many sentences as there are now is that of today and stays."""
        ws = Workspace(self.spark, "experts")
        corpus = self.table("corpus")
        corpus = corpus.where(F.col("expert").isin(*names)) if names else corpus
        sizes = ws.stage(corpus.groupBy("expert").agg(F.count(F.lit(1)).alias("sentences")), "sizes")
        stale = sizes.join(self.table("trained"), ["expert", "sentences"], "left_anti")
        corpus = corpus.join(F.broadcast(stale.select("expert")), "expert", "left_semi")  # a row for each expert
        rows = G.tokenized(corpus.select("expert", "text", F.monotonically_increasing_id().alias("row")), ws)
        uni, bi = G.fit_experts(rows, "expert", ws)
        scores = ws.stage(G.own_scores(rows, uni, bi, ws), "scores")
        gates = []
        for name in [r["expert"] for r in rows.select("expert").distinct().collect()]:  # experts are named one by one
            own = scores.where(F.col("expert") == name)
            gates.append(G.suggest_threshold(own, PERCENT).select("threshold", F.lit(name).alias("expert")) if own.limit(10).count() == 10 else self.spark.range(1).select(F.lit(G.STATE_THRESHOLD).alias("threshold"), F.lit(name).alias("expert")))
        self._write(uni.select("tok", "c", "expert"), "uni", "overwrite")
        self._write(bi.select("w1", "w2", "c", "expert"), "bi", "overwrite")
        for gate in gates:
            self._write(gate, "gate", "overwrite")
        self._write(ws.stage(stale.select("sentences", "expert"), "stale"), "trained", "overwrite")  # last: what broke off is trained again
        ws.close()

    def list(self) -> DataFrame:
        """expert, about, n_sentences and threshold (null before training) of the listed experts."""
        counts = self.table("corpus").groupBy("expert").agg(F.count(F.lit(1)).alias("n_sentences"))
        about = self.table("about").select("expert", F.col("text").alias("about"))
        out = about.join(counts, "expert", "left").join(self.table("gate"), "expert", "left")
        return out.select("expert", "about", F.coalesce("n_sentences", F.lit(0)).alias("n_sentences"), "threshold")

    def route(self, texts: DataFrame, id_col: str, min_margin: float = 0.5, floor: float = -5.0) -> DataFrame:
        """id, expert, top_score, margin: each text to the trained expert that scores it best, or to none."""
        ws = Workspace(self.spark, "experts")
        return G.route(texts, G.score_experts(texts, self.table("uni"), self.table("bi"), id_col, ws), id_col, min_margin, floor)
