"""Streams: the learning cycle over micro-batches, running model counts, and windowed events."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus as C
from ..operators import curate as U
from ..operators import guard as G
from ..operators import mapnet as M
from ..operators import metrics as X
from ..functions import text as FT
from ..sources import store
from ..sources.workspace import Folder

# Penalties of a cycle that finds nothing, and of one that is all rejected
PENALTY_EMPTY, PENALTY_REJECTED = -0.1, -0.2
#: Rejected sentences that the log keeps.
REJECTED = 200


@dataclass
class Learner:
    """The autonomous cycle. Tables live under `path`, one version for each batch; a replayed batch changes nothing.

    encode gives (seq, vec) for rows (seq, text).
    """

    spark: SparkSession
    path: str
    encode: object
    nodes: DataFrame
    baseline: tuple[G.Model, float] | None = None
    rounds: int = 3
    records: list[dict] = field(default_factory=list)

    def _corpus(self, before: int) -> DataFrame | None:
        """Sentences added by batches before this one."""
        held = [v for v in range(before) if self._has("corpus", v)]
        paths = [f"{self.path}/corpus/version={v}" for v in held]
        return self.spark.read.parquet(*paths) if paths else None

    def _has(self, table: str, version: int) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}/version={version}/_SUCCESS")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def step(self, batch: DataFrame, batch_id: int) -> dict:
        """One cycle on rows (seq, query, text): filter, guide, add, train, reward."""
        if self._has("corpus", batch_id):
            return {"cycle": batch_id, "note": "already done"}
        record = {"cycle": batch_id, "query": None, "added": 0, "rejected": 0, "reward": PENALTY_EMPTY, "note": ""}
        sentences = C.keep_first(
            batch.select("seq", "query", F.explode(FT.split_sentences(F.col("text"))).alias("s")).select("seq", "query", F.trim("s").alias("text")).where(FT.keep_sentence(F.col("text"))),
            F.col("text"),
            ["seq"],
        )
        store.save_table(sentences, f"{self.path}/arrived", batch_id)
        sentences = self.spark.read.parquet(f"{self.path}/arrived/version={batch_id}")
        first = sentences.orderBy("seq").first()
        if first is None:
            record["note"] = "nothing collected"
            store.save_table(sentences.select("seq", "text"), f"{self.path}/corpus", batch_id)
            return self._close(record)
        record["query"] = first["query"]
        old = self._corpus(batch_id)
        fresh = sentences.select("seq", "text")
        if old is not None:
            fresh = fresh.join(old.select("text").distinct(), "text", "left_anti").select("seq", "text")
        judged = G.check_identity(fresh, "seq", self.baseline, None)
        outside = fresh.join(judged, "seq").withColumn("added", F.col("inside"))
        store.save_table(G.last_rejected(outside, "seq", REJECTED), f"{self.path}/rejected", batch_id)
        vectors = self.encode(fresh)
        table = None if old is None else self.encode(old.select("seq", "text"))
        known = U.known(vectors, table, "seq") if table is not None else vectors.select("seq", F.lit(0.0).alias("known"))
        guided = U.guide(judged.join(known, "seq").join(U.novelty(vectors, self.nodes, "seq"), "seq"))
        keep = fresh.join(guided.where("action = 'learn'").select("seq"), "seq", "left_semi")
        store.save_table(keep, f"{self.path}/corpus", batch_id)
        keep = self.spark.read.parquet(f"{self.path}/corpus/version={batch_id}")
        record["added"], total = keep.count(), fresh.count()
        record["rejected"] = total - record["added"]
        if not record["added"]:
            record |= {"reward": PENALTY_REJECTED, "note": "all rejected"}
            return self._close(record)
        every = keep if old is None else old.unionByName(keep)
        x = self.encode(every)
        before = X.measure(x, self.nodes, C.tokens(every, "seq")).first()
        for r in range(self.rounds):
            trained = M.batch_round(x, self.nodes, max(0.5, 2.0 * 0.85**r))
            errors = M.bmu(x, trained).groupBy(F.col("bmu").alias("node_id")).agg(F.sum("qe").alias("e"))
            trained = trained.join(errors, "node_id", "left").withColumn("err", F.col("err") + F.coalesce("e", F.lit(0.0))).drop("e")
            store.save_table(M.grown(trained.select("node_id", "w", "cx", "cy", "err"), seed=batch_id), f"{self.path}/nodes", batch_id * self.rounds + r)
            self.nodes = self.spark.read.parquet(f"{self.path}/nodes/version={batch_id * self.rounds + r}")
        after = X.measure(x, self.nodes, C.tokens(every, "seq")).first()
        values = self.spark.range(1).select(*(F.lit(float(v)).alias(k) for k, v in (("q0", before["mean_qe"]), ("q1", after["mean_qe"]), ("v0", before["vocab_div"]), ("v1", after["vocab_div"]))))
        record["reward"] = values.select(X.reward(*(F.col(c) for c in ("q0", "q1", "v0", "v1")))).first()[0]
        return self._close(record)

    def _close(self, record: dict) -> dict:
        self.records.append(record)
        log = self.spark.createDataFrame([(record["cycle"], record["query"], float(record["reward"]))], "cycle long, query string, reward double")
        store.save_table(log, f"{self.path}/policy_log", record["cycle"])
        return record

    def rejected(self) -> DataFrame:
        """seq, text, score: the last `REJECTED` sentences that the baseline rejected, over all batches.

        Each batch writes its own last ones, so what is read is bounded by batches and a replayed batch changes nothing.
        """
        if not Folder(self.spark, self.path).names("rejected"):
            return self.spark.createDataFrame([], "seq long, text string, score double")
        rows = self.spark.read.parquet(f"{self.path}/rejected")
        return rows.orderBy(F.desc("version"), F.desc("seq"), F.desc("text")).limit(REJECTED).select("seq", "text", "score")

    def policy(self) -> DataFrame:
        return U.policy(self.spark.read.parquet(f"{self.path}/policy_log").where("query is not null"))

    def run(self, stream: DataFrame, checkpoint: str):
        """Start the cycle on a stream of (seq, query, text)."""
        return stream.writeStream.foreachBatch(lambda df, i: self.step(df, i) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_bigrams(stream: DataFrame, id_col: str = "seq") -> DataFrame:
    """w1, w2, c over a stream of texts: Spark keeps the counts as state."""
    return G.bigrams(stream, id_col).groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("c"))


def windowed(events: DataFrame, width: str = "1 day", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """start, event_type, n, mean of each event-time window; rows later than the watermark are dropped on a stream."""
    ts = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        ts = ts.withWatermark("ts", late)
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return ts.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), "event_type", "n", "mean")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """user_id, start, n of each session window."""
    ts = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return ts.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
