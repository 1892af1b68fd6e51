"""Session state: the map, the corpus, its history, the query policy and a locked baseline, saved together.

A save is a folder of Parquet tables under `path`, one for each part, and a manifest: a small JSON file that names the
folder, its tables and the single values (dimension, round, threshold). The manifest is written last and appears at
once, so it is what makes a save visible: a save that was broken off, or that still runs, is never read, and the one
before it stays whole. Two writers get different folders; manifests are numbered and the first to take a number has it.

Weights are kept as INT8 with their scale. Of the policy log the last `LOG` rows are kept. The baseline is kept only
if it is locked. The guardrail in use and the log of rejected sentences are not kept: loading fits the guardrail anew
where the corpus has ten sentences or more, and a locked baseline is the saved one, not a new fit.

Nulls in any column, empty tables and repeated rows come back as they were; parts that a session lacks come back as None.
Extra columns of a table are kept, but for the nodes (node_id, wq, scale, cx, cy, err).
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import guard as G
from ..operators import mapnet as M
from .workspace import Folder

#: Rows of the policy log that a save keeps, the newest ones.
LOG = 300


@dataclass
class Session:
    """nodes (node_id, w, cx, cy, err); corpus (seq, text); history (round, ...); policy (word, reward_sum, n, ...);
    policy_log (seq, query, reward); baseline and guardrail: (model, threshold)."""

    nodes: DataFrame | None = None
    corpus: DataFrame | None = None
    history: DataFrame | None = None
    policy: DataFrame | None = None
    policy_log: DataFrame | None = None
    baseline: tuple[G.Model, float] | None = None
    guardrail: tuple[G.Model, float] | None = None
    dim: int | None = None
    round: int = 0
    created: float | None = None
    extra: dict = field(default_factory=dict)


def _tables(session: Session) -> dict[str, DataFrame]:
    out = {k: getattr(session, k) for k in ("corpus", "history", "policy") if getattr(session, k) is not None}
    if session.nodes is not None:
        out["nodes"] = M.quantized(session.nodes).select("node_id", "wq", "scale", "cx", "cy", "err")
    if session.policy_log is not None:
        out["policy_log"] = session.policy_log.orderBy(F.desc("seq")).limit(LOG)
    if session.baseline is not None:
        model, _ = session.baseline
        out |= {"baseline_uni": model.uni, "baseline_bi": model.bi}
    return out


def saves(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the saves that are visible."""
    names = Folder(spark, path).names("manifests")
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def save(session: Session, path: str, spark: SparkSession, keep: int = 2) -> int:
    """Write the session and make it visible; its number. Older saves but the last `keep` are removed after that."""
    folder, name = Folder(spark, path), f"save-{uuid.uuid4().hex}"
    tables = _tables(session)
    for table, df in tables.items():
        df.write.parquet(folder.path(f"{name}/{table}"))
    manifest = {
        "folder": name,
        "tables": {t: json.loads(df.schema.json()) for t, df in tables.items()},
        "values": {"dim": session.dim, "round": session.round, "created": session.created, "baseline_threshold": session.baseline and session.baseline[1], "extra": session.extra},
    }
    number = max(saves(spark, path), default=-1) + 1
    while not folder.write_text(f"manifests/{number:012d}.json", json.dumps(manifest)):
        number += 1
    clean(spark, path, keep)
    return number


def clean(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Remove all visible saves but the last `keep`; their manifests go first, so none points to a folder that is gone."""
    folder = Folder(spark, path)
    for number in saves(spark, path)[: -keep or None]:
        manifest = json.loads(folder.read_text(f"manifests/{number:012d}.json"))
        folder.remove(f"manifests/{number:012d}.json")
        folder.remove(manifest["folder"])


def load(spark: SparkSession, path: str, number: int | None = None) -> Session:
    """The last visible save, or the one of that number, with a guardrail fitted to its corpus."""
    from pyspark.sql.types import StructType

    there = saves(spark, path)
    if not there or number is not None and number not in there:
        raise FileNotFoundError(f"no {'such ' if there else ''}save in {path}")
    folder = Folder(spark, path)
    manifest = json.loads(folder.read_text(f"manifests/{there[-1] if number is None else number:012d}.json"))
    values = manifest["values"]

    def table(name: str) -> DataFrame | None:
        kind = manifest["tables"].get(name)
        return None if kind is None else spark.read.schema(StructType.fromJson(kind)).parquet(folder.path(f"{manifest['folder']}/{name}"))

    nodes = table("nodes")
    out = Session(
        nodes=None if nodes is None else M.dequantized(nodes).select("node_id", "w", "cx", "cy", "err"),
        **{k: table(k) for k in ("corpus", "history", "policy", "policy_log")},
        **{k: values[k] for k in ("dim", "round", "created", "extra")},
    )
    if "baseline_uni" in manifest["tables"]:
        out.baseline = (G.Model(table("baseline_uni"), table("baseline_bi")), values["baseline_threshold"])
    if out.corpus is not None:
        locked = None if out.baseline is None else out.baseline[1]
        fitted = G.fit_guardrail(out.corpus.where(F.col("text").isNotNull()), "seq", locked=locked)
        out.guardrail = fitted and fitted[:2]
    return out
