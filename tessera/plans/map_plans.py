"""Queries over vectors: map assignment, training rounds, graphs, quantization, instruments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vec as V
from ..operators import corpus as C
from ..operators import embed as E
from ..operators import mapnet as M
from ..operators import metrics as X
from ..operators import refine as R
from ..sources.workspace import Workspace
from . import sqlparts as S
from .text_plans import read

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH RECURSIVE {_BASE}{sql}" if sql.lstrip().startswith(",") else f"WITH RECURSIVE {_BASE} {sql}"
        return f

    return wrap


_BASE = """v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec FROM embeddings),
n AS (SELECT vec_id AS node_id, vec AS w, vec[1] AS cx, vec[2] AS cy, abs(vec[3]) * 20 AS err, vec_id // 4 AS row, vec_id % 4 AS col FROM v WHERE vec_id < 16),
a AS (SELECT vec_id, vec, node_id, list_distance(vec, w) AS d, row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(vec, w), node_id) AS r FROM v, n),
b AS (SELECT vec_id, vec, node_id AS bmu, d AS qe FROM a WHERE r = 1),
sc AS (SELECT i AS dim, (max(abs(w[i])) + 1e-8) / 127 AS scale FROM n, range(1, 65) t(i) GROUP BY i),
q AS (SELECT node_id, list(greatest(-127, least(127, round_even(w[dim] / scale, 0))) ORDER BY dim) AS wq, list(greatest(-127, least(127, round_even(w[dim] / scale, 0))) * scale ORDER BY dim) AS wd FROM n, sc GROUP BY node_id)"""


def vectors(spark, d):
    return read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


def nodes(spark, d):
    """The first 16 vectors as nodes; places, errors and lattice cells from their values."""
    w = F.col("vec")
    return vectors(spark, d).where("vec_id < 16").select(
        F.col("vec_id").alias("node_id"),
        w.alias("w"),
        w[0].alias("cx"),
        w[1].alias("cy"),
        (F.abs(w[2]) * 20).alias("err"),
        F.floor(F.col("vec_id") / 4).cast("int").alias("row"),
        (F.col("vec_id") % 4).cast("int").alias("col"),
    )


def r6(*cols: str):
    return [F.round(c, 6).alias(c) for c in cols]


@query("SELECT vec_id, bmu, round(qe, 6) AS qe FROM b")
def bmu_assign(spark, d):
    return M.bmu(vectors(spark, d), nodes(spark, d)).select("vec_id", "bmu", *r6("qe"))


@query("SELECT vec_id, bmu, round(qe, 6) AS qe FROM b")
def bmu_assign_arrow(spark, d):
    return M.bmu_arrow(vectors(spark, d), nodes(spark, d)).select("vec_id", "bmu", *r6("qe"))


@query("SELECT b.vec_id, bmu, round(qe, 6) AS qe, node_id AS second FROM b JOIN a ON a.vec_id = b.vec_id AND a.r = 2")
def bmu_second(spark, d):
    return M.bmu2(vectors(spark, d), nodes(spark, d)).select("vec_id", "bmu", *r6("qe"), "second")


@query(""", vq AS (SELECT vec_id, list(greatest(-127, least(127, round_even(vec[dim] / scale, 0))) ORDER BY dim) AS x FROM v, sc GROUP BY vec_id),
z AS (SELECT vec_id, node_id, list_sum(list_transform(range(1, 65), lambda i: (x[i] - wq[i]) * (x[i] - wq[i]))) AS d2 FROM vq, q)
SELECT vec_id, arg_min(node_id, d2 * 100 + node_id) AS bmu, CAST(min(d2) AS BIGINT) AS d2 FROM z GROUP BY vec_id""")
def bmu_int8(spark, d):
    return M.bmu_int8(vectors(spark, d), nodes(spark, d)).select("vec_id", "bmu", "d2")


@query("SELECT node_id, dim - 1 AS dim, CAST(wq[dim] AS INT) AS q, round(wd[dim], 9) AS back FROM q, sc")
def quantize_nodes(spark, d):
    """Quantized and read back, in long form."""
    q = M.dequantized(M.quantized(nodes(spark, d)))
    return q.select("node_id", F.posexplode(F.arrays_zip("wq", "w")).alias("dim", "x")).select("node_id", "dim", F.col("x.wq").cast("int").alias("q"), F.round("x.w", 9).alias("back"))


@query(""", s AS (SELECT bmu, dim, sum(vec[dim]) AS s, count(*) AS n FROM b, sc GROUP BY ALL),
k AS (SELECT x.node_id, y.node_id AS bmu, exp(-((x.cx - y.cx) ** 2 + (x.cy - y.cy) ** 2) / 8.0) AS h FROM n x, n y)
SELECT node_id, dim - 1 AS dim, round(sum(h * s) / sum(h * n), 6) AS x FROM k JOIN s USING (bmu) GROUP BY node_id, dim""")
def batch_map_round(spark, d):
    out = M.batch_round(vectors(spark, d), nodes(spark, d), 2.0)
    return out.select("node_id", F.posexplode("w").alias("dim", "x")).select("node_id", "dim", *r6("x"))


@query(""", s AS (SELECT bmu, dim, sum(vec[dim]) AS s, count(*) AS n FROM b, sc GROUP BY ALL),
k AS (SELECT x.node_id, y.node_id AS bmu, exp(-((x.row - y.row) ** 2 + (x.col - y.col) ** 2) / 4.5) AS h FROM n x, n y WHERE (x.row - y.row) ** 2 + (x.col - y.col) ** 2 <= 2.25)
SELECT node_id, dim - 1 AS dim, round(sum(h * s) / sum(h * n), 6) AS x FROM k JOIN s USING (bmu) GROUP BY node_id, dim""")
def lattice_map_round(spark, d):
    grid = nodes(spark, d).withColumn("cx", F.col("row").cast("double")).withColumn("cy", F.col("col").cast("double"))
    out = M.batch_round(vectors(spark, d), grid, 1.5, lattice=True)
    return out.select("node_id", F.posexplode("w").alias("dim", "x")).select("node_id", "dim", *r6("x"))


@query("SELECT node_id, round(err, 6) AS err, 15 + row_number() OVER (ORDER BY err DESC, node_id) AS child_id FROM n WHERE err >= 2.0 ORDER BY err DESC, node_id LIMIT 4")
def grow_selection(spark, d):
    return M.growth(nodes(spark, d)).select("node_id", *r6("err"), "child_id")


def _digest(word: str) -> str:
    u = [f"((CAST(('0x' || substr(md5({word}), {at}, 8)) AS BIGINT) + 1) / 4294967297.0e0)" for at in (1, 9)]
    return f"sqrt(-2 * ln({u[0]})) * cos(2 * pi() * {u[1]})"


@query(f""", g AS (SELECT *, 15 + row_number() OVER (ORDER BY err DESC, node_id) AS child FROM n WHERE err >= 2.0 ORDER BY err DESC, node_id LIMIT 4),
k AS (SELECT node_id, w, cx, cy, CASE WHEN node_id IN (SELECT node_id FROM g) THEN err / 2 ELSE err END AS err FROM n
UNION ALL SELECT child, [w[i + 1] + 0.1 * {_digest("'child 0 ' || child || ' w:' || i")} for i in range(64)], cx + 0.3 * {_digest("'child 0 ' || child || ' at:0'")}, cy + 0.3 * {_digest("'child 0 ' || child || ' at:1'")}, 0 FROM g)
SELECT node_id, dim, round(w[dim + 1], 6) AS w, round(cx, 6) AS cx, round(cy, 6) AS cy, round(err, 6) AS err FROM k, range(64) t(dim)""")
def grow_nodes(spark, d):
    """The map after one growth, its children included."""
    out = M.grown(nodes(spark, d)).select("node_id", F.posexplode("w").alias("dim", "w"), "cx", "cy", "err")
    return out.select("node_id", "dim", *r6("w", "cx", "cy", "err"))


_KNN = """e AS (SELECT src, dst, w FROM (SELECT x.node_id AS src, y.node_id AS dst, list_distance(x.w, y.w) AS w,
  row_number() OVER (PARTITION BY x.node_id ORDER BY sqrt((x.cx - y.cx) ** 2 + (x.cy - y.cy) ** 2), y.node_id) AS r FROM n x, n y WHERE x.node_id <> y.node_id) WHERE r <= {k})"""


@query(f", {_KNN.format(k=6)} SELECT src, dst, round(w, 6) AS w FROM e")
def knn_graph(spark, d):
    return M.knn_graph(nodes(spark, d), 6).select("src", "dst", *r6("w"))


_LATTICE = "e AS (SELECT x.node_id AS src, y.node_id AS dst, list_distance(x.w, y.w) AS w FROM n x, n y WHERE x.node_id <> y.node_id AND abs(x.row - y.row) <= 1 AND abs(x.col - y.col) <= 1)"


@query(f", {_LATTICE} SELECT src, dst, round(w, 6) AS w FROM e")
def lattice_edges(spark, d):
    return M.lattice_edges(nodes(spark, d)).select("src", "dst", *r6("w"))


#: Shortest ways of all pairs: after i steps each row is the best way of i edges at most; 15 steps are enough for 16 nodes.
_PATHS = """z AS (SELECT src, dst, w, 1 AS h FROM e UNION ALL SELECT node_id, node_id, 0, 0 FROM n),
p AS (SELECT node_id AS src, node_id AS dst, {'cost': 0.0::DOUBLE, 'hops': 0, 'path': [node_id]} AS l, 0 AS i FROM n
  UNION ALL SELECT p.src, z.dst, min({'cost': l.cost + w, 'hops': l.hops + h, 'path': CASE h WHEN 1 THEN list_append(l.path, z.dst) ELSE l.path END}), i + 1
  FROM p JOIN z ON z.src = p.dst WHERE i < 15 GROUP BY p.src, z.dst, i),
ways AS (SELECT x.node_id AS src, y.node_id AS dst, coalesce(l.cost, 'infinity'::DOUBLE) AS cost, coalesce(l.hops, -1) AS hops, coalesce(l.path, [x.node_id, y.node_id]) AS path
  FROM n x CROSS JOIN n y LEFT JOIN (SELECT * FROM p WHERE i = 15) q ON q.src = x.node_id AND q.dst = y.node_id)"""


@query(f", {_KNN.format(k=3)}, {_PATHS} SELECT src, dst, round(cost, 6) AS cost, hops, array_to_string(path, ' ') AS path FROM ways")
def semantic_paths(spark, d):
    """Shortest paths between all pairs of nodes, those without a way included."""
    grid = nodes(spark, d)
    ends = grid.select(F.col("node_id").alias("src")).crossJoin(F.broadcast(grid.select(F.col("node_id").alias("dst"))))  # 16 nodes
    out = M.shortest_paths(M.knn_graph(grid, 3), ends, Workspace(spark, "paths"))
    return out.select("src", "dst", *r6("cost"), "hops", F.array_join("path", " ").alias("path"))


@query("SELECT node_id, round(sqrt(list_inner_product(w, w)), 6) AS norm FROM n ORDER BY sqrt(list_inner_product(w, w)), node_id LIMIT 4")
def low_density_centers(spark, d):
    return M.low_density_centers(nodes(spark, d)).select("node_id", *r6("norm"))


@query("SELECT node_id, count(b.bmu) AS n FROM n LEFT JOIN b ON b.bmu = node_id GROUP BY node_id")
def node_density(spark, d):
    return M.density(M.bmu(vectors(spark, d), nodes(spark, d)), nodes(spark, d))


_MEASURE = """t AS (SELECT b.vec_id, bmu, qe, sqrt((x.cx - y.cx) ** 2 + (x.cy - y.cy) ** 2) AS far, greatest(abs(x.row - y.row), abs(x.col - y.col)) AS steps
  FROM b JOIN a ON a.vec_id = b.vec_id AND a.r = 2 JOIN n x ON x.node_id = bmu JOIN n y ON y.node_id = a.node_id)"""


@query(f""", {_MEASURE}, k AS ({S.tokens('documents')})
SELECT 16 AS nodes, count(DISTINCT bmu) AS occupancy, count(DISTINCT bmu) / 16.0 AS occ_ratio, round(avg(qe), 6) AS mean_qe, avg(CASE WHEN far > 1.5 THEN 1.0 ELSE 0.0 END) AS topo_error,
  (SELECT round(count(DISTINCT tok) / count(*), 9) FROM k) AS vocab_div FROM t""")
def map_metrics(spark, d):
    m = X.measure(vectors(spark, d), nodes(spark, d), C.tokens(read(spark, d, "documents")))
    return m.select("nodes", "occupancy", "occ_ratio", *r6("mean_qe"), "topo_error", F.round("vocab_div", 9).alias("vocab_div"))


@query(f""", {_MEASURE}
SELECT count(*) AS n_inputs, count(DISTINCT bmu) AS occupancy, count(DISTINCT bmu) / 16.0 AS occupancy_ratio, 16 - count(DISTINCT bmu) AS empty_cells, round(avg(qe), 6) AS mean_qe,
  avg(CASE WHEN steps > 1 THEN 1.0 ELSE 0.0 END) AS topo_error FROM t""")
def lattice_metrics(spark, d):
    m = X.lattice_measure(vectors(spark, d), nodes(spark, d))
    return m.select("n_inputs", "occupancy", "occupancy_ratio", "empty_cells", *r6("mean_qe"), "topo_error")


@query(""", l AS (SELECT label, row, col, lag(row) OVER w AS pr, lag(col) OVER w AS pc FROM b JOIN n ON node_id = bmu JOIN embeddings e ON e.vec_id = b.vec_id WINDOW w AS (PARTITION BY label ORDER BY b.vec_id))
SELECT label, CAST(coalesce(sum(greatest(abs(row - pr), abs(col - pc))), 0) AS BIGINT) AS path_len FROM l GROUP BY label""")
def path_length(spark, d):
    """Lattice steps along the vectors of each label in order."""
    v = read(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    return X.path_length(M.bmu(v, nodes(spark, d)), nodes(spark, d), "vec_id", "label")


_HISTORY = """, h AS (SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS round, count(DISTINCT user_id) AS occupancy, count(DISTINCT user_id) / 1000.0 AS occ_ratio,
  count(*) AS nodes, avg(value) AS mean_qe, count(DISTINCT user_id) / count(*) AS vocab_div FROM events GROUP BY 1)"""


def history(spark, d):
    """Rounds from events, a day each."""
    e = read(spark, d, "events").select(F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("round"), "user_id", "value")
    return e.groupBy("round").agg(
        F.count_distinct("user_id").alias("occupancy"),
        (F.count_distinct("user_id") / 1000.0).alias("occ_ratio"),
        F.count(F.lit(1)).alias("nodes"),
        F.avg("value").alias("mean_qe"),
        (F.count_distinct("user_id") / F.count(F.lit(1))).alias("vocab_div"),
    )


@query(_HISTORY + "SELECT round, round(greatest(0.02, 0.4 * pow(0.9, round)), 9) AS lr, round(greatest(0.5, 2.0 * pow(0.85, round)), 9) AS radius FROM h")
def training_schedule(spark, d):
    """Rate and radius of every round of the history."""
    lr, radius = M.schedule(F.col("round"))
    return history(spark, d).select("round", F.round(lr, 9).alias("lr"), F.round(radius, 9).alias("radius"))


_DOWN = "({k} <= lag({k}) OVER w AND lag({k}) OVER w <= lag({k}, 2) OVER w AND lag({k}, 2) OVER w <= lag({k}, 3) OVER w AND lag({k}, 3) OVER w > {k})"


@query(_HISTORY + f"""
SELECT round, CASE WHEN lag(round, 3) OVER w IS NULL THEN NULL
  WHEN {_DOWN.format(k='occupancy')} AND {_DOWN.format(k='vocab_div')} AND {_DOWN.format(k='mean_qe')} THEN 'echo'
  WHEN {_DOWN.format(k='occupancy')} AND occ_ratio < 0.1 THEN 'point'
  WHEN lag(round, 5) OVER w IS NOT NULL AND vocab_div < 0.12 AND max(vocab_div) OVER (ORDER BY round ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) > 0.25 THEN 'vocabulary'
  WHEN occ_ratio < 0.15 AND nodes > 200 THEN 'overgrown' END AS alarm FROM h WINDOW w AS (ORDER BY round)""")
def collapse_alarm(spark, d):
    return X.collapse_alarm(history(spark, d)).select("round", "alarm")


@query(_HISTORY + """
SELECT count(*) AS rounds, min_by(occupancy, round) AS occupancy_first, max_by(occupancy, round) AS occupancy_last, round(min_by(mean_qe, round), 6) AS mean_qe_first, round(max_by(mean_qe, round), 6) AS mean_qe_last,
  CASE WHEN max_by(occupancy, round) >= min_by(occupancy, round) AND max_by(vocab_div, round) >= min_by(vocab_div, round) * 0.9 THEN 'deepening' ELSE 'collapse-risk' END AS trend FROM h""")
def trend_summary(spark, d):
    return X.trend(history(spark, d))


@query(_HISTORY + ", t AS (SELECT CASE WHEN count(*) > 1 THEN avg(mean_qe) + 2 * stddev_pop(mean_qe) END AS band FROM h) SELECT vec_id, qe <= coalesce(band, 1.5 * qe) AS inside FROM b, t")
def domain_band(spark, d):
    return X.domain_band(M.bmu(vectors(spark, d), nodes(spark, d)), history(spark, d)).select("vec_id", "inside")


_REWARD = """, l AS (SELECT round, lag(mean_qe) OVER w AS q0, mean_qe AS q1, lag(vocab_div) OVER w AS v0, vocab_div AS v1 FROM h WINDOW w AS (ORDER BY round)),
c AS (SELECT *, (q0 - q1) / (abs(q0) + 1e-8) AS assim, abs(q1 - q0) / (abs(q0) + 1e-8) AS ch, v1 - v0 AS dv FROM l WHERE q0 IS NOT NULL)
SELECT round, round(assim + CASE WHEN q1 > q0 THEN -0.6 * least(2.0, ch / 0.5) * 0.5 WHEN ch BETWEEN 0.15 AND 0.5 THEN 0.6 WHEN ch < 0.15 THEN 0.6 * (ch / 0.15) * 0.5 ELSE 0.6 * (1 - least(2.0, (ch - 0.5) / 0.5)) END
  + CASE WHEN dv >= 0 THEN 0.8 * dv ELSE -0.4 * greatest(0.0, -dv - 0.05) * 0.5 END, 6) AS reward FROM c"""


@query(_HISTORY + _REWARD)
def learning_reward(spark, d):
    return X.rewards(history(spark, d)).select("round", *r6("reward"))


@query(""", e AS (SELECT vec_id, vec, x.wd FROM v, q x), i AS (SELECT vec_id, min(list_distance(vec, wd)) AS qe8 FROM e GROUP BY vec_id)
SELECT round(avg(qe), 6) AS qe_full, round(avg(qe8), 6) AS qe_int8, 16 * 64 * 8 AS bytes_full, 16 * 64 + 64 * 8 AS bytes_int8, round(16 * 64 * 8 / (16 * 64 + 64 * 8), 6) AS ratio, round(abs(avg(qe8) - avg(qe)) / avg(qe) * 100, 6) AS diff_percent FROM b JOIN i USING (vec_id)""")
def quantization_report(spark, d):
    return X.quantization_report(vectors(spark, d), nodes(spark, d)).select(*r6("qe_full", "qe_int8"), "bytes_full", "bytes_int8", *r6("ratio", "diff_percent"))


@query(", m AS (SELECT dim, avg(vec[dim]) AS m, stddev_pop(vec[dim]) AS s FROM v, sc GROUP BY dim) SELECT vec_id, dim - 1 AS dim, round((vec[dim] - m) / (s + 1e-8), 6) AS z FROM v, m")
def zscore_vectors(spark, d):
    out = E.zscored(vectors(spark, d), "vec_id")
    return out.select("vec_id", F.posexplode("vec").alias("dim", "z")).select("vec_id", "dim", *r6("z"))


@query("SELECT vec_id, dim - 1 AS dim, round(vec[dim] / (sqrt(list_inner_product(vec, vec)) + 1e-8), 6) AS u FROM v, sc")
def unit_vectors(spark, d):
    out = vectors(spark, d).select("vec_id", F.posexplode(V.unit(F.col("vec"))).alias("dim", "u"))
    return out.select("vec_id", "dim", *r6("u"))


@query(""", p AS (SELECT x.vec_id AS word, y.vec_id AS other, list_inner_product(x.vec, y.vec) / greatest(sqrt(list_inner_product(x.vec, x.vec)) * sqrt(list_inner_product(y.vec, y.vec)), 1e-12) AS sim
  FROM v x, v y WHERE x.vec_id <> y.vec_id)
SELECT word, other, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY sim DESC, other) AS r FROM p) WHERE r <= 5""")
def nearest_words(spark, d):
    v = vectors(spark, d).withColumnRenamed("vec_id", "word")
    return E.nearest(v, v, 5).select("word", "other", *r6("sim"))


_SOFT = """s AS (SELECT vec_id, node_id, list_distance(vec, wd) AS d FROM v, q), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d * d, node_id) AS r FROM s) WHERE r <= 4),
e AS (SELECT *, exp(-(d * d) / 2.0 - max(-(d * d) / 2.0) OVER (PARTITION BY vec_id)) AS e FROM k), p AS (SELECT vec_id, node_id, d, e / (sum(e) OVER (PARTITION BY vec_id) + 1e-12) AS p FROM e)"""


@query(f", {_SOFT} SELECT vec_id, node_id, round(p, 6) AS p FROM p")
def soft_assign(spark, d):
    out = R.soft_assign(vectors(spark, d), M.quantized(nodes(spark, d)), 4, 2.0)
    return out.select("vec_id", F.explode("soft").alias("s")).select("vec_id", "s.node_id", F.round("s.p", 6).alias("p"))


@query(f", {_SOFT} SELECT vec_id, round(sum(p * d), 6) AS local_qe FROM p GROUP BY vec_id")
def local_qe(spark, d):
    return R.local_qe(R.soft_assign(vectors(spark, d), M.quantized(nodes(spark, d)), 4, 2.0)).select("vec_id", *r6("local_qe"))


@query(f""", {_SOFT}, x AS (SELECT vec_id, node_id, p, vec FROM p JOIN v USING (vec_id)),
y AS (SELECT vec_id, node_id, p, vec, [greatest(-127, least(127, round_even((wd[i] + 0.3 * p * (vec[i] - wd[i])) / sc2[i], 0))) * sc2[i] for i in range(1, 65)] AS wn FROM x JOIN q USING (node_id), (SELECT list(scale ORDER BY dim) AS sc2 FROM sc)),
da AS (SELECT vec_id, node_id, p, list_distance(vec, wn) AS d FROM y), ea AS (SELECT *, exp(-(d * d) / 2.0 - max(-(d * d) / 2.0) OVER (PARTITION BY vec_id)) AS e FROM da),
pa AS (SELECT vec_id, node_id, p, d, e / (sum(e) OVER (PARTITION BY vec_id) + 1e-12) AS q FROM ea),
bf AS (SELECT vec_id, sum(p * d) AS before FROM p GROUP BY vec_id)
SELECT vec_id, round(any_value(before), 6) AS before, round(sum(q * d), 6) AS after, round(sum(p), 6) AS used FROM pa JOIN bf USING (vec_id) GROUP BY vec_id""")
def refine_step(spark, d):
    """For every vector, one local update by it alone: the local error before and after, and the use that it adds."""
    out = R.refine_each(vectors(spark, d), M.quantized(nodes(spark, d)), 4, 2.0, 0.3)
    return out.select("vec_id", *r6("before", "after"), F.round(V.total(F.transform("moved", lambda m: m.p)), 6).alias("used"))


@query(f", {_SOFT} SELECT node_id, round(coalesce(sum(p), 0), 6) AS use_count FROM n LEFT JOIN p USING (node_id) GROUP BY node_id")
def node_use(spark, d):
    """How much all vectors use each node, by their soft assignment."""
    return R.use_counts(R.soft_assign(vectors(spark, d), M.quantized(nodes(spark, d)), 4, 2.0), nodes(spark, d)).select("node_id", *r6("use_count"))


@query(""", s AS (SELECT avg(sd) AS spread, any_value(m) AS m FROM (SELECT dim, stddev_pop(vec[dim]) AS sd, count(*) AS m FROM v JOIN embeddings e USING (vec_id), sc WHERE label = 1 GROUP BY dim))
SELECT CAST(least(16, greatest(4, 2 * m)) AS INT) AS k, round(least(4.0, greatest(0.8, spread * 8.0)), 6) AS temp, round(least(0.35, greatest(0.15, 0.4 - spread)), 6) AS lr, round(spread, 6) AS spread, m AS region_size FROM s""")
def auto_parameters(spark, d):
    region = read(spark, d, "embeddings").where("label = 1").select(F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    return R.auto_params(region).select("k", *r6("temp", "lr", "spread"), "region_size")


@query(""", u AS (SELECT node_id, wq, (node_id * 7) % 16 * 0.95 AS use FROM q), t AS (SELECT quantile_cont(use, 0.3) AS t FROM u)
SELECT node_id, dim - 1 AS dim, CAST(CASE WHEN use <= t THEN trunc(greatest(-127, least(127, round_even(wq[dim] * scale / (1.5 * scale), 0) * 1.5))) ELSE wq[dim] END AS INT) AS q FROM u, t, sc""")
def forget_nodes(spark, d):
    used = M.quantized(nodes(spark, d)).withColumn("use_count", ((F.col("node_id") * 7) % 16).cast("double"))
    return R.forget(used).select("node_id", F.posexplode("wq").alias("dim", "q")).select("node_id", "dim", F.col("q").cast("int").alias("q"))


@query("SELECT node_id, dim - 1 AS dim, round(wd[dim], 9) AS w FROM q, sc")
def state_round_trip(spark, d):
    """Map state written with INT8 weights and read back."""
    from ..sources import store

    path = store.scratch(spark, "state")
    n = nodes(spark, d)
    store.save_state(n, path, {"round": 3})
    return store.load_nodes(spark, path).select("node_id", F.posexplode("w").alias("dim", "w")).select("node_id", "dim", F.round("w", 9).alias("w"))


@query(f""", s AS (SELECT vec_id, vec, md5('0 ' || vec_id) AS h, row_number() OVER (ORDER BY md5('0 ' || vec_id)) - 1 AS node_id FROM v ORDER BY h LIMIT 36)
SELECT node_id, vec_id, dim, round(vec[dim + 1] + 0.01 * {_digest("'noise ' || h || ':' || dim")}, 6) AS w, round({_digest("'place 0 ' || node_id || ':0'")}, 6) AS cx, round({_digest("'place 0 ' || node_id || ':1'")}, 6) AS cy
FROM s, range(64) t(dim)""")
def map_reinit(spark, d):
    """A map begun anew from 36 vectors drawn from all, with noise."""
    out = M.reinit(vectors(spark, d)).select("node_id", F.col("id").alias("vec_id"), F.posexplode("w").alias("dim", "w"), "cx", "cy")
    return out.select("node_id", "vec_id", "dim", *r6("w", "cx", "cy"))


@query()
def train_online_maps(spark, d):
    """Exact sequential training, a map for each label; its quantization error must not rise."""
    e = read(spark, d, "embeddings").select(F.col("label").cast("string").alias("expert"), F.col("vec_id").alias("seq"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    start = e.select("expert").distinct().crossJoin(F.broadcast(nodes(spark, d).select("node_id", "w", "cx", "cy", F.lit(0.0).alias("err"))))  # 16 nodes
    return M.train_online(e, start, 3).select("expert", "node_id", *r6("err"))


@query()
def local_regions(spark, d):
    """Greedy leader regions of the vectors of each label."""
    e = read(spark, d, "embeddings").select(F.col("label").cast("string").alias("grp"), F.col("vec_id").alias("seq"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    return R.regions(e, 0.6)
