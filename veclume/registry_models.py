"""Queries of clustering, codes and neural projections, and their SQL.

Iterations are unrolled in SQL from the same first centroids. Fits from random
rows have no SQL of their own; what they must reach has.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import functions as F

from veclume.functions import quant as Q
from veclume.functions import vector as V
from veclume.operators import hist, kmeans, learned, pq, stats, topk, umap
from veclume.plans.blocked import knn
from veclume.plans.index import IndexConfig, VectorIndex
from veclume.registry import DIM, EDGES, _layout, add, label_centroids, query, rounded, table, vectors
from veclume.registry_search import _weights_sql
from veclume.storage import shared_dir

# -- k-means from the first vectors ------------------------------------------------------

K, STEPS = 10, 5
NEAREST = "SELECT e.vec_id, e.embedding, k, list_sum(list_transform(range(1, 65), lambda i: (e.embedding[i]::DOUBLE - c[i]) ** 2)) AS d FROM embeddings e, {c} QUALIFY row_number() OVER (PARTITION BY e.vec_id ORDER BY d, k) = 1"
MEANS = "SELECT k, list(m ORDER BY i) AS c FROM (SELECT k, i, {value} AS m FROM (SELECT a.k, i, avg(embedding[i]::DOUBLE) AS m, any_value(o.c[i]) AS old FROM {a} a JOIN {c} o ON o.k = a.k, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2)) GROUP BY 1"


def lloyd_sql(steps: int, value: str = "m") -> str:
    """CTEs c0 to c<steps>: centroids by step."""
    parts = [f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS k, embedding::DOUBLE[] AS c FROM (SELECT * FROM embeddings ORDER BY vec_id LIMIT {K}))"]
    for t in range(steps):
        parts += [f"a{t} AS MATERIALIZED ({NEAREST.format(c=f'c{t}')})", f"c{t + 1} AS MATERIALIZED ({MEANS.format(a=f'a{t}', c=f'c{t}', value=value)})"]
    return ", ".join(parts)


def _first(spark, d, k: int = K) -> np.ndarray:
    """The vectors of least id, as first centroids."""
    return np.array([r[0] for r in vectors(spark, d)[0].orderBy("vec_id").limit(k).select("embedding").collect()], float)


def _assigned(spark, d, c: np.ndarray):
    return rounded(kmeans.assign(vectors(spark, d)[0].select("vec_id", "embedding"), c).select("vec_id", "cluster_id", "distance"), 3, "distance")


@query("kmeans_lloyd", f"WITH {lloyd_sql(STEPS)} SELECT vec_id, k::INT AS cluster_id, round(d, 3) AS distance FROM ({NEAREST.format(c=f'c{STEPS}')})")
def _(spark, d):
    return _assigned(spark, d, kmeans.fit(vectors(spark, d)[0], K, STEPS, 0.0, init=_first(spark, d)).centroids)


@query("kmeans_mini_batch", f"WITH {lloyd_sql(2, 'old + 0.1 * (m - old)')} SELECT vec_id, k::INT AS cluster_id, round(d, 3) AS distance FROM ({NEAREST.format(c='c2')})")
def _(spark, d):
    return _assigned(spark, d, kmeans.fit_mini_batch(vectors(spark, d)[0], K, 2, 0.1, 1.0, init=_first(spark, d)).centroids)


@query("kmeans_fit")
def _(spark, d):
    e = vectors(spark, d)[0].select("vec_id", "embedding")
    return kmeans.assign(e, kmeans.fit(e, K, 15, seed=1).centroids).select("vec_id", "cluster_id", "distance")


@query("kmeans_quality", "SELECT count(*) AS n, true AS as_good_as_labels FROM embeddings")
def _(spark, d):
    """Whether the clusters are as tight as the labels', by inertia, within a twentieth."""
    e = vectors(spark, d)[0].select("vec_id", "embedding")
    own, labels = (kmeans.assign(e, c).agg(F.sum("distance").alias("d"), F.count("*").alias("n")).first() for c in (kmeans.fit(e, K, 15, seed=1).centroids, label_centroids(spark, d)[1]))
    return spark.createDataFrame([(own.n, own.d <= 1.05 * labels.d)], "n long, as_good_as_labels boolean")


# -- a stored inverted file ----------------------------------------------------------------

RECALL = 0.95


def stored_index(spark, d) -> VectorIndex:
    """The index of the table as it is now, in the shared folder: opened, or made once and trained."""
    e = vectors(spark, d)[0]
    jvm = spark.sparkContext._jvm
    files = []
    for f in sorted(e.inputFiles()):
        at = jvm.org.apache.hadoop.fs.Path(f)
        status = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at)
        files.append((f, status.getLen(), status.getModificationTime()))
    path = f"{shared_dir(spark).rstrip('/')}/ivf-{hashlib.sha256(repr(files).encode()).hexdigest()[:32]}"
    config = IndexConfig(DIM, kind="ivf_auto", recall=RECALL, routing_threshold=0, auto_train=False)
    index = VectorIndex.open(spark, path, config)
    if index.centroids is None:
        index.insert(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")))
        index.train(seed=1, iterations=10)
    return index


def _ivf(spark, d):
    return stored_index(spark, d).search(vectors(spark, d)[1].select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec")), 10)


add("ivf_search", _ivf)


@query("ivf_recall", "SELECT true AS reached, count(*) AS queries FROM embeddings WHERE vec_id % 20 = 0")
def _(spark, d):
    found = topk.recall(_ivf(spark, d), knn(*vectors(spark, d), 10))
    return found.select((F.col("recall") >= RECALL).alias("reached"), "queries")


# -- product quantization from the first vectors ----------------------------------------------

M, CODES, ROUNDS, SUB = 8, 16, 3, 8
CODED = f"SELECT vec_id, m, k, list_sum(list_transform(range(1, {SUB + 1}), lambda i: (embedding[m * {SUB} + i]::DOUBLE - c[i]) ** 2)) AS d, embedding FROM embeddings, {{b}} QUALIFY row_number() OVER (PARTITION BY vec_id, m ORDER BY d, k) = 1"
BOOK = f"SELECT o.m, o.k, coalesce(n.c, o.c) AS c FROM {{b}} o LEFT JOIN (SELECT m, k, list(x ORDER BY i) AS c FROM (SELECT m, k, i, avg(embedding[m * {SUB} + i]::DOUBLE) AS x FROM {{a}}, (SELECT unnest(range(1, {SUB + 1})) AS i) GROUP BY 1, 2, 3) GROUP BY 1, 2) n ON n.m = o.m AND n.k = o.k"


def book_sql() -> str:
    """CTEs b0 to b<ROUNDS> (codebooks by step) and codes."""
    parts = [f"b0 AS MATERIALIZED (SELECT m, row_number() OVER (PARTITION BY m ORDER BY vec_id) - 1 AS k, list_slice(embedding::DOUBLE[], m * {SUB} + 1, m * {SUB} + {SUB}) AS c FROM (SELECT * FROM embeddings ORDER BY vec_id LIMIT {CODES}), (SELECT unnest(range(0, {M})) AS m))"]
    for t in range(ROUNDS):
        parts += [f"a{t} AS MATERIALIZED ({CODED.format(b=f'b{t}')})", f"b{t + 1} AS MATERIALIZED ({BOOK.format(a=f'a{t}', b=f'b{t}')})"]
    return ", ".join([*parts, f"codes AS MATERIALIZED ({CODED.format(b=f'b{ROUNDS}')})"])


def _book(spark, d) -> np.ndarray:
    return pq.train(vectors(spark, d)[0], M, CODES, ROUNDS, 0.0, init=_first(spark, d, CODES))


@query("pq_codes", f"WITH {book_sql()} SELECT vec_id, m::INT AS m, k::INT AS code FROM codes")
def _(spark, d):
    return pq.encode(vectors(spark, d)[0].select("vec_id", "embedding"), _book(spark, d)).select("vec_id", F.posexplode("codes").alias("m", "code")).select("vec_id", "m", F.col("code").cast("int").alias("code"))


@query("pq_adc", f"WITH {book_sql()}, found AS (SELECT q.vec_id AS query_id, x.vec_id AS id, sqrt(sum(list_sum(list_transform(range(1, {SUB + 1}), lambda i: (q.embedding[x.m * {SUB} + i]::DOUBLE - b.c[i]) ** 2)))) AS d FROM embeddings q, codes x JOIN b{ROUNDS} b ON b.m = x.m AND b.k = x.k WHERE q.vec_id % 20 = 0 GROUP BY 1, 2) SELECT query_id, row_number() OVER w AS rank, id, round(d, 4) AS distance FROM found WINDOW w AS (PARTITION BY query_id ORDER BY round(d, 9), id) QUALIFY row_number() OVER w <= 10")
def _(spark, d):
    e, q = vectors(spark, d)
    book = _book(spark, d)
    return rounded(pq.search(pq.encode(e, book), book, q, 10), 4, "distance")


@query("pq_decoded", f"WITH {book_sql()} SELECT vec_id, round(sum(d) / {DIM}, 6) AS mse FROM codes GROUP BY 1")
def _(spark, d):
    book = _book(spark, d)
    out = pq.decode(pq.encode(vectors(spark, d)[0].select("vec_id", "embedding"), book), book)
    return out.select("vec_id", F.round(Q.mse("embedding", "decoded"), 6).alias("mse"))


#: Candidates of a query that are compared exactly, whatever the table.
CANDIDATES = 100


def _reranked(spark, d):
    e, q = vectors(spark, d)
    book = pq.train(e, 32, 64, 8)
    return pq.reranked(pq.encode(e, book), book, q, 10, CANDIDATES)


add("pq_search", _reranked)


@query("pq_recall", "SELECT true AS reached, count(*) AS queries FROM embeddings WHERE vec_id % 20 = 0")
def _(spark, d):
    return topk.recall(_reranked(spark, d), knn(*vectors(spark, d), 10)).select((F.col("recall") >= 0.9).alias("reached"), "queries")


# -- neural codes -------------------------------------------------------------------------------

ENCODE, DECODE = learned.xavier(32, DIM, 2), learned.xavier(DIM, 32, 3)
LATENT_SQL = f"SELECT vec_id, list_transform(h, lambda x: CASE WHEN n > 1e-8 THEN x / n ELSE 0 END) AS h FROM (SELECT vec_id, h, sqrt(list_dot_product(h, h)) AS n FROM (SELECT vec_id, list_transform({_weights_sql(ENCODE)}, lambda r: greatest(0, list_dot_product(r, embedding::DOUBLE[]))) AS h FROM embeddings))"
CODE_SQL = f"SELECT vec_id, s, list_transform(h, lambda x: greatest(-128, least(127, round_even(x / s, 0)))) AS q FROM (SELECT *, greatest(list_max(list_transform(h, lambda x: abs(x))) / 127, 1e-8) AS s FROM ({LATENT_SQL}))"


@query("neural_codes", f"SELECT vec_id, round(s, 8) AS scale, list_sum(q)::BIGINT AS code_sum, round(list_dot_product(({_weights_sql(DECODE)})[1], list_transform(q, lambda x: x * s)), 6) AS first FROM ({CODE_SQL})")
def _(spark, d):
    e = vectors(spark, d)[0].select("vec_id", "embedding")
    coded = learned.neural_encode(e, ENCODE, np.zeros(32))
    out = learned.neural_decode(coded, DECODE, np.zeros(DIM))
    return out.select("vec_id", F.round("code.scale", 8).alias("scale"), F.aggregate("code.q", F.lit(0).cast("long"), lambda a, x: a + x).alias("code_sum"), F.round(F.element_at("decoded", 1), 6).alias("first"))


# -- stored codes, codes by dimension, sizes ---------------------------------------------------------


def stored_sql(bits: int, symmetric: bool) -> str:
    most = (1 << (bits - 1)) - 1 if symmetric else (1 << bits) - 1
    scale = f"list_max(list_transform(v, lambda x: abs(x))) / {most}" if symmetric else f"(list_max(v) - list_min(v)) / {most}"
    low, move, least = ("0::DOUBLE", most, -most) if symmetric else ("list_min(v)", 0, 0)
    return f"SELECT vec_id, list_sum(q)::BIGINT AS code_sum, round(s, 8) AS scale, round(lo, 6) AS \"offset\", round(list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - ((q[i] - {move}) * s + lo)) ** 2)) / len(v), 8) AS mse FROM (SELECT *, list_transform(v, lambda x: round(greatest({least}, least({most}, (x - lo) / s))) + {move}) AS q FROM (SELECT vec_id, v, {scale} AS s, {low} AS lo FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)))"


for _bits in (4, 8, 16):
    for _sym in (True, False):

        def _stored(spark, d, b=_bits, sym=_sym):
            e = table(spark, d, "embeddings").select("vec_id", "embedding", Q.stored("embedding", b, sym).alias("c"))
            decoded = Q.stored_decode("c", b, sym)
            return e.select("vec_id", F.aggregate("c.q", F.lit(0).cast("long"), lambda a, x: a + x).alias("code_sum"), F.round("c.scale", 8).alias("scale"), F.round("c.offset", 6).alias("offset"), F.round(Q.mse("embedding", decoded), 8).alias("mse"))

        add(f"stored_codes_{_bits}_{'sym' if _sym else 'asym'}", _stored, stored_sql(_bits, _sym))


@query("per_channel_codes", "WITH s AS (SELECT list(scale ORDER BY i) AS s FROM (SELECT i, greatest(max(abs(embedding[i]::DOUBLE)) / 127, 1e-8) AS scale FROM (SELECT embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY 1)), q AS (SELECT vec_id, embedding::DOUBLE[] AS v, s, list_transform(range(1, 65), lambda i: greatest(-128, least(127, round_even(embedding[i]::DOUBLE / s[i], 0)))) AS q FROM embeddings, s) SELECT vec_id, list_sum(q)::BIGINT AS code_sum, round(list_sum(list_transform(range(1, 65), lambda i: (v[i] - q[i] * s[i]) ** 2)) / 64, 8) AS mse FROM q")
def _(spark, d):
    coded, scales = Q.per_channel(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding")
    return coded.select("vec_id", F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x).alias("code_sum"), F.round(Q.mse("embedding", Q.per_channel_decode("q", scales)), 8).alias("mse"))


@query("compression", "SELECT bits, 32.0::DOUBLE / bits AS ratio, CASE WHEN bits <= 1 THEN 1 WHEN bits <= 4 THEN 4 WHEN bits <= 8 THEN 8 ELSE 16 END AS adaptive FROM (VALUES (1), (4), (8), (16)) t(bits)")
def _(spark, d):
    return spark.createDataFrame([(b, Q.compression_ratio(b), Q.adaptive_bits(32 / b)) for b in (1, 4, 8, 16)], "bits int, ratio double, adaptive int")


# -- statistics over data sets, edges -------------------------------------------------------------------


@query("stats_across", "SELECT count(*) AS datasets, round(avg(m), 4) AS mean_mean, round(avg(s), 4) AS mean_stddev FROM (SELECT avg(l_quantity) AS m, stddev_samp(l_quantity) AS s FROM lineitem GROUP BY l_returnflag)")
def _(spark, d):
    return rounded(stats.across(stats.basic(table(spark, d, "lineitem"), "l_quantity", ["l_returnflag"]), ["mean", "stddev"]), 4, "mean_mean", "mean_stddev")


BIN_SQL = "CASE " + " ".join(f"WHEN l_quantity < {e} THEN {k}" for k, e in enumerate(EDGES[1:-1])) + f" ELSE {len(EDGES) - 2} END"


@query("hist_averaged", f"WITH n AS (SELECT l_returnflag, count(*) AS t FROM lineitem GROUP BY 1), h AS (SELECT l_returnflag, {BIN_SQL} AS b, count(*) AS c FROM lineitem GROUP BY 1, 2) SELECT k AS bin, {list(EDGES)}[k + 1]::DOUBLE AS low, {list(EDGES)}[k + 2]::DOUBLE AS high, round(avg(coalesce(c, 0)), 4) AS mean_count, round(avg(coalesce(c, 0) / t), 6) AS mean_share FROM (SELECT unnest(range(0, 4)) AS k) CROSS JOIN n LEFT JOIN h ON h.b = k AND h.l_returnflag = n.l_returnflag GROUP BY 1, 2, 3")
def _(spark, d):
    return rounded(rounded(hist.averaged(hist.histogram(table(spark, d, "lineitem"), "l_quantity", EDGES, ["l_returnflag"]), "l_returnflag"), 4, "mean_count"), 6, "mean_share")


@query("edges_by_source", "SELECT a.vec_id AS source, b.vec_id AS target, w.weight FROM embeddings a JOIN (VALUES (1, 1.0::DOUBLE), (7, 0.5::DOUBLE)) w(s, weight) ON true JOIN embeddings b ON b.vec_id = a.vec_id + w.s")
def _(spark, d):
    points, edges = _layout(spark, d)
    return umap.sort_edges(edges.join(points.select(F.col("id").alias("target")), "target", "left_semi")).select("source", "target", "weight")


@query("quantiles_ties", "SELECT event_type, round(quantile_cont(v, 0.1), 4) AS q10, round(quantile_cont(v, 0.5), 4) AS q50, round(quantile_cont(v, 0.9), 4) AS q90 FROM (SELECT event_type, CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE value END AS v FROM events) GROUP BY 1")
def _(spark, d):
    rows = table(spark, d, "events").select("event_type", F.when(F.col("event_id") % 3 == 0, 1.0).otherwise(F.col("value")).alias("v"))
    return rounded(stats.quantiles(rows, "v", (0.1, 0.5, 0.9), ["event_type"]), 4, "q10", "q50", "q90")


@query("vector_hints", "SELECT vec_id, round(n, 5) AS norm, abs(n - 1) <= 1e-4 AS is_normalized FROM (SELECT vec_id, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)")
def _(spark, d):
    return table(spark, d, "embeddings").select("vec_id", V.hints("embedding").alias("h")).select("vec_id", F.round("h.norm", 5).alias("norm"), "h.is_normalized")
