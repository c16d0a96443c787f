"""Queries of searches and distance matrices beyond the plain ones, and their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from veclume.functions import quant as Q
from veclume.functions import vector as V
from veclume.operators import batch, graph, kmeans, learned, topk
from veclume.plans.blocked import knn, most_similar, pairwise
from veclume.registry import BEST_SQL, CENTROID_SQL, DIM, DISTANCES, METRIC_SQL, PAIRS_SQL, add, label_centroids, pairs, query, rounded, search_sql, table, vectors

# -- ties: every vector 25 times -----------------------------------------------------

COPIES = 25
MANY_SQL = f"(SELECT vec_id + 1000000 * c AS vec_id, embedding, label FROM embeddings, (SELECT unnest(range(0, {COPIES})) AS c))"


def _many(spark, d):
    e, q = vectors(spark, d)
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(COPIES - 1).cast("long")))
    return e.select("vec_id", "embedding", copies.alias("c")).select((F.col("vec_id") + 1000000 * F.col("c")).alias("vec_id"), "embedding"), q


for _m, _n in (("euclidean", "knn_ties"), ("hamming", "knn_hamming_ties")):
    add(_n, lambda s, d, m=_m: rounded(knn(*_many(s, d), 40, m), 4, "distance"), search_sql(METRIC_SQL[_m] + ("::DOUBLE" if _m == "hamming" else ""), k=40).replace("embeddings b WHERE", f"{MANY_SQL} b WHERE"))

# -- more metrics ----------------------------------------------------------------------


def _absolute(spark, d):
    e, q = vectors(spark, d)
    size = F.transform("embedding", F.abs).alias("embedding")
    return e.select("vec_id", size), q.select("vec_id", size)


RUZICKA, P3 = DISTANCES["ruzicka"][1], DISTANCES["minkowski_p3"][1]
add("knn_jaccard", lambda s, d: rounded(knn(*_absolute(s, d), 10, "jaccard"), 4, "distance"), search_sql(RUZICKA))
add("knn_minkowski", lambda s, d: rounded(knn(*vectors(s, d), 10, "minkowski:3"), 4, "distance"), search_sql(P3))
add("most_similar", lambda s, d: rounded(most_similar(*_absolute(s, d), 5), 4, "similarity"), search_sql(RUZICKA, k=5).replace("round(d, 4) AS distance", "round(1 - d, 4) AS similarity"))


@query("custom_metric", search_sql(DISTANCES["manhattan_weighted"][1]))
def _(spark, d):
    w = np.arange(1, DIM + 1) / DIM
    return rounded(knn(*vectors(spark, d), 10, lambda x, y: (np.abs(x - y) * w).sum(axis=1)), 4, "distance")


WORDS_SQL = "list_transform(range(0, 2), lambda w: list_sum(list_transform(range(1, 33), lambda i: CASE WHEN embedding[w * 32 + i] > 0 THEN 1::BIGINT << (i - 1) ELSE 0 END))::BIGINT)"


@query("packed_hamming_search", search_sql("(bit_count(xor(va[1], vb[1])) + bit_count(xor(va[2], vb[2])))::DOUBLE").replace("q.embedding::DOUBLE[] AS va, b.embedding::DOUBLE[] AS vb", "q.w AS va, b.w AS vb").replace("FROM embeddings q, embeddings b", f"FROM (SELECT vec_id, label, {WORDS_SQL} AS w FROM embeddings) q, (SELECT vec_id, label, {WORDS_SQL} AS w FROM embeddings) b"))
def _(spark, d):
    coded = table(spark, d, "embeddings").select("vec_id", Q.binarize("embedding").alias("embedding"))
    return rounded(knn(coded, coded.where(F.col("vec_id") % 20 == 0), 10, "packed"), 4, "distance")


# -- distance matrices, in long form ------------------------------------------------------


def matrix_sql(dist: str) -> str:
    return f"SELECT query_id, id, round(({dist})::DOUBLE, 4) AS distance FROM (SELECT q.vec_id AS query_id, b.vec_id AS id, q.embedding::DOUBLE[] AS va, b.embedding::DOUBLE[] AS vb FROM embeddings q, embeddings b WHERE q.vec_id % 20 = 0)"


for _m, _n, _d in (
    ("euclidean", "matrix_l2_squared", METRIC_SQL["euclidean"]), ("cosine", "matrix_cosine", METRIC_SQL["cosine"]), ("dot", "matrix_dot", METRIC_SQL["dot"]), ("manhattan", "matrix_manhattan", METRIC_SQL["manhattan"]),
    ("chebyshev", "matrix_chebyshev", METRIC_SQL["chebyshev"]), ("minkowski:3", "matrix_minkowski", P3), ("hamming", "matrix_hamming", METRIC_SQL["hamming"]),
):
    add(_n, lambda s, d, m=_m: rounded(pairwise(*vectors(s, d), m), 4, "distance"), matrix_sql(_d))
add("matrix_jaccard", lambda s, d: rounded(pairwise(*_absolute(s, d), "jaccard"), 4, "distance"), matrix_sql(RUZICKA))


@query("one_to_many", matrix_sql(f"sqrt({METRIC_SQL['euclidean']})").replace("q.vec_id % 20 = 0", "q.vec_id = 40").replace("query_id, id, round", "id, round"))
def _(spark, d):
    e, _ = vectors(spark, d)
    found = pairwise(e, e.where("vec_id = 40"))
    return found.select("id", F.round(F.sqrt("distance"), 4).alias("distance"))


CORES_SQL = "SELECT i AS id, sqrt(d) AS core FROM (SELECT a.vec_id AS i, list_sum(list_transform(range(1, 65), lambda k: (a.embedding[k]::DOUBLE - b.embedding[k]::DOUBLE) ** 2)) AS d, b.vec_id AS j FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id) QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) = 5"
L2_AB = "sqrt(list_sum(list_transform(range(1, 65), lambda k: (a.embedding[k]::DOUBLE - b.embedding[k]::DOUBLE) ** 2)))"


@query("dense_reachability", f"WITH core AS MATERIALIZED ({CORES_SQL}) SELECT a.vec_id AS i, b.vec_id AS j, round(CASE WHEN a.vec_id = b.vec_id THEN 0 ELSE greatest(ca.core, cb.core, {L2_AB}) END, 4) AS d FROM embeddings a, embeddings b, core ca, core cb WHERE ca.id = a.vec_id AND cb.id = b.vec_id AND a.vec_id % 20 = 0")
def _(spark, d):
    e, q = vectors(spark, d)
    return rounded(graph.dense_reachability(e, graph.core_distances(e, 5), q), 4, "d")


# Prim's algorithm on lists: of each point the least edge (weight, ends) to the tree; equal weights go by the ends.
TREE_SQL = f"""WITH RECURSIVE core AS MATERIALIZED ({CORES_SQL}),
 p AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id) AS k FROM embeddings JOIN core ON core.id = vec_id),
 m AS MATERIALIZED (SELECT a.k, list({{'w': greatest(a.core, b.core, {L2_AB}), 's': least(a.vec_id, b.vec_id), 't': greatest(a.vec_id, b.vec_id)}} ORDER BY b.k) AS r FROM p a, p b GROUP BY a.k),
 n AS (SELECT count(*) AS n FROM p),
 tree AS (SELECT 1 AS step, 1::BIGINT AS at, NULL::STRUCT(w DOUBLE, s BIGINT, t BIGINT) AS e, r AS best, list_transform(range(1, n + 1), lambda i: i = 1) AS held FROM m, n WHERE k = 1
  UNION ALL SELECT step + 1, c.at, c.e, list_transform(range(1, n + 1), lambda i: least(best[i], r[i])), list_transform(range(1, n + 1), lambda i: held[i] OR i = c.at)
  FROM (SELECT step, best, held, n, list_position(edges, list_min(edges)) AS at, list_min(edges) AS e FROM (SELECT *, list_transform(range(1, n + 1), lambda i: CASE WHEN held[i] THEN {{'w': 'inf'::DOUBLE, 's': 0::BIGINT, 't': 0::BIGINT}} ELSE best[i] END) AS edges FROM tree, n WHERE step < n)) c JOIN m ON m.k = c.at)
SELECT e.s AS source, e.t AS target, round(e.w, 4) AS weight FROM tree WHERE step > 1"""


@query("boruvka_mst", TREE_SQL)
def _(spark, d):
    return rounded(graph.hdbscan_tree(vectors(spark, d)[0], 5), 4, "weight")


# -- inverted lists over codes: lists by the labels' means ------------------------------------


def _lists_sql(decoded: str) -> str:
    return f"""WITH c AS ({CENTROID_SQL}), lists AS (SELECT vec_id, cluster FROM ({BEST_SQL})),
 range AS (SELECT min(list_min(embedding))::DOUBLE AS lo, max(list_max(embedding))::DOUBLE AS hi FROM embeddings),
 coded AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: {decoded}) AS v FROM embeddings, range),
 probes AS (SELECT q.vec_id AS query_id, c.label AS cluster FROM embeddings q, c WHERE q.vec_id % 20 = 0
  QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_sum(list_transform(range(1, 65), lambda i: (q.embedding[i]::DOUBLE - c.c[i]) ** 2)), c.label) <= 3),
 found AS (SELECT query_id, b.vec_id AS id, list_sum(list_transform(range(1, 65), lambda i: (q.embedding[i]::DOUBLE - b.v[i]) ** 2)) AS d
  FROM probes JOIN lists USING (cluster) JOIN coded b ON b.vec_id = lists.vec_id JOIN embeddings q ON q.vec_id = query_id)
SELECT query_id, row_number() OVER w AS rank, id, round(d, 3) AS distance FROM found WINDOW w AS (PARTITION BY query_id ORDER BY d, id) QUALIFY row_number() OVER w <= 10"""


def _symmetric_sql(bits: int) -> str:
    low, high = -(1 << (bits - 1)), (1 << (bits - 1)) - 1
    s = f"greatest(greatest(abs(lo), abs(hi)) / {high}, 1e-8)"
    return f"greatest({low}, least({high}, round_even(x / {s}, 0))) * {s}"


_S = "greatest((hi - lo) / 255, 1e-8)"
_Z = f"(-128 - round_even(lo / {_S}, 0))"
for _n, _bits, _sym, _sql in (("ivf_lists_sq8", 8, True, _symmetric_sql(8)), ("ivf_lists_sq4", 4, True, _symmetric_sql(4)), ("ivf_lists_sq8_asymmetric", 8, False, f"(greatest(-128, least(127, round_even(x / {_S}, 0) + {_Z})) - {_Z}) * {_S}")):

    def _lists(spark, d, bits=_bits, sym=_sym):
        e, q = vectors(spark, d)
        _, c = label_centroids(spark, d)
        coded, scale, zero = Q.global_codes(e, "embedding", bits, sym)
        return rounded(kmeans.ivf_search(kmeans.assign(coded, c).drop("distance"), c, q, 10, 3, vec="q", query_vec="embedding", codes=(scale, zero)), 3, "distance")

    add(_n, _lists, _lists_sql(_sql))

# -- learned distances with a fallback, attention ------------------------------------------------


def _weights_sql(w: np.ndarray) -> str:
    return f"'{w.tolist()}'::DOUBLE[][]"


def _projected_sql(w: np.ndarray, a: str = "va") -> str:
    return f"list_transform({_weights_sql(w)}, lambda r: list_dot_product(r, {a}))"


W16 = learned.xavier(16, DIM, 5)
P_SQL = f"(SELECT id_a, va, vb, {_projected_sql(W16)} AS pa, {_projected_sql(W16, 'vb')} AS pb {PAIRS_SQL})"
L2_P = "sqrt(list_sum(list_transform(range(1, len(pa) + 1), lambda i: (pa[i] - pb[i]) ** 2)))"
COSINE_P = "1 - greatest(-1, least(1, list_dot_product(pa, pb) / (sqrt(list_dot_product(pa, pa)) * sqrt(list_dot_product(pb, pb)))))"
HEADS_P = "(list_dot_product(list_slice(pa, 1, 8), list_slice(pb, 1, 8)) + list_dot_product(list_slice(pa, 9, 16), list_slice(pb, 9, 16))) / sqrt(8) / 2"


def _projected(spark, d):
    return learned.project(learned.project(pairs(spark, d).select("id_a", "va", "vb"), W16, "va", "pa"), W16, "vb", "pb")


add("learned_l2", lambda s, d: _projected(s, d).select("id_a", F.round(learned.learned_distance("pa", "pb"), 5).alias("d")), f"SELECT id_a, round({L2_P}, 5) AS d FROM {P_SQL}")
add("learned_cosine", lambda s, d: _projected(s, d).select("id_a", F.round(learned.learned_distance("pa", "pb", "cosine"), 6).alias("d")), f"SELECT id_a, round({COSINE_P}, 6) AS d FROM {P_SQL}")
add("attention_similarity", lambda s, d: _projected(s, d).select("id_a", F.round(learned.attention("pa", "pb", 2, 8), 5).alias("score")), f"SELECT id_a, round({HEADS_P}, 5) AS score FROM {P_SQL}")


@query("learned_service", f"SELECT id_a, mode, round(distance, 5) AS distance FROM (SELECT id_a, 'learned' AS mode, {L2_P} AS distance FROM {P_SQL} UNION ALL SELECT id_a, 'standard', {DISTANCES['l2'][1]} {PAIRS_SQL})")
def _(spark, d):
    p = pairs(spark, d).select("id_a", "va", "vb")
    both = [learned.distance(p, "va", "vb", w).select("id_a", "mode", F.round("distance", 5).alias("distance")) for w in (W16, None)]
    return both[0].unionByName(both[1])


def _learned_sql(dist: str, order: str, places: int, k: int, name: str) -> str:
    return f"SELECT query_id, row_number() OVER w AS rank, id, round({name}, {places}) AS {name} FROM (SELECT query_id, id, {dist} AS {name} FROM (SELECT q.vec_id AS query_id, b.vec_id AS id, q.p AS pa, b.p AS pb FROM (SELECT vec_id, {_projected_sql(W16, 'embedding::DOUBLE[]')} AS p FROM embeddings WHERE vec_id % 20 = 0) q, (SELECT vec_id, {_projected_sql(W16, 'embedding::DOUBLE[]')} AS p FROM embeddings) b)) WINDOW w AS (PARTITION BY query_id ORDER BY {name} {order}, id) QUALIFY row_number() OVER w <= {k}"


add("learned_search", lambda s, d: rounded(learned.search(*vectors(s, d), 5, W16), 4, "distance"), _learned_sql("list_sum(list_transform(range(1, 17), lambda i: (pa[i] - pb[i]) ** 2))", "", 4, 5, "distance"))
add("attention_topk", lambda s, d: rounded(learned.attention_topk(*vectors(s, d), 5, W16, W16, 2), 4, "score"), _learned_sql(HEADS_P, "DESC", 4, 5, "score"))
SIGMOIDS_P = " + ".join(f"1 / (1 + exp(-list_dot_product(list_slice(pa, {a}, {b}), list_slice(pb, {a}, {b})) / sqrt(8)))" for a, b in ((1, 8), (9, 16)))
add("attention_topk_sigmoid", lambda s, d: rounded(learned.attention_topk(*vectors(s, d), 5, W16, W16, 2, sigmoid=True), 5, "score"), _learned_sql(f"({SIGMOIDS_P}) / 2", "DESC", 5, 5, "score"))

# -- names, hooks ------------------------------------------------------------------------------------

NAMED = {"euclidean": METRIC_SQL["euclidean"], "cosine": METRIC_SQL["cosine"], "dot": METRIC_SQL["dot"], "manhattan": METRIC_SQL["manhattan"], "chebyshev": METRIC_SQL["chebyshev"], "hamming": METRIC_SQL["hamming"], "minkowski": P3}


@query("distance_by_name", " UNION ALL ".join(f"SELECT id_a, '{m}' AS metric, round(({q})::DOUBLE, 4) AS d {PAIRS_SQL}" for m, q in NAMED.items()))
def _(spark, d):
    p = pairs(spark, d)
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.round(V.distance("va", "vb", m, 3.0).cast("double"), 4).alias("d")) for m in NAMED]))
    return p.select("id_a", each.alias("x")).select("id_a", "x.*")


@query("cosine_normalized", f"SELECT id_a, round(greatest(-1, least(1, {DISTANCES['dot_product'][1].replace('va[i] * vb[i]', 'va[i] / na * vb[i] / nb')})), 6) AS s FROM (SELECT *, sqrt(list_dot_product(va, va)) AS na, sqrt(list_dot_product(vb, vb)) AS nb {PAIRS_SQL})")
def _(spark, d):
    p = pairs(spark, d).select("id_a", V.l2_normalize("va").alias("a"), V.l2_normalize("vb").alias("b"))
    return p.select("id_a", F.round(V.cosine_similarity("a", "b", normalized=True), 6).alias("s"))


@query("apply_function", "SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x * x - 2 * x)), 3) AS total FROM embeddings")
def _(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", batch.apply_function(V.doubles("embedding"), lambda x: x * x * x - 2 * x).alias("v"))
    return e.select("vec_id", F.round(V.vsum("v"), 3).alias("total"))


def _sums(b):
    import pyarrow as pa

    x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(b), -1)
    return pa.RecordBatch.from_arrays([b.column(0), pa.array(np.round(x.sum(axis=1), 3) + 0.0)], ["vec_id", "total"])


BATCH_SQL = "SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 3) AS total FROM embeddings"
add("batch_process", lambda s, d: batch.process(table(s, d, "embeddings").select("vec_id", "embedding"), _sums, "vec_id long, total double"), BATCH_SQL)


@query("batch_strategies", " UNION ALL ".join(f"SELECT '{k}' AS strategy, vec_id, total FROM ({BATCH_SQL})" for k in ("sequential", "parallel", "streaming")))
def _(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    n = e.count()
    plans = [batch.choose_strategy(50, 4 * DIM, 8), batch.choose_strategy(n + batch.SMALL, 4 * DIM, 8), batch.choose_strategy(n, 4 * DIM, 8, memory_limit=100 * 4 * DIM)]
    parts = [batch.process_with(e, _sums, "vec_id long, total double", p).select(F.lit(p.kind).alias("strategy"), "vec_id", "total") for p in plans]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("argmax", "SELECT max(o_totalprice) AS v, min(o_orderkey) AS i FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)")
def _(spark, d):
    return topk.argmax(table(spark, d, "orders"), "o_totalprice", "o_orderkey")
