"""Queries of the library's operators over the given tables, and their DuckDB SQL.

Each query takes (spark, sf_dir). Searches take every vector whose id is
divisible by 20 as a query, against all vectors. Floats are rounded on both
sides, since sums may run in another order.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veclume.functions import quant as Q
from veclume.functions import vector as V
from veclume.operators import batch, graph, hist, kmeans, quantstats, stats, text, topk, umap
from veclume.operators import matrix as M
from veclume.plans.blocked import knn, within
from veclume.storage import kept

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
DIM = 64
RADIUS = 40.0


def add(name: str, make: Query, sql: str | None = None) -> None:
    _QUERIES[name] = make
    if sql is not None:
        _SQL[name] = sql


def query(name: str, sql: str | None = None):
    def put(make: Query) -> Query:
        add(name, make, sql)
        return make

    return put


def queries() -> dict[str, Query]:
    from veclume import registry_index, registry_models, registry_search  # noqa: F401  they add theirs

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int, *names: str) -> DataFrame:
    return df.select(*[F.round(F.col(c).cast("double"), places).alias(c) if c in names else F.col(c) for c in df.columns])


# -- distances of neighbouring vectors (id, id + 1): an equi-join ---------------


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    a = e.select(F.col("vec_id").alias("id_a"), F.col("embedding").alias("va"), F.col("label").alias("label_a"))
    b = e.select((F.col("vec_id") - 1).alias("id_a"), F.col("embedding").alias("vb"))
    return a.join(b, "id_a")


PAIRS_SQL = "FROM (SELECT a.vec_id AS id_a, a.embedding::DOUBLE[] AS va, b.embedding::DOUBLE[] AS vb FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


def each(expr: str) -> str:
    return f"list_transform(range(1, len(va) + 1), lambda i: {expr})"


def vsum(expr: str) -> str:
    return f"list_sum({each(expr)})"


def weights() -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(DIM)), lambda i: i / float(DIM))


def absolute() -> tuple[Column, Column]:
    return F.transform(F.col("va"), F.abs), F.transform(F.col("vb"), F.abs)


NORM = f"(sqrt({vsum('va[i] * va[i]')}) * sqrt({vsum('vb[i] * vb[i]')}))"
DISTANCES: dict[str, tuple[Callable[[], Column], str]] = {
    "l2": (lambda: V.l2("va", "vb"), f"sqrt({vsum('(va[i] - vb[i]) ** 2')})"),
    "l2_squared": (lambda: V.l2_squared("va", "vb"), vsum("(va[i] - vb[i]) ** 2")),
    "cosine_distance": (lambda: V.cosine_distance("va", "vb"), f"1 - greatest(-1, least(1, CASE WHEN {NORM} > 1.17549435e-38 THEN {vsum('va[i] * vb[i]')} / {NORM} ELSE 0 END))"),
    "dot_product": (lambda: V.dot("va", "vb"), vsum("va[i] * vb[i]")),
    "dot_absolute": (lambda: V.dot("va", "vb", absolute=True), f"abs({vsum('va[i] * vb[i]')})"),
    "manhattan": (lambda: V.manhattan("va", "vb"), vsum("abs(va[i] - vb[i])")),
    "manhattan_weighted": (lambda: V.manhattan("va", "vb", weights()), vsum("abs(va[i] - vb[i]) * (i / 64.0)")),
    "manhattan_mean": (lambda: V.manhattan_mean("va", "vb"), f"{vsum('abs(va[i] - vb[i])')} / len(va)"),
    "chebyshev": (lambda: V.chebyshev("va", "vb"), f"list_max({each('abs(va[i] - vb[i])')})"),
    "chebyshev_capped": (lambda: V.chebyshev("va", "vb", cap=2.0), f"least(2.0, list_max({each('abs(va[i] - vb[i])')}))"),
    "chebyshev_weighted": (lambda: V.chebyshev("va", "vb", weights=weights()), f"list_max({each('abs(va[i] - vb[i]) * (i / 64.0)')})"),
    "chebyshev_range_normalized": (lambda: V.chebyshev("va", "vb", ranges=weights()), f"list_max({each('abs(va[i] - vb[i]) / (i / 64.0)')})"),
    "minkowski_p3": (lambda: V.minkowski("va", "vb", 3.0), f"{vsum('abs(va[i] - vb[i]) ** 3')} ** (1 / 3.0::DOUBLE)"),
    "minkowski_fractional": (lambda: V.minkowski("va", "vb", 0.5) / 1000, f"{vsum('abs(va[i] - vb[i]) ** 0.5::DOUBLE')} ** 2.0 / 1000"),
    "minkowski_large_p": (lambda: V.minkowski("va", "vb", 40.0), f"list_max({each('abs(va[i] - vb[i])')})"),
    "hamming_threshold": (lambda: V.hamming("va", "vb"), vsum("((va[i] > 0) != (vb[i] > 0))::INT")),
    "hamming_normalized": (lambda: V.hamming("va", "vb", normalized=True), f"{vsum('((va[i] > 0) != (vb[i] > 0))::INT')} / 64.0"),
    "hamming_packed": (lambda: V.hamming_words(Q.binarize("va"), Q.binarize("vb")), vsum("((va[i] > 0) != (vb[i] > 0))::INT")),
    "ruzicka": (lambda: V.ruzicka(*absolute()), f"1 - {vsum('least(abs(va[i]), abs(vb[i]))')} / {vsum('greatest(abs(va[i]), abs(vb[i]))')}"),
    "binary_jaccard": (lambda: V.binary_jaccard("va", "vb"), f"1 - {vsum('(va[i] > 0 AND vb[i] > 0)::INT')} / {vsum('(va[i] > 0 OR vb[i] > 0)::INT')}"),
}
for _name, (_d, _sql) in DISTANCES.items():
    add(_name, lambda s, d, e=_d: pairs(s, d).select("id_a", F.round(e().cast("double"), 4).alias("d")), f"SELECT id_a, round(({_sql})::DOUBLE, 4) AS d {PAIRS_SQL}")

# -- element by element, normalisation, softmax: sum and an element of the result ----


def digest(v: Column) -> list[Column]:
    return [F.round(V.vsum(v), 4).alias("total"), F.round(F.element_at(v, 7), 4).alias("seventh")]


def digest_sql(expr: str) -> str:
    return f"SELECT id_a, round({vsum(expr)}, 4) AS total, round(list_extract({each(expr)}, 7)::DOUBLE, 4) AS seventh {PAIRS_SQL}"


def positive() -> Column:
    return F.transform("va", lambda x: F.abs(x) + 0.5)


ELEMENTS: dict[str, tuple[Callable[[], Column], str]] = {
    "elementwise_add": (lambda: V.elementwise("va", "add", F.col("vb")), "va[i] + vb[i]"),
    "elementwise_subtract": (lambda: V.elementwise("va", "subtract", F.col("vb")), "va[i] - vb[i]"),
    "elementwise_multiply": (lambda: V.elementwise("va", "multiply", F.col("vb")), "va[i] * vb[i]"),
    "elementwise_divide": (lambda: V.elementwise("va", "divide", F.transform("vb", lambda x: F.abs(x) + 0.5)), "va[i] / (abs(vb[i]) + 0.5)"),
    "elementwise_power": (lambda: V.elementwise(positive(), "power", 1.5), "(abs(va[i]) + 0.5) ** 1.5::DOUBLE"),
    "elementwise_maximum": (lambda: V.elementwise("va", "maximum", F.col("vb")), "greatest(va[i], vb[i])"),
    "elementwise_minimum": (lambda: V.elementwise("va", "minimum", F.col("vb")), "least(va[i], vb[i])"),
    "elementwise_add_scalar": (lambda: V.elementwise("va", "add", 2.5), "va[i] + 2.5"),
    "elementwise_multiply_scalar": (lambda: V.elementwise("va", "multiply", -1.5), "va[i] * -1.5"),
    "elementwise_clamp": (lambda: V.clamp("va", -0.5, 0.5), "greatest(-0.5, least(0.5, va[i]))"),
    "elementwise_abs": (lambda: V.elementwise("va", "abs"), "abs(va[i])"),
    "elementwise_square": (lambda: V.elementwise("va", "square"), "va[i] * va[i]"),
    "elementwise_sqrt": (lambda: V.elementwise(positive(), "sqrt"), "sqrt(abs(va[i]) + 0.5)"),
    "elementwise_reciprocal": (lambda: V.elementwise(positive(), "reciprocal"), "1 / (abs(va[i]) + 0.5)"),
    "elementwise_negate": (lambda: V.elementwise("va", "negate"), "-va[i]"),
    "elementwise_exp": (lambda: V.elementwise(V.clamp("va", -3, 3), "exp"), "exp(greatest(-3, least(3, va[i])))"),
    "elementwise_log": (lambda: V.elementwise(positive(), "log"), "ln(abs(va[i]) + 0.5)"),
    "elementwise_sin": (lambda: V.elementwise("va", "sin"), "sin(va[i])"),
    "elementwise_cos": (lambda: V.elementwise("va", "cos"), "cos(va[i])"),
    "activation_relu": (lambda: V.elementwise("va", "relu"), "greatest(0, va[i])"),
    "activation_tanh": (lambda: V.elementwise("va", "tanh"), "tanh(va[i])"),
    "activation_sigmoid": (lambda: V.elementwise("va", "sigmoid"), "1 / (1 + exp(-va[i]))"),
    "activation_gelu": (lambda: V.elementwise("va", "gelu"), "0.5 * va[i] * (1 + tanh(0.7978845608028654 * (va[i] + 0.044715 * va[i] * va[i] * va[i])))"),
    "vector_scale": (lambda: V.scale("va", 3.0), "va[i] * 3.0"),
    "l2_normalize": (lambda: V.l2_normalize("va"), f"va[i] / sqrt({vsum('va[i] * va[i]').replace('[i]', '[j]').replace('lambda i', 'lambda j')})"),
    "fast_normalize": (lambda: V.fast_normalize("va"), f"va[i] / sqrt({vsum('va[i] * va[i]').replace('[i]', '[j]').replace('lambda i', 'lambda j')} + 1e-8)"),
    "row_softmax": (lambda: V.row_softmax("va"), f"exp(va[i] - list_max(va)) / {vsum('exp(va[j] - list_max(va))').replace('lambda i', 'lambda j')}"),
}
for _name, (_d, _sql) in ELEMENTS.items():
    add(_name, lambda s, d, e=_d: pairs(s, d).select("id_a", *digest(e())), digest_sql(_sql))

add("strided", lambda s, d: pairs(s, d).select("id_a", F.round(V.vsum(V.strided(V.doubles("va"), 4, 1)), 4).alias("total")), f"SELECT id_a, round({vsum('CASE WHEN (i - 2) % 4 = 0 THEN va[i] ELSE 0 END')}, 4) AS total {PAIRS_SQL}")
add("vector_norm", lambda s, d: pairs(s, d).select("id_a", F.round(V.norm("va"), 4).alias("norm"), V.hints("va")["is_normalized"].alias("is_normalized")), f"SELECT id_a, round(sqrt({vsum('va[i] * va[i]')}), 4) AS norm, abs(sqrt({vsum('va[i] * va[i]')}) - 1) <= 1e-4 AS is_normalized {PAIRS_SQL}")
add("row_logsumexp", lambda s, d: pairs(s, d).select("id_a", F.round(V.row_logsumexp("va"), 4).alias("lse")), f"SELECT id_a, round(list_max(va) + ln({vsum('exp(va[i] - list_max(va))')}), 4) AS lse {PAIRS_SQL}")
add("array_topk", lambda s, d: pairs(s, d).select("id_a", F.posexplode(V.array_topk("va", 3)).alias("rank", "t")).select("id_a", F.col("rank").cast("long").alias("rank"), F.col("t.index").cast("long").alias("index"), F.round("t.value", 4).alias("value")), "SELECT vec_id AS id_a, row_number() OVER w - 1 AS rank, i - 1 AS index, round(embedding[i]::DOUBLE, 4) AS value FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings WHERE vec_id + 1 IN (SELECT vec_id FROM embeddings)) WINDOW w AS (PARTITION BY vec_id ORDER BY embedding[i]::DOUBLE, i) QUALIFY row_number() OVER w <= 3")


@query("batch_max3", "SELECT l_orderkey, l_linenumber, greatest(l_quantity, l_discount * 1000, l_tax * 1000) AS m FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", V.batch_max("l_quantity", F.col("l_discount") * 1000, F.col("l_tax") * 1000).alias("m"))


# -- searches: queries are the ids divisible by 20 -----------------------------------


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return e, e.where(F.col("vec_id") % 20 == 0)


def search_sql(dist: str, where: str = "true", k: int = 10, extra: str = "", places: int = 4) -> str:
    return f"SELECT query_id, row_number() OVER w AS rank, id, round(d, {places}) AS distance FROM (SELECT query_id, id, {dist} AS d FROM (SELECT q.vec_id AS query_id, b.vec_id AS id, q.embedding::DOUBLE[] AS va, b.embedding::DOUBLE[] AS vb, b.label AS label FROM embeddings q, embeddings b WHERE q.vec_id % 20 = 0 {extra}) WHERE {where}) WINDOW w AS (PARTITION BY query_id ORDER BY d, id) QUALIFY row_number() OVER w <= {k}"


METRIC_SQL = {
    "euclidean": DISTANCES["l2_squared"][1], "cosine": DISTANCES["cosine_distance"][1], "dot": f"-({DISTANCES['dot_product'][1]})",
    "manhattan": DISTANCES["manhattan"][1], "chebyshev": DISTANCES["chebyshev"][1], "hamming": DISTANCES["hamming_threshold"][1],
}
for _m, _n in (("euclidean", "knn_flat"), ("cosine", "knn_cosine"), ("dot", "knn_dot"), ("manhattan", "knn_manhattan"), ("chebyshev", "knn_chebyshev"), ("hamming", "knn_hamming")):
    add(_n, lambda s, d, m=_m: rounded(knn(*vectors(s, d), 10, m), 4, "distance"), search_sql(METRIC_SQL[_m] + ("::DOUBLE" if _m == "hamming" else "")))


@query("knn_filtered", search_sql(METRIC_SQL["euclidean"], "label < 3", 10))
def _(spark, d):
    e, q = vectors(spark, d)
    return rounded(knn(e, q, 10, where=F.col("label") < 3), 4, "distance")


@query("knn_excluding_self", search_sql(METRIC_SQL["euclidean"], extra="AND q.vec_id <> b.vec_id"))
def _(spark, d):
    e, q = vectors(spark, d)
    return rounded(knn(e, q, 10, exclude_self=True), 4, "distance")


@query("range_join", f"SELECT query_id, id, round(distance, 4) AS distance FROM (SELECT q.vec_id AS query_id, b.vec_id AS id, {DISTANCES['manhattan'][1].replace('va', 'q.embedding').replace('vb', 'b.embedding').replace('q.embedding[i]', 'q.embedding[i]::DOUBLE').replace('b.embedding[i]', 'b.embedding[i]::DOUBLE')} AS distance FROM embeddings q, embeddings b WHERE q.vec_id % 20 = 0) WHERE distance <= {RADIUS}")
def _(spark, d):
    return rounded(within(*vectors(spark, d), RADIUS, "manhattan"), 4, "distance")


@query("topk_merge", search_sql(METRIC_SQL["euclidean"]))
def _(spark, d):
    e, q = vectors(spark, d)
    halves = [knn(e, q, 10, where=F.col("label") % 2 == r) for r in (0, 1)]
    return rounded(topk.merge(halves, "query_id", ["distance", "id"], 10).select("query_id", "rank", "id", "distance"), 4, "distance")


def _means(by: str = "label") -> str:
    return f"SELECT {by}, i, avg(embedding[i]::DOUBLE) AS m FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY ALL"


CENTROID_SQL = f"SELECT label, list(m ORDER BY i) AS c FROM ({_means()}) GROUP BY label"


def label_centroids(spark: SparkSession, sf_dir: str) -> tuple[list[int], np.ndarray]:
    rows = kmeans.means(table(spark, sf_dir, "embeddings"), "label").select("label", "i", F.col("mean").alias("m")).orderBy("label", "i").collect()  # a row a list and dimension
    labels = sorted({r.label for r in rows})
    return labels, np.array([r.m for r in rows]).reshape(len(labels), -1)


@query("centroid_means_by_label", f"SELECT label, i - 1 AS i, round(m, 4) AS m FROM ({_means()})")
def _(spark, d):
    return kmeans.means(table(spark, d, "embeddings"), "label").select("label", F.col("i").cast("long").alias("i"), F.round("mean", 4).alias("m"))


ASSIGN_SQL = f"SELECT vec_id, label AS own, c.label AS cluster, list_sum(list_transform(range(1, 65), lambda i: (e.embedding[i]::DOUBLE - c.c[i]) ** 2)) AS d FROM embeddings e, ({CENTROID_SQL}) c".replace("label AS own", "e.label AS own")
BEST_SQL = f"SELECT * FROM ({ASSIGN_SQL}) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster) = 1"


@query("assign_nearest_centroid", f"SELECT vec_id, cluster::INT AS cluster_id, round(d, 4) AS distance FROM ({BEST_SQL})")
def _(spark, d):
    labels, c = label_centroids(spark, d)
    out = kmeans.assign(vectors(spark, d)[0].select("vec_id", "embedding"), c)
    return rounded(out.select("vec_id", F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("cluster_id") + 1).alias("cluster_id"), "distance"), 4, "distance")


@query("inertia", f"SELECT cluster::INT AS cluster_id, count(*) AS n, round(sum(d), 3) AS inertia FROM ({BEST_SQL}) GROUP BY 1")
def _(spark, d):
    labels, c = label_centroids(spark, d)
    out = kmeans.assign(vectors(spark, d)[0].select("vec_id", "embedding"), c)
    g = out.groupBy("cluster_id").agg(F.count("*").alias("n"), F.sum("distance").alias("inertia"))
    return g.select(F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("cluster_id") + 1).alias("cluster_id"), "n", F.round("inertia", 3).alias("inertia"))


PROBE_SQL = f"""WITH c AS ({CENTROID_SQL}), lists AS (SELECT vec_id, cluster FROM ({BEST_SQL})),
 probes AS (SELECT q.vec_id AS query_id, c.label AS cluster FROM embeddings q, c WHERE q.vec_id % 20 = 0
  QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_sum(list_transform(range(1, 65), lambda i: (q.embedding[i]::DOUBLE - c.c[i]) ** 2)), c.label) <= 3),
 found AS (SELECT query_id, b.vec_id AS id, list_sum(list_transform(range(1, 65), lambda i: (q.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) ** 2)) AS d
  FROM probes JOIN lists USING (cluster) JOIN embeddings b ON b.vec_id = lists.vec_id JOIN embeddings q ON q.vec_id = query_id)
SELECT query_id, row_number() OVER w AS rank, id, round(d, 4) AS distance FROM found WINDOW w AS (PARTITION BY query_id ORDER BY d, id) QUALIFY row_number() OVER w <= 10"""


def _probed(spark: SparkSession, d: str, nprobe: int) -> DataFrame:
    e, q = vectors(spark, d)
    _, c = label_centroids(spark, d)
    return kmeans.ivf_search(kmeans.assign(e, c), c, q, 10, nprobe)


add("ivf_probe_search", lambda s, d: rounded(_probed(s, d, 3), 4, "distance"), PROBE_SQL)


@query("recall_at_k", f"WITH t AS ({search_sql(METRIC_SQL['euclidean'], places=9)}), f AS ({PROBE_SQL}), e AS (SELECT t.query_id, count(f.id) / count(*) AS r FROM t LEFT JOIN f ON t.query_id = f.query_id AND t.id = f.id GROUP BY 1) SELECT round(avg(r), 6) AS recall, count(*) AS queries FROM e")
def _(spark, d):
    return rounded(topk.recall(_probed(spark, d, 3), knn(*vectors(spark, d), 10)), 6, "recall")


@query("point_lookup", "SELECT vec_id, label, embedding[1]::DOUBLE AS first FROM embeddings WHERE vec_id IN (0, 7, 13, 499, 123456)")
def _(spark, d):
    e = table(spark, d, "embeddings").where(F.col("vec_id").isin(0, 7, 13, 499, 123456))
    return e.select("vec_id", "label", F.element_at("embedding", 1).cast("double").alias("first"))


@query("tombstone_filter", "SELECT vec_id, label FROM embeddings e WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = e.vec_id AND l.toxic = 1)")
def _(spark, d):
    gone = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("vec_id"))
    return table(spark, d, "embeddings").select("vec_id", "label").join(gone, "vec_id", "left_anti")


@query("existence", "SELECT vec_id, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = e.vec_id) AS found FROM embeddings e")
def _(spark, d):
    own = table(spark, d, "labels").select(F.col("doc_id").alias("vec_id"), F.lit(True).alias("found")).distinct()
    return table(spark, d, "embeddings").select("vec_id").join(own, "vec_id", "left").select("vec_id", F.coalesce("found", F.lit(False)).alias("found"))


# -- reductions and statistics --------------------------------------------------------


@query("topk_min", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice, l_orderkey, l_linenumber LIMIT 10")
def _(spark, d):
    return topk.select_single(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), ["l_extendedprice", "l_orderkey", "l_linenumber"], 10)


@query("topk_max", "SELECT l_returnflag, row_number() OVER w AS rank, l_orderkey, l_linenumber, l_extendedprice FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) QUALIFY row_number() OVER w <= 5")
def _(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice")
    return topk.topk(rows, "l_returnflag", [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"], 5)


@query("reduction_summary", "SELECT count(*) AS count, round(sum(o_totalprice), 2) AS sum, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS min, max(o_totalprice) AS max, (SELECT min(o_orderkey) FROM orders WHERE o_totalprice = (SELECT min(o_totalprice) FROM orders)) AS min_index, (SELECT min(o_orderkey) FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)) AS max_index FROM orders")
def _(spark, d):
    return rounded(rounded(stats.reduction(table(spark, d, "orders"), "o_totalprice", "o_orderkey"), 2, "sum"), 4, "mean")


@query("argmin_argmax", "SELECT min(o_totalprice) AS v, min(o_orderkey) AS i FROM orders WHERE o_totalprice = (SELECT min(o_totalprice) FROM orders)")
def _(spark, d):
    return topk.argmin(table(spark, d, "orders"), "o_totalprice", "o_orderkey")


BASIC_SQL = "SELECT l_returnflag, count(*) AS count, round(avg(x), 4) AS mean, round(var_samp(x), 4) AS variance, min(x) AS min, max(x) AS max, round(sum(x), 2) AS sum, round(stddev_samp(x), 4) AS stddev, round(max(x) - min(x), 4) AS range, round(stddev_samp(x) / abs(avg(x)), 6) AS cv, round(stddev_samp(x) / sqrt(count(*)), 6) AS sem, round(avg(x) - 1.96 * stddev_samp(x) / sqrt(count(*)), 4) AS ci_low, round(avg(x) + 1.96 * stddev_samp(x) / sqrt(count(*)), 4) AS ci_high FROM (SELECT l_returnflag, l_quantity AS x FROM lineitem) GROUP BY 1"


@query("basic_stats", BASIC_SQL)
def _(spark, d):
    out = stats.basic(table(spark, d, "lineitem"), "l_quantity", ["l_returnflag"])
    return rounded(rounded(rounded(out, 4, "mean", "variance", "stddev", "range", "ci_low", "ci_high"), 6, "cv", "sem"), 2, "sum")


@query("moments_corrected", "SELECT event_type, count(*) AS count, round(skewness(value), 4) AS skewness, round(kurtosis(value), 4) AS kurtosis, CASE WHEN abs(skewness(value)) < 0.5 THEN 'symmetric' WHEN skewness(value) > 0 THEN 'right' ELSE 'left' END AS shape, CASE WHEN kurtosis(value) > 1 THEN 'heavy' WHEN kurtosis(value) < -1 THEN 'light' ELSE 'normal' END AS tail FROM events WHERE value IS NOT NULL GROUP BY 1")
def _(spark, d):
    return rounded(stats.moments(table(spark, d, "events"), "value", ["event_type"]), 4, "skewness", "kurtosis")


@query("quantiles_r7", "SELECT l_linestatus, " + ", ".join(f"round(quantile_cont(l_extendedprice, {q}), 4) AS q{100 * q:g}" for q in stats.QUANTILES) + " FROM lineitem GROUP BY 1")
def _(spark, d):
    return rounded(stats.quantiles(table(spark, d, "lineitem"), "l_extendedprice", by=["l_linestatus"]), 4, "q25", "q50", "q75", "q95")


FENCES_SQL = "SELECT round(q25, 4) AS q25, round(q50, 4) AS q50, round(q75, 4) AS q75, round(q75 - q25, 4) AS iqr, round(q25 - 1.5 * (q75 - q25), 4) AS low_fence, round(q75 + 1.5 * (q75 - q25), 4) AS high_fence FROM (SELECT quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75 FROM events)"


@query("latency_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 4) AS q50, round(quantile_cont(value, 0.95), 4) AS q95, round(quantile_cont(value, 0.99), 4) AS q99 FROM events GROUP BY 1")
def _(spark, d):
    return rounded(stats.quantiles(table(spark, d, "events"), "value", (0.5, 0.95, 0.99), ["event_type"]), 4, "q50", "q95", "q99")


@query("vector_statistics", "SELECT label, count(*) AS n, round(sum(s) / sum(d), 6) AS mean, round(sqrt(sum(q) / sum(d) - (sum(s) / sum(d)) ** 2), 6) AS stddev, round(avg(sqrt(q)), 5) AS mean_norm FROM (SELECT label, len(v) AS d, list_sum(v) AS s, list_sum(list_transform(v, lambda x: x * x)) AS q FROM (SELECT label, embedding::DOUBLE[] AS v FROM embeddings)) GROUP BY 1")
def _(spark, d):
    return rounded(rounded(batch.vector_statistics(table(spark, d, "embeddings"), "label"), 6, "mean", "stddev"), 5, "mean_norm")


@query("outlier_groups", "WITH m AS (SELECT l_suppkey, avg(l_quantity) AS mean FROM lineitem GROUP BY 1), z AS (SELECT l_suppkey, mean, (mean - (SELECT avg(mean) FROM m)) / (SELECT stddev_samp(mean) FROM m) AS z FROM m) SELECT l_suppkey, round(mean, 4) AS mean, round(z, 4) AS z FROM z WHERE abs(z) > 0.5")
def _(spark, d):
    return rounded(stats.outlier_groups(table(spark, d, "lineitem"), "l_quantity", "l_suppkey", 0.5), 4, "mean", "z")


@query("global_minimum", f"SELECT round(d, 4) AS d, id_a, id_b FROM (SELECT {DISTANCES['l2'][1]} AS d, id_a, id_a + 1 AS id_b {PAIRS_SQL}) ORDER BY d, id_a LIMIT 1")
def _(spark, d):
    cells = pairs(spark, d).select(V.l2("va", "vb").alias("d"), "id_a", (F.col("id_a") + 1).alias("id_b"))
    return rounded(topk.global_minimum(cells, "d", "id_a", "id_b"), 4, "d")


@query("valid_results", f"SELECT id_a AS id, round({DISTANCES['l2'][1]}, 4) AS distance {PAIRS_SQL} WHERE id_a % 3 <> 0")
def _(spark, d):
    rows = pairs(spark, d).select("id_a", V.l2("va", "vb").alias("d"))
    broken = rows.select(F.col("id_a").alias("id"), F.when(F.col("id_a") % 6 == 0, float("nan")).when(F.col("id_a") % 3 == 0, float("inf")).otherwise(F.col("d")).alias("distance"))
    return rounded(batch.valid(broken), 4, "distance")


@query("outlier_fences", FENCES_SQL)
def _(spark, d):
    return rounded(stats.fences(table(spark, d, "events"), "value"), 4, "q25", "q50", "q75", "iqr", "low_fence", "high_fence")


CORRELATED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _pairs_sql(f: str) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS i, '{b}' AS j, round({f.format(a=a, b=b)}, 4) AS value FROM lineitem" for k, a in enumerate(CORRELATED) for b in CORRELATED[k:])


add("correlation_matrix", lambda s, d: rounded(stats.correlation_matrix(table(s, d, "lineitem"), CORRELATED), 4, "value"), _pairs_sql("corr({a}, {b})"))
add("covariance_matrix", lambda s, d: rounded(stats.correlation_matrix(table(s, d, "lineitem"), CORRELATED, True), 4, "value"), _pairs_sql("covar_samp({a}, {b})"))
add("logsumexp_reduce", lambda s, d: rounded(stats.logsumexp(table(s, d, "lineitem"), "l_quantity", ["l_returnflag"]), 4, "logsumexp"), "SELECT l_returnflag, round(m + ln(sum(exp(l_quantity - m))), 4) AS logsumexp FROM lineitem JOIN (SELECT l_returnflag, max(l_quantity) AS m FROM lineitem GROUP BY 1) USING (l_returnflag) GROUP BY l_returnflag, m")

# -- histograms -------------------------------------------------------------------------

UNIFORM_SQL = "SELECT k AS bin, round(lo + (hi - lo) * k / 20, 6) AS low, round(lo + (hi - lo) * (k + 1) / 20, 6) AS high, count(b) AS count FROM (SELECT unnest(range(0, 20)) AS k) CROSS JOIN (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem) LEFT JOIN (SELECT len(list_filter(range(1, 20), lambda j: lo + (hi - lo) * j / 20 <= l_quantity)) AS b FROM lineitem, (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem)) ON b = k GROUP BY 1, 2, 3"


def _hist(spark: SparkSession, d: str) -> DataFrame:
    return hist.uniform(table(spark, d, "lineitem"), "l_quantity", 20)


add("hist_uniform", lambda s, d: rounded(_hist(s, d), 6, "low", "high"), UNIFORM_SQL)
EDGES = [0.0, 5.0, 10.0, 25.0, 100.0]
CUSTOM_CASE = "CASE " + " ".join(f"WHEN x < {e} THEN {k}" for k, e in enumerate(EDGES[1:-1])) + f" ELSE {len(EDGES) - 2} END"
CUSTOM_SQL = f"SELECT k AS bin, {list(EDGES)}[k + 1]::DOUBLE AS low, {list(EDGES)}[k + 2]::DOUBLE AS high, count(b) AS count FROM (SELECT unnest(range(0, 4)) AS k) LEFT JOIN (SELECT {CUSTOM_CASE} AS b FROM (SELECT {{col}} AS x FROM {{tab}} WHERE {{where}})) ON b = k GROUP BY 1, 2, 3"
add("hist_custom", lambda s, d: hist.histogram(table(s, d, "lineitem"), "l_quantity", EDGES), CUSTOM_SQL.format(col="l_quantity", tab="lineitem", where="true"))
add("hist_batch", lambda s, d: hist.histogram(table(s, d, "lineitem"), "l_quantity", EDGES, ["l_returnflag"]), " UNION ALL ".join(f"SELECT '{f}' AS l_returnflag, * FROM ({CUSTOM_SQL.format(col='l_quantity', tab='lineitem', where=f"l_returnflag = '{f}'")})" for f in "ANR"))
EQUAL_SQL = "WITH e AS (SELECT quantile_cont(l_extendedprice, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]) AS q FROM lineitem) SELECT k AS bin, round(q[k + 1], 4) AS low, round(q[k + 2], 4) AS high, count(b) AS count FROM (SELECT unnest(range(0, 10)) AS k) CROSS JOIN e LEFT JOIN (SELECT len(list_filter(q[2:10], lambda x: x <= l_extendedprice)) AS b FROM lineitem, e) ON b = k GROUP BY 1, 2, 3"
add("hist_equal_freq", lambda s, d: rounded(hist.equal_frequency(table(s, d, "lineitem"), "l_extendedprice", 10), 4, "low", "high"), EQUAL_SQL)
LOG_SQL = "WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders WHERE o_totalprice > 0) SELECT k AS bin, round(exp(ln(lo) + (ln(hi) - ln(lo)) * k / 10), 3) AS low, round(exp(ln(lo) + (ln(hi) - ln(lo)) * (k + 1) / 10), 3) AS high, count(b) AS count FROM (SELECT unnest(range(0, 10)) AS k) CROSS JOIN e LEFT JOIN (SELECT len(list_filter(range(1, 10), lambda j: exp(ln(lo) + (ln(hi) - ln(lo)) * j / 10) <= o_totalprice)) AS b FROM orders, e WHERE o_totalprice > 0) ON b = k GROUP BY 1, 2, 3"
add("hist_log", lambda s, d: rounded(hist.logarithmic(table(s, d, "orders"), "o_totalprice", 10), 3, "low", "high"), LOG_SQL)
add("hist_normalized", lambda s, d: hist.normalized(_hist(s, d)).select("bin", F.round("share", 6).alias("share")), f"SELECT bin, round(count / sum(count) OVER (), 6) AS share FROM ({UNIFORM_SQL})")
add("hist_cdf", lambda s, d: hist.cumulative(_hist(s, d)).select("bin", F.round("cdf", 6).alias("cdf")), f"SELECT bin, round(sum(count) OVER (ORDER BY bin) / sum(count) OVER (), 6) AS cdf FROM ({UNIFORM_SQL})")
add("hist_intersection", lambda s, d: hist.intersection(*[hist.histogram(table(s, d, "lineitem").where(F.col("l_returnflag") == f), "l_quantity", EDGES) for f in "AN"]), f"SELECT sum(least(a.count, b.count))::BIGINT AS intersection FROM ({CUSTOM_SQL.format(col='l_quantity', tab='lineitem', where=chr(108) + '_returnflag = ' + repr('A'))}) a JOIN ({CUSTOM_SQL.format(col='l_quantity', tab='lineitem', where='l_returnflag = ' + repr('N'))}) b USING (bin)")
FIGURES_SQL = f"WITH h AS ({UNIFORM_SQL.replace('round(lo + (hi - lo) * k / 20, 6)', 'lo + (hi - lo) * k / 20').replace('round(lo + (hi - lo) * (k + 1) / 20, 6)', 'lo + (hi - lo) * (k + 1) / 20')}), x AS (SELECT *, (low + high) / 2 AS x, sum(count) OVER (ORDER BY bin) / sum(count) OVER () AS cdf, count / sum(count) OVER () AS w FROM h), m AS (SELECT sum(x * w) AS mean FROM x) SELECT round(m.mean, 4) AS mean, round(sqrt(sum(w * (x - m.mean) ** 2)), 4) AS sd, round(sum(CASE WHEN w > 0 THEN -w * log2(w) ELSE 0 END), 4) AS entropy, round(arg_max(x, count * 1000.0 - bin), 4) AS mode, round(min(CASE WHEN cdf >= 0.25 THEN x END), 4) AS q1, round(min(CASE WHEN cdf >= 0.5 THEN x END), 4) AS median, round(min(CASE WHEN cdf >= 0.75 THEN x END), 4) AS q3, round(sum(w * (x - m.mean) ** 3) / sum(w * (x - m.mean) ** 2) ** 1.5, 4) AS skewness, round(sum(w * (x - m.mean) ** 4) / sum(w * (x - m.mean) ** 2) ** 2, 4) AS kurtosis FROM x, m GROUP BY m.mean"
add("hist_figures", lambda s, d: rounded(hist.figures(_hist(s, d)), 4, "mean", "sd", "entropy", "mode", "q1", "median", "q3", "skewness", "kurtosis"), FIGURES_SQL)
add("hist_2d", lambda s, d: hist.two_dimensional(table(s, d, "lineitem"), "l_quantity", "l_discount", EDGES, [0.0, 0.025, 0.055, 1.0]), f"SELECT {CUSTOM_CASE.replace('x <', 'l_quantity <')}::BIGINT AS x_bin, (CASE WHEN l_discount < 0.025 THEN 0 WHEN l_discount < 0.055 THEN 1 ELSE 2 END)::BIGINT AS y_bin, count(*) AS count FROM lineitem GROUP BY 1, 2")

# -- quantization ------------------------------------------------------------------------


def _codes(spark: SparkSession, d: str, c: Column, bits: int) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "embedding", c.alias("code"))
    e = e.withColumn("decoded", Q.decode("code"))
    return e.select("vec_id", F.aggregate("code.q", F.lit(0).cast("long"), lambda a, x: a + x).alias("code_sum"), F.round("code.scale", 6).alias("scale"), F.col("code.zero_point").alias("zero_point"), F.round(Q.mse("embedding", "decoded"), 6).alias("mse"), F.round(Q.max_error("embedding", "decoded"), 5).alias("max_error"))


def codes_sql(bits: int, symmetric: bool) -> str:
    low, high = -(1 << (bits - 1)), (1 << (bits - 1)) - 1
    scale = f"greatest(list_max(list_transform(v, lambda x: abs(x))) / {high}, 1e-8)" if symmetric else f"greatest((list_max(v) - list_min(v)) / {(1 << bits) - 1}, 1e-8)"
    zero = "0" if symmetric else f"{low} - round_even(list_min(v) / s, 0)"
    return f"SELECT vec_id, list_sum(q)::BIGINT AS code_sum, round(s, 6) AS scale, z::BIGINT AS zero_point, round(list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - (q[i] - z) * s) ** 2)) / len(v), 6) AS mse, round(list_max(list_transform(range(1, len(v) + 1), lambda i: abs(v[i] - (q[i] - z) * s))), 5) AS max_error FROM (SELECT *, list_transform(v, lambda x: greatest({low}, least({high}, round_even(x / s, 0) + z))) AS q FROM (SELECT *, {zero} AS z FROM (SELECT vec_id, v, {scale} AS s FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings))))"


for _bits in (8, 4):
    add(f"int{_bits}_sym_roundtrip", lambda s, d, b=_bits: _codes(s, d, Q.symmetric("embedding", b), b), codes_sql(_bits, True))
    add(f"int{_bits}_asym_roundtrip", lambda s, d, b=_bits: _codes(s, d, Q.asymmetric("embedding", b), b), codes_sql(_bits, False))


@query("int4_packed", "SELECT vec_id, list_sum(list_transform(range(1, 33), lambda i: ((q[2 * i - 1]::INT + 16) % 16) + 16 * ((q[2 * i]::INT + 16) % 16)))::BIGINT AS byte_sum, true AS same FROM (SELECT vec_id, list_transform(v, lambda x: greatest(-8, least(7, round_even(x / s, 0)))) AS q FROM (SELECT vec_id, v, greatest(list_max(list_transform(v, lambda x: abs(x))) / 7, 1e-8) AS s FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)))")
def _(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", Q.symmetric("embedding", 4)["q"].alias("q"))
    packed = e.withColumn("p", Q.pack_nibbles("q"))
    return packed.select("vec_id", F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x).alias("byte_sum"), (Q.unpack_nibbles("p", F.size("q")) == F.col("q")).alias("same"))


@query("binary_quantize", "SELECT vec_id, w AS word, list_sum(list_transform(range(1, 33), lambda i: CASE WHEN embedding[w * 32 + i] > 0 THEN 1::BIGINT << (i - 1) ELSE 0 END))::BIGINT AS bits FROM (SELECT vec_id, embedding, unnest(range(0, 2)) AS w FROM embeddings)")
def _(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode(Q.binarize("embedding")).alias("word", "bits"))
    return e.select("vec_id", F.col("word").cast("long").alias("word"), "bits")


@query("binary_quantize_mean", "SELECT vec_id, list_sum(list_transform(v, lambda x: (x > list_sum(v) / len(v))::INT))::BIGINT AS ones FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)")
def _(spark, d):
    words = Q.binarize("embedding", None)
    return table(spark, d, "embeddings").select("vec_id", F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.bit_count(w)).alias("ones"))


def _quality(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "embedding", Q.decode(Q.symmetric("embedding")).alias("decoded"))
    return quantstats.row_quality(e, "embedding", "decoded").drop("embedding", "decoded")


ROWS_SQL = f"SELECT vec_id, mse, CASE WHEN mse > 0 THEN 20 * log10(m / sqrt(mse)) ELSE 'inf'::DOUBLE END AS psnr FROM (SELECT vec_id, list_max(list_transform(v, lambda x: abs(x))) AS m, list_sum(list_transform(v, lambda x: (x - greatest(-128, least(127, round_even(x / s, 0))) * s) ** 2)) / len(v) AS mse FROM (SELECT vec_id, v, greatest(list_max(list_transform(v, lambda x: abs(x))) / 127, 1e-8) AS s FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)))"
CLASS_SQL = "CASE WHEN psnr > 40 THEN 'excellent' WHEN psnr > 30 THEN 'good' WHEN psnr > 20 THEN 'acceptable' ELSE 'poor' END"
add("quant_quality", lambda s, d: _quality(s, d).select("vec_id", F.round("mse", 8).alias("mse"), F.round("psnr", 3).alias("psnr"), "class"), f"SELECT vec_id, round(mse, 8) AS mse, round(psnr, 3) AS psnr, {CLASS_SQL} AS class FROM ({ROWS_SQL})")
add("quant_batch_quality", lambda s, d: rounded(rounded(quantstats.batch_quality(_quality(s, d)), 8, "mean_mse", "min_mse", "max_mse", "sd_mse", "p95_mse"), 3, "mean_psnr"), f"SELECT count(*) AS n, round(avg(mse), 8) AS mean_mse, round(min(mse), 8) AS min_mse, round(max(mse), 8) AS max_mse, round(stddev_pop(mse), 8) AS sd_mse, round(quantile_disc(mse, 0.95), 8) AS p95_mse, round(avg(psnr), 3) AS mean_psnr, " + ", ".join(f"count(*) FILTER (c = '{c}') AS n_{c}" for c in ("excellent", "good", "acceptable", "poor")) + f" FROM (SELECT *, {CLASS_SQL} AS c FROM ({ROWS_SQL}))")
add("poor_quality_rows", lambda s, d: rounded(quantstats.poor_rows(_quality(s, d), 0.00005), 8, "mse"), f"SELECT vec_id, round(mse, 8) AS mse FROM ({ROWS_SQL}) WHERE mse > 0.00005")


GLOBAL_SQL = "(SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: (greatest(-128, least(127, round_even(x / s, 0) + z)) - z) * s) AS embedding FROM embeddings, (SELECT s, -128 - round_even(lo / s, 0) AS z FROM (SELECT lo, greatest((hi - lo) / 255, 1e-8) AS s FROM (SELECT min(list_min(embedding))::DOUBLE AS lo, max(list_max(embedding))::DOUBLE AS hi FROM embeddings))))"


@query("ivf_sq8_search", search_sql(METRIC_SQL["euclidean"], places=3).replace("FROM embeddings q, embeddings b WHERE", f"FROM embeddings q, {GLOBAL_SQL} b WHERE"))
def _(spark, d):
    e, q = vectors(spark, d)
    coded, scale, zero = Q.global_codes(e, "embedding")
    _, c = label_centroids(spark, d)
    listed = kmeans.assign(coded, c).drop("distance")
    return rounded(kmeans.ivf_search(listed, c, q, 10, len(c), vec="q", query_vec="embedding", codes=(scale, zero)), 3, "distance")


@query("per_channel_scales", "SELECT (i - 1)::INT AS i, round(greatest(max(abs(embedding[i]::DOUBLE)) / 127, 1e-8), 6) AS scale FROM (SELECT embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY 1")
def _(spark, d):
    return rounded(Q.per_channel_scales(table(spark, d, "embeddings"), "embedding"), 6, "scale")


def errors_sql(bits: int, symmetric: bool) -> str:
    """(vec_id, mse, psnr) of codes."""
    low, high = -(1 << (bits - 1)), (1 << (bits - 1)) - 1
    scale = f"greatest(list_max(list_transform(v, lambda x: abs(x))) / {high}, 1e-8)" if symmetric else f"greatest((list_max(v) - list_min(v)) / {(1 << bits) - 1}, 1e-8)"
    zero = "0" if symmetric else f"{low} - round_even(list_min(v) / s, 0)"
    decoded = f"(greatest({low}, least({high}, round_even(x / s, 0) + z)) - z) * s"
    return f"SELECT vec_id, mse, CASE WHEN mse > 0 THEN 20 * log10(m / sqrt(mse)) ELSE 'inf'::DOUBLE END AS psnr FROM (SELECT vec_id, list_max(list_transform(v, lambda x: abs(x))) AS m, list_sum(list_transform(v, lambda x: (x - {decoded}) ** 2)) / len(v) AS mse FROM (SELECT *, {zero} AS z FROM (SELECT vec_id, v, {scale} AS s FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings))))"


FIGURES = "count(*) AS n, round(avg(mse), 8) AS mean_mse, round(min(mse), 8) AS min_mse, round(max(mse), 8) AS max_mse, round(stddev_pop(mse), 8) AS sd_mse, round(quantile_disc(mse, 0.95), 8) AS p95_mse, round(avg(psnr), 3) AS mean_psnr, " + ", ".join(f"count(*) FILTER ({CLASS_SQL} = '{c}') AS n_{c}" for c in ("excellent", "good", "acceptable", "poor"))


@query("quant_compare", " UNION ALL ".join(f"SELECT 'int{b}_{n}' AS method, {FIGURES} FROM ({errors_sql(b, n == 'sym')})" for b in (4, 8) for n in ("sym", "asym")))
def _(spark, d):
    methods = {f"int{b}_{n}": Q.decode(f("embedding", b)) for b in (4, 8) for n, f in (("sym", Q.symmetric), ("asym", Q.asymmetric))}
    out = quantstats.compare(table(spark, d, "embeddings"), "embedding", methods)
    return rounded(rounded(out, 8, "mean_mse", "min_mse", "max_mse", "sd_mse", "p95_mse"), 3, "mean_psnr")


SLIDING_SQL = "SELECT event_id, round(avg(value) OVER w, 8) AS sliding_mean, count(*) OVER w >= 10 AND list_sum(list_slice(list(value) OVER w, -5, -1)) / 5 > list_sum(list_slice(list(value) OVER w, 1, 5)) / 5 AS degrading FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)"
add("sliding_quality", lambda s, d: rounded(quantstats.sliding(table(s, d, "events").where("value is not null"), "event_id", "value", "user_id").select("event_id", "sliding_mean", "degrading"), 8, "sliding_mean"), SLIDING_SQL)


# -- clustering, text, graphs, layouts ----------------------------------------------------


TF_SQL = "SELECT lang AS cluster, term, count(*)::DOUBLE AS tf FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-zà-ÿß]+')) AS term FROM documents WHERE lang IS NOT NULL) GROUP BY 1, 2"
SCORE_SQL = f"WITH tf AS ({TF_SQL}), c AS (SELECT term, sum(tf) AS ctf FROM tf GROUP BY 1), a AS (SELECT sum(tf) / count(DISTINCT cluster) AS avg FROM tf) SELECT cluster, term, tf, tf * ln(1 + avg / greatest(ctf, 1)) AS score FROM tf JOIN c USING (term), a"
add("ctfidf", lambda s, d: rounded(text.ctfidf(text.term_frequencies(table(s, d, "documents"), "lang")).select("cluster", "term", "tf", "score"), 4, "score"), f"SELECT cluster, term, tf, round(score, 4) AS score FROM ({SCORE_SQL})")
add("ctfidf_topk", lambda s, d: rounded(text.top_terms(text.ctfidf(text.term_frequencies(table(s, d, "documents"), "lang")), 10).select("cluster", "rank", "term", "score"), 4, "score"), f"SELECT cluster, row_number() OVER w AS rank, term, round(score, 4) AS score FROM ({SCORE_SQL}) WINDOW w AS (PARTITION BY cluster ORDER BY score DESC, term) QUALIFY row_number() OVER w <= 10")

CORE_SQL = f"SELECT query_id AS id, round(sqrt(distance), 4) AS core FROM ({search_sql(METRIC_SQL['euclidean'], k=5, extra='AND q.vec_id <> b.vec_id', places=9)}) WHERE rank = 5"


@query("core_distance", CORE_SQL)
def _(spark, d):
    e, q = vectors(spark, d)
    return rounded(graph.core_distances(e, 5, queries=q), 4, "core")


REACH_SQL = f"WITH core AS ({CORE_SQL.replace('round(sqrt(distance), 4)', 'sqrt(distance)')}) SELECT a.vec_id AS i, b.vec_id AS j, round(CASE WHEN a.vec_id = b.vec_id THEN 0 ELSE greatest(ca.core, cb.core, sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) ** 2)))) END, 4) AS d FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 20 JOIN core ca ON ca.id = a.vec_id JOIN core cb ON cb.id = b.vec_id WHERE a.vec_id % 20 = 0"


@query("mutual_reachability", REACH_SQL)
def _(spark, d):
    e, q = vectors(spark, d)
    own = q.select(F.col("vec_id").alias("i"), (F.col("vec_id") + 20).alias("j"))
    return rounded(graph.pair_reachability(own, e, graph.core_distances(e, 5, queries=q)), 4, "d")


def _layout(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Points: a quarter of the sums of both halves of each vector; edges: id to id + 1 and id + 7, weight 1 and 0.5."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    points = e.select(F.col("vec_id").alias("id"), F.array(V.vsum(F.slice("v", 1, DIM // 2)) * 0.25, V.vsum(F.slice("v", DIM // 2 + 1, DIM // 2)) * 0.25).alias("y"))
    step = F.explode(F.array(F.struct(F.lit(1).alias("s"), F.lit(1.0).alias("weight")), F.struct(F.lit(7).alias("s"), F.lit(0.5).alias("weight"))))
    edges = points.select(F.col("id").alias("source"), step.alias("x")).select("source", (F.col("source") + F.col("x.s")).alias("target"), F.col("x.weight").alias("weight"))
    return points, edges


POINTS_SQL = "SELECT vec_id AS id, list_sum(list_slice(embedding::DOUBLE[], 1, 32)) * 0.25 AS y1, list_sum(list_slice(embedding::DOUBLE[], 33, 64)) * 0.25 AS y2 FROM embeddings"
LAYOUT_SQL = f"SELECT a.id AS source, b.id AS target, w.weight AS weight, a.y1 AS x1, a.y2 AS x2, b.y1 AS y1, b.y2 AS y2 FROM ({POINTS_SQL}) a JOIN (VALUES (1, 1.0::DOUBLE), (7, 0.5::DOUBLE)) w(s, weight) ON true JOIN ({POINTS_SQL}) b ON b.id = a.id + w.s"
PULL_SQL = "greatest(-4, least(4, -2 * 1.5 * 0.9 * d2 ** (0.9 - 1)::DOUBLE / (1 + 1.5 * d2 ** 0.9::DOUBLE) * weight * {rate} * ({a} - {b})))"
PULLED_SQL = f"SELECT *, greatest((x1 - y1) ** 2 + (x2 - y2) ** 2, 1e-6) AS d2 FROM ({LAYOUT_SQL})"


def negative_sql(seed: int, draws: int = 5) -> str:
    """(source, target) and their places, by the generator of negative_pairs."""
    one = f"((id + {seed}) % 2147483647 * 48271) % 2147483647"
    target = f"((({one} + k * 16807 + 1) * 69621) % 2147483647) % (SELECT count(*) FROM embeddings)"
    return f"SELECT *, (x1 - y1) ** 2 + (x2 - y2) ** 2 AS d2 FROM (SELECT s.id AS source, t.id AS target, s.y1 AS x1, s.y2 AS x2, t.y1 AS y1, t.y2 AS y2 FROM (SELECT id, y1, y2, {target} AS target FROM ({POINTS_SQL}), (SELECT unnest(range(0, {draws})) AS k)) s JOIN ({POINTS_SQL}) t ON t.id = s.target WHERE s.id <> t.id)"


PUSH_SQL = "greatest(-4, least(4, 2 * 0.9 / ((1e-6 + d2) * (1 + 1.5 * d2 ** 0.9::DOUBLE)) * {rate} * ({a} - {b})))"
MOVES_SQL = " UNION ALL ".join(
    [f"SELECT source AS id, {PULL_SQL.format(rate=0.5, a='x1', b='y1')} AS g1, {PULL_SQL.format(rate=0.5, a='x2', b='y2')} AS g2 FROM ({PULLED_SQL})", f"SELECT target AS id, -{PULL_SQL.format(rate=0.5, a='x1', b='y1')} AS g1, -{PULL_SQL.format(rate=0.5, a='x2', b='y2')} AS g2 FROM ({PULLED_SQL})", f"SELECT source AS id, {PUSH_SQL.format(rate=0.5, a='x1', b='y1')} AS g1, {PUSH_SQL.format(rate=0.5, a='x2', b='y2')} AS g2 FROM ({negative_sql(0)})"]
)


@query("umap_edge_gradient", f"SELECT source, target, round(greatest(-4, least(4, f * (x1 - y1))), 4) AS g1, round(greatest(-4, least(4, f * (x2 - y2))), 4) AS g2 FROM (SELECT *, -2 * 1.5 * 0.9 * d2 ** (0.9 - 1)::DOUBLE / (1 + 1.5 * d2 ** 0.9::DOUBLE) * weight AS f FROM (SELECT *, greatest((x1 - y1) ** 2 + (x2 - y2) ** 2, 1e-6) AS d2 FROM ({LAYOUT_SQL})))")
def _(spark, d):
    points, edges = _layout(spark, d)
    g = umap.edge_gradients(edges, points, 1.5, 0.9, 1.0)
    return g.select("source", "target", F.round(F.element_at("g", 1), 4).alias("g1"), F.round(F.element_at("g", 2), 4).alias("g2"))


@query("umap_loss", f"SELECT round(sum(-weight * ln(q) - (1 - weight) * ln(1 - q)), 3) AS loss, count(*) AS edges FROM (SELECT *, least(greatest(1 / (1 + 1.5 * ((x1 - y1) ** 2 + (x2 - y2) ** 2) ** 0.9::DOUBLE), 1e-6), 1 - 1e-6) AS q FROM ({LAYOUT_SQL}))")
def _(spark, d):
    points, edges = _layout(spark, d)
    return rounded(umap.loss(edges, points, 1.5, 0.9), 3, "loss")


@query("umap_epoch", f"SELECT p.id, round(p.y1 + coalesce(m.g1, 0), 4) AS y1, round(p.y2 + coalesce(m.g2, 0), 4) AS y2 FROM ({POINTS_SQL}) p LEFT JOIN (SELECT id, sum(g1) AS g1, sum(g2) AS g2 FROM ({MOVES_SQL}) GROUP BY 1) m ON m.id = p.id")
def _(spark, d):
    points, edges = _layout(spark, d)
    moved = umap.epoch(points, edges, points.count(), 0.5, 1.5, 0.9)
    return moved.select("id", F.round(F.element_at("y", 1), 4).alias("y1"), F.round(F.element_at("y", 2), 4).alias("y2"))


@query("umap_negative_gradient", f"SELECT source, target, round({PUSH_SQL.format(rate=1.0, a='x1', b='y1')}, 4) AS g1 FROM ({negative_sql(3)})")
def _(spark, d):
    points, _ = _layout(spark, d)
    g = umap.negative_gradients(umap.negative_pairs(points, 5, points.count(), 3), points, 0.9, 1.5, 1.0)
    return g.select("source", "target", F.round(F.element_at("g", 1), 4).alias("g1"))


# -- matrices ------------------------------------------------------------------------------


def _m(spark: SparkSession, d: str) -> DataFrame:
    """All vectors as a matrix, a row each."""
    return M.from_vectors(table(spark, d, "embeddings"), "vec_id", "embedding")


def _w(spark: SparkSession, d: str) -> DataFrame:
    """Dimension x label: the mean vectors of all labels as columns."""
    return kmeans.means(table(spark, d, "embeddings"), "label").select(F.col("i").cast("int").alias("i"), F.col("label").cast("int").alias("j"), F.col("mean").alias("v"))


def _x(spark: SparkSession, d: str) -> DataFrame:
    """The mean of all vectors."""
    return _m(spark, d).groupBy("j").agg(F.avg("v").alias("v"))


def _repeated(batches: DataFrame, w: DataFrame) -> DataFrame:
    """The same right operand for each batch: (batch, i, j, v)."""
    keys = batches.select("batch", F.col("j").alias("i")).distinct()
    return keys.join(w, "i").select("batch", "i", "j", "v")


M_SQL = "SELECT vec_id::INT AS i, (k - 1)::INT AS j, embedding[k]::DOUBLE AS v FROM (SELECT *, unnest(range(1, 65)) AS k FROM embeddings)"
W_SQL = f"SELECT (i - 1)::INT AS i, label::INT AS j, m AS v FROM ({_means()})"
X_SQL = f"SELECT j, avg(v) AS v FROM ({M_SQL}) GROUP BY 1"
add("gemm", lambda s, d: rounded(M.multiply(_m(s, d), _w(s, d), 0.5), 3, "v"), f"SELECT a.i, b.j, round(0.5 * sum(a.v * b.v), 3) AS v FROM ({M_SQL}) a JOIN ({W_SQL}) b ON a.j = b.i GROUP BY 1, 2")
add("gemm_transposed", lambda s, d: rounded(M.multiply(_m(s, d), _m(s, d), transpose_a=True, beta=2.0, c=_w(s, d)), 2, "v"), f"SELECT coalesce(p.i, c.i) AS i, coalesce(p.j, c.j) AS j, round(coalesce(p.v, 0) + 2 * coalesce(c.v, 0), 2) AS v FROM (SELECT a.j AS i, b.j, sum(a.v * b.v) AS v FROM ({M_SQL}) a JOIN ({M_SQL}) b ON a.i = b.i GROUP BY 1, 2) p FULL JOIN ({W_SQL}) c ON p.i = c.i AND p.j = c.j")
add("gemm_transposed_b", lambda s, d: rounded(M.multiply(_m(s, d), M.transpose(_w(s, d)), transpose_b=True), 3, "v"), f"SELECT a.i, b.j, round(sum(a.v * b.v), 3) AS v FROM ({M_SQL}) a JOIN ({W_SQL}) b ON a.j = b.i GROUP BY 1, 2")
add("gemm_fused", lambda s, d: rounded(M.fused(_m(s, d), _w(s, d), M.row(_w(s, d), 1), "relu"), 3, "v"), f"SELECT a.i, b.j, round(greatest(0, sum(a.v * b.v) + any_value(w.v)), 3) AS v FROM ({M_SQL}) a JOIN ({W_SQL}) b ON a.j = b.i JOIN ({W_SQL}) w ON w.i = 1 AND w.j = b.j GROUP BY 1, 2")
add("gemm_batch", lambda s, d: rounded(M.multiply(*[_m(s, d).withColumn("batch", (F.col("i") % 4)) for _ in (0, 1)], transpose_a=True, batch=["batch"]), 2, "v"), f"SELECT a.i % 4 AS batch, a.j AS i, b.j, round(sum(a.v * b.v), 2) AS v FROM ({M_SQL}) a JOIN ({M_SQL}) b ON a.i = b.i GROUP BY 1, 2, 3")
add("gemm_strided", lambda s, d: rounded(M.multiply(M.strided(_m(s, d), 8, 10), _repeated(M.strided(_m(s, d), 8, 10), _w(s, d)), batch=["batch"]), 3, "v"), f"SELECT a.i // 10 AS batch, a.i % 10 AS i, b.j, round(sum(a.v * b.v), 3) AS v FROM ({M_SQL}) a JOIN ({W_SQL}) b ON a.j = b.i WHERE a.i % 10 < 8 GROUP BY 1, 2, 3")
add("gemv", lambda s, d: rounded(M.multiply_vector(_m(s, d), _x(s, d)), 4, "v"), f"SELECT a.i, round(sum(a.v * b.v), 4) AS v FROM ({M_SQL}) a JOIN ({X_SQL}) b ON a.j = b.j GROUP BY 1")
add("gemv_normalized", lambda s, d: rounded(M.multiply_vector(_m(s, d), _x(s, d), normalize=True), 6, "v"), f"SELECT i, round(v / sqrt(sum(v * v) OVER ()), 6) AS v FROM (SELECT a.i, sum(a.v * b.v) AS v FROM ({M_SQL}) a JOIN ({X_SQL}) b ON a.j = b.j GROUP BY 1)")
add("gemv_batch", lambda s, d: rounded(M.multiply_vector(_m(s, d).withColumn("batch", F.col("i") % 4), _m(s, d).groupBy((F.col("i") % 4).alias("batch"), "j").agg(F.avg("v").alias("v")), ["batch"], True), 6, "v"), f"SELECT batch, i, round(v / sqrt(sum(v * v) OVER (PARTITION BY batch)), 6) AS v FROM (SELECT a.i % 4 AS batch, a.i, sum(a.v * b.v) AS v FROM ({M_SQL}) a JOIN (SELECT i % 4 AS batch, j, avg(v) AS v FROM ({M_SQL}) GROUP BY 1, 2) b ON a.j = b.j AND a.i % 4 = b.batch GROUP BY 1, 2)")
add("matrix_row_cell", lambda s, d: M.row(_w(s, d), 5).select(F.lit(5).alias("i"), "j", F.round("v", 5).alias("v")).unionByName(M.cell(_w(s, d), 9, 2).select(F.lit(9).alias("i"), F.lit(2).alias("j"), F.round("v", 5).alias("v"))), f"SELECT i, j, round(v, 5) AS v FROM ({W_SQL}) WHERE i = 5 OR i = 9 AND j = 2")
add("matrix_rows", lambda s, d: M.to_rows(_w(s, d)).select("i", F.size("row").cast("long").alias("n"), F.round(F.element_at("row", 3), 5).alias("third")), f"SELECT i, count(*) AS n, round(max(CASE WHEN j = 2 THEN v END), 5) AS third FROM ({W_SQL}) GROUP BY 1")
add("zeros", lambda s, d: M.zeros(s, 3, 5), "SELECT i::INT AS i, j::INT AS j, 0::DOUBLE AS v FROM (SELECT unnest(range(0, 3)) AS i), (SELECT unnest(range(0, 5)) AS j)")
add("transpose", lambda s, d: M.transpose(_m(s, d)).select("i", "j", F.round("v", 5).alias("v")), f"SELECT j AS i, i AS j, round(v, 5) AS v FROM ({M_SQL})")
add("identity", lambda s, d: M.identity(s, 8), "SELECT i::INT AS i, j::INT AS j, (i = j)::INT::DOUBLE AS v FROM (SELECT unnest(range(0, 8)) AS i), (SELECT unnest(range(0, 8)) AS j)")


GRAM_SQL = f"SELECT list(r ORDER BY i) AS g FROM (SELECT i, list(v ORDER BY j) AS r FROM (SELECT a.j AS i, b.j, sum(a.v * b.v) AS v FROM ({M_SQL}) a JOIN ({M_SQL}) b ON a.i = b.i GROUP BY 1, 2) GROUP BY 1)"
STEPS = 30
POWER_SQL = f"""WITH RECURSIVE g AS MATERIALIZED ({GRAM_SQL}),
 p AS (SELECT 0 AS step, list_transform(range(0, {DIM}), lambda i: 1 / sqrt({DIM})) AS x, 0::DOUBLE AS value
  UNION ALL SELECT step + 1, list_transform(y, lambda v: v / sqrt(list_dot_product(y, y))), list_dot_product(x, y) FROM (SELECT step, x, list_transform(g.g, lambda r: list_dot_product(r, x)) AS y FROM p, g) WHERE step < {STEPS})
SELECT k::INT AS j, round(value, 2) AS eigenvalue, round(x[k + 1], 5) AS v FROM p, (SELECT unnest(range(0, {DIM})) AS k) WHERE step = {STEPS}"""


@query("power_iteration", POWER_SQL)
def _(spark, d):
    m = kept(M.gram(table(spark, d, "embeddings"), "embedding"), "gram")
    value, vector = M.power_iteration(m, DIM, STEPS, 0.0)
    return spark.createDataFrame([(k, round(value, 2), round(v, 5)) for k, v in enumerate(vector)], "j int, eigenvalue double, v double")


# -- logs, index, events ---------------------------------------------------------------------


def _log(spark: SparkSession, d: str) -> DataFrame:
    """A change log made of events: clicks and views insert their user, errors and purchases remove it."""
    op = F.when(F.col("event_type").isin("click", "view"), "insert").otherwise("remove")
    return table(spark, d, "events").where("user_id is not null").select(F.col("event_id").alias("seq"), "ts", op.alias("op"), F.col("user_id").alias("id"), F.array(F.col("value").cast("float")).alias("vec"), F.create_map(F.lit("type"), F.col("event_type")).alias("metadata"), F.lit("").alias("checksum"))


@query("log_replay", "SELECT user_id AS id, round(arg_max(value, event_id)::FLOAT::DOUBLE, 3) AS v, arg_max(event_type, event_id) AS type FROM events WHERE user_id IS NOT NULL GROUP BY 1 HAVING arg_max(event_type, event_id) IN ('click', 'view')")
def _(spark, d):
    from veclume.sources.changelog import replay

    return replay(_log(spark, d)).select("id", F.round(F.element_at("vec", 1).cast("double"), 3).alias("v"), F.element_at("metadata", "type").alias("type"))


@query("prefix_sum", "SELECT label, n, (sum(n) OVER (ORDER BY label) - n)::BIGINT AS first FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)")
def _(spark, d):
    return stats.exclusive_sum(table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n")), "label", "n")


@query("tumbling_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2")
def _(spark, d):
    from veclume.streaming.topk import windowed

    return rounded(windowed(table(spark, d, "events"), "ts", "event_type", "value"), 3, "total")


@query("session_windows", "SELECT min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, user_id, count(*) AS n FROM (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events WHERE ts IS NOT NULL)) GROUP BY user_id, k")
def _(spark, d):
    from veclume.streaming.topk import sessions

    return sessions(table(spark, d, "events"), "ts", "user_id")


@query("streaming_topk", search_sql(METRIC_SQL["euclidean"]))
def _(spark, d):
    import uuid

    from veclume.storage import shared_dir
    from veclume.streaming.topk import StreamingTopK

    e, q = vectors(spark, d)
    path = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    e.write.option("maxRecordsPerFile", 200_000).parquet(f"{path}/in")
    run = StreamingTopK(spark, f"{path}/state", q, 10)
    run.start(spark.readStream.schema(e.schema).parquet(f"{path}/in"), f"{path}/checkpoint").awaitTermination()
    return rounded(run.result(), 4, "distance")
