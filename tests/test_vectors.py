"""Column functions against NumPy, special values, searches and training."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veclume.functions import quant as Q
from veclume.functions import vector as V
from veclume.operators import graph, hist, kmeans, learned, matrix, pq, stats, topk, umap
from veclume.plans.blocked import knn, within

RNG = np.random.default_rng(3)


def frame(spark, *vectors):
    return spark.createDataFrame([tuple(v) for v in zip(*vectors, strict=True)], ", ".join(f"v{k} array<float>" for k in range(len(vectors))))


def one(spark, column, a, b):
    return frame(spark, [a], [b]).select(column.alias("x")).first().x


def vectors(spark, x, **extra):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


@pytest.mark.parametrize("dim", [1, 3, 31, 33, 384])
def test_distances(spark, dim):
    a, b = RNG.normal(size=(2, dim)).astype(np.float32)
    d = np.abs(a.astype(float) - b)
    want = {"euclidean": (d**2).sum(), "manhattan": d.sum(), "chebyshev": d.max(), "dot": -(a.astype(float) @ b), "hamming": ((a > 0) != (b > 0)).sum()}
    row = frame(spark, [a.tolist()], [b.tolist()]).select(*[V.distance("v0", "v1", m).cast("double").alias(m) for m in want], V.minkowski("v0", "v1", 5).alias("p5"), V.minkowski("v0", "v1", 0.5).alias("p05")).first()
    for m, w in want.items():
        assert row[m] == pytest.approx(w, rel=1e-6)
    assert row.p5 == pytest.approx((d**5).sum() ** 0.2, rel=1e-6)
    assert row.p05 == pytest.approx((d**0.5).sum() ** 2, rel=1e-6)


def test_special_values(spark):
    assert one(spark, V.cosine_similarity("v0", "v1"), [0.0, 0.0], [1.0, 2.0]) == 0
    assert one(spark, V.ruzicka("v0", "v1"), [0.0], [0.0]) == 1
    assert one(spark, V.ruzicka("v0", "v1"), [], []) == 0
    assert one(spark, V.l2_normalize("v0"), [1e-9, 0.0], [0.0, 0.0]) == [0, 0]
    assert one(spark, V.minkowski("v0", "v1", 3), [1.0], [1.0]) == 0
    assert one(spark, V.elementwise("v0", "divide", F.col("v1")), [1.0, -1.0], [0.0, 0.0]) == [math.inf, -math.inf]
    assert one(spark, V.elementwise("v0", "log"), [0.0, 1.0], [0.0, 0.0]) == [-math.inf, 0]
    assert one(spark, V.elementwise("v0", "maximum", F.col("v1")), [math.nan, 2.0], [1.0, math.nan]) == [1, 2]
    assert one(spark, V.row_logsumexp("v0"), [-math.inf, -math.inf], []) == -math.inf
    assert one(spark, V.row_softmax("v0"), [math.inf, 1.0, math.inf], []) == [0.5, 0, 0.5]
    assert one(spark, V.l2("v0", "v1"), None, [1.0]) is None
    with pytest.raises(Exception, match="unequal length"):
        one(spark, V.l2("v0", "v1"), [1.0], [1.0, 2.0])
    with pytest.raises(ValueError, match="unknown metric"):
        V.distance("a", "b", "nope")


def test_quantizers(spark):
    x = RNG.normal(size=(20, 37)).astype(np.float32)
    df = vectors(spark, x)
    for bits, most in ((8, 0.02), (4, 0.4)):
        for make in (Q.symmetric, Q.asymmetric):
            rows = df.select("embedding", Q.decode(make("embedding", bits)).alias("d")).collect()
            assert max(np.abs(np.array(r.embedding) - np.array(r.d)).max() for r in rows) < most
    words = df.select("vec_id", Q.binarize("embedding").alias("w"), Q.unpack_nibbles(Q.pack_nibbles(Q.symmetric("embedding", 4)["q"]), F.lit(37)).alias("n"), Q.symmetric("embedding", 4)["q"].alias("q")).collect()
    for r in words:
        bits = [(r.w[i // 32] >> (i % 32)) & 1 for i in range(37)]
        assert bits == (x[r.vec_id] > 0).astype(int).tolist() and r.n == r.q
    odd = one(spark, Q.symmetric("v0")["q"], [math.nan, math.inf, -math.inf, 0.0], [])
    assert odd == [0, 127, -127, 0]


def test_search_ties_and_filters(spark):
    x = np.repeat(RNG.normal(size=(10, 8)), 5, axis=0)
    df = vectors(spark, x)
    found = knn(df, df.where("vec_id < 7"), 6).collect()
    for q in range(7):
        d = ((x - x[q]) ** 2).sum(1)
        want = sorted(range(50), key=lambda i: (round(d[i], 9), i))[:6]
        assert [r.id for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q] == want
    few = knn(df, df.where("vec_id = 0"), 6, where=F.col("vec_id") > 47).collect()
    assert [r.id for r in few] == [48, 49] and knn(df, df.where("vec_id < 0"), 3).count() == 0
    assert knn(df, df.where("vec_id = 0"), 200).count() == 50
    near = within(df, df.where("vec_id = 0"), 1e-9).collect()
    assert sorted(r.id for r in near) == [0, 1, 2, 3, 4]
    assert topk.recall(knn(df, df, 5), knn(df, df, 5)).first().recall == 1


def test_kmeans_and_ivf(spark):
    centers = RNG.normal(size=(5, 6)) * 20
    x = np.concatenate([c + RNG.normal(size=(40, 6)) for c in centers])
    df = vectors(spark, x)
    model = kmeans.fit(df, 5, seed=2)
    assert model.converged
    got = {r.vec_id: r.cluster_id for r in kmeans.assign(df, model.centroids).collect()}
    assert len({tuple(got[i] for i in range(a, a + 40)) for a in range(0, 200, 40)}) == 5 and all(len({got[i] for i in range(a, a + 40)}) == 1 for a in range(0, 200, 40))
    assigned, q = kmeans.assign(df, model.centroids), df.where("vec_id % 20 = 0")
    full = [tuple(r) for r in kmeans.ivf_search(assigned, model.centroids, q, 5, 5).orderBy("query_id", "rank").collect()]
    assert full == [tuple(r) for r in knn(df, q, 5).orderBy("query_id", "rank").collect()]
    recalls = [topk.recall(kmeans.ivf_search(assigned, model.centroids, q, 60, p), knn(df, q, 60)).first().recall for p in (1, 3, 5)]
    assert recalls == sorted(recalls) and recalls[-1] == 1
    assert (kmeans.recommended_nlist(100), kmeans.recommended_nlist(10**9), kmeans.recommended_nprobe(100, 0.92)) == (10, 4096, 23)
    empties = kmeans.fit(df, 5, init=np.concatenate([np.full((4, 6), 1e6), np.zeros((1, 6))]))
    assert len(set(map(tuple, empties.centroids))) == 5


def test_pq(spark):
    x = RNG.normal(size=(300, 8))
    df = vectors(spark, x)
    book = pq.train(df, 4, 32, 10)
    coded = pq.decode(pq.encode(df, book), book).collect()
    error = np.mean([((np.array(r.decoded) - x[r.vec_id]) ** 2).sum() for r in coded])
    assert error < 0.5 * (x**2).sum(1).mean()
    r = pq.search(pq.encode(df, book), book, df.where("vec_id = 3"), 1).first()
    best = min(coded, key=lambda c: (((np.array(c.decoded) - x[3]) ** 2).sum(), c.vec_id))
    assert r.id == best.vec_id and r.distance == pytest.approx(np.sqrt(((np.array(best.decoded) - x[3]) ** 2).sum()))


def test_spanning_tree(spark):
    x = RNG.normal(size=(60, 3))
    df = vectors(spark, x)
    core = graph.core_distances(df, 4)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = np.sort(d, axis=1)[:, 4]
    assert np.allclose([r.core for r in core.orderBy("id").collect()], want)
    m = np.maximum(d, np.maximum(want[:, None], want[None]))
    seen, total = {0}, 0.0
    while len(seen) < 60:
        w, j = min((m[i, j], j) for i in seen for j in range(60) if j not in seen)
        total += w
        seen.add(j)
    edges = graph.minimum_spanning_tree(df, core).collect()
    assert len(edges) == 59 and sum(e.weight for e in edges) == pytest.approx(total)


def test_statistics(spark):
    x = RNG.gamma(2, size=500)
    df = spark.createDataFrame([(float(v), "a") for v in x] + [(3.0, "b")], "v double, g string")
    b = {r.g: r for r in stats.basic(df, "v", ["g"]).collect()}
    assert b["b"].variance == 0 and b["a"].variance == pytest.approx(x.var(ddof=1))
    m = {r.g: r for r in stats.moments(df, "v", ["g"]).collect()}
    assert (m["b"].skewness, m["b"].kurtosis) == (0, -3)
    h = hist.uniform(df.where("g = 'a'"), "v", 13).orderBy("bin").collect()
    assert [r["count"] for r in h] == np.histogram(x, 13)[0].tolist()
    odd = spark.createDataFrame([(math.nan,), (math.inf,), (None,), (-5.0,), (0.5,), (99.0,)], "v double")
    assert [r["count"] for r in hist.histogram(odd, "v", [0.0, 1.0, 2.0]).orderBy("bin").collect()] == [2, 1]
    assert [r["count"] for r in hist.histogram(odd, "v", [0.0, 1.0, 2.0], include_outliers=False).orderBy("bin").collect()] == [1, 0]
    with pytest.raises(ValueError, match="positive"):
        hist.log_edges(0, 1, 4)
    lse = stats.logsumexp(df.where("g = 'a'"), "v").first()[0]
    assert lse == pytest.approx(np.log(np.exp(x).sum()))


def test_matrices(spark):
    a = RNG.normal(size=(4, 4))
    a = a + a.T
    long = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(4) for j in range(4)], "i int, j int, v double")
    p = np.zeros((4, 4))
    for r in matrix.multiply(long, long, alpha=2, transpose_b=True).collect():
        p[r.i, r.j] = r.v
    assert np.allclose(p, 2 * a @ a.T)
    value, vector = matrix.power_iteration(long, 4, 400, 1e-13)
    assert np.allclose(a @ vector, value * np.array(vector), atol=1e-3)
    assert matrix.to_rows(matrix.identity(spark, 3)).count() == 3 and matrix.zeros(spark, 2, 3).agg(F.sum("v")).first()[0] == 0


def test_layout_and_projection(spark):
    a, b = umap.curve(0.1)
    assert (a, b) == (pytest.approx(1.577, abs=0.02), pytest.approx(0.895, abs=0.02))
    points = spark.createDataFrame([(i, RNG.normal(size=2).tolist()) for i in range(20)], "id long, y array<double>")
    edges = spark.createDataFrame([(i, (i + 1) % 20, 1.0) for i in range(20)], "source long, target long, weight double")
    before = umap.loss(edges, points, a, b).first().loss
    p = umap.epoch(points, edges, 20, 0.3, a, b, negatives=0 or 1)
    assert umap.loss(edges, p, a, b).first().loss < before
    x = RNG.normal(size=(5, 6))
    w = learned.xavier(3, 6, 1)
    out = learned.project(vectors(spark, x), w, normalize=True).orderBy("vec_id").collect()
    y = x @ w.T
    assert np.allclose([r.projected for r in out], y / np.linalg.norm(y, axis=1, keepdims=True))
