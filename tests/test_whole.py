"""Operators do the whole job: every row counts, whatever the size."""

import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from veclume import registry
from veclume.operators import graph, kmeans, matrix, quantstats, stats, topk
from veclume.plans.blocked import Nearest, exact, knn


def test_power_iteration_over_all_vectors(spark, sf):
    x = np.array([r.embedding for r in registry.table(spark, sf, "embeddings").collect()], float)
    got = {(r.i, r.j): r.v for r in matrix.gram(registry.table(spark, sf, "embeddings"), "embedding").collect()}
    assert np.allclose([[got[i, j] for j in range(64)] for i in range(64)], x.T @ x)
    found = registry.queries()["power_iteration"](spark, sf).orderBy("j").collect()
    v, top = np.array([r.v for r in found]), np.linalg.eigvalsh(x.T @ x)[-1]
    assert 0.9 * top < found[0].eigenvalue <= top * (1 + 1e-9) and np.isclose(v @ v, 1)
    assert matrix.gram(registry.table(spark, sf, "embeddings").where(F.lit(False)), "embedding").count() == 0


@pytest.mark.parametrize("metric", ["hamming", "euclidean", "cosine", "dot", "manhattan"])
def test_ties_beyond_any_slack_go_to_the_least_ids(spark, metric):
    rng = np.random.default_rng(8)
    one, other = rng.normal(size=8), rng.normal(size=8)
    ids = rng.permutation(3000)
    x = {int(i): (one if i % 3 else other).tolist() for i in ids}
    df = spark.createDataFrame(list(x.items()), "vec_id long, embedding array<double>").coalesce(1)
    q = spark.createDataFrame([(0, one.tolist()), (1, other.tolist())], "vec_id long, embedding array<double>")
    found = knn(df, q, 10, metric).orderBy("query_id", "rank").collect()
    first = {0: [i for i in range(3000) if i % 3][:10], 1: list(range(0, 30, 3))}
    if metric == "dot" and one @ other > max(one @ one, other @ other):
        raise AssertionError("choose other vectors")
    want = {}
    for k, v in enumerate((one, other)):
        d = [exact(np.array([w]), np.array([v]), metric)[0] for w in (one, other)]
        want[k] = first[0] if d[0] < d[1] else first[1]
    assert {k: [r.id for r in found if r.query_id == k] for k in (0, 1)} == want


def test_nearest_keeps_order_over_many_batches():
    rng = np.random.default_rng(9)
    x, q = rng.integers(-2, 3, (5000, 6)).astype(float), rng.integers(-2, 3, (7, 6)).astype(float)
    ids = rng.permutation(5000)
    for metric in ("euclidean", "hamming", "cosine", "chebyshev", "jaccard"):
        best = Nearest(q, 12, metric)
        for a in range(0, 5000, 700):
            best.add(x[a : a + 700], ids[a : a + 700])
        for r in range(7):
            d = exact(x, np.broadcast_to(q[r], x.shape).copy(), metric)
            assert best.id[best.row == r].tolist() == ids[np.lexsort((ids, d))[:12]].tolist()


@pytest.mark.parametrize(("small", "neighbours"), [(0, 3), (0, 40), (10**6, 3), (10**6, 40)])
def test_spanning_tree_holds_no_points_on_the_driver(spark, monkeypatch, small, neighbours):
    monkeypatch.setattr(graph, "TILE", 70)
    monkeypatch.setattr(graph, "SMALL", small)
    rng = np.random.default_rng(10)
    x = np.concatenate([rng.integers(0, 4, (120, 3)), rng.integers(50, 53, (40, 3))]).astype(float)  # copies, equal weights, two far groups
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    core = graph.core_distances(df, 3)
    c = np.array([r.core for r in core.orderBy("id").collect()])
    m = np.maximum(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), np.maximum(c[:, None], c[None]))
    seen, total = [0], 0.0
    while len(seen) < 160:
        rest = np.setdiff1d(np.arange(160), seen)
        near = m[np.ix_(seen, rest)].min(axis=0)
        total += near.min()
        seen.append(int(rest[near.argmin()]))
    tree = graph.minimum_spanning_tree(df, core, neighbours=neighbours)
    monkeypatch.undo()
    edges, root = tree.collect(), list(range(160))
    assert "max_points" not in inspect.signature(graph.minimum_spanning_tree).parameters
    for e in edges:
        a, b = root[e.source], root[e.target]
        assert a != b
        root = [a if r == b else r for r in root]
    assert len(edges) == 159 and np.isclose(sum(e.weight for e in edges), total)
    assert graph.minimum_spanning_tree(df.limit(0), core).count() == 0 and graph.minimum_spanning_tree(df.limit(1), core).count() == 0


def test_exact_quantiles_beyond_small_groups(spark, monkeypatch):
    """Brackets from the sketch, heavy ties, nulls and NaN: as sorted values give them."""
    monkeypatch.setattr(stats, "SMALL_GROUP", 10)
    rng = np.random.default_rng(14)
    rows = [("a", float(v)) for v in rng.normal(size=6000)] + [("b", 1.0)] * 3000 + [("b", float(v)) for v in rng.random(3000)] + [("c", None)] * 5 + [(None, float(k)) for k in range(2001)] + [("d", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    levels = (0.0, 0.05, 0.25, 0.5, 0.95, 1.0)
    got = {r.g: r for r in stats.quantiles(df, "v", levels, ["g"]).collect()}
    near = {r.g: r.q for r in stats.selected(df, "v", (0.5, 0.95), ["g"], nearest=True).collect()}
    for g in ("a", "b", "d", None):
        own = np.sort([v for k, v in rows if k == g])
        assert np.allclose([got[g][f"q{100 * q:g}"] for q in levels], np.quantile(own, levels), rtol=1e-12)
        assert near[g] == [own[max(int(np.ceil(len(own) * q)), 1) - 1] for q in (0.5, 0.95)]
    assert tuple(got["c"])[1:] == (None,) * 6
    whole = stats.quantiles(df.where("g = 'a'"), "v", (0.5,)).first()
    assert np.isclose(whole.q50, np.median([v for k, v in rows if k == "a"])) and stats.quantiles(df.limit(0), "v", (0.5,)).first().q50 is None


def test_sliding_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(quantstats, "STRETCH", 150)
    rng = np.random.default_rng(15)
    values = rng.random(1000)
    df = spark.createDataFrame([(int(i), float(values[i])) for i in rng.permutation(1000)], "i long, v double").repartition(6)
    got = quantstats.sliding(df, "i", "v").orderBy("i").collect()
    assert [r.i for r in got] == list(range(1000))
    for r in got:
        w = values[max(0, r.i - 99) : r.i + 1]
        assert np.isclose(r.sliding_mean, w.mean()) and r.degrading == (len(w) >= 10 and w[-5:].mean() > w[:5].mean())


def test_measured_probes_reach_the_recall(spark):
    rng = np.random.default_rng(16)
    x = rng.normal(size=(3000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    c = kmeans.fit(df, 30, 5, seed=2).centroids
    listed = kmeans.assign(df, c).drop("distance").cache()
    nprobe = kmeans.measured_nprobe(listed, c, 10, 0.9)
    asked = df.where("vec_id % 20 = 0")
    got = topk.recall(kmeans.ivf_search(listed, c, asked, 10, nprobe), knn(df, asked, 10)).first().recall
    assert 1 <= nprobe < 30 and got >= 0.9
