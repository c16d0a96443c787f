"""Queries of the index's life, of logs, files and reports, and their SQL."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from veclume.functions import vector as V
from veclume.operators import stats
from veclume.plans.index import IndexConfig, VectorIndex
from veclume.registry import BEST_SQL, DIM, METRIC_SQL, _log, label_centroids, query, rounded, search_sql, table, vectors
from veclume.sources import report, vecfile, weights
from veclume.sources.changelog import ChangeLog
from veclume.storage import shared_dir


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _labelled(e, label):
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.create_map(F.lit("label"), label).alias("metadata"))


def _filled(spark, d, **config) -> VectorIndex:
    index = VectorIndex(spark, _folder(spark, "index"), IndexConfig(DIM, **config))
    index.insert(_labelled(vectors(spark, d)[0], F.col("label").cast("string")))
    return index


def _changed(spark, d, **config) -> VectorIndex:
    """All vectors; each seventh removed; each fifth that is left renamed; each eleventh doubled, new or again."""
    index, e = _filled(spark, d, **config), vectors(spark, d)[0]
    index.remove(e.where("vec_id % 7 = 0").select(F.col("vec_id").alias("id")))
    index.set_metadata(e.where("vec_id % 5 = 0").select(F.col("vec_id").alias("id"), F.create_map(F.lit("label"), F.lit("x")).alias("metadata")))
    double = e.where("vec_id % 11 = 0").withColumn("embedding", F.transform("embedding", lambda x: x * 2))
    index.insert(_labelled(double, F.lit("new")))
    return index


def _again(index: VectorIndex) -> VectorIndex:
    return VectorIndex.open(index.spark, index.path, index.config)


def _state(index: VectorIndex):
    return index.rows().select("id", F.col("metadata")["label"].alias("label"), F.round(V.vsum(V.doubles("vec")), 3).alias("total"))


VEC = "CASE WHEN vec_id % 11 = 0 THEN list_transform(embedding, lambda x: x * 2) ELSE embedding END"
CHANGED_SQL = f"SELECT vec_id, {VEC} AS embedding, CASE WHEN vec_id % 11 = 0 THEN 'new' WHEN vec_id % 5 = 0 THEN 'x' ELSE label::VARCHAR END AS label FROM embeddings WHERE vec_id % 11 = 0 OR vec_id % 7 <> 0"
STATE_SQL = f"SELECT vec_id AS id, label, round(list_sum(embedding::DOUBLE[]), 3) AS total FROM ({CHANGED_SQL})"


@query("index_insert", "SELECT vec_id AS id, label::VARCHAR AS label, round(list_sum(embedding::DOUBLE[]), 3) AS total FROM embeddings")
def _(spark, d):
    return _state(_filled(spark, d))


@query("index_changes", STATE_SQL)
def _(spark, d):
    return _state(_changed(spark, d))


@query("index_recover", STATE_SQL)
def _(spark, d):
    return _state(_again(_changed(spark, d)))


@query("index_compact", STATE_SQL)
def _(spark, d):
    index = _changed(spark, d)
    index.compact()
    return _state(_again(index))


@query("index_checkpoints", STATE_SQL)
def _(spark, d):
    """With checkpoints and compaction of the log by themselves."""
    return _state(_again(_changed(spark, d, auto_checkpoint=50, auto_compact=1)))


@query("index_cached", STATE_SQL)
def _(spark, d):
    index = _changed(spark, d).cache()
    index.search(vectors(spark, d)[1].limit(1).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec")), 1).count()
    index.release()
    return _state(index)


def _asked(spark, d):
    return vectors(spark, d)[1].select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))


_FROM = "FROM embeddings q, embeddings b WHERE"


@query("index_search", search_sql(METRIC_SQL["euclidean"]).replace(_FROM, f"FROM embeddings q, ({CHANGED_SQL}) b WHERE"))
def _(spark, d):
    return rounded(_changed(spark, d).search(_asked(spark, d), 10), 4, "distance")


@query("index_search_filtered", search_sql(METRIC_SQL["euclidean"], "label IN ('1', 'x')", 5).replace(_FROM, f"FROM embeddings q, ({CHANGED_SQL}) b WHERE"))
def _(spark, d):
    return rounded(_changed(spark, d).search(_asked(spark, d), 5, where=F.col("metadata")["label"].isin("1", "x")), 4, "distance")


@query("index_handles", f"SELECT vec_id AS id FROM ({CHANGED_SQL}) WHERE label = 'x'")
def _(spark, d):
    return _changed(spark, d).handles(F.col("metadata")["label"] == "x")


@query("index_lookups", f"SELECT i AS id, c.vec_id IS NOT NULL AS found, c.label FROM (VALUES (0), (7), (11), (13), (77), (999999)) t(i) LEFT JOIN ({CHANGED_SQL}) c ON c.vec_id = i")
def _(spark, d):
    index = _changed(spark, d)
    ids = [0, 7, 11, 13, 77, 999999]
    found = index.contains(spark.createDataFrame([(i,) for i in ids], "id int"))
    return found.join(index.get(ids).select("id", F.col("metadata")["label"].alias("label")), "id", "left").select(F.col("id").cast("int").alias("id"), "found", "label")


@query("index_statistics", f"WITH c AS ({CHANGED_SQL}) SELECT count(*) AS vectors, count(label) AS with_metadata, {DIM} AS dimension, count(*) * {4 * DIM} AS bytes, (SELECT count(*) FROM embeddings WHERE vec_id % 7 = 0 AND vec_id % 11 <> 0) AS replaced FROM c")
def _(spark, d):
    index = _filled(spark, d)
    index.compact()
    e = vectors(spark, d)[0]
    index.remove(e.where("vec_id % 7 = 0").select(F.col("vec_id").alias("id")))
    double = e.where("vec_id % 11 = 0").withColumn("embedding", F.transform("embedding", lambda x: x * 2))
    index.insert(_labelled(double, F.lit("new")))
    return index.statistics().select("vectors", "with_metadata", "dimension", "bytes", "replaced")


@query("index_stats", f"SELECT sum(n)::BIGINT AS vectors, sum(n)::BIGINT * {4 * DIM} AS bytes, count(*) AS lists, round(avg(n), 4) AS mean_list, round(stddev_pop(n), 4) AS sd_list FROM (SELECT cluster, count(*) AS n FROM ({BEST_SQL}) GROUP BY 1)")
def _(spark, d):
    index = _filled(spark, d)
    index.centroids = label_centroids(spark, d)[1]
    index.compact()
    return rounded(index.statistics().select("vectors", "bytes", "lists", "mean_list", "sd_list"), 4, "mean_list", "sd_list")


@query("index_auto_train", "SELECT true AS trained, count(*) AS vectors FROM embeddings")
def _(spark, d):
    index = _again(_filled(spark, d, kind="ivf_auto", minimum_training=100))
    return index.rows().agg((F.count("cluster_id") == F.count("*")).alias("trained"), F.count("*").alias("vectors"))


@query("index_iteration", f"SELECT count(*) AS n, round(sum(list_sum(embedding::DOUBLE[])), 2) AS total FROM ({CHANGED_SQL})")
def _(spark, d):
    rows = [(r.id, float(np.sum(np.array(r.vec, float)))) for r in _changed(spark, d).iterate()]
    return spark.createDataFrame([(len(rows), round(sum(t for _, t in rows), 2))], "n long, total double")


# -- logs ---------------------------------------------------------------------------------

OPS = "SELECT event_id AS seq, user_id AS id, event_type, value, CASE WHEN event_type IN ('click', 'view') THEN 'insert' ELSE 'remove' END AS op FROM events WHERE user_id IS NOT NULL"
REPLAY_SQL = "SELECT id, round(arg_max(value, seq)::FLOAT::DOUBLE, 3) AS v, arg_max(event_type, seq) AS type FROM ({ops}) GROUP BY 1 HAVING arg_max(op, seq) = 'insert'"


def _written(spark, d, **options) -> ChangeLog:
    """The events' log, in three parts."""
    log = ChangeLog(spark, _folder(spark, "log"), **options)
    rows = _log(spark, d).withColumn("n", F.col("seq"))
    for k in range(3):
        log.append(rows.where(F.pmod("seq", F.lit(3)) == k), 0)
    log.flush()
    return log


def _replayed(df):
    return df.select("id", F.round(F.element_at("vec", 1).cast("double"), 3).alias("v"), F.element_at("metadata", "type").alias("type"))


@query("log_written", REPLAY_SQL.format(ops=OPS))
def _(spark, d):
    return _replayed(_written(spark, d, sync="batch").replay())


@query("log_truncated", REPLAY_SQL.format(ops=f"SELECT * FROM ({OPS}) WHERE seq <= 500"))
def _(spark, d):
    log = _written(spark, d)
    log.truncate(500)
    return _replayed(log.replay())


@query("log_compacted", REPLAY_SQL.format(ops=f"SELECT * FROM ({OPS}) WHERE seq > 500"))
def _(spark, d):
    log = _written(spark, d)
    log.compact(500)
    return _replayed(log.replay())


@query("log_statistics", f"SELECT count(*) + 1 AS entries, max(seq) + 1 AS last_seq, 1 AS checkpoints, 4 AS segments FROM ({OPS})")
def _(spark, d):
    log = _written(spark, d)
    log.checkpoint(log.statistics().first().last_seq + 1)
    return log.statistics().select("entries", "last_seq", F.col("checkpoints").cast("int").alias("checkpoints"), "segments")


# -- files, weights, reports ------------------------------------------------------------------


@query("vecfile_scan", "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, round(list_sum(embedding::DOUBLE[]), 3) AS total FROM embeddings")
def _(spark, d):
    path = _folder(spark, "vectors")
    vecfile.write(vectors(spark, d)[0], path)
    return vecfile.read(spark, path).select("id", F.round(V.vsum(V.doubles("vec")), 3).alias("total"))


@query("vecfile_range", "SELECT id, round(list_sum(embedding::DOUBLE[]), 3) AS total FROM (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, embedding FROM embeddings) WHERE id BETWEEN 100 AND 349")
def _(spark, d):
    path = _folder(spark, "vectors")
    vecfile.write(vectors(spark, d)[0], path)
    return vecfile.read(spark, path, 100, 250).select("id", F.round(V.vsum(V.doubles("vec")), 3).alias("total"))


@query("vecfile_int8", "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, list_sum(list_transform(embedding::DOUBLE[], lambda x: greatest(-128, least(127, round_even(x, 0)))))::BIGINT AS total FROM embeddings")
def _(spark, d):
    path = _folder(spark, "vectors")
    vecfile.write(vectors(spark, d)[0], path, "int8")
    return vecfile.read(spark, path).select("id", V.vsum(V.doubles("vec")).cast("long").alias("total"))


@query("weight_files", "SELECT * FROM (VALUES ('bias', 1, 16, 64::BIGINT, 120.0::DOUBLE), ('w', 16, 64, 8192::BIGINT, 523776.0::DOUBLE)) t(name, rows, columns, bytes, total)")
def _(spark, d):
    path = _folder(spark, "weights")
    weights.save(spark, {"w": np.arange(1024, dtype=np.float64).reshape(16, 64), "bias": np.arange(16, dtype=np.float32)}, path)
    held = weights.load(spark, path)
    sums = spark.createDataFrame([(n, float(t.sum())) for n, t in held.items()], "name string, total double")
    shape = F.col("shape")
    rows = weights.manifest(spark, path).select("name", F.when(F.size(shape) == 2, F.get(shape, F.lit(0))).otherwise(1).alias("rows"), F.element_at(shape, -1).alias("columns"), F.col("bytes").cast("long").alias("bytes"))
    return rows.join(sums, "name")


@query("report_saved", "SELECT l_returnflag AS name, 'mean' AS figure, round(avg(l_quantity), 4) AS value FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, 'max', max(l_quantity) FROM lineitem GROUP BY 1")
def _(spark, d):
    path = _folder(spark, "report")
    report.save(stats.basic(table(spark, d, "lineitem"), "l_quantity", ["l_returnflag"]).select("l_returnflag", "mean", "max"), "l_returnflag", path)
    held = report.load(spark, path).select("name", F.explode("figures").alias("figure", "value"))
    return held.select("name", "figure", F.round("value", 4).alias("value"))
