"""Index lifecycle, logs, files and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veclume.plans.index import IndexConfig, VectorIndex
from veclume.sources import vecfile, weights
from veclume.sources.changelog import ChangeLog
from veclume.streaming.topk import StreamingTopK, sessions, windowed

RNG = np.random.default_rng(5)


def rows(spark, n, first=0, dim=4):
    return spark.createDataFrame([(first + i, RNG.normal(size=dim).tolist(), {"kind": "ab"[i % 2]}) for i in range(n)], "id long, vec array<float>, metadata map<string,string>")


def test_lifecycle(spark, tmp_path):
    index = VectorIndex(spark, f"file://{tmp_path}/ix", IndexConfig(4, routing_threshold=10))
    data = rows(spark, 60).cache()
    assert index.insert(data) == 60
    query = data.where("id = 7").select(F.col("id").alias("query_id"), "vec")
    assert index.search(query, 1).first().id == 7
    assert index.remove(spark.createDataFrame([(7,), (8,), (999,)], "id long")) == 2
    assert index.rows().count() == 58 and index.search(query, 1).first().id != 7
    assert index.set_metadata(spark.createDataFrame([(9, {"kind": "z"})], "id long, metadata map<string,string>")) == 1
    assert [r.id for r in index.handles(F.col("metadata")["kind"] == "z").collect()] == [9]
    found = index.search(query, 3, where=F.col("metadata")["kind"] == "a").collect()
    assert len(found) == 3 and all(r.id % 2 == 0 for r in found)
    assert index.train(4) == 1 and index.statistics().first().lists <= 4
    index.insert(rows(spark, 5, first=100))
    again = VectorIndex.open(spark, f"file://{tmp_path}/ix", index.config)
    assert again.rows().count() == 63 and again.seq == index.seq and again.centroids.shape == (4, 4)
    exact = sorted(tuple(r) for r in again.search(query, 5, nprobe=4).collect())
    assert [r[2] for r in exact] == [r.id for r in again.search(query, 5, where=F.lit(True)).orderBy("rank").collect()]
    got = {r.id: r.found for r in again.contains(spark.createDataFrame([(8,), (100,)], "id long")).collect()}
    assert got == {8: False, 100: True} and again.get([100]).first().hints.norm > 0
    with pytest.raises(Exception, match="dimension"):
        index.insert(rows(spark, 1, first=500, dim=3))


def test_config():
    for bad in ({"dimension": 0}, {"dimension": 2, "kind": "ivf", "nlist": 4, "nprobe": 5}, {"dimension": 2, "kind": "x"}):
        with pytest.raises(ValueError):
            IndexConfig(**bad)


def test_log(spark, tmp_path):
    log = ChangeLog(spark, f"file://{tmp_path}/log")
    make = lambda ops: spark.createDataFrame([(o, i, [1.0 * n], {"n": str(n)}, n) for n, (o, i) in enumerate(ops)], "op string, id long, vec array<float>, metadata map<string,string>, n long")
    log.append(make([("insert", 1), ("insert", 2), ("remove", 1), ("insert", 1)]), 0)
    log.append(make([("remove", 2), ("metadata", 1)]), 4)
    state = [tuple(r) for r in log.replay().collect()]
    assert state == [(1, [3.0], {"n": "1"})] == [tuple(r) for r in log.replay().collect()]
    assert (len(log.segments()), log.statistics().first().segments) == (2, 2) and log.statistics().first().bytes > 0
    log._read().withColumn("vec", F.array(F.lit(9.0).cast("float"))).write.parquet(f"file://{tmp_path}/bad/segment-000000-x")
    log.truncate(3)
    assert sorted(r.id for r in log.replay().collect()) == [1, 2] and len(log.segments()) == 1
    log.append(make([("remove", 2), ("metadata", 1)]), 4)
    log.checkpoint(6)
    log.compact(3)
    assert tuple(log.statistics().first())[:4] == (3, 6, 1, 1)
    late = ChangeLog(spark, f"file://{tmp_path}/late", "batch", 3)
    for k in range(5):
        late.append(make([("insert", k)]), k)
    assert len(late.segments()) == 1 and late.statistics().first().entries == 3
    late.flush()
    for k in range(5, 60):
        late.append(make([("insert", k)]), k)
    late.flush()
    assert late.statistics().first().entries == 60 and len(late.segments()) <= 11
    with pytest.raises(Exception, match="checksum"):
        ChangeLog(spark, f"file://{tmp_path}/bad").replay().collect()


@pytest.mark.parametrize("kind", ["float32", "float16", "int8", "uint8"])
def test_vector_files(spark, tmp_path, kind):
    x = np.abs(RNG.normal(size=(25, 3)) * 20).round()
    (tmp_path / "v.bin").write_bytes(vecfile.encode(x, kind))
    got = vecfile.read(spark, f"{tmp_path}/v.bin").orderBy("id").collect()
    assert np.allclose([r.vec for r in got], x, rtol=1e-3)
    assert [r.id for r in vecfile.read(spark, f"{tmp_path}/v.bin", 5, 4).orderBy("id").collect()] == [5, 6, 7, 8]
    assert vecfile.read_binary(spark, f"{tmp_path}/v.bin").count() == 25
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    for again in range(2):  # written over the first time's files
        vecfile.write(df.repartition(3).unionByName(df.where("vec_id < 0")), f"file://{tmp_path}/out", kind)
        got = vecfile.read(spark, f"{tmp_path}/out").orderBy("id").collect()
        assert [r.id for r in got] == list(range(25)) and np.allclose([r.vec for r in got], x, rtol=1e-3)
    assert [r.id for r in vecfile.read(spark, f"{tmp_path}/out", 9, 8).orderBy("id").collect()] == list(range(9, 17))
    assert vecfile.read_binary(spark, f"file://{tmp_path}/out/*.vec").count() == 25 and not [f for f in (tmp_path / "out").iterdir() if f.name.startswith("_part")]
    vecfile.write_parts(df, f"{tmp_path}/parts", kind)
    assert sum(r.rows for r in spark.read.parquet(f"{tmp_path}/parts").collect()) == 25


def test_weights(spark, tmp_path):
    t = {"w": RNG.normal(size=(2, 3)).astype(np.float32), "b": np.arange(3, dtype=np.int8)}
    weights.save(spark, t, f"{tmp_path}/w")
    got = weights.load(spark, f"{tmp_path}/w")
    assert all((got[k] == t[k]).all() for k in t) and weights.broadcast_compatible((3, 1), (2, 3, 4))


def test_streaming_topk(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").limit(90)
    e.repartition(3).write.parquet(f"{tmp_path}/in")
    q = e.where("vec_id % 20 = 0")
    run = StreamingTopK(spark, f"{tmp_path}/state", q, 4)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run.start(stream, f"{tmp_path}/cp").awaitTermination()
    from veclume.plans.blocked import knn

    want = sorted(tuple(r) for r in knn(e, q, 4).collect())
    assert sorted(tuple(r) for r in run.result().collect()) == want
    run.update(e, run.last + 1)
    assert sorted(tuple(r) for r in run.result().collect()) == want


def test_event_time(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    assert windowed(events, "ts", "event_type", "value").agg(F.sum("n")).first()[0] == events.where("ts is not null").count()
    assert sessions(events, "ts", "user_id").count() > 0
