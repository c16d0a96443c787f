"""Projections with learned weights: distances, attention, neural codes. One matrix product an Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veclume.functions import vector as V
from veclume.plans.blocked import knn, matrix


def xavier(rows: int, columns: int, seed: int, scale: float = 1.0) -> np.ndarray:
    """Normal weights of standard deviation scale sqrt(2 / (rows + columns)); seeded."""
    return np.random.default_rng(seed).standard_normal((rows, columns)) * scale * np.sqrt(2.0 / (rows + columns))


def project(df: DataFrame, weights: np.ndarray, vec: str = "embedding", out: str = "projected", bias: np.ndarray | None = None, activation: str = "none", normalize: bool = False) -> DataFrame:
    """Adds activation(W x + b), of unit length if wanted; one narrow pass. Null vectors give null."""
    held = df.sparkSession.sparkContext.broadcast((weights, bias))
    at = df.columns.index(vec)
    names = [*df.columns, out]
    acts = {"none": lambda x: x, "relu": lambda x: np.maximum(x, 0), "tanh": np.tanh, "sigmoid": lambda x: 1 / (1 + np.exp(-x)), "gelu": lambda x: 0.5 * x * (1 + np.tanh(0.7978845608028654 * (x + 0.044715 * x**3)))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = held.value
        for batch in batches:
            known = batch.column(at).is_valid().to_numpy(zero_copy_only=False)
            x = matrix(batch.column(at).filter(pa.array(known)), w.shape[1])
            y = acts[activation](x @ w.T + (0 if b is None else b))
            if normalize:
                size = np.sqrt((y * y).sum(axis=1, keepdims=True))
                y = np.where(size > 1e-8, y / np.where(size > 1e-8, size, 1), 0)
            rows = np.full(len(batch), None, object)
            rows[np.flatnonzero(known)] = list(y)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(rows), pa.list_(pa.float64()))], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` array<double>"
    return df.mapInArrow(run, schema)


def learned_distance(a: str, b: str, metric: str = "euclidean") -> Column:
    """Between projected columns: l2 or cosine."""
    return V.l2(a, b) if metric == "euclidean" else V.cosine_distance(a, b)


def attention(query: str, key: str, heads: int, head_dim: int, temperature: float | None = None, sigmoid: bool = False) -> Column:
    """Mean over heads of (q . k) / T of projected columns of heads x head_dim numbers; T: sqrt(head_dim)."""
    t = temperature or head_dim**0.5
    score = F.lit(0.0)
    for h in range(heads):
        s = V.dot(F.slice(query, h * head_dim + 1, head_dim), F.slice(key, h * head_dim + 1, head_dim)) / t
        score = score + (1 / (1 + F.exp(-s)) if sigmoid else s)
    return score / heads


def distance(df: DataFrame, a: str, b: str, weights: np.ndarray | None = None, metric: str = "euclidean", out: str = "distance", force_standard: bool = False) -> DataFrame:
    """Adds the distance of two vector columns and the mode: between projections if there are weights, else between the vectors."""
    if weights is None or force_standard:
        return df.withColumn(out, learned_distance(a, b, metric)).withColumn("mode", F.lit("standard"))
    both = project(project(df, weights, a, "__pa"), weights, b, "__pb")
    return both.withColumn(out, learned_distance("__pa", "__pb", metric)).withColumn("mode", F.lit("learned")).drop("__pa", "__pb")


def search(db: DataFrame, queries: DataFrame, k: int, weights: np.ndarray | None = None, metric: str = "euclidean", vec: str = "embedding") -> DataFrame:
    """(query_id, rank, id, distance) of the k nearest, between projections if there are weights, else between the vectors."""
    if weights is not None:
        db, queries = (project(d, weights, vec, "__p").drop(vec).withColumnRenamed("__p", vec) for d in (db, queries))
    return knn(db, queries, k, metric, vec=vec)


def attention_topk(keys: DataFrame, queries: DataFrame, k: int, query_weights: np.ndarray, key_weights: np.ndarray, heads: int, temperature: float | None = None, sigmoid: bool = False, vec: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the k keys with the greatest attention of each query, ties by id."""
    dim = len(key_weights) // heads
    t = temperature or dim**0.5

    def less(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        s = (x * y).reshape(len(x), heads, dim).sum(axis=2) / t
        return -(1 / (1 + np.exp(-s)) if sigmoid else s).mean(axis=1)

    db = project(keys, key_weights, vec, "__p").drop(vec).withColumnRenamed("__p", vec)
    asked = project(queries, query_weights, vec, "__p").drop(vec).withColumnRenamed("__p", vec)
    return knn(db, asked, k, less, vec=vec).select("query_id", "rank", "id", (-F.col("distance")).alias("score"))


def neural_encode(df: DataFrame, weights: np.ndarray, bias: np.ndarray, vec: str = "embedding", normalize: bool = True) -> DataFrame:
    """Adds code STRUCT<q, scale>: relu(W x + b), unit length if wanted, 8-bit symmetric codes."""
    p = project(df, weights, vec, "__h", bias, "relu", normalize)
    scale = F.greatest(F.array_max(F.transform("__h", F.abs)) / 127, F.lit(1e-8))
    q = F.transform("__h", lambda x: F.least(F.greatest(F.rint(x / scale), F.lit(-128)), F.lit(127)).cast("smallint"))
    return p.withColumn("code", F.when(F.col("__h").isNotNull(), F.struct(q.alias("q"), scale.alias("scale")))).drop("__h")


def neural_decode(df: DataFrame, weights: np.ndarray, bias: np.ndarray, out: str = "decoded") -> DataFrame:
    """Adds W' (q scale) + b'."""
    latent = df.withColumn("__h", F.transform("code.q", lambda x: x * F.col("code.scale")))
    return project(latent, weights, "__h", out, bias).drop("__h")
