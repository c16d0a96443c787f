"""Class-based TF-IDF: tf x ln(1 + average cluster size / corpus frequency)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veclume.operators.topk import topk


def term_frequencies(docs: DataFrame, cluster: str, text: str = "text") -> DataFrame:
    """(cluster, term, tf): lower-cased runs of letters; partial sums before the shuffle."""
    terms = F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"([a-zà-ÿß]+)"), F.lit(1)))
    return docs.where(F.col(cluster).isNotNull()).select(F.col(cluster).alias("cluster"), terms.alias("term")).groupBy("cluster", "term").agg(F.count("*").cast("double").alias("tf"))


def ctfidf(tf: DataFrame, corpus: DataFrame | None = None, average: float | None = None) -> DataFrame:
    """Adds score to (cluster, term, tf). corpus: (term, corpus_tf), average: cluster size; else taken from tf."""
    corpus = corpus if corpus is not None else tf.groupBy("term").agg(F.sum("tf").alias("corpus_tf"))
    if average is None:
        average = tf.agg(F.sum("tf") / F.count_distinct("cluster")).first()[0] or 0.0
    score = F.col("tf") * F.log1p(F.lit(float(average)) / F.greatest("corpus_tf", F.lit(1.0)))
    return tf.join(corpus, "term").withColumn("score", score)


def top_terms(scored: DataFrame, k: int) -> DataFrame:
    return topk(scored, "cluster", [F.desc("score"), F.col("term")], k)
