"""Sparse-feature logistic classification: training in sequence, scoring alone and in ensembles, and AUC."""

from __future__ import annotations

from collections.abc import Iterator
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.operators.postings import pack_integers, unpack_integers

DELTA = 0.002


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose features, the last column, are different numbers from 0 in order, as gaps, each with its repeats."""
    for b in batches:
        data = []
        for features in b.column(3).to_pylist():
            found, times = np.unique(np.array(features or [], np.int64), return_counts=True)
            data.append(pack_integers(np.stack([np.diff(found, prepend=0), times], axis=1).ravel())[0].tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(data, pa.binary())], names=["k", "doc_id", "spam", "data"])


def train(instances: DataFrame, seed: int | None = None, delta: float = DELTA) -> DataFrame:
    """(feature, weight): one pass of stochastic gradient descent over (doc_id, label, features), in order of the id, or
    in a seeded shuffle.  Each instance is scored once and updates the weight of each of its features, repeats included.

    The pass is sequential by its nature, so one task runs it; rows are streamed through it in sorted order (the sort
    spills), and it holds the weights only.  The tasks before pack each row's features, as gaps and repeats of seven bits a
    byte, so that the one task reads little more than a byte a feature.
    """
    key = F.col("doc_id") if seed is None else F.xxhash64(F.lit(seed), F.col("doc_id"))
    id_type = instances.schema["doc_id"].dataType.simpleString()
    rows = instances.select(key.alias("k"), "doc_id", (F.col("label").eqNullSafe("spam")).alias("spam"), "features")
    packed = rows.mapInArrow(_pack, f"k {'long' if seed is not None else id_type}, doc_id {id_type}, spam boolean, data binary")
    packed = packed.repartition(1).sortWithinPartitions("k", "doc_id").select("spam", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w: dict[int, float] = {}
        for b in batches:
            for spam, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                pairs = unpack_integers(np.frombuffer(data, np.uint8)).reshape(-1, 2)
                features, times = np.cumsum(pairs[:, 0]).tolist(), pairs[:, 1].tolist()
                score = sum(w.get(f, 0.0) * n for f, n in zip(features, times, strict=True))
                step = ((1.0 if spam else 0.0) - 1.0 / (1.0 + exp(-max(-700.0, min(700.0, score))))) * delta
                for f, n in zip(features, times, strict=True):
                    w[f] = w.get(f, 0.0) + n * step
        keys = sorted(w)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([w[k] for k in keys], pa.float64())], names=["feature", "weight"])

    return packed.mapInArrow(run, "feature int, weight double")


def _scores(instances: DataFrame, models: DataFrame) -> DataFrame:
    """(model_id, doc_id, label, score) of each model; features that a model lacks count 0."""
    flat = instances.select("doc_id", "label", F.explode("features").alias("feature")).groupBy("doc_id", "label", "feature").agg(F.count(F.lit(1)).alias("times"))
    hit = flat.join(models, "feature").groupBy("model_id", "doc_id").agg(F.sum(F.col("times") * F.col("weight")).alias("score"))
    return hit


def apply_model(instances: DataFrame, model: DataFrame) -> DataFrame:
    """(doc_id, label, score, class): spam above 0."""
    got = _scores(instances, model.withColumn("model_id", F.lit(0))).select("doc_id", "score")
    out = instances.select("doc_id", "label").join(got, "doc_id", "left").withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 6))
    return out.select("doc_id", "label", "score", F.when(F.col("score") > 0, "spam").otherwise("ham").alias("class"))


def apply_ensemble(instances: DataFrame, models: DataFrame, method: str, n_models: int = 3) -> DataFrame:
    """(doc_id, label, score, class) by the mean of the models' scores (``average``) or by their votes (anything else).

    A score of exactly 0 votes against spam.
    """
    got = _scores(instances, models)
    if method == "average":
        got = got.groupBy("doc_id").agg(F.sum("score").alias("total"))
        score = F.round(F.coalesce("total", F.lit(0.0)) / n_models, 6)
    else:
        got = got.groupBy("doc_id").agg(F.sum(F.when(F.round("score", 9) > 0, 1).otherwise(0)).alias("total"))
        score = (2 * F.coalesce("total", F.lit(0)) - n_models).cast("double")
    out = instances.select("doc_id", "label").join(got, "doc_id", "left").withColumn("score", score)
    return out.select("doc_id", "label", "score", F.when(F.col("score") > 0, "spam").otherwise("ham").alias("class"))


def one_minus_auc(scored: DataFrame, step: float = 0.25) -> DataFrame:
    """(one_minus_auc_pct): 100 (1 - AUC) by ranks, ties halved.

    Distinct scores are counted first; running counts are taken within ranges of scores and over the few ranges, so no
    task orders all scores.
    """
    spam = (F.col("label") == "spam").cast("long")
    points = scored.groupBy("score").agg(F.sum(spam).alias("pos"), F.sum(1 - spam).alias("neg")).withColumn("part", F.floor(F.col("score") / step))
    parts = points.groupBy("part").agg(F.sum("neg").alias("part_neg"))
    below = F.sum("part_neg").over(W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(below, F.lit(0)).alias("base"))
    inner = F.coalesce(F.sum("neg").over(W.partitionBy("part").orderBy("score").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = points.withColumn("inner", inner).join(parts, "part")
    won = F.sum(F.col("pos") * (F.col("base") + F.col("inner") + 0.5 * F.col("neg")))
    return rows.agg(F.round(100 * (1 - won / (F.sum("pos") * F.sum("neg"))), 6).alias("one_minus_auc_pct"))
