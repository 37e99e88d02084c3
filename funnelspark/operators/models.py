"""Models: conversion logit, topics, hidden Markov journey stages."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelspark.operators.mmm import held


def logit(df: DataFrame, features: list[str], label: str, key: str, c: float = 1.0, test: float = 0.3) -> DataFrame:
    """feature, coefficient, odds_ratio, auc of a ridge logit on z-scored features; the split is by hash of the key."""
    rows = df.select(*[F.col(f).cast("double") for f in features], F.col(label).cast("double").alias("label"), (F.pmod(F.xxhash64(key), F.lit(1000)) < test * 1000).alias("held"))
    rows = VectorAssembler(inputCols=features, outputCol="raw").transform(rows)
    train, held = rows.filter("not held"), rows.filter("held")
    n = train.count()
    if n < 2 or train.agg(F.count_distinct("label")).first()[0] < 2:
        return df.sparkSession.createDataFrame([], "feature string, coefficient double, odds_ratio double, auc double")
    scaler = StandardScaler(inputCol="raw", outputCol="x", withMean=True).fit(train)
    model = LogisticRegression(featuresCol="x", regParam=1 / (c * n), standardization=False).fit(scaler.transform(train))
    # not model.transform: the model holds its training summary and that the session, which can't be sent to tasks once an Observation was made in it
    weights = F.array(*[F.lit(float(b)) for b in model.coefficients.toArray()])
    margin = F.aggregate(F.zip_with(vector_to_array("x"), weights, lambda x, b: x * b), F.lit(float(model.intercept)), lambda a, x: a + x)
    scored = scaler.transform(held).select("label", margin.alias("margin"))
    both = scored.agg(F.count_distinct("label")).first()[0] == 2
    auc = BinaryClassificationEvaluator(rawPredictionCol="margin").evaluate(scored) if both else float("nan")
    out = [(f, float(b), float(np.exp(b)), float(auc)) for f, b in zip(features, model.coefficients.toArray(), strict=True)]
    out.sort(key=lambda r: -abs(r[1]))
    return df.sparkSession.createDataFrame(out, "feature string, coefficient double, odds_ratio double, auc double")


def topics(df: DataFrame, vector: str, key: str, k: int, seed: int = 42) -> DataFrame:
    """key, topic of k-means on an array column; -1 for all if there are fewer than 8 rows."""
    rows = df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    n = rows.count()
    if n < 8:
        return df.select(key, F.lit(-1).alias("topic"))
    k = min(k, max(2, n // 4))
    return KMeans(k=k, seed=seed).fit(rows).transform(rows).select(key, F.col("prediction").alias("topic"))


#: Symbols of the sequences of one length that are worked on at once.
BLOCK = 500_000


def _blocks(sequences: Iterable, weights: Iterable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sequences of equal length as a matrix, with their weights."""
    by_length: dict[int, list] = {}
    for seq, w in zip(sequences, weights, strict=True):
        by_length.setdefault(len(seq), []).append((seq, w))
    for n, rows in by_length.items():
        step = max(1, BLOCK // max(1, n))
        for at in range(0, len(rows) if n else 0, step):
            some = rows[at : at + step]
            yield np.array([r[0] for r in some], int), np.array([r[1] for r in some], float)


def _expected(start, move, emit, seq, weight):
    """Expected starts, moves, emissions and the log likelihood of sequences (rows of ``seq``), by forward and backward sums; ``weight`` is how often each occurs."""
    (rows, n), k = seq.shape, len(start)
    out = emit.T[seq]  # rows x n x k
    a, scale = np.zeros((rows, n, k)), np.zeros((rows, n))
    for t in range(n):
        a[:, t] = (start if t == 0 else a[:, t - 1] @ move) * out[:, t]
        scale[:, t] = a[:, t].sum(1)
        a[:, t] /= scale[:, t, None]
    o, x, b = np.zeros((emit.shape[1], k)), np.zeros((k, k)), np.ones((rows, k))
    for t in range(n - 1, -1, -1):
        g = a[:, t] * b
        g *= (weight / g.sum(1))[:, None]
        np.add.at(o, seq[:, t], g)
        if t:
            ahead = out[:, t] * b / scale[:, t, None]
            x += (a[:, t - 1] * weight[:, None]).T @ ahead * move
            b = ahead @ move.T
    return np.concatenate([g.sum(0), x.ravel(), o.T.ravel(), [(np.log(scale).sum(1) * weight).sum()]])


class Hmm:
    """Discrete hidden Markov model; the E-step runs on the partitions, only k x k sums come back."""

    def __init__(self, k: int, symbols: int):
        self.k, self.m = k, symbols
        self.start = np.full(k, 0.02 / max(1, k - 1))
        self.start[0] = 0.98 if k > 1 else 1.0
        move = np.triu(np.ones((k, k))) * 0.5 ** np.maximum(0, np.subtract.outer(np.arange(k), np.arange(k)).T)
        move += 0.02
        self.move = move / move.sum(1, keepdims=True)
        emit = np.full((k, symbols), 0.1 / symbols)
        emit[np.arange(k), np.arange(k) % symbols] += 0.9
        self.emit = emit / emit.sum(1, keepdims=True)

    def fit(self, sequences: DataFrame, col: str = "seq", rounds: int = 50, tol: float = 1e-4) -> Hmm:
        each = sequences.filter(F.size(col) > 0).groupBy(F.col(col).alias("seq")).agg(F.count("*").alias("n"))
        with held(each):  # equal sequences are worked on once, and the sequences made once
            return self._fit(each, rounds, tol)

    def _fit(self, each: DataFrame, rounds: int, tol: float) -> Hmm:
        last = -np.inf
        for _ in range(rounds):
            start, move, emit, k, m = self.start, self.move, self.emit, self.k, self.m

            def e_step(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                total = np.zeros(k + k * k + k * m + 1)  # noqa: B023
                for part in parts:
                    for seq, n in _blocks(part["seq"], part["n"]):
                        total += _expected(start, move, emit, seq, n)  # noqa: B023
                yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

            sums = each.mapInPandas(e_step, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
            v = np.zeros(k + k * k + k * m + 1)
            for r in sums:
                v[r.i] = r.v
            ll, v = v[-1] if sums else None, v[:-1] + 1e-6
            self.start = v[:k] / v[:k].sum()
            self.move = v[k : k + k * k].reshape(k, k)
            self.move /= self.move.sum(1, keepdims=True)
            self.emit = v[k + k * k :].reshape(k, m)
            self.emit /= self.emit.sum(1, keepdims=True)
            if ll is None or abs(ll - last) < tol:
                break
            last = ll
        return self

    def viterbi(self, seq) -> list[int]:
        with np.errstate(divide="ignore"):
            s, x, o = np.log(self.start), np.log(self.move), np.log(self.emit)
        seq = np.asarray(seq, int)
        if not len(seq):
            return []
        best, back = s + o[:, seq[0]], []
        for t in seq[1:]:
            step = best[:, None] + x
            back.append(step.argmax(0))
            best = step.max(0) + o[:, t]
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]

    def decode(self, sequences: DataFrame, key: str, col: str = "seq") -> DataFrame:
        """key, path (array<int>) by Viterbi."""
        kind = sequences.schema[key].dataType.simpleString()

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                seqs = [tuple(x) for x in part[col]]
                paths = {x: self.viterbi(x) for x in set(seqs)}  # equal ones once
                yield pd.DataFrame({key: part[key], "path": [paths[x] for x in seqs]})

        return sequences.select(key, col).mapInPandas(run, f"`{key}` {kind}, path array<int>")
