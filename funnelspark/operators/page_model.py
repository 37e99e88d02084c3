"""The learned channel of the page classifier: hashed tokens of url and text, a multinomial logistic model, its votes.

Features are (place, weight) by MD5 of the token: its first eight bytes as a little-endian
number give the place modulo ``DIM`` and the sign by bit 62; a page's vector has length 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelspark.functions.url import parse_url
from funnelspark.operators.audit import top_votes
from funnelspark.sources.artifacts import read_json, write_json

DIM = 1 << 16
#: Weight of the votes, least probability of a vote, votes of a page, inverse regularisation.
WEIGHT, LEAST, VOTES, C = 2.0, 0.15, 3, 2.0
#: Samples of a fit, at most (by hash of the url); steps of the fit.
SAMPLE, ROUNDS = 20_000, 200
#: Weight of rows by where their label comes from.
SOURCES = {"synthetic": 1.0, "rule": 1.0, "weak": 1.0, "human": 3.0}


def tokens(url: Column, title: Column | None = None, text: Column | None = None) -> Column:
    """Words of the path, the site, query keys, and the first 300 words of title and text, each with the name of its place."""
    u = parse_url(F.coalesce(url, F.lit("")))
    words = lambda c: F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    named = lambda some, name: F.transform(some, lambda w: F.concat(F.lit(f"{name}:"), w))
    keys = F.filter(F.transform(F.split(u["query"], "&"), lambda p: F.substring_index(p, "=", 1)), lambda k: k != "")
    depth = F.concat(F.lit("depth:"), F.least(F.size(words(u["path"])), F.lit(6)).cast("string"))
    parts = [named(words(u["path"]), "path"), F.array(F.concat(F.lit("site:"), u["core"])), named(keys, "key"), F.array(depth)]
    parts += [named(F.slice(words(c), 1, 300), n) for c, n in ((title, "title"), (text, "text")) if c is not None]
    return F.concat(*parts)


def place(token: Column) -> Column:
    """struct<i, sign> of a token."""
    h = F.md5(token.cast("binary"))
    low = F.conv(F.concat(F.substring(h, 3, 2), F.substring(h, 1, 2)), 16, 10).cast("int")
    top = F.conv(F.substring(h, 15, 2), 16, 10).cast("int")  # the eighth byte; bit 62 is its bit 6
    return F.struct(F.pmod(low, F.lit(DIM)).alias("i"), F.when(F.shiftright(top, 6).bitwiseAND(1) == 1, 1.0).otherwise(-1.0).alias("sign"))


def hashed(words: Column) -> Column:
    """array<struct<i, w>> by place: signed counts, scaled to length 1."""
    places = F.transform(words, place)
    at = F.array_sort(F.array_distinct(F.transform(places, lambda p: p["i"])))
    sums = F.transform(at, lambda i: F.struct(i.alias("i"), F.aggregate(F.filter(places, lambda p: p["i"] == i), F.lit(0.0), lambda a, p: a + p["sign"]).alias("w")))
    kept = F.filter(sums, lambda s: s["w"] != 0)
    length = F.aggregate(kept, F.lit(0.0), lambda a, s: a + s["w"] * s["w"], F.sqrt)
    return F.transform(kept, lambda s: F.struct(s["i"].alias("i"), (s["w"] / length).alias("w")))


def with_features(pages: DataFrame) -> DataFrame:
    """``pages`` (url, and title, text if there are) with ``features``."""
    title, text = (F.col(c) if c in pages.columns else None for c in ("title", "text"))
    return pages.withColumn("features", hashed(tokens(F.col("url"), title, text)))


@dataclass
class PageModel:
    labels: list[str]
    weights: np.ndarray  # DIM x labels
    bias: np.ndarray

    def probabilities(self, places: list[np.ndarray], values: list[np.ndarray]) -> np.ndarray:
        size = np.array([len(p) for p in places], np.int64)
        out = np.zeros((len(places), len(self.labels)))
        if size.sum():
            flat = np.concatenate(values)[:, None] * self.weights[np.concatenate(places)]
            np.add.at(out, np.repeat(np.arange(len(places)), size), flat)
        out = np.exp(out + self.bias - (out + self.bias).max(axis=1, keepdims=True))
        return out / out.sum(axis=1, keepdims=True)


def train(samples: DataFrame, rounds: int = ROUNDS) -> PageModel:
    """The model of samples (url, subtype, source, ...); human rows weigh more. Adam on the penalised multinomial loss, the same for the same rows."""
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in SOURCES.items() for x in kv])[F.col("source")], F.lit(1.0))
    rows = with_features(samples.filter("subtype is not null")).select("subtype", weight.alias("w"), F.col("features.i").alias("i"), F.col("features.w").alias("v"), F.xxhash64("url").alias("h"))
    got = rows.orderBy("h", "subtype", "w").limit(SAMPLE).collect()
    labels = sorted({r.subtype for r in got})
    if not labels:
        raise ValueError("no labelled samples")
    size = np.array([len(r.i) for r in got], np.int64)
    at, value = np.array([i for r in got for i in r.i], np.int64), np.array([v for r in got for v in r.v])
    used, inner = np.unique(at, return_inverse=True)
    row = np.repeat(np.arange(len(got)), size)
    weights = np.array([r.w for r in got])
    target = np.zeros((len(got), len(labels)))
    target[np.arange(len(got)), [labels.index(r.subtype) for r in got]] = 1
    w, bias = np.zeros((len(used), len(labels))), np.zeros(len(labels))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(bias), np.zeros_like(bias)]
    for step in range(1, rounds + 1):
        score = np.zeros_like(target) + bias
        np.add.at(score, row, value[:, None] * w[inner])
        p = np.exp(score - score.max(axis=1, keepdims=True))
        err = weights[:, None] * (p / p.sum(axis=1, keepdims=True) - target) / weights.sum()
        grad = w / (C * weights.sum())
        np.add.at(grad, inner, value[:, None] * err[row])
        for x, g, m, s in ((w, grad, state[0], state[1]), (bias, err.sum(axis=0), state[2], state[3])):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            x -= 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    full = np.zeros((DIM, len(labels)))
    full[used] = w
    return PageModel(labels, full, bias)


def votes(model: PageModel, pages: DataFrame, weight: float = WEIGHT) -> DataFrame:
    """``pages`` with model_subtype (the likeliest), model_p and model_votes (map of subtype to weighted probability, as the classifier reads it)."""

    @F.pandas_udf("array<double>")
    def probabilities(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for places, values in parts:
            p = model.probabilities([np.asarray(x, np.int64) for x in places], [np.asarray(x, float) for x in values])
            yield pd.Series(list(p))

    names = F.array(*[F.lit(x) for x in model.labels])
    out = with_features(pages).withColumn("_q", probabilities("features.i", "features.w"))
    out = out.select("*", F.explode(F.array(F.zip_with(names, F.col("_q"), lambda name, v: F.struct(name.alias("name"), v.alias("p"))))).alias("_p"))  # one row; later expressions read it
    best = top_votes(F.col("_p"), VOTES, LEAST)
    table = F.map_from_entries(F.transform(F.filter("_p", lambda v: F.array_contains(best, v["name"])), lambda v: F.struct(v["name"], (v["p"] * weight).alias("w"))))
    top = F.array_max(F.transform("_p", lambda v: F.struct(v["p"].alias("p"), v["name"].alias("name"))))
    return out.withColumns({"model_votes": table, "model_subtype": top["name"], "model_p": top["p"]}).drop("features", "_p", "_q")


def disagreement(model: PageModel, pages: DataFrame, stored: str = "page_subtype") -> DataFrame:
    """Pages whose bare url the model takes for another subtype than the stored one."""
    told = votes(model, pages.select("url").distinct()).select("url", "model_subtype", "model_p")
    return pages.join(told, "url").filter(~F.col("model_subtype").eqNullSafe(F.col(stored)))


def cross_validated(samples: DataFrame, folds: int = 5, rounds: int = ROUNDS) -> DataFrame:
    """fold, n, accuracy; a url's rows are in one fold, so no fold has seen its pages."""
    fold = F.pmod(F.xxhash64("url"), F.lit(folds))
    out = []
    for k in range(folds):
        told = votes(train(samples.filter(fold != k), rounds), samples.filter(fold == k))
        r = told.agg(F.count("*").alias("n"), F.avg((F.col("model_subtype") == F.col("subtype")).cast("double")).alias("a")).first()
        out.append((k, r.n, r.a))
    return samples.sparkSession.createDataFrame(out, "fold int, n long, accuracy double")


def save(spark: SparkSession, model: PageModel, path: str, version: int = 1) -> None:
    """Weights that aren't 0 as a table, then what they are, which makes the model whole."""
    i, k = np.nonzero(model.weights)
    rows = pd.DataFrame({"i": i, "k": k, "w": model.weights[i, k]})
    spark.createDataFrame(rows, "i long, k long, w double").write.mode("overwrite").parquet(f"{path}/weights")
    write_json(spark, f"{path}/model.json", {"labels": model.labels, "bias": model.bias.tolist(), "version": version, "dim": DIM})


def load(spark: SparkSession, path: str, version: int = 1) -> PageModel | None:
    """The model, or None without one of this version: the classifier goes on without its channel."""
    told = read_json(spark, f"{path}/model.json")
    if not told or told.get("version") != version or told.get("dim") != DIM:
        return None
    rows = spark.read.parquet(f"{path}/weights").toPandas()  # as many as the fit's sample has features
    weights = np.zeros((DIM, len(told["labels"])))
    weights[rows["i"], rows["k"]] = rows["w"]
    return PageModel(told["labels"], weights, np.array(told["bias"]))
