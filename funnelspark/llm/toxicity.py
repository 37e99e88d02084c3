"""Toxicity by a convolutional text classifier, trained in numpy.

A word is the mean of hashed embeddings: of itself and of its first 5, 6 and 7 bytes,
lower-cased, so that inflected forms share weight. Filters of widths 1, 2 and 3 run
over all words of the text; each filter's largest answer over the whole text goes
through a logistic layer. Training takes ``SAMPLE`` labelled rows of each class at
most, chosen by hash; the bias is corrected for the classes' true shares. Then a
threshold for each language maximises F1 over all labelled rows of that language that
the fit didn't see (at least one in ``SPARE``), by histograms of their scores; languages
with few of them take the one for all. It only sets ``flagged``.
``held_out`` rows take no part in the fit. Labels, language, source and id are never
inputs of a score.

Defined cases: null and empty texts score the share of toxic labels; without labels of
both classes every score is that share (0 if there are none); without unseen rows of
both classes every threshold is ``CUT``; a document labelled
twice is toxic if one label says so; repeated rows score alike, and so do ties; texts of any length are read whole; other
columns, whatever their names, are left alone; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelspark.llm.vectext import LOWER, U64, RangeHash, mix, slices, text_bytes, words
from funnelspark.llm.workspace import Workspace

#: Labelled rows of each class in the fit, at most.
SAMPLE = 1500
#: One labelled row in so many, by hash, is never in the fit; bins of the scores' histograms.
SPARE, BINS = 5, 4096
ROWS, DIM, WIDTHS, FILTERS = 1 << 15, 8, (1, 2, 3), 6
PREFIXES = (5, 6, 7)
EPOCHS, RATE, BATCH, DECAY, SEED = 5, 0.02, 64, 1e-4, 7
#: A score of this or more predicts 1.
CUT = 0.3
#: Rows of a language, toxic ones among them, that its own threshold needs.
LANG_ROWS, LANG_TOXIC = 100, 10


def word_rows(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of each word (words x 4), and each text's first word (with a last bound)."""
    data = LOWER[data]
    start, end, first = words(data, offs)
    if not len(start):
        return np.zeros((0, 1 + len(PREFIXES)), np.uint16), first
    ranges = RangeHash(data)
    hashes = [ranges(start, end)] + [mix(ranges(start, np.minimum(start + p, end)) + U64(p)) for p in PREFIXES]
    return np.stack([(h & U64(ROWS - 1)).astype(np.uint16) for h in hashes], axis=1), first


@dataclass
class Model:
    table: np.ndarray  # ROWS x DIM
    filters: np.ndarray  # (sum of widths) * FILTERS x DIM: of each width each offset
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    prior: float

    def answers(self) -> np.ndarray:
        """What each embedding row adds to each filter at each offset."""
        return (self.table @ self.filters.T / (1 + len(PREFIXES))).astype(np.float32)

    def pooled(self, rows: np.ndarray, first: np.ndarray, answers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest answer of each filter in each text before the rectifier, and the word where it is."""
        each = answers[rows[:, 0]]
        for j in range(1, rows.shape[1]):
            each += answers[rows[:, j]]
        texts, col, best, where = len(first) - 1, 0, [], []
        size = np.diff(first)
        for w in WIDTHS:
            wide = each[:, col : col + FILTERS].copy()
            for k in range(1, w):
                wide[:-k] += each[k:, col + k * FILTERS : col + (k + 1) * FILTERS]
            col += w * FILTERS
            top, at = np.full((texts, FILTERS), -np.inf, np.float32), np.zeros((texts, FILTERS), np.int64)
            for t in np.flatnonzero(size >= w).tolist():
                part = wide[first[t] : first[t + 1] - w + 1]
                i = part.argmax(axis=0)
                top[t], at[t] = part[i, np.arange(FILTERS)], i + first[t]
            best.append(top)
            where.append(at)
        return np.concatenate(best, axis=1) + self.bias, np.concatenate(where, axis=1)

    def scores(self, rows: np.ndarray, first: np.ndarray, answers: np.ndarray) -> np.ndarray:
        size = np.diff(first)
        if not len(rows):
            return np.full(len(size), self.prior)
        top, _ = self.pooled(rows, first, answers)
        score = 1 / (1 + np.exp(-np.clip(np.maximum(top, 0) @ self.out + self.out_bias, -30, 30)))
        return np.where(size > 0, score, self.prior)


def train(texts: list[np.ndarray], toxic: np.ndarray, prior: float) -> Model:
    """``texts``: embedding rows of each text. Adam on the logistic loss; gradients reach only the words that the pooling chose."""
    rng = np.random.default_rng(SEED)
    units, spans = FILTERS * len(WIDTHS), sum(WIDTHS) * FILTERS
    model = Model(rng.normal(0, 0.3, (ROWS, DIM)), rng.normal(0, 0.3, (spans, DIM)), np.zeros(units), rng.normal(0, 0.3, units), 0.0, prior)
    names = ("table", "filters", "bias", "out")
    moments = {k: [np.zeros_like(getattr(model, k)), np.zeros_like(getattr(model, k))] for k in names}
    last = [0.0, 0.0]
    step, scale = 0, 1 / (1 + len(PREFIXES))
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), BATCH):
            pick = order[a : a + BATCH]
            rows = np.concatenate([texts[i] for i in pick])
            if not len(rows):
                continue
            first = np.concatenate([[0], np.cumsum([len(texts[i]) for i in pick])])
            top, where = model.pooled(rows, first, model.answers())
            act = np.maximum(top, 0)
            p = 1 / (1 + np.exp(-np.clip(act @ model.out + model.out_bias, -30, 30)))
            err = (p - toxic[pick]) / len(pick)
            back = err[:, None] * model.out * (top > 0)
            grads = {"table": np.zeros_like(model.table), "filters": DECAY * model.filters, "bias": back.sum(0), "out": act.T @ err + DECAY * model.out}
            col = unit = 0
            for w in WIDTHS:
                for f in range(FILTERS):
                    on = np.flatnonzero(back[:, unit])
                    g = back[on, unit]
                    for k in range(w):
                        i = col + k * FILTERS + f
                        chosen = rows[where[on, unit] + k]
                        for j in range(rows.shape[1]):
                            grads["filters"][i] += scale * (g @ model.table[chosen[:, j]])
                            np.add.at(grads["table"], chosen[:, j], scale * g[:, None] * model.filters[i])
                    unit += 1
                col += w * FILTERS
            step += 1
            grow, even = 1 - 0.9**step, 1 - 0.999**step
            for k in names:
                m, v = moments[k]
                m += 0.1 * (grads[k] - m)
                v += 0.001 * (grads[k] ** 2 - v)
                getattr(model, k)[...] -= RATE * (m / grow) / (np.sqrt(v / even) + 1e-8)
            last[0] += 0.1 * (err.sum() - last[0])
            last[1] += 0.001 * (err.sum() ** 2 - last[1])
            model.out_bias -= RATE * (last[0] / grow) / (np.sqrt(last[1] / even) + 1e-8)
    share = toxic.mean()
    model.out_bias += np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "_text"):
            rows, first = word_rows(*text_bytes(part.column(2)))
            blobs = [rows[a:b].tobytes() for a, b in zip(first.tolist(), first[1:].tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(blobs, pa.binary())], ["toxic", "lang", "rows"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[Model | None, float, dict[str, float], float, DataFrame]:
    """(model, share of toxic labels, threshold of each language, threshold of the others, id_col, _lang and score of all rows)."""
    known = labels.filter(F.col(id_col).isNotNull() & ~held_out(F.col(id_col)) & F.col("toxic").isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    n = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    prior = n.get(1, 0) / max(1, sum(n.values()))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).cast("string").alias("_text"))
    scored = lambda model: rows.mapInArrow(_score(model, prior), f"`{id_col}` {kind}, _lang string, score double")
    if len(n) < 2:
        return None, prior, {}, CUT, scored(None)
    work = Workspace(docs.sparkSession, "toxicity")
    open_ = known.filter(F.pmod(F.xxhash64(F.lit(SEED), "_id"), F.lit(SPARE)) > 0)
    each = [open_.filter(F.col("toxic") == y).orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE) for y in (0, 1)]
    picked = work.write(each[0].union(each[1]), "picked")  # 2 * SAMPLE rows at most
    sample = docs.join(F.broadcast(picked), docs[id_col] == picked["_id"]).select(picked["toxic"], docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("_text"), F.xxhash64(docs[id_col]).alias("h"))
    sample = work.write(sample.orderBy("h", "_text").drop("h").mapInArrow(_rows_of, "toxic int, lang string, rows binary"), "sample").toPandas()
    sample = sample.sort_values(["rows", "toxic"], ignore_index=True)
    texts = [np.frombuffer(x, np.uint16).reshape(-1, 1 + len(PREFIXES)) for x in sample["rows"]]
    toxic = sample["toxic"].to_numpy(float)
    if not len(toxic) or not 0 < toxic.mean() < 1:
        return None, prior, {}, CUT, scored(None)
    model = train(texts, toxic, prior)
    out = work.write(scored(model), "scores")
    unseen = known.join(F.broadcast(picked.select("_id")), "_id", "left_anti")
    found = out.join(unseen, out[id_col] == unseen["_id"]).groupBy("_lang", "toxic", F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int").alias("bin")).count()
    hists: dict[str | None, np.ndarray] = {}
    for r in found.collect():  # 2 * BINS rows a language at most
        hists.setdefault(r._lang, np.zeros((2, BINS)))[r.toxic, r.bin] += r["count"]
    every = sum(hists.values(), np.zeros((2, BINS)))
    seen = every.sum(axis=1)
    if not seen.all():
        return model, prior, {}, CUT, out
    weight = np.array([1 - prior, prior]) / seen  # the fit takes more of the rarer class
    cuts = {lang: _best_cut(h, weight) for lang, h in hists.items() if lang is not None and h.sum() >= LANG_ROWS and h[1].sum() >= LANG_TOXIC}
    return model, prior, cuts, _best_cut(every, weight), out


def _best_cut(hist: np.ndarray, weight: np.ndarray) -> float:
    """The score with the best F1, halfway through the empty bins below it. hist: rows of each class and bin."""
    at = np.flatnonzero(hist.sum(axis=0))[::-1]
    rows = hist[:, at] * weight[:, None]
    f1 = 2 * np.cumsum(rows[1]) / (np.cumsum(rows.sum(axis=0)) + rows[1].sum())
    i = int(f1.argmax())
    return float((at[i] + at[i + 1] + 1) / 2 / BINS) if i + 1 < len(at) else float(at[i] / BINS)


def _score(model: Model | None, prior: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers = model.answers() if model else None
        for batch in batches:
            for part in slices(batch, "_text"):
                score = model.scores(*word_rows(*text_bytes(part.column(part.num_columns - 1))), answers) if model else np.full(part.num_rows, prior)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(score.astype(float))], [*part.schema.names[:-1], "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: id_col, held_out, score, predicted (score >= CUT), flagged (score >= its language's threshold)."""
    _, _, cuts, other, scored = fit(docs, labels, id_col, text_col, lang_col)
    cut = F.lit(other)
    for lang, c in cuts.items():
        cut = F.when(F.col("_lang") == lang, c).otherwise(cut)
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), (F.col("score") >= cut).alias("flagged"))
