"""Marketing-mix model: design columns in Spark, small linear algebra on one aggregated row."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelspark.functions import stats as S


@contextmanager
def held(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` cached while several passes read it, so that its plan runs once; one that is cached already stays so."""
    mine = not (df.storageLevel.useMemory or df.storageLevel.useDisk)
    try:
        yield df.persist() if mine else df
    finally:
        if mine:
            df.unpersist()


def week_index(df: DataFrame, week: str = "week") -> DataFrame:
    """Dense rank of the week from 0. The distinct weeks are ranked, not the rows."""
    weeks = df.select(week).distinct().withColumn("week_index", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(week)) - 1).cast("long"))
    return df.join(weeks, week)


def adstock(df: DataFrame, col: str, keys: list[str], order: str, decay: float) -> DataFrame:
    """a[t] = x[t] + decay * a[t-1] in each series, as ``{col}_adstock``. A series is bounded by its weeks."""
    rest = [c for c in df.columns if c not in keys]
    series = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in rest if c != order]))).alias("s"))
    x = F.transform("s", lambda r: F.coalesce(r[col].cast("double"), F.lit(0.0)))
    start = F.array().cast("array<double>")
    run = F.aggregate(x, start, lambda acc, v: F.array_append(acc, v + decay * F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0))))
    rows = series.select(*keys, F.explode(F.arrays_zip("s", run.alias("a"))).alias("z"))
    return rows.select(*keys, *[F.col(f"z.s.{c}").alias(c) for c in rest], F.col("z.a").alias(f"{col}_adstock"))


def hill(df: DataFrame, col: str, shape: float = 1.0) -> DataFrame:
    """x^s / (x^s + h^s) as ``{col}_hill``; h is the mean of the whole column's positive values."""
    half = df.agg(F.greatest(F.coalesce(F.avg(F.when(F.col(col) > 0, F.col(col))), F.lit(1.0)), F.lit(1e-9)).alias("_h"))
    x = F.pow(F.greatest(F.col(col), F.lit(0.0)), F.lit(shape))
    return df.crossJoin(F.broadcast(half)).withColumn(f"{col}_hill", x / (x + F.pow("_h", F.lit(shape)))).drop("_h")  # half is one row


def fourier(t: Column, period: int = 52, harmonics: int = 2) -> dict[str, Column]:
    angle = lambda k: t.cast("double") * (2 * math.pi * k / period)
    return {f"seas_{n}{k}": f(angle(k)) for k in range(1, harmonics + 1) for n, f in (("sin", F.sin), ("cos", F.cos))}


def trend(df: DataFrame, col: str = "week_index") -> DataFrame:
    m = df.agg(F.avg(col).alias("_m"), F.greatest(F.stddev_pop(col), F.lit(1e-9)).alias("_s"))
    return df.crossJoin(F.broadcast(m)).withColumn("trend", (F.col(col) - F.col("_m")) / F.col("_s")).drop("_m", "_s")  # m is one row


def design(sales: DataFrame, exposure: DataFrame, media: DataFrame, keys: list[str]) -> DataFrame:
    """Every sales cell with exposure (rates averaged, counts summed over the rest) and media spend; what is missing is 0."""
    rate = {"ai_share_of_voice", "exposure_rate"}
    agg = [(F.avg if c in rate else F.sum)(c).alias(c) for c in exposure.columns if c not in keys and dict(exposure.dtypes)[c] in ("double", "bigint", "int")]
    out = sales.join(exposure.groupBy(*keys).agg(*agg), keys, "left")
    on = [k for k in keys if k in media.columns]
    spend = [c for c in media.columns if c not in on]
    out = out.join(media.groupBy(*on).agg(*[F.sum(c).alias(c) for c in spend]), on, "left")
    filled = [c for c in out.columns if c not in sales.columns]
    return week_index(out.na.fill(0, filled))


def gram(df: DataFrame, cols: list[str], target: str) -> tuple[np.ndarray, np.ndarray, float, float, int]:
    """X'X, X'y, y'y, sum of y and n of cols and an intercept, by one aggregate; a row of k * k sums reaches the driver."""
    xs = [F.col(c).cast("double") for c in cols] + [F.lit(1.0)]
    y = F.col(target).cast("double")
    k = len(xs)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = df.agg(*[F.sum(xs[i] * xs[j]).alias(f"g{i}_{j}") for i, j in pairs], *[F.sum(xs[i] * y).alias(f"m{i}") for i in range(k)], F.sum(y * y).alias("yy"), F.count("*").alias("n")).first()
    g = np.zeros((k, k))
    for i, j in pairs:
        g[i, j] = g[j, i] = row[f"g{i}_{j}"] or 0.0
    m = np.array([row[f"m{i}"] or 0.0 for i in range(k)])
    return g, m, float(row["yy"] or 0.0), float(m[-1]), int(row["n"])


def fit(df: DataFrame, cols: list[str], target: str, free: tuple[str, ...] = (), ridge: float = 1.0, prior: tuple[str, float, float] | None = None) -> dict[str, float]:
    """Coefficients (intercept included), unpenalised for ``free`` and the intercept; prior (column, mean, strength)."""
    g, m, *_ = gram(df, cols, target)
    penalty = np.array([0.0 if c in free else ridge for c in cols] + [0.0])
    b = S.penalised_ls(g, m, penalty, (cols.index(prior[0]), prior[1], prior[2]) if prior else None)
    return dict(zip([*cols, "intercept"], map(float, b), strict=True))


def vif(df: DataFrame, cols: list[str]) -> dict[str, float]:
    """Variance inflation of each column: the diagonal of the inverse correlation matrix; infinite for constants."""
    g, _, _, _, n = gram(df, cols, cols[0])
    mean = g[-1, :-1] / n
    cov = g[:-1, :-1] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    ok = sd > 1e-12
    out = dict.fromkeys(cols, float("inf"))
    if ok.any():
        inverse = np.linalg.pinv(cov[np.ix_(ok, ok)] / np.outer(sd[ok], sd[ok]))
        out |= {c: float(v) for c, v in zip(np.array(cols)[ok].tolist(), np.diag(inverse), strict=True)}
    return out


def two_stage(df: DataFrame, drivers: list[str], mediator: str, target: str, ridge: float = 1.0) -> dict[str, tuple[float, float, float]]:
    """Direct and indirect (through the mediator) effect of each driver, and the indirect share."""
    with held(df):
        first, second = fit(df, drivers, mediator, ridge=ridge), fit(df, [*drivers, mediator], target, ridge=ridge)
    out = {}
    for d in drivers:
        direct, indirect = second[d], first[d] * second[mediator]
        whole = abs(direct) + abs(indirect)
        out[d] = (direct, indirect, abs(indirect) / whole if whole else 0.0)
    return out


def predicted(df: DataFrame, b: dict[str, float]) -> DataFrame:
    value = sum((F.col(c).cast("double") * v for c, v in b.items() if c != "intercept"), F.lit(b["intercept"]))
    return df.withColumn("predicted", value)


def accuracy(df: DataFrame, target: str) -> DataFrame:
    """R squared (null for a constant target) and MAPE over non-zero targets."""
    y, e = F.col(target).cast("double"), F.col(target).cast("double") - F.col("predicted")
    total = F.sum(y * y) - F.sum(y) * F.sum(y) / F.count("*")
    return df.agg((1 - F.try_divide(F.sum(e * e), F.nullif(total, F.lit(0.0)))).alias("r2"), F.avg(F.abs(F.try_divide(e, F.nullif(y, F.lit(0.0))))).alias("mape"))


def holdout_fit(df: DataFrame, cols: list[str], target: str, weeks: int = 8, free: tuple[str, ...] = (), ridge: float = 1.0, prior: tuple[str, float, float] | None = None, week: str = "week_index") -> tuple[DataFrame, dict[str, float | None]]:
    """Fit on all but the last weeks. (feature, coefficient, contribution, contribution_share) over all rows, and r2_train, r2_holdout, mape_holdout, n_train, n_holdout.

    All weeks train if holding out would leave only the first.
    """
    with held(df):
        return _holdout_fit(df, cols, target, weeks, free, ridge, prior, week)


def _holdout_fit(df: DataFrame, cols: list[str], target: str, weeks: int, free: tuple[str, ...], ridge: float, prior: tuple[str, float, float] | None, week: str) -> tuple[DataFrame, dict[str, float | None]]:
    ends = df.agg(F.min(week).alias("a"), F.max(week).alias("b")).first()
    cut = ends.b - weeks if ends.b is not None and weeks and ends.b - weeks > ends.a else ends.b
    train = F.col(week) <= F.lit(cut)
    b = fit(df.filter(train), cols, target, free, ridge, prior)
    told = predicted(df, b)
    sums = told.agg(*[F.sum(F.col(c).cast("double")).alias(c) for c in cols], F.count("*").alias("_n"), F.sum("predicted").alias("_total"), F.count(F.when(train, 1)).alias("_train")).first()
    rows = [(c, v, v * (sums["_n"] if c == "intercept" else sums[c] or 0.0)) for c, v in b.items()]
    total = sums["_total"] or 0.0
    spark = df.sparkSession
    coefficients = spark.createDataFrame([(*r, r[2] / total if total else None) for r in rows], "feature string, coefficient double, contribution double, contribution_share double")
    inside, outside = accuracy(told.filter(train), target).first(), accuracy(told.filter(~train), target).first()
    report = {"r2_train": inside.r2, "r2_holdout": outside.r2, "mape_holdout": outside.mape, "n_train": sums["_train"], "n_holdout": sums["_n"] - sums["_train"]}
    return coefficients, report


def compare_variables(df: DataFrame, candidates: list[str], controls: list[str], target: str, weeks: int = 8, limit: float = 10.0) -> DataFrame:
    """The same model with each candidate in turn: its share, sign, inflation, holdout R squared and a verdict."""
    out = []
    with held(df):
        for c in candidates:
            coefficients, report = holdout_fit(df, [c, *controls], target, weeks)
            own = coefficients.filter(F.col("feature") == c).first()  # a row for each feature
            inflation = vif(df, [c, *controls])[c]
            verdict = "wrong sign, unusable" if own.coefficient < 0 else "collinear, fragile" if inflation > limit else "well-conditioned"
            out.append((c, own.contribution_share, "+" if own.coefficient >= 0 else "-", inflation, report["r2_holdout"], verdict))
    return df.sparkSession.createDataFrame(out, "variable string, contribution_share double, sign string, vif double, r2_holdout double, verdict string")


def prior_from_total(df: DataFrame, col: str, incremental: float, strength: float = 1.0) -> tuple[str, float, float] | None:
    """The prior (column, mean, strength in rows) under which the column's contribution is the bridge's incremental total; None if the column has no mass."""
    r = df.agg(F.sum(F.col(col).cast("double")).alias("s"), F.count("*").alias("n")).first()
    return (col, incremental / r.s, strength * r.n) if r.s and r.s > 0 else None
