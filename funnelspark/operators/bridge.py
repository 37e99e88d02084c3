"""Sales bridge: projected exposure to influenced sales through ranged factors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelspark import vocab
from funnelspark.functions import stats as S

CHAIN = list(vocab.LEDGER)[:8]


def ledger_frame(spark, ledger: dict = vocab.LEDGER) -> DataFrame:
    """name, value, low, high, status; a row needs low <= value <= high."""
    for name, (value, low, high, _) in ledger.items():
        if not low <= value <= high:
            raise ValueError(f"{name}: {value} is outside {low} to {high}")
    return spark.createDataFrame([(k, *v) for k, v in ledger.items()], "name string, value double, low double, high double, status string")


def provenance(ledger: DataFrame) -> DataFrame:
    """Factors, their names and mean relative width by status."""
    width = F.try_divide(F.col("high") - F.col("low"), F.nullif("value", F.lit(0.0)))
    return ledger.groupBy("status").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"), F.bround(F.avg(width), 4).alias("mean_relative_width"))


def join_sales(exposure: DataFrame, sales: DataFrame, dims: list[str]) -> DataFrame:
    """Inner join on the dimensions that ``sales`` has, and brand; category_sales_value is the cell's total unless given."""
    key = [c for c in (*dims, "brand") if c in sales.columns]
    if "brand" not in key:
        raise ValueError("sales needs a brand")
    out = exposure.join(sales, key)
    if "category_sales_value" not in sales.columns:
        out = out.withColumn("category_sales_value", F.sum("sales_value").over(Window.partitionBy(*[c for c in key if c != "brand"])))
    return out


def chain(projected: Column, p: Column, f: dict[str, Column]) -> Column:
    """Influenced sales value, bottom-up."""
    exposed = projected / F.greatest(f["device_coverage"], F.lit(1e-9)) * f["panel_representativeness"] * f["window_recovery"]
    orders = exposed * p * f["cart_to_order"] * f["cross_device_completion"]
    return orders * f["ropo_multiplier"] * f["basket_value"] * f["brand_match_precision"]


def topdown_share(users: Column, category_value: Column, exposure_rate: Column, f: dict[str, Column]) -> Column:
    """Influenced share from the market side; null without users."""
    reached = users / F.greatest(f["device_coverage"], F.lit(1e-9)) * f["panel_representativeness"]
    occasions = category_value / F.greatest(f["basket_value"], F.lit(1e-9))
    return F.least(F.greatest(reached / F.greatest(occasions, F.lit(1e-9)), F.lit(0.0)), F.lit(1.0)) * exposure_rate * f["influence_given_exposure"]


def central(ledger: dict = vocab.LEDGER) -> dict[str, Column]:
    return {k: F.lit(float(v[0])) for k, v in ledger.items()}


def drawn(i: Column, n: int, ledger: dict = vocab.LEDGER, only: str | None = None) -> dict[str, Column]:
    """Factors of draw i: stratified triangular draws, each factor with its own permutation; with ``only``, the others stay central."""
    out = central(ledger)
    for j, (name, (value, low, high, _)) in enumerate(ledger.items()):
        if only in (None, name):
            out[name] = S.triangular(S.spread(i, n, 2 * j + 3, 7 * j + 1), low, value, high)
    return out


def draws(spark, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("draw"))


def influenced(cells: DataFrame, n: int, key: list[str]) -> DataFrame:
    """p05, p50, p95 of each cell's influenced value over n draws, its share of sales, and the incremental p50.

    cells: key, projected, p, sales_value. The factors are the same in every cell and the chain is a
    product, so the quantiles of one unit, a single row, scale to all cells.
    """
    one, f = F.lit(1.0), drawn(F.col("draw"), n)
    unit = draws(cells.sparkSession, n).select(chain(one, one, f).alias("x"), f["incrementality"].alias("g"))
    q = unit.agg(*[F.expr(f"percentile(x, {p})").alias(a) for a, p in (("_05", 0.05), ("_50", 0.5), ("_95", 0.95))], F.expr("percentile(x * g, 0.5)").alias("_g"))
    size = F.col("projected") * F.col("p")
    out = cells.crossJoin(F.broadcast(q)).withColumns({"p05": size * F.col("_05"), "p50": size * F.col("_50"), "p95": size * F.col("_95"), "incremental_p50": size * F.col("_g")})
    out = out.withColumn("share_p50", F.try_divide("p50", F.nullif("sales_value", F.lit(0.0)))).withColumn("exceeds_sales", F.col("p50") > F.col("sales_value"))
    return out.select(*key, "sales_value", "p05", "p50", "p95", "incremental_p50", "share_p50", "exceeds_sales")


def tornado(cells: DataFrame, n: int, ledger: dict = vocab.LEDGER) -> DataFrame:
    """One factor at a time over its range, the others central: p05 and p95 of the total over its central value, and the share of log variance.

    The chain is a product, so a factor scales the total: one aggregate over the cells is enough.
    """
    spark = cells.sparkSession
    mid = central(ledger)
    base = cells.agg(F.sum(chain(F.col("projected"), F.col("p"), mid)).alias("base"))
    one = F.lit(1.0)
    unit = chain(one, one, mid)
    rows = [draws(spark, n).select(F.lit(k).alias("factor"), F.lit(ledger[k][3]).alias("status"), (chain(one, one, drawn(F.col("draw"), n, ledger, k)) / unit).alias("x")) for k in CHAIN]
    inc = ledger["incrementality"]
    rows.append(draws(spark, n).select(F.lit("incrementality").alias("factor"), F.lit(inc[3]).alias("status"), (drawn(F.col("draw"), n, ledger, "incrementality")["incrementality"] / inc[0]).alias("x")))
    g = reduce(DataFrame.union, rows).groupBy("factor", "status").agg(F.expr("percentile(x, 0.05)").alias("low_x"), F.expr("percentile(x, 0.95)").alias("high_x"), F.var_pop(F.log("x")).alias("log_variance"))
    g = g.withColumn("variance_share", S.ratio(F.col("log_variance"), F.sum("log_variance").over(Window.partitionBy())))
    return g.crossJoin(F.broadcast(base))  # one row


#: Sessions that the pooled rate weighs in a cell's posterior, cells that are drawn together.
SHRINKAGE, BLOCK = 20.0, 64


def _posterior(cells: DataFrame, key: list[str], shrinkage: float) -> DataFrame:
    """Cells with the Beta parameters of their conversion rate, shrunk to the pooled rate, and a seed by key. cells: key, projected, mentioned, converted, sales_value."""
    n, k = F.col("mentioned").cast("double"), F.least("converted", "mentioned").cast("double")
    pooled = cells.agg(F.coalesce(F.try_divide(F.sum(k), F.sum(n)), F.lit(0.0)).alias("_pooled"))
    out = cells.crossJoin(F.broadcast(pooled))  # one row
    a, b = k + shrinkage * F.col("_pooled") + 0.5, n - k + shrinkage * (1 - F.col("_pooled")) + 0.5
    return out.select(*key, "projected", "sales_value", a.alias("_a"), b.alias("_b"), F.pmod(F.xxhash64(*key), F.lit(2**31 - 1)).alias("_seed"))


def _unit_draws(spark, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Chain of one unit and incrementality for each draw; n rows reach the driver."""
    f = drawn(F.col("draw"), n)
    rows = draws(spark, n).select("draw", chain(F.lit(1.0), F.lit(1.0), f).alias("x"), f["incrementality"].alias("g")).orderBy("draw").collect()
    return np.array([r.x for r in rows]), np.array([r.g for r in rows])


def _rates(f: pd.DataFrame, n: int) -> np.ndarray:
    """Cells x draws rates; a cell's draws depend on its key only."""
    return np.stack([np.random.default_rng(int(s)).beta(a, b, n) for s, a, b in zip(f["_seed"], f["_a"], f["_b"], strict=True)])


def posterior_influenced(cells: DataFrame, n: int, key: list[str], shrinkage: float = SHRINKAGE) -> DataFrame:
    """As ``influenced``, with the conversion rate drawn from each cell's posterior, so cells with few sessions have wide intervals."""
    x, g = _unit_draws(cells.sparkSession, n)
    given = _posterior(cells, key, shrinkage)
    kinds = {f.name: f.dataType.simpleString() for f in given.schema}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), BLOCK):
                f = frame.iloc[at : at + BLOCK]
                value = f["projected"].to_numpy(float)[:, None] * x[None, :] * _rates(f, n)
                out = f[[*key, "sales_value"]].copy()
                out["p05"], out["p50"], out["p95"] = np.quantile(value, [0.05, 0.5, 0.95], axis=1)
                out["incremental_p50"] = np.quantile(value * g[None, :], 0.5, axis=1)
                yield out

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*key, "sales_value")) + ", p05 double, p50 double, p95 double, incremental_p50 double"
    out = given.mapInPandas(run, schema)
    return out.withColumn("share_p50", F.try_divide("p50", F.nullif(F.col("sales_value").cast("double"), F.lit(0.0)))).withColumn("exceeds_sales", F.col("p50") > F.col("sales_value"))


def posterior_totals(cells: DataFrame, n: int, key: list[str], shrinkage: float = SHRINKAGE) -> DataFrame:
    """metric, p05, p50, p95 of totals: cells are summed inside each draw, as they share its factors. ``panel_sampling`` has the central factors and only the rates drawn."""
    spark = cells.sparkSession
    x, g = _unit_draws(spark, n)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        value, sampling = np.zeros(n), np.zeros(n)
        for frame in frames:
            for at in range(0, len(frame), BLOCK):
                f = frame.iloc[at : at + BLOCK]
                each = f["projected"].to_numpy(float)[:, None] * _rates(f, n)
                sampling += each.sum(axis=0)
                value += (each * x[None, :]).sum(axis=0)
        yield pd.DataFrame({"draw": np.arange(n), "v": value, "i": value * g, "s": sampling})

    one = F.lit(1.0)
    mid = spark.range(1).select(chain(one, one, central()).alias("_mid"))
    by_draw = _posterior(cells, key, shrinkage).mapInPandas(run, "draw long, v double, i double, s double").groupBy("draw").agg(*[F.sum(c).alias(c) for c in "vis"])
    sales = cells.agg(F.sum(F.col("sales_value").cast("double")).alias("_sales"))
    wide = by_draw.crossJoin(F.broadcast(sales)).crossJoin(F.broadcast(mid))  # one row each
    metrics = {"ai_influenced_value": F.col("v"), "ai_influenced_share": F.col("v") / F.col("_sales"), "ai_incremental_value": F.col("i"), "ai_incremental_share": F.col("i") / F.col("_sales"), "panel_sampling": F.col("s") * F.col("_mid"), "sales_value": F.col("_sales")}
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("x")) for k, v in metrics.items()])).alias("m")).select("m.*")
    return long.groupBy("metric").agg(*[F.percentile("x", F.lit(p)).alias(a) for a, p in (("p05", 0.05), ("p50", 0.5), ("p95", 0.95))], F.var_pop(F.log("x")).alias("log_variance"))


def reconciliation(bottom_up: Column, top_down: Column) -> Column:
    """How far both sides are apart: the larger over the smaller share; null if one is missing or not positive."""
    return F.when((bottom_up > 0) & (top_down > 0), F.greatest(bottom_up, top_down) / F.least(bottom_up, top_down))


def incrementality_bound(features: DataFrame) -> DataFrame:
    """1 - 1 / lift of the followed over the other sessions, 0 to 1; null without both rates."""
    rate = lambda yes: F.avg(F.when(F.col("followed_recommendation") == yes, F.col("converted").cast("double")))
    r = features.agg(rate(True).alias("rate_followed"), rate(False).alias("rate_other"))
    return r.withColumn("bound", F.when((F.col("rate_followed") > 0) & F.col("rate_other").isNotNull(), F.greatest(F.lit(0.0), 1 - F.col("rate_other") / F.col("rate_followed"))))
