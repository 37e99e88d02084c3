"""Weekly facts, panel projection and weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelspark.functions import stats as S


def week_of(day: Column, anchor: str = "monday") -> Column:
    """First day of the week as yyyy-MM-dd, ``unknown`` for null. ``tuesday``: weeks that end on Monday."""
    d = day.cast("date")
    start = F.date_trunc("week", d).cast("date") if anchor == "monday" else F.date_add(F.date_trunc("week", F.date_sub(d, 1)).cast("date"), 1)
    return F.coalesce(F.date_format(start, "yyyy-MM-dd"), F.lit("unknown"))


def category_weekly(sessions: DataFrame, dims: list[str]) -> DataFrame:
    """Sessions, users, followed, converted and rate per cell of sessions (session_id, user_id, followed, converted, dims)."""
    n = lambda c: F.count(F.when(F.col(c), 1))
    g = sessions.groupBy(*dims).agg(F.count_distinct("session_id").alias("n_sessions"), F.count_distinct("user_id").alias("n_users"), n("followed").alias("n_followed"), n("converted").alias("n_converted"))
    return g.withColumn("conversion_rate", S.ratio(F.col("n_converted"), F.col("n_sessions"), 4))


def brand_weekly(relations: DataFrame, category: DataFrame, dims: list[str], sums: tuple[str, ...] = ()) -> DataFrame:
    """Per cell and brand of session-brand relations: counts, share of voice, exposure and visit rates, and the ``sums`` added up; ``category`` gives n_sessions of the cell."""
    n = lambda c: F.count(F.when(F.col(c), 1))
    names = {"mentioned": "n_sessions_mentioned", "visited": "n_sessions_visited", "followed": "n_sessions_followed", "converted": "n_sessions_converted"}
    g = relations.groupBy(*dims, "brand").agg(*[n(c).alias(a) for c, a in names.items()], F.count(F.when(F.col("mentioned") & F.col("visited"), 1)).alias("n_visited_exposed"), *[F.sum(c).alias(c) for c in sums])
    g = g.join(category.select(*dims, F.col("n_sessions").alias("n_sessions_category")), dims, "left")
    return rates(g, dims).withColumn("visit_given_exposure", S.ratio(F.col("n_visited_exposed"), F.col("n_sessions_mentioned"), 4))


def rates(cells: DataFrame, dims: list[str]) -> DataFrame:
    """exposure_rate and ai_share_of_voice from the counts, never from rates."""
    total = F.sum("n_sessions_mentioned").over(Window.partitionBy(*dims))
    return cells.withColumn("exposure_rate", S.ratio(F.col("n_sessions_mentioned"), F.col("n_sessions_category"), 4)).withColumn("ai_share_of_voice", S.ratio(F.col("n_sessions_mentioned"), total, 4))


def project(cells: DataFrame, frames: DataFrame, counts: list[str], base: str | None = None, deff: float = 1.0) -> DataFrame:
    """Counts times the market's factor (``*`` is the default market; null without either) and, with a base, 95 % bounds.

    frames: market, factor; broadcast only as the small table it is, so the plan is left to choose.
    """
    own, other = frames.select("market", F.col("factor").alias("_f")), frames.filter("market = '*'").select(F.col("factor").alias("_d"))
    out = cells.join(own, "market", "left").join(other.limit(1), F.lit(True), "left").withColumn("factor", F.coalesce("_f", "_d")).drop("_f", "_d")
    for c in counts:
        n = F.col(c).cast("double")
        out = out.withColumn(f"{c}_projected", n * F.col("factor"))
        if base:
            b = F.col(base).cast("double")
            p = F.least(F.greatest(F.try_divide(n, b), F.lit(0.0)), F.lit(1.0))
            p = F.when(F.try_divide(n, b).isNotNull(), p)
            se = F.sqrt(F.try_divide(p * (1 - p), b) * max(deff, 1.0))
            out = out.withColumn(f"{c}_projected_lo", F.when(p.isNotNull(), F.greatest(p - 1.96 * se, F.lit(0.0)) * b * F.col("factor")))
            out = out.withColumn(f"{c}_projected_hi", F.when(p.isNotNull(), F.least(p + 1.96 * se, F.lit(1.0)) * b * F.col("factor")))
    return out


def post_stratify(segments: DataFrame) -> DataFrame:
    """weight of each segment (panel_share, universe_share): their ratio, scaled so that the panel's mean weight is 1."""
    w = S.ratio(F.col("universe_share"), F.col("panel_share"))
    out = segments.withColumn("_w", w)
    return out.withColumn("weight", S.ratio(F.col("_w"), F.sum(F.col("_w") * F.col("panel_share")).over(Window.partitionBy()))).drop("_w")


def collapse(cells: DataFrame, key: list[str], dims: list[str], counts: list[str]) -> DataFrame:
    """Counts summed to ``key`` (brand included), rates derived again, dropped dimensions stamped ``all``; untouched if the key is full."""
    if set(key) >= {*dims, "brand"}:
        return cells
    out = cells.groupBy(*key).agg(*[F.sum(c).alias(c) for c in counts])
    for d in dims:
        if d not in key:
            out = out.withColumn(d, F.lit("all"))
    return rates(out, [c for c in key if c != "brand"])
