"""Behavioural events: trails, session outcomes, conversion, transitions, attribution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelspark.functions import stats as S

BEHAVIOUR = ("ai_click", "trail_visit")
DEPTH = {"shop": 1, "cart": 2, "checkout": 3}
STRATA = ("followed_recommendation", "followed_agent_link", "visited_recommended_brand")


def trail(events: DataFrame, key: str, url: str, t_ms: str, pos: str) -> DataFrame:
    """position (1-based, blank urls dropped first) and dwell_seconds to the next visit.

    Ordered by time only if every event of the key has one, else as given by ``pos``;
    dwell is null at the end, without times, or when negative.
    """
    per = Window.partitionBy(key)
    timed = events.filter(F.trim(F.coalesce(url, F.lit(""))) != "").withColumn("_all", F.count(t_ms).over(per) == F.count("*").over(per))
    order = per.orderBy(F.when(F.col("_all"), F.col(t_ms)).asc_nulls_last(), F.col(pos))
    gap = (F.lead(t_ms).over(order) - F.col(t_ms)) / 1000.0
    out = timed.withColumn("position", F.row_number().over(order).cast("long")).withColumn("dwell_seconds", F.when(gap >= 0, gap))
    return out.drop("_all")


def commerce_depth(category: Column, subtype: Column) -> Column:
    return F.when(subtype.isin("checkout", "order"), 3).when(subtype == "cart", 2).when(category == "shopping", 1).otherwise(0)


def union_events(turns: DataFrame) -> DataFrame:
    """cited (all), ai_click (distinct) and trail_visit events of turns with links_cited, links_clicked and trail arrays."""
    base = ["session_id", "message_id"]
    cited = turns.select(*base, F.lit("cited").alias("event_type"), F.explode("links_cited").alias("url"), F.lit(None).cast("long").alias("position"))
    click = turns.select(*base, F.lit("ai_click").alias("event_type"), F.explode(F.array_distinct("links_clicked")).alias("url"), F.lit(None).cast("long").alias("position"))
    visit = turns.select(*base, F.lit("trail_visit").alias("event_type"), F.posexplode("trail").alias("_p", "url")).withColumn("position", (F.col("_p") + 1).cast("long")).drop("_p")
    every = cited.unionByName(click).unionByName(visit)
    links = turns.select("message_id", F.array_union("links_cited", "links_clicked").alias("_links"))
    out = every.join(links, "message_id")
    followed = (F.col("event_type") == "ai_click") | ((F.col("event_type") == "trail_visit") & F.array_contains("_links", F.col("url")))
    return out.withColumn("followed_agent_link", followed).drop("_links")


def brand_match(page: Column, unsolicited: Column, endorsed: Column, asked: Column) -> Column:
    return F.when(F.arrays_overlap(page, unsolicited), "unsolicited_rec").when(F.arrays_overlap(page, endorsed), "endorsed").when(F.arrays_overlap(page, asked), "requested").otherwise("none")


def attach_pages(events: DataFrame, pages: DataFrame, fallback: dict[str, Column]) -> DataFrame:
    """Page columns by url; the last duplicate of a page wins (by ``_order``), urls without a page take ``fallback``."""
    last = pages.groupBy("url").agg(F.max_by(F.struct(*[c for c in pages.columns if c not in ("url", "_order")]), "_order").alias("p"))
    out = events.join(last, "url", "left")
    cols = [F.coalesce(F.col(f"p.{c}"), v).alias(c) for c, v in fallback.items()]
    return out.select(*events.columns, *cols, F.when(F.col("p").isNull(), "url_only").otherwise("pages").alias("page_coverage"))


def session_behaviour(events: DataFrame) -> DataFrame:
    """Per session over behavioural events: depth, visits, flags, dwell."""
    e = events.filter(F.col("event_type").isin(*BEHAVIOUR))
    shop = F.col("commerce_depth") >= 1
    return e.groupBy("session_id").agg(
        F.max("commerce_depth").cast("long").alias("max_commerce_depth"),
        F.count("*").alias("n_visits"),
        F.count(F.when(shop, 1)).alias("n_shopping_visits"),
        F.count(F.when(F.col("is_study_relevant"), 1)).alias("n_relevant_visits"),
        F.bool_or("followed_agent_link").alias("followed_agent_link"),
        F.bool_or(F.col("brand_match") == "unsolicited_rec").alias("visited_recommended_brand"),
        F.sum(F.when(shop, F.coalesce("dwell_seconds", F.lit(0.0))).otherwise(0.0)).alias("total_dwell_shopping"),
        F.coalesce(F.avg("dwell_seconds"), F.lit(0.0)).alias("mean_dwell"),
    )


def outcomes(sessions: DataFrame, behaviour: DataFrame, stage: str = "cart") -> DataFrame:
    """``sessions`` with behaviour (0 and false without) and reached/converted flags."""
    out = sessions.join(behaviour, "session_id", "left")
    for f in behaviour.schema:
        if f.name != "session_id":
            zero = F.lit(False) if f.dataType.simpleString() == "boolean" else F.lit(0).cast(f.dataType)
            out = out.withColumn(f.name, F.coalesce(f.name, zero))
    out = out.withColumn("followed_recommendation", F.col("followed_agent_link") | F.col("visited_recommended_brand"))
    for name, d in DEPTH.items():
        out = out.withColumn(f"reached_{name}", F.col("max_commerce_depth") >= d)
    return out.withColumn("converted", F.col("max_commerce_depth") >= DEPTH[stage])


def conversion_report(features: DataFrame, strata: tuple[str, ...] = STRATA, interval: bool = True) -> DataFrame:
    """stratum, n, conversions, rate, lift (of True over False), and Jeffreys bounds: one pass over the sessions."""
    cond = {"overall": F.lit(True)} | {f"{c}={v}": (F.col(c) == (v == "True")) for c in strata for v in ("True", "False")}
    flat = features.select("converted", *strata)
    cells = flat.agg(*[F.array(F.count(F.when(c, 1)), F.count(F.when(c & F.col("converted"), 1))).alias(f"s{i}") for i, c in enumerate(cond.values())])
    rows = cells.select(F.explode(F.array(*[F.struct(F.lit(k).alias("stratum"), F.col(f"s{i}")[0].alias("n"), F.col(f"s{i}")[1].alias("conversions")) for i, k in enumerate(cond)])).alias("r")).select("r.*")
    rows = rows.withColumn("rate", F.bround(F.try_divide(F.col("conversions").cast("double"), F.col("n").cast("double")), 4))
    base = F.substring_index("stratum", "=", 1)
    other = F.max(F.when(F.col("stratum").endswith("=False"), F.col("rate"))).over(Window.partitionBy(base))
    rows = rows.withColumn("lift", F.when(F.col("stratum").endswith("=True") & (other > 0), F.bround(F.try_divide("rate", other), 3)))
    if not interval:
        return rows
    ci = rows.withColumn("ci", S.jeffreys_column(F.col("conversions"), F.col("n")))
    return ci.select("stratum", "n", "conversions", "rate", "lift", F.bround("ci.low", 4).alias("ci_low"), F.bround("ci.high", 4).alias("ci_high"))


def transitions(steps: DataFrame, stages: list[str]) -> DataFrame:
    """from_stage, to_stage, n, prob (of the from stage) of neighbouring steps (session_id, phase, position, stage)."""
    s = steps.filter(F.col("stage").isin(*stages))
    s = s.withColumn("to_stage", F.lead("stage").over(Window.partitionBy("session_id").orderBy("phase", "position")))
    counts = s.filter("to_stage is not null").groupBy(F.col("stage").alias("from_stage"), "to_stage").agg(F.count("*").alias("n"))
    return counts.withColumn("prob", F.bround(F.col("n") / F.sum("n").over(Window.partitionBy("from_stage")), 4))


def transition_pivot(edges: DataFrame, stages: list[str]) -> DataFrame:
    wide = edges.groupBy("from_stage").pivot("to_stage", stages).agg(F.first("prob"))
    return wide.na.fill(0.0, stages)


def session_brands(mentions: DataFrame, events: DataFrame, converted: DataFrame) -> DataFrame:
    """One row per (session, brand): mentioned, unsolicited, cited, visited, followed, converted, max_depth.

    A conversion counts for one brand: of the session's branded behaviour the deepest,
    then the earliest position (nulls last), then the first brand by name.
    """
    ev = events.filter(F.coalesce("brand", F.lit("")) != "").select("session_id", "brand", "event_type", "commerce_depth", "position", "followed_agent_link")
    rows = mentions.select("session_id", "brand", "mentioned", "unsolicited").unionByName(ev, allowMissingColumns=True)
    won = converted.filter("converted").select("session_id", F.lit(True).alias("session_converted")).distinct()
    return brand_relations(rows.join(won, "session_id", "left"))


def brand_relations(rows: DataFrame, keep: tuple[str, ...] = (), sums: tuple[str, ...] = ()) -> DataFrame:
    """As ``session_brands``, of rows that mention and visit at once and know whether their session converted (session_converted).

    keep: further columns that the session determines; sums: columns to add up. Rows that lie by session stay there.
    """
    known = F.coalesce("brand", F.lit("")) != ""
    behave = known & F.col("event_type").isin(*BEHAVIOUR)
    depth, place = F.col("commerce_depth"), F.col("position")
    order = F.struct(depth.isNull().alias("a"), (-depth).alias("b"), place.isNull().alias("c"), place.alias("d"))
    yes = {"mentioned": F.col("mentioned"), "unsolicited": F.col("unsolicited"), "cited": known & (F.col("event_type") == "cited"), "visited": behave, "followed": behave & F.col("followed_agent_link"), "_won": F.col("session_converted")}
    g = rows.groupBy("session_id", *keep, "brand").agg(
        *[F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in yes.items()], F.coalesce(F.max(F.when(behave, depth)), F.lit(0)).cast("long").alias("max_depth"), F.min(F.when(behave, order)).alias("_best"), *[F.sum(c).alias(c) for c in sums]
    )
    first = F.min(F.when(F.col("_best").isNotNull(), F.struct("_best", "brand"))).over(Window.partitionBy("session_id"))
    g = g.withColumn("_first", first)
    won = F.coalesce(F.col("_won") & (F.col("_first.brand") == F.col("brand")) & (F.col("_first._best.b") < 0), F.lit(False))
    return g.select("session_id", *keep, "brand", "mentioned", "unsolicited", "cited", "visited", "followed", won.alias("converted"), "max_depth", *sums)


def depth_funnel(features: DataFrame) -> DataFrame:
    share = lambda c: F.bround(F.avg(c.cast("double")), 4)
    return features.agg(*[share(c).alias(n) for n, c in {"any_visit": F.col("n_visits") > 0, "shop": F.col("reached_shop"), "cart": F.col("reached_cart"), "checkout": F.col("reached_checkout")}.items()])


def leaderboard(relations: DataFrame, top: int = 10) -> DataFrame:
    """Brands by sessions that recommend them, then that visit them; conversion_rate of the recommended sessions."""
    flags = {c: F.col(c) for c in ("mentioned", "visited", "followed")} | {"won": F.col("mentioned") & F.col("session_converted")}
    each = relations.groupBy("session_id", "brand").agg(*[F.bool_or(c & F.col("session_id").isNotNull()).alias(n) for n, c in flags.items()])
    n = lambda c: F.count(F.when(F.col(c), 1))
    rows = each.groupBy("brand").agg(n("mentioned").alias("recommended"), n("visited").alias("visited"), n("followed").alias("followed"), n("won").alias("won"))
    return rows.withColumn("conversion_rate", S.ratio(F.col("won"), F.col("recommended"), 4)).drop("won").orderBy(F.desc("recommended"), F.desc("visited"), "brand").limit(top)


def median_split(features: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """segment, n, rate_followed, rate_other, lift for the halves above and up to each column's median."""
    cuts = features.agg(*[F.expr(f"percentile({c}, 0.5)").alias(f"_m_{c}") for c in columns])
    f = features.crossJoin(F.broadcast(cuts))  # cuts is one row
    halves = [F.struct(F.lit(f"{c}_{side}").alias("segment"), ((F.col(c) > F.col(f"_m_{c}")) == (side == "high")).alias("inside")) for c in columns for side in ("high", "low")]
    f = f.select("converted", "followed_recommendation", F.explode(F.array(*halves)).alias("s")).filter("s.inside")
    rate = lambda yes: F.avg(F.when(F.col("followed_recommendation") == yes, F.col("converted").cast("double")))
    g = f.groupBy("s.segment").agg(F.count("*").alias("n"), F.bround(rate(True), 4).alias("rate_followed"), F.bround(rate(False), 4).alias("rate_other"))
    return g.withColumn("lift", F.bround(F.try_divide("rate_followed", "rate_other"), 3))


def url_candidates(links: DataFrame) -> DataFrame:
    """Roll-up per url of links (url, message_id, source, recommended, visited, purchased, dwell, position); blank and 'none' urls go."""
    u = F.trim(F.coalesce("url", F.lit("")))
    rows = links.withColumn("url", u).filter((F.col("url") != "") & (F.lower("url") != "none"))
    n = lambda c: F.count(F.when(F.col(c), 1))
    return rows.groupBy("url").agg(
        F.count("*").alias("times_surfaced"), n("recommended").alias("times_recommended"), n("visited").alias("times_visited"), F.coalesce(F.bool_or("purchased"), F.lit(False)).alias("purchase_any"),
        F.array_sort(F.collect_set(F.when(F.coalesce("message_id", F.lit("")) != "", F.col("message_id")))).alias("message_ids"), F.array_sort(F.collect_set("source")).alias("sources"),
        F.bround(F.avg("dwell"), 3).alias("mean_dwell_seconds"), F.bround(F.sum("dwell"), 3).alias("total_dwell_seconds"), F.bround(F.avg("position"), 3).alias("mean_trail_position"),
    )


def strata_union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
