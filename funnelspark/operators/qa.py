"""Page classification look-ups, review queue, corrections, agreement, samples, incremental runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelspark import vocab
from funnelspark.functions import stats as S


def mapped(key: Column, mapping: dict[str, str], default: str) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[key], F.lit(default))


def category_of(subtype: Column) -> Column:
    return mapped(F.coalesce(subtype, F.lit("")), vocab.SUBTYPE_CATEGORY, "unknown")


def stage_of(category: Column, subtype: Column) -> Column:
    """The category's stage; a shopping page in the cart or checkout is Purchase, an order Post-Purchase."""
    bump = F.when((category == "shopping") & subtype.isin("cart", "checkout"), "Purchase").when((category == "shopping") & (subtype == "order"), "Post-Purchase")
    return F.coalesce(bump, mapped(category, vocab.CATEGORY_STAGE, "Irrelevant"))


def softmax_confidence(votes: list[Column]) -> Column:
    """Of positive sums by category: 1 / sum(exp(s - max)), 3 places; 0 without any."""
    top = F.greatest(*[F.coalesce(v, F.lit(0.0)) for v in votes])
    total = reduce(lambda a, b: a + b, [F.when(v > 0, F.exp(v - top)).otherwise(0.0) for v in votes])
    return F.when(top > 0, F.bround(F.try_divide(F.lit(1.0), total), 3)).otherwise(0.0)


def winner(votes: dict[str, Column]) -> Column:
    """The name with most votes, the first of equals; null if none is positive."""
    ranked = F.array(*[F.struct(v.alias("v"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, (k, v) in enumerate(votes.items())])
    best = F.array_max(ranked)
    return F.when(best["v"] > 0, best["k"])


def suspicion(pages: DataFrame) -> DataFrame:
    """suspicion and reasons of pages (page_category, page_subtype, page_category_confidence, fetch_scope, skincare_relevance, signals, model_subtype)."""
    conf, rel, scope = F.coalesce("page_category_confidence", F.lit(0.0)), F.coalesce("skincare_relevance", F.lit(0.0)), F.coalesce("fetch_scope", F.lit(""))
    n = F.size(F.coalesce("signals", F.array().cast("array<string>")))
    two = lambda c: F.format_string("%.2f", c)
    flags = [
        (F.col("page_category") == "unknown", 3, F.lit("category=unknown")),
        ((F.coalesce("model_subtype", F.lit("")) != "") & ~F.col("model_subtype").eqNullSafe(F.col("page_subtype")), 2, F.concat(F.lit("model says '"), F.col("model_subtype"), F.lit("'"))),
        ((F.col("page_category") == "unrelated") & (rel >= 0.5), 2, F.concat(F.lit("unrelated but relevance="), two(rel))),
        (conf < 0.75, 3, F.concat(F.lit("confidence="), two(conf))),
        ((conf >= 0.75) & (conf < 0.9), 2, F.concat(F.lit("confidence="), two(conf))),
        (~scope.isin("page", "stripped"), 1, F.concat(F.lit("no page content ("), F.when(scope == "", "none").otherwise(scope), F.lit(")"))),
        (n <= 2, 1, F.concat(n.cast("string"), F.lit(" signal(s)"))),
    ]
    human = F.array_contains(F.coalesce("signals", F.array().cast("array<string>")), "human")
    score = reduce(lambda a, b: a + b, [F.when(F.coalesce(c, F.lit(False)), p).otherwise(0) for c, p, _ in flags])
    why = F.concat_ws("; ", *[F.when(F.coalesce(c, F.lit(False)), t) for c, _, t in flags])
    return pages.withColumn("suspicion", F.when(human, 0).otherwise(score).cast("long")).withColumn("reasons", F.when(human, "human-labelled").when(why == "", "clean").otherwise(why))


def review_queue(scored: DataFrame, least: int, n: int) -> DataFrame:
    return scored.filter(F.col("suspicion") >= least).orderBy(F.desc("suspicion"), "page_category_confidence", "page_id").limit(n)


def correction_error(subtype: Column, category: Column) -> Column:
    """What is wrong with a correction; null if nothing is."""
    known = list(vocab.SUBTYPE_CATEGORY)
    return (
        F.when((F.coalesce(subtype, F.lit("")) == "") & (F.coalesce(category, F.lit("")) == ""), "empty correction")
        .when((F.coalesce(subtype, F.lit("")) != "") & ~subtype.isin(*known), F.concat(F.lit("unknown subtype: "), subtype))
        .when((F.coalesce(category, F.lit("")) != "") & ~category.isin(*vocab.CATEGORY_STAGE), F.concat(F.lit("unknown category: "), category))
        .when((F.coalesce(subtype, F.lit("")) != "") & (F.coalesce(category, F.lit("")) != "") & (category_of(subtype) != category), F.concat(F.lit("subtype "), subtype, F.lit(" is "), category_of(subtype)))
    )


def apply_corrections(pages: DataFrame, corrections: DataFrame) -> DataFrame:
    """Valid corrections by page_id, else by url; human rows stay; the first valid correction (``seq``) wins."""
    good = corrections.filter(correction_error(F.col("correct_subtype"), F.col("correct_category")).isNull())
    pick = lambda key: good.filter(F.coalesce(key, F.lit("")) != "").groupBy(key).agg(F.min_by(F.struct("correct_subtype", "correct_category"), "seq").alias(f"c_{key}"))
    out = pages.join(pick("page_id"), "page_id", "left").join(pick("url"), "url", "left")
    c = F.coalesce("c_page_id", "c_url")
    human = F.array_contains(F.coalesce("signals", F.array().cast("array<string>")), "human")
    use = c.isNotNull() & ~human
    sub = F.when(use & (F.coalesce(c["correct_subtype"], F.lit("")) != ""), c["correct_subtype"]).otherwise(F.col("page_subtype"))
    cat = F.when(use, F.coalesce(F.nullif(c["correct_category"], F.lit("")), category_of(c["correct_subtype"]))).otherwise(F.col("page_category"))
    sig = F.when(use, F.array_union(F.coalesce("signals", F.array().cast("array<string>")), F.array(F.lit("human")))).otherwise(F.col("signals"))
    return out.withColumns({"page_subtype": sub, "page_category": cat, "signals": sig, "corrected": use}).drop("c_page_id", "c_url")


def bands(confidence: Column) -> Column:
    return F.when(confidence < 0.5, "<0.50").when(confidence < 0.75, "0.50-0.75").when(confidence < 0.95, "0.75-0.95").otherwise(">=0.95")


def precision_recall(df: DataFrame, truth: str, guess: str, positive) -> DataFrame:
    """accuracy, tp, fp, fn, precision and recall (1 where nothing was to be found)."""
    t, g = F.col(truth) == positive, F.col(guess) == positive
    n = lambda c: F.count(F.when(c, 1))
    r = df.agg(F.bround(F.avg((F.col(truth) == F.col(guess)).cast("double")), 4).alias("accuracy"), n(t & g).alias("tp"), n(~t & g).alias("fp"), n(t & ~g).alias("fn"))
    share = lambda a, b: F.when(b > 0, F.bround(a / F.greatest(b, F.lit(1)), 4)).otherwise(1.0)
    return r.withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("tp") + F.col("fn")))


def stratified_sample(df: DataFrame, stratum: str, share: float, key: str, seed: int = 42) -> DataFrame:
    """max(1, round(n * share)) rows of each stratum, by md5 of seed and key. Sampling is the feature here."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    n = df.groupBy(stratum).agg(F.greatest(F.lit(1), F.bround(F.count("*") * share, 0)).cast("long").alias("_take"))
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy(order, key)))
    return ranked.join(n, stratum).filter(F.col("_r") <= F.col("_take")).drop("_r", "_take")


def pending(candidates: DataFrame, done: DataFrame, key: str = "url") -> DataFrame:
    """Candidates that no committed page has."""
    return candidates.join(done.select(key).distinct(), key, "left_anti")


def fetch_plan(urls: DataFrame, domain: str, rank: list[Column], budget: int) -> DataFrame:
    """fetch: whether a url is among the first ``budget`` of its domain."""
    return urls.withColumn("fetch_rank", F.row_number().over(Window.partitionBy(domain).orderBy(*rank)).cast("long")).withColumn("fetch", F.col("fetch_rank") <= budget)


def domain_profile(pages: DataFrame, domain: str, order: str) -> DataFrame:
    """Fold of a domain's pages: most relevant, first known seller and platform in order, number of pages."""
    first = lambda c, bad: F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c) != bad), F.col(order)))
    return pages.groupBy(domain).agg(F.max("relevance").alias("max_relevance"), first("seller_type", "na").alias("seller_type"), first("platform", "").alias("platform"), F.count("*").alias("n_pages"))


def crosstab_margins(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts by both, by each, and in all; ``All`` marks a margin."""
    g = df.cube(a, b).agg(F.grouping(a).alias("_a"), F.grouping(b).alias("_b"), F.count("*").alias("n"))
    return g.select(F.when(F.col("_a") == 1, "All").otherwise(F.col(a)).alias(a), F.when(F.col("_b") == 1, "All").otherwise(F.col(b)).alias(b), "n")


def agreement(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Share of equal values by column over an inner join; each side must hold a key once."""
    for side in (left, right):
        if side.groupBy(key).count().filter("count > 1").take(1):
            raise ValueError(f"{key} isn't unique")
    j = left.select(key, *columns).join(right.select(key, *[F.col(c).alias(f"_{c}") for c in columns]), key)
    return j.agg(F.count("*").alias("n"), *[F.bround(F.avg(F.col(c).eqNullSafe(F.col(f"_{c}")).cast("double")), 4).alias(c) for c in columns])


def weights_of(segments: DataFrame) -> DataFrame:
    return segments.agg(S.kish_n(F.col("weight")).alias("effective_n"))
