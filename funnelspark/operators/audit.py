"""Roll-ups, rankings and predicates of reports and audits. Ties are always broken by a named key, so results don't depend on the order of rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# predicates and scalars


def clean_none(text: Column) -> Column:
    """Blank texts and 'none' as null."""
    t = F.trim(text)
    return F.when((t != "") & (F.lower(t) != "none"), t)


def duration_seconds(times: Column) -> Column:
    """Aggregate: last minus first; 0 if a time is missing or there is only one."""
    span = (F.unix_micros(F.max(times)) - F.unix_micros(F.min(times))) / 1e6
    return F.when((F.count(times) < F.count(F.lit(1))) | (F.count(F.lit(1)) < 2), 0.0).otherwise(span)


def stable_id(text: Column, n: int) -> Column:
    """A number under ``n`` that only depends on the text: its MD5's first 32 bits modulo n."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % n


def name_set(names: Column) -> Column:
    """Sorted distinct non-blank names of an array, trimmed and lower-cased."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(names, lambda x: F.lower(F.trim(x))), lambda x: F.coalesce(x != "", F.lit(False)))))


def canonical_brand(raw: Column, domain: Column, aliases: dict[str, str], domains: dict[str, str]) -> Column:
    """The brand that an alias names, else that of the domain, else the trimmed text."""
    table = lambda d, k: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[k]
    return F.coalesce(table(aliases, F.lower(F.trim(raw))), table(domains, F.lower(domain)), F.trim(raw))


#: Paths of logins, what error pages say in title and headings, phrases of carts, prices.
LOGIN_PATH = r"wp-login|/login|/signin|/sign-in|/sso/|/auth/"
ERROR_TITLE = (
    r"page not found|not found|does not exist|error 4\d\d|\b40[1348]\b|forbidden|access denied|not allowed|not permitted|log ?in|sign ?in|session (has )?expired|link (has )?expired|"
    r"invalid (link|request|nonce|token|preview)|preview (unavailable|expired)|something went wrong|are you lost"
)
CART_PHRASE = r"add to (?:cart|bag|basket)|buy now|add-to-cart|checkout|proceed to (?:checkout|pay)"
PRICE = r"(?:[$£€¥]|USD|EUR|GBP)\s?\d[\d.,]*|\d[\d.,]*\s?(?:[$£€¥]|USD|EUR|GBP|dollars?)"


def soft_error(url: Column, title: Column, headings: Column, n_words: Column, has_jsonld: Column, thin: int = 25, short: int = 300) -> Column:
    """Pages that answer but hold nothing: a login, a thin shell without title or markup, an error's title or heading on a short page."""
    title = F.coalesce(title, F.lit(""))
    empty = (n_words < thin) & (title == "") & ~has_jsonld
    head = F.concat_ws(" ", title, F.array_join(F.slice(F.coalesce(headings, F.array().cast("array<string>")), 1, 2), " "))
    return F.lower(url).rlike(LOGIN_PATH) | empty | (head.rlike(f"(?i){ERROR_TITLE}") & (n_words < short))


def commerce_signs(text: Column, links: Column, has_price_markup: Column) -> dict[str, Column]:
    """Whether a page has a price (in markup or text) and a way to buy (in its text's first 4,000 characters or its links)."""
    blob = F.concat_ws(" ", F.substring(F.coalesce(text, F.lit("")), 1, 4000), F.array_join(F.coalesce(links, F.array().cast("array<string>")), " "))
    return {"has_price": F.coalesce(has_price_markup, F.lit(False)) | F.coalesce(text, F.lit("")).rlike(f"(?i){PRICE}"), "has_add_to_cart": blob.rlike(f"(?i){CART_PHRASE}")}


def decisive_mismatch(category: Column, subtype: Column, url_category: Column, url_subtype: Column, url_relevant: Column, url_proves: Column) -> Column:
    """'category' where a stored page is off-topic or unknown but its url decides, 'subtype' where a shopping page's url proves another one; null elsewhere."""
    decides = ~url_category.isin("unknown", "unrelated") & url_relevant
    return F.when(category.isin("unrelated", "unknown") & decides, "category").when((category == "shopping") & url_proves & ~subtype.eqNullSafe(url_subtype), "subtype")


def top_votes(votes: Column, k: int = 3, least: float = 0.15, skip: tuple[str, ...] = ("other",)) -> Column:
    """The ``k`` largest of array<struct<name, p>> with p of at least ``least``; equal ones by name."""
    good = F.filter(votes, lambda v: (v["p"] >= least) & ~v["name"].isin(*skip))
    order = F.array_sort(F.transform(good, lambda v: F.struct((-v["p"]).alias("m"), v["name"].alias("name"))))
    return F.transform(F.slice(order, 1, k), lambda v: v["name"])


# roll-ups


def first_known(rows: DataFrame, key: str, order: list[Column], columns: list[str]) -> DataFrame:
    """The first non-null value of each column, in order, for each key."""
    return rows.groupBy(key).agg(*[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in columns])


def accuracies(rows: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """For each name the share of rows where both columns agree; one row."""
    return rows.agg(F.count("*").alias("n"), *[F.avg(F.col(a).eqNullSafe(F.col(b)).cast("double")).alias(name) for name, (a, b) in pairs.items()])


def confidence_report(conf: DataFrame, column: str, levels: tuple[float, ...] = (0.5, 0.75, 0.9)) -> DataFrame:
    """Mean, median, least and the shares at or above each level; one row."""
    c = F.col(column)
    shares = [F.avg((c >= x).cast("double")).alias(f"share_{int(round(x * 100))}") for x in levels]
    return conf.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.percentile(c, F.lit(0.5)).alias("median"), F.min(c).alias("least"), *shares)


def frequencies(rows: DataFrame, values: Column, name: str = "value") -> DataFrame:
    """Count of each element of an array column."""
    return rows.select(F.explode(values).alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def attention(visits: DataFrame, by: str, dwell: str, position: str) -> DataFrame:
    """Visits, mean dwell, mean position and share of all visits, for each group; the total comes from the groups."""
    out = visits.groupBy(by).agg(F.count("*").alias("n"), F.avg(dwell).alias("mean_dwell"), F.sum(dwell).alias("sum_dwell"), F.avg(position).alias("mean_position"))
    total = out.agg(F.sum("n").alias("total"))
    return out.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("total")).drop("total")  # total has one row


def behaviour(turns: DataFrame, by: str) -> DataFrame:
    """Turns, recommendation rate, mean sentiment, brands and links, for each group. turns: recommended, sentiment, n_brands, n_links."""
    return turns.groupBy(by).agg(F.count("*").alias("n_turns"), F.avg(F.col("recommended").cast("double")).alias("reco_rate"), F.avg("sentiment").alias("mean_sentiment"), F.sum("n_brands").alias("brands"), F.sum("n_links").alias("links"))


def product_summary(products: DataFrame, key: str, strengths: tuple[str, ...] = ("none", "likely", "strong", "exact"), names: int = 3) -> DataFrame:
    """Products, any that coincides, best strength and first names of each key. products: key, position, name, match_strength, coincides."""
    rank = F.array_position(F.array(*[F.lit(s) for s in strengths]), F.col("match_strength"))
    own = products.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("position", "name")))
    few = F.array_sort(F.collect_list(F.when(F.col("_r") <= names, F.struct("_r", "name"))))
    return own.groupBy(key).agg(F.count("*").alias("n_products"), F.max("coincides").alias("any_coincides"), F.max_by("match_strength", rank).alias("best_strength"), F.array_join(F.transform(few, lambda x: x["name"]), "; ").alias("names"))


def mix(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Count of each value of a group, and its share of the group."""
    n = rows.groupBy(by, value).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(by)))


def sets_by_kind(rows: DataFrame, key: str, kind: Column, value: Column, kinds: dict[str, str]) -> DataFrame:
    """For each key the sorted distinct values of each kind. kinds: kind -> column."""
    return rows.groupBy(key).agg(*[F.array_sort(F.collect_set(F.when(kind == k, value))).alias(c) for k, c in kinds.items()])


def volume(cells: DataFrame, by: list[str], sessions: str, share: float = 0.8) -> DataFrame:
    """The largest number of sessions of each cell, and the users that it stands for."""
    return cells.groupBy(*by).agg(F.max(sessions).alias("n_sessions")).withColumn("n_users", F.floor(F.col("n_sessions") * share).cast("long"))


# rankings and joins


def keep_first(rows: DataFrame, key: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key; the order must name a unique key last."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def sequence(rows: DataFrame, key: str, order: list[Column], name: str = "seq") -> DataFrame:
    """Running number of the rows of each key."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def is_last(rows: DataFrame, key: str, position: str, name: str = "is_last") -> DataFrame:
    """Whether a row has its key's largest position."""
    return rows.withColumn(name, F.col(position) == F.max(position).over(Window.partitionBy(key)))


def candidates(urls: DataFrame, count: str, url: str, cap: int) -> DataFrame:
    """The ``cap`` urls that surfaced most, equal ones by url."""
    return urls.orderBy(F.desc(count), url).limit(cap)


def lookup_last(left: DataFrame, right: DataFrame, key: str, order: list[Column], columns: list[str]) -> DataFrame:
    """Left rows with the columns of the last right row of their key."""
    last = right.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_last"))
    return left.join(last, key, "left").select(*left.columns, *[F.col("_last")[c].alias(c) for c in columns])


def attach_set(left: DataFrame, right: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """Left rows with the sorted distinct values of the right rows of their key (empty without any)."""
    sets = right.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias(name))
    return left.join(sets, key, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))


def weights_of(users: DataFrame, weights: DataFrame, key: str, weight: str) -> DataFrame:
    """Users with their weight, 1 without one or if it isn't finite and positive."""
    w = F.col(weight)
    good = weights.filter(w.isNotNull() & ~F.isnan(w) & (w > 0) & (w < float("inf"))).select(key, weight)
    return users.join(good, key, "left").withColumn(weight, F.coalesce(weight, F.lit(1.0)))


def audit_events(events: DataFrame, pages: DataFrame, products: DataFrame, sessions: DataFrame, url: str, session: str) -> DataFrame:
    """Events of the given sessions only, with facts of their page and their page's products where known."""
    return reduce(lambda a, b: a.join(b, url, "left"), (pages, products), events.join(sessions.select(session).distinct(), session, "left_semi"))


def recovered(parts: DataFrame, log: DataFrame, products: DataFrame, page: str) -> tuple[DataFrame, DataFrame]:
    """Pages of the commit log that no part file has, and the products of committed pages only."""
    return log.join(parts.select(page), page, "left_anti"), products.join(log.select(page), page, "left_semi")


def repaired(pages: DataFrame, fixes: DataFrame, url: str, columns: list[str]) -> DataFrame:
    """Pages with the columns of the fix of their url, where it has a value."""
    new = fixes.select(url, *[F.col(c).alias(f"_fix_{c}") for c in columns])
    out = pages.join(new, url, "left")
    return out.select(*[F.coalesce(f"_fix_{c}", c).alias(c) if c in columns else F.col(c) for c in pages.columns])


def draw_totals(draws: DataFrame, draw: str, value: str) -> DataFrame:
    """Sum over all cells inside each draw, then p05, p50 and p95 over draws; one row."""
    totals = draws.groupBy(draw).agg(F.sum(value).alias("t"))
    return totals.agg(F.percentile("t", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("q")).select(*[F.col("q")[i].alias(n) for i, n in enumerate(("p05", "p50", "p95"))])
