"""Queries of reports and audits over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from funnelspark.operators import audit as A
from funnelspark.operators import journey as J
from funnelspark.plans.catalogue import KINDS, query
from funnelspark.plans.fixtures import EV_SQL, dealt, events, table

_EV = f"WITH {EV_SQL} "


def _visits(spark, sf):
    e = events(spark, sf)
    nxt = F.lead("t_ms").over(J.Window.partitionBy("session_id").orderBy("t_ms", "event_id"))
    pos = F.row_number().over(J.Window.partitionBy("session_id").orderBy("t_ms", "event_id"))
    return e.withColumn("dwell_seconds", (nxt - F.col("t_ms")) / 1000.0).withColumn("position", pos)


@query(
    _EV + "SELECT session_id, arg_min(CASE WHEN kind <> 'error' THEN kind END, (t_ms, event_id)) FILTER (WHERE kind <> 'error') AS platform, arg_min(value, (t_ms, event_id)) FILTER (WHERE value > 50) AS spend FROM ev GROUP BY session_id"
)
def q_session_dimensions(spark, sf):
    e = events(spark, sf).withColumn("platform", F.when(F.col("kind") != "error", F.col("kind"))).withColumn("spend", F.when(F.col("value") > 50, F.col("value")))
    return A.first_known(e, "session_id", [F.col("t_ms"), F.col("event_id")], ["platform", "spend"])


@query(
    _EV
    + """SELECT count(*) AS n, avg((f.converted = t.bought)::INT) AS conversion_accuracy, avg((f.followed_agent_link = t.clicked)::INT) AS followed_accuracy
    FROM feat f JOIN (SELECT session_id, bool_or(kind = 'purchase') AS bought, bool_or(kind IN ('click', 'signup')) AS clicked FROM ev GROUP BY session_id) t USING (session_id)"""
)
def q_journey_accuracy(spark, sf):
    e = events(spark, sf)
    own = e.groupBy("session_id").agg((F.max("commerce_depth") >= 2).alias("converted"), F.max("followed_agent_link").alias("followed"))
    truth = e.groupBy("session_id").agg(F.max(F.col("kind") == "purchase").alias("bought"), F.max(F.col("kind").isin("click", "signup")).alias("clicked"))
    return A.accuracies(own.join(truth, "session_id"), {"conversion_accuracy": ("converted", "bought"), "followed_accuracy": ("followed", "clicked")})


@query(
    "SELECT count(c) AS n, avg(c) AS mean, quantile_cont(c, 0.5) AS median, min(c) AS least, avg((c >= 0.5)::INT) AS share_50, avg((c >= 0.75)::INT) AS share_75, avg((c >= 0.9)::INT) AS share_90 FROM (SELECT value / 200 AS c FROM events)"
)
def q_confidence_report(spark, sf):
    return A.confidence_report(table(spark, sf, "events").select((F.col("value") / 200).alias("c")), "c")


@query("SELECT signal, count(*) AS n FROM (SELECT unnest(string_split(p_name || ' ' || lower(p_type), ' ')) AS signal FROM part) GROUP BY signal")
def q_signal_frequency(spark, sf):
    return A.frequencies(table(spark, sf, "part"), F.split(F.concat_ws(" ", "p_name", F.lower("p_type")), " "), "signal")


@query(
    _EV + "SELECT kind, count(*) AS n, avg(dwell_seconds) AS mean_dwell, sum(dwell_seconds) AS sum_dwell, avg(position) AS mean_position, count(*) / sum(count(*)) OVER () AS share FROM tr GROUP BY kind"
)
def q_attention(spark, sf):
    return A.attention(_visits(spark, sf), "kind", "dwell_seconds", "position")


@query(
    "SELECT role, count(*) AS n_turns, avg((length(text) % 2 = 0)::INT) AS reco_rate, avg(length(text) % 7 - 3) AS mean_sentiment, sum(turn % 3)::BIGINT AS brands, sum(conv_id % 2)::BIGINT AS links FROM conversations GROUP BY role"
)
def q_behaviour_by_role(spark, sf):
    n = F.length("text")
    t = table(spark, sf, "conversations").withColumns({"recommended": n % 2 == 0, "sentiment": n % 7 - 3, "n_brands": F.col("turn") % 3, "n_links": F.col("conv_id") % 2})
    return A.behaviour(t, "role")


@query(
    """SELECT l_orderkey AS url, count(*) AS n_products, bool_or(l_linestatus = 'O') AS any_coincides, arg_max(s, r) AS best_strength, string_agg(name, '; ' ORDER BY l_linenumber, name) FILTER (WHERE k <= 3) AS names
    FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 'likely' WHEN 'R' THEN 'strong' ELSE 'none' END AS s, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 0 END AS r, 'item ' || l_partkey AS name,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 'item ' || l_partkey) AS k FROM lineitem) GROUP BY l_orderkey"""
)
def q_product_summary(spark, sf):
    li = table(spark, sf, "lineitem")
    s = F.when(F.col("l_returnflag") == "A", "likely").when(F.col("l_returnflag") == "R", "strong").otherwise("none")
    p = li.select(F.col("l_orderkey").alias("url"), F.col("l_linenumber").alias("position"), F.concat(F.lit("item "), F.col("l_partkey").cast("string")).alias("name"), s.alias("match_strength"), (F.col("l_linestatus") == "O").alias("coincides"))
    return A.product_summary(p, "url")


@query("SELECT user_id % 50 AS cohort, event_type AS stage, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY user_id % 50) AS share FROM events GROUP BY user_id % 50, event_type")
def q_stage_mix(spark, sf):
    return A.mix(table(spark, sf, "events").select((F.col("user_id") % 50).alias("cohort"), F.col("event_type").alias("stage")), "cohort", "stage")


@query(
    "SELECT host, page_id, url, seen FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY seen DESC, url, page_id) AS r FROM (SELECT page_id, url, page_id % 7 AS seen, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages)) WHERE r = 1"
)
def q_representative_url(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url", (F.col("page_id") % 7).alias("seen"), F.regexp_extract("url", r"://([^/?#]*)", 1).alias("host"))
    return A.keep_first(p, ["host"], [F.desc("seen"), F.col("url"), F.col("page_id")]).select("host", "page_id", "url", "seen")


@query(
    "SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 5"
)
def q_examples_by_category(spark, sf):
    return A.keep_first(table(spark, sf, "part"), ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], 5).select("p_brand", "p_partkey", "p_retailprice")


@query("SELECT url, seen FROM (SELECT url, sum(page_id % 7)::BIGINT AS seen FROM pages GROUP BY url) ORDER BY seen DESC, url LIMIT 100")
def q_candidate_cap(spark, sf):
    return A.candidates(table(spark, sf, "pages").groupBy("url").agg(F.sum(F.col("page_id") % 7).alias("seen")), "seen", "url", 100)


@query(
    _EV
    + "SELECT event_id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY t_ms // 3600000, list_position(['view', 'click', 'signup', 'purchase', 'error'], kind), t_ms, event_id) AS seq FROM ev"
)
def q_ledger_sequence(spark, sf):
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    return A.sequence(events(spark, sf), "session_id", [F.floor(F.col("t_ms") / 3600000), rank, F.col("t_ms"), F.col("event_id")]).select("event_id", "session_id", "seq")


@query("SELECT conv_id, turn, turn = max(turn) OVER (PARTITION BY conv_id) AS is_last FROM conversations")
def q_last_turn(spark, sf):
    return A.is_last(table(spark, sf, "conversations"), "conv_id", "turn").select("conv_id", "turn", "is_last")


@query(
    """SELECT l_orderkey, coalesce(string_agg(name, '>' ORDER BY p DESC, name) FILTER (WHERE r <= 3), '') AS votes FROM (
      SELECT l_orderkey, name, p, row_number() OVER (PARTITION BY l_orderkey ORDER BY p DESC, name) AS r FROM (SELECT l_orderkey, 'v' || l_linenumber AS name, l_discount * 5 AS p FROM lineitem) WHERE p >= 0.15 AND name <> 'v1'
      UNION ALL SELECT DISTINCT l_orderkey, '', 0.0, 99 FROM lineitem) GROUP BY l_orderkey"""
)
def q_top_votes(spark, sf):
    v = F.struct(F.concat(F.lit("v"), F.col("l_linenumber").cast("string")).alias("name"), (F.col("l_discount") * 5).alias("p"))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(v).alias("v")).select("l_orderkey", F.array_join(A.top_votes(F.col("v"), skip=("v1",)), ">").alias("votes"))


@query(
    """SELECT o_orderkey, o_orderstatus, coalesce(brands, '') AS brands FROM orders LEFT JOIN (SELECT l_orderkey AS o_orderkey, string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) AS brands
      FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 30 GROUP BY l_orderkey) USING (o_orderkey)"""
)
def q_page_brands(spark, sf):
    li = table(spark, sf, "lineitem").filter("l_quantity > 30").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("o_orderkey"), "p_brand")
    return A.attach_set(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), li, "o_orderkey", F.col("p_brand"), "b").select("o_orderkey", "o_orderstatus", F.array_join("b", "|").alias("brands"))


@query(
    """SELECT l_orderkey, coalesce(string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) FILTER (WHERE l_returnflag = 'A'), '') AS brands, coalesce(string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) FILTER (WHERE l_returnflag = 'R'), '') AS sub_brands,
      coalesce(string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) FILTER (WHERE l_returnflag = 'N'), '') AS categories FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey"""
)
def q_mention_sets(spark, sf):
    li = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    names = {"A": "brands", "R": "sub_brands", "N": "categories"}
    return A.sets_by_kind(li, "l_orderkey", F.col("l_returnflag"), F.col("p_brand"), names).select("l_orderkey", *[F.array_join(c, "|").alias(c) for c in names.values()])


@query(
    "SELECT o_orderkey, o_custkey, l_partkey AS site, l_quantity AS prior FROM orders LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_quantity DESC) AS r FROM lineitem) ON o_orderkey = l_orderkey AND r = 1"
)
def q_site_prior(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.col("l_partkey").alias("site"), F.col("l_quantity").alias("prior"))
    return A.lookup_last(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), li, "o_orderkey", [F.col("l_linenumber"), F.col("site"), F.col("prior")], ["site", "prior"])


@query("SELECT user_id, coalesce(w, 1.0) AS weight FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN (SELECT c_custkey AS user_id, c_acctbal / 1000 AS w FROM customer WHERE c_acctbal > 0) USING (user_id)")
def q_user_weights(spark, sf):
    w = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") / 1000).alias("weight"))
    return A.weights_of(table(spark, sf, "events").select("user_id").distinct(), w, "user_id", "weight")


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, p_brand, n_products, total FROM lineitem l LEFT JOIN (SELECT p_partkey AS l_partkey, p_brand FROM part WHERE p_size < 25) USING (l_partkey)
      LEFT JOIN (SELECT l_partkey, count(*) AS n_products, sum(l_quantity) AS total FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey) USING (l_partkey) WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')"""
)
def q_audit_events(spark, sf):
    li = table(spark, sf, "lineitem")
    pages = table(spark, sf, "part").filter("p_size < 25").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    products = li.filter("l_returnflag = 'R'").groupBy("l_partkey").agg(F.count("*").alias("n_products"), F.sum("l_quantity").alias("total"))
    some = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return A.audit_events(li.select("l_orderkey", "l_linenumber", "l_partkey"), pages, products, some, "l_partkey", "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", "p_brand", "n_products", "total")


@query(
    """SELECT 'page' AS kind, o_orderkey AS page, 0 AS item FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0)
      UNION ALL SELECT 'product', l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')"""
)
def q_recovery(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("page"), "o_orderstatus")
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("item"))
    n = items.count()
    lost, kept = A.recovered(o.filter("page % 3 = 0"), dealt(o.filter("o_orderstatus <> 'P'"), n, "page"), dealt(items, n, "page"), "page")
    return lost.select(F.lit("page").alias("kind"), "page", F.lit(0).alias("item")).union(kept.select(F.lit("product"), "page", "item"))


@query("SELECT p_partkey, CASE WHEN p_size > 40 THEN 'fixed ' || p_brand ELSE p_brand END AS p_brand, CASE WHEN p_size > 45 THEN 'X' ELSE p_type END AS p_type FROM part")
def q_validation_repair(spark, sf):
    p = table(spark, sf, "part")
    fixes = p.filter("p_size > 40").select("p_partkey", F.concat(F.lit("fixed "), F.col("p_brand")).alias("p_brand"), F.when(F.col("p_size") > 45, "X").alias("p_type"))
    return A.repaired(p.select("p_partkey", "p_brand", "p_type"), fixes, "p_partkey", ["p_brand", "p_type"])


@query("SELECT event_type, user_id % 10 AS market, max(n)::BIGINT AS n_sessions, floor(max(n) * 0.8)::BIGINT AS n_users FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL) GROUP BY event_type, user_id % 10")
def q_category_volume(spark, sf):
    n = table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n")).withColumn("market", F.col("user_id") % 10)
    return A.volume(n, ["event_type", "market"], "n")


@query("SELECT quantile_cont(t, 0.05) AS p05, quantile_cont(t, 0.5) AS p50, quantile_cont(t, 0.95) AS p95 FROM (SELECT l_partkey % 200 AS d, sum(l_quantity) AS t FROM lineitem GROUP BY 1)")
def q_draw_totals(spark, sf):
    return A.draw_totals(table(spark, sf, "lineitem").select((F.col("l_partkey") % 200).alias("d"), "l_quantity"), "d", "l_quantity")


@query("SELECT o_custkey, CASE WHEN count(*) < 2 OR count(o) < count(*) THEN 0.0 ELSE (epoch_us(max(o)) - epoch_us(min(o))) / 1e6 END AS seconds FROM (SELECT o_custkey, CASE WHEN o_orderkey % 97 > 0 THEN o_orderdate END AS o FROM orders) GROUP BY o_custkey")
def q_duration(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 97 > 0, F.col("o_orderdate").cast("timestamp")).alias("o"))
    return o.groupBy("o_custkey").agg(A.duration_seconds(F.col("o")).alias("seconds"))


@query(
    """SELECT page_id, ('0x' || substr(md5(url), 1, 8))::BIGINT % 1000 AS id, CASE WHEN page_id % 5 > 1 THEN url END AS url, list_aggregate(list_sort(list_distinct([lower(h), lower(t)])), 'string_agg', '|') AS names
      FROM (SELECT page_id, url, regexp_extract(url, '://([^/?#]*)', 1) AS h, regexp_extract(url, '\\.([a-z]+)[/?#]', 1) AS t FROM pages)"""
)
def q_page_keys(spark, sf):
    url = F.col("url")
    raw = F.when(F.col("page_id") % 5 == 0, F.lit(" ")).when(F.col("page_id") % 5 == 1, F.lit(" None")).otherwise(url)
    names = F.array(F.concat(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit(" ")), F.regexp_extract(url, r"\.([a-z]+)[/?#]", 1), F.lit(None).cast("string"), F.lit(""))
    return table(spark, sf, "pages").select("page_id", A.stable_id(url, 1000).alias("id"), A.clean_none(raw).alias("url"), F.array_join(A.name_set(names), "|").alias("names"))


_ERROR = A.ERROR_TITLE.replace("'", "''")


@query(
    rf"""SELECT page_id, regexp_matches(lower(url), '{A.LOGIN_PATH}') OR (n < 25 AND title = '') OR (n < 300 AND regexp_matches(title || ' ' || h, '(?i){_ERROR}')) AS soft_error,
        regexp_matches(html, '(?i){A.PRICE}') AS has_price, regexp_matches(substr(html, 1, 4000) || ' ' || url, '(?i){A.CART_PHRASE}') AS has_add_to_cart
      FROM (SELECT page_id, url, html, CASE WHEN page_id % 4 = 0 THEN '404 not found' WHEN page_id % 4 = 1 THEN '' ELSE regexp_extract(html, '<title>([^<]*)', 1) END AS title, regexp_extract(html, '<h1>([^<]*)', 1) AS h,
        len(regexp_extract_all(substr(html, 1, 100 * (page_id % 40)), '\w+')) AS n FROM pages)"""
)
def q_soft_error(spark, sf):
    title = F.when(F.col("page_id") % 4 == 0, "404 not found").when(F.col("page_id") % 4 == 1, "").otherwise(F.regexp_extract("html", "<title>([^<]*)", 1))
    n = F.size(F.regexp_extract_all(F.substring(F.col("html"), F.lit(1), (F.col("page_id") % 40 * 100).cast("int")), F.lit(r"\w+"), F.lit(0)))
    signs = A.commerce_signs(F.col("html"), F.array("url"), F.lit(False))
    return table(spark, sf, "pages").select("page_id", A.soft_error(F.col("url"), title, F.array(F.regexp_extract("html", "<h1>([^<]*)", 1)), n, F.lit(False)).alias("soft_error"), *[v.alias(k) for k, v in signs.items()])
