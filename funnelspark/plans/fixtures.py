"""How the driver's tables stand in for the engine's inputs. These mappings are for tests and carry no meaning of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelspark.operators import weekly as W

DIMS = ["week", "market"]
WEIGHTED = ["n_sessions_mentioned", "n_sessions_visited", "n_sessions_followed", "n_sessions_converted", "n_sessions_category"]
#: Words that the invented prose has.
POS, NEG, NEGATORS = ["the", "and"], ["of"], ["that"]

#: Texts for the text rules, with hits of each intent and stage.
TEXTS = [
    "What is retinol and how does it work?", "Is fragrance bad for skin? Explain please", "CeraVe vs Cetaphil: which is better?", "Recommend the best serum for dry skin", "Where can I buy it, and how much is it?",
    "I just ordered the cream, added to cart and checkout done", "I have been using it and it got worse, a side effect?", "What should I use in a morning and night routine", "Nothing here matches", "",
    "best moisturizer for winter under $20", "can i mix niacinamide and vitamin c", "I bought the toner but it burns, how do i use it", "what products suit oily skin, any good dupe?", "reviews of the new sunscreen, pros and cons", "I love it, not bad, great and gentle", "I don't love it; awful, harsh and never good",
]
BRANDS = {"cerave": "CeraVe", "cera ve": "CeraVe", "cetaphil": "Cetaphil", "niacinamide": "Niacinamide", "vitamin c": "Vitamin C", "retinol": "Retinol"}

DEPTHS = {"click": 1, "signup": 2, "purchase": 3}

EV_SQL = """ev AS (
  SELECT event_id, user_id, event_type AS kind, value, ts, concat(user_id, ':', strftime(ts, '%Y%m%d')) AS session_id, epoch_us(ts) // 1000 AS t_ms,
    CASE event_type WHEN 'click' THEN 'ai_click' ELSE 'trail_visit' END AS event_type,
    CASE event_type WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END AS commerce_depth,
    event_type = 'click' AS followed_agent_link, event_id % 2 = 0 AS is_study_relevant,
    CASE WHEN event_type = 'signup' THEN 'unsolicited_rec' ELSE 'none' END AS brand_match FROM events),
tr AS (SELECT *, row_number() OVER w AS position, (lead(t_ms) OVER w - t_ms) / 1000.0 AS dwell_seconds FROM ev
  WINDOW w AS (PARTITION BY session_id ORDER BY t_ms, event_id)),
beh AS (SELECT session_id, CAST(max(commerce_depth) AS BIGINT) AS max_commerce_depth, count(*) AS n_visits,
    count(*) FILTER (WHERE commerce_depth >= 1) AS n_shopping_visits, count(*) FILTER (WHERE is_study_relevant) AS n_relevant_visits,
    bool_or(followed_agent_link) AS followed_agent_link, bool_or(brand_match = 'unsolicited_rec') AS visited_recommended_brand,
    coalesce(sum(dwell_seconds) FILTER (WHERE commerce_depth >= 1), 0) AS total_dwell_shopping, coalesce(avg(dwell_seconds), 0) AS mean_dwell
  FROM tr GROUP BY session_id),
feat AS (SELECT *, followed_agent_link OR visited_recommended_brand AS followed_recommendation, max_commerce_depth >= 1 AS reached_shop,
    max_commerce_depth >= 2 AS reached_cart, max_commerce_depth >= 3 AS reached_checkout, max_commerce_depth >= 2 AS converted FROM beh)"""

REL_SQL = """li AS (SELECT l_orderkey, p_brand AS brand, l_linenumber, l_quantity, l_discount, l_tax, l_extendedprice, l_returnflag, l_linestatus FROM lineitem JOIN part ON l_partkey = p_partkey),
be AS (SELECT CAST(l_orderkey AS VARCHAR) AS session_id, brand, CASE l_returnflag WHEN 'N' THEN 'cited' WHEN 'A' THEN 'ai_click' ELSE 'trail_visit' END AS event_type,
    l_linenumber % 4 AS commerce_depth, l_linenumber AS position, l_linestatus = 'O' AS followed_agent_link, l_quantity > 25 AS mentioned, l_discount > 0.05 AS unsolicited FROM li),
seen AS (SELECT session_id, brand, bool_or(event_type = 'cited') AS cited, bool_or(event_type <> 'cited') AS visited, bool_or(event_type <> 'cited' AND followed_agent_link) AS followed,
    coalesce(max(commerce_depth) FILTER (WHERE event_type <> 'cited'), 0) AS max_depth, bool_or(mentioned) AS mentioned, bool_or(unsolicited) AS unsolicited FROM be GROUP BY session_id, brand),
won AS (SELECT session_id, brand FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY commerce_depth DESC, position NULLS LAST, brand) AS r FROM be WHERE event_type <> 'cited')
  WHERE r = 1 AND commerce_depth > 0 AND session_id IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'F')),
rel AS (SELECT seen.session_id, seen.brand, mentioned, unsolicited, cited, visited, followed, won.brand IS NOT NULL AS converted, CAST(max_depth AS BIGINT) AS max_depth
  FROM seen LEFT JOIN won USING (session_id, brand)),
ses AS (SELECT CAST(o_orderkey AS VARCHAR) AS session_id, o_custkey AS user_id, strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS week, r_name AS market,
    o_orderpriority LIKE '1%' AS followed_s, o_orderstatus = 'F' AS converted_s
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
cat AS (SELECT week, market, count(DISTINCT session_id) AS n_sessions, count(DISTINCT user_id) AS n_users, count(*) FILTER (WHERE followed_s) AS n_followed, count(*) FILTER (WHERE converted_s) AS n_converted
  FROM ses GROUP BY week, market),
bw0 AS (SELECT week, market, brand, count(*) FILTER (WHERE mentioned) AS n_sessions_mentioned, count(*) FILTER (WHERE visited) AS n_sessions_visited, count(*) FILTER (WHERE followed) AS n_sessions_followed,
    count(*) FILTER (WHERE converted) AS n_sessions_converted, count(*) FILTER (WHERE mentioned AND visited) AS n_visited_exposed FROM rel JOIN ses USING (session_id) GROUP BY week, market, brand),
bw AS (SELECT bw0.*, n_sessions AS n_sessions_category, coalesce(round_even(n_sessions_mentioned / nullif(n_sessions, 0), 4), 0) AS exposure_rate,
    coalesce(round_even(n_sessions_mentioned / nullif(sum(n_sessions_mentioned) OVER (PARTITION BY week, market), 0), 4), 0) AS ai_share_of_voice,
    coalesce(round_even(n_visited_exposed / nullif(n_sessions_mentioned, 0), 4), 0) AS visit_given_exposure FROM bw0 LEFT JOIN cat USING (week, market)),
sales AS (SELECT week, market, brand, sum(l_extendedprice * (1 - l_discount)) AS sales_value FROM li JOIN ses ON CAST(l_orderkey AS VARCHAR) = session_id GROUP BY week, market, brand),
media AS (SELECT week, brand, sum(l_extendedprice * l_tax) AS tv_spend FROM li JOIN ses ON CAST(l_orderkey AS VARCHAR) = session_id GROUP BY week, brand)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a part that are sorted or grouped in one task: its memory doesn't grow with the table.
PART = 500_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt by its keys into parts of about PART of its ``rows``, which adaptive execution leaves as they are."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // PART)), *keys)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    kind = F.col("kind")
    depth = F.when(kind == "click", 1).when(kind == "signup", 2).when(kind == "purchase", 3).otherwise(0)
    e = e.withColumnRenamed("event_type", "kind").withColumn("session_id", F.concat_ws(":", "user_id", F.date_format("ts", "yyyyMMdd"))).withColumn("t_ms", F.unix_millis("ts"))
    return e.withColumns({
        "event_type": F.when(kind == "click", "ai_click").otherwise("trail_visit"), "commerce_depth": depth, "followed_agent_link": kind == "click",
        "is_study_relevant": F.col("event_id") % 2 == 0, "brand_match": F.when(kind == "signup", "unsolicited_rec").otherwise("none"),
    })


def brand_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("brand")), F.col("l_partkey") == F.col("p_partkey"))
    kind = F.when(F.col("l_returnflag") == "N", "cited").when(F.col("l_returnflag") == "A", "ai_click").otherwise("trail_visit")
    return li.select(
        F.col("l_orderkey").cast("string").alias("session_id"), "brand", kind.alias("event_type"), (F.col("l_linenumber") % 4).alias("commerce_depth"), F.col("l_linenumber").alias("position"),
        (F.col("l_linestatus") == "O").alias("followed_agent_link"), (F.col("l_quantity") > 25).alias("mentioned"), (F.col("l_discount") > 0.05).alias("unsolicited"), "l_extendedprice", "l_discount", "l_tax",
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    o = t("orders").join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.join(t("nation").select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region").select("r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
    return o.select(F.col("o_orderkey").cast("string").alias("session_id"), F.col("o_custkey").alias("user_id"), W.week_of(F.col("o_orderdate")).alias("week"), F.col("r_name").alias("market"), F.col("o_orderpriority").startswith("1").alias("followed"), (F.col("o_orderstatus") == "F").alias("converted"))
