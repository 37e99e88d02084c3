"""Golden cases and invariants of single operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from funnelspark.functions import stats as S
from funnelspark.functions import text as T
from funnelspark.functions import url as U
from funnelspark.operators import html as H
from funnelspark.operators import journey as J
from funnelspark.operators import mmm as M
from funnelspark.operators import models
from funnelspark.operators import weekly as W
from funnelspark.sources import readers as R


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_jeffreys_interval():
    low, high = S.jeffreys(5, 10)
    assert 0.15 < low < 0.5 < high < 0.85 and math.isclose(low + high, 1, abs_tol=1e-9)
    assert S.jeffreys(0, 0) == (0.0, 1.0)


def test_adstock_keeps_series_apart(spark):
    df = spark.createDataFrame([("a", w, x) for w, x in enumerate([1.0, 0.0, 0.0, 0.0])] + [("b", w, 0.0) for w in range(3)], "brand string, week int, tv double")
    rows = M.adstock(df, "tv", ["brand"], "week", 0.5).orderBy("brand", "week").collect()
    assert [r.tv_adstock for r in rows] == [1.0, 0.5, 0.25, 0.125, 0, 0, 0]


def test_projection_with_bounds(spark):
    cells = spark.createDataFrame([("m", 50, 200), ("other", 1, 0)], "market string, n long, base long")
    frames = spark.createDataFrame([("m", 1000.0)], "market string, factor double")
    rows = {r.market: r for r in W.project(cells, frames, ["n"], "base").collect()}
    assert rows["m"].n_projected == 50_000 and rows["m"].n_projected_lo < 50_000 < rows["m"].n_projected_hi
    assert rows["other"].n_projected is None and rows["other"].n_projected_lo is None


def test_kish(spark):
    df = spark.createDataFrame([(1.0,)] * 4 + [(float("nan"),), (-1.0,)], "w double")
    assert df.agg(S.kish_n(F.col("w"))).first()[0] == 4


def test_conversion_goes_to_the_deepest_brand(spark):
    ev = spark.createDataFrame([("s", "A", "ai_click", 1, 1, True), ("s", "B", "trail_visit", 3, 2, False), ("s", "", "trail_visit", 3, 1, False), ("t", "A", "cited", 3, None, False)], "session_id string, brand string, event_type string, commerce_depth int, position int, followed_agent_link boolean")
    said = spark.createDataFrame([("s", "C", True, False)], "session_id string, brand string, mentioned boolean, unsolicited boolean")
    conv = spark.createDataFrame([("s", True), ("t", True)], "session_id string, converted boolean")
    rows = {(r.session_id, r.brand): r for r in J.session_brands(said, ev, conv).collect()}
    assert [k for k, r in rows.items() if r.converted] == [("s", "B")]
    assert rows[("s", "C")].mentioned and not rows[("s", "C")].visited and rows[("t", "A")].cited


def test_leaderboard_counts_each_session_once(spark):
    rel = spark.createDataFrame([("s", "A", True, True, False, True), ("s", "A", True, False, False, True), ("t", "A", True, None, False, False), (None, "B", True, True, True, True)], "session_id string, brand string, mentioned boolean, visited boolean, followed boolean, session_converted boolean")
    board = J.leaderboard(rel)
    assert [tuple(r) for r in board.collect()] == [("A", 2, 1, 0, 0.5), ("B", 0, 0, 0, 0.0)]
    assert "Expand" not in board._jdf.queryExecution().optimizedPlan().toString()  # no copy of the rows for each count


def test_urls(spark):
    u = U.parse_url(F.lit("HTTPS://www.Shop.co.uk/A/B?Q=1#x"))
    assert list(one(spark, u["scheme"], u["host"], u["registrable"], u["core"], u["subdomain"], u["path"], u["query"])) == ["https", "www.shop.co.uk", "shop.co.uk", "shop", "", "/a/b", "q=1"]
    assert list(one(spark, U.query_stripped(F.lit("https://a.x/p?utm=1")), U.query_stripped(F.lit("https://a.x/p?sku=1")), U.query_stripped(F.lit("https://a.x/?utm=1")), U.base_url(F.lit("https://a.x/")))) == ["https://a.x/p", "", "", ""]


def test_text_rules(spark):
    assert list(one(spark, T.lexicon_sentiment(F.lit("not bad, but awful")), T.spf_numbers(F.lit("SPF 50 and spf30")), T.to_float(F.lit("1,299.50 EUR")))) == [0.0, ["30", "50"], 1299.5]
    r = one(spark, T.trigram_cosine(F.lit("abcd"), F.lit("abcd")), T.trigram_cosine(F.lit("ab"), F.lit("abcd")))
    assert math.isclose(r[0], 1) and r[1] == 0


def test_null_and_empty_texts(spark):
    df = spark.createDataFrame([(None,), ("",)], "t string")
    for r in df.select(T.classify_intent(F.col("t")), T.classify_stage(T.stage_scores(F.col("t"))), T.lexicon_sentiment(F.col("t")), T.word_count(F.col("t"))).collect():
        assert list(r) == ["informational", "Discovery", 0.0, 0]


def test_html_products_and_prices():
    page = H.parse_page('<html lang="x"><title> A  b</title><h1>One</h1><h1>Two</h1><a href="u">l</a><script>var t="</p>"</script>text</html>')
    assert (page["title"], page["h1"], page["lang"], page["n_links"]) == ("A b", "One", "x", 1) and "var" not in page["text"]
    assert H.price_of("12,50") == 1250.0 and H.price_of("12,50", decimal_comma=True) == 12.5 and H.price_of(None) is None


def test_html_keeps_references_that_are_cut():
    page = H.parse_page('<title>a &amp;&lt;&#x27; b&amp</title><h1>x &am &notit; &copy</h1><a href="?a=1&copy=2">AT&T</a><script type="application/ld+json">{"@type": "A&amp;B"}</script> R&D')
    assert (page["title"], page["h1"], page["text"]) == ("a &<' b&amp", "x &am &notit; &copy", "x &am &notit; &copy AT&T R&D")
    assert page["json_ld"] == ['{"@type": "A&amp;B"}']
    assert H.parse_page('<link rel="canonical" href="/p?a=1&copy=2&amp;b=3">')["canonical"] == "/p?a=1&copy=2&b=3"


def test_conversations_load_without_optional_columns(spark):
    df = spark.createDataFrame([("s", "2", "q"), ("s", "1", None)], "session_id string, message_id string, question string")
    rows = R.load_conversations(df).orderBy("session_pos").collect()
    assert [(r.message_id, r.question, r.user_id) for r in rows] == [("1", "", "s"), ("2", "q", "s")]
    with pytest.raises(ValueError, match="message_id"):
        R.load_conversations(df.drop("message_id"))


def test_empty_inputs(spark):
    e = spark.createDataFrame([], "session_id string, kind string, t_ms long, event_id long")
    assert J.trail(e, "session_id", "kind", "t_ms", "event_id").count() == 0
    assert J.conversion_report(spark.createDataFrame([], "converted boolean, followed_recommendation boolean, followed_agent_link boolean, visited_recommended_brand boolean")).filter("n = 0").count() == 7


def test_least_squares_recovers_planted_effects(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 2))
    y = 3 * x[:, 0] - 2 * x[:, 1] + 5 + rng.normal(scale=0.01, size=300)
    df = spark.createDataFrame([tuple(map(float, (*a, b))) for a, b in zip(x, y, strict=True)], "a double, b double, y double")
    b = M.fit(df, ["a", "b"], "y", ridge=0.0)
    assert np.allclose([b["a"], b["b"], b["intercept"]], [3, -2, 5], atol=0.01)
    assert M.accuracy(M.predicted(df, b), "y").first().r2 > 0.999
    assert abs(M.fit(df, ["a", "b"], "y", prior=("a", 10.0, 1e9))["a"] - 10) < 0.01
    assert all(v < 1.2 for v in M.vif(df, ["a", "b"]).values())


def test_hmm_finds_two_regimes(spark):
    seqs = spark.createDataFrame([(i, [0] * 6 + [1] * 6) for i in range(20)], "k long, seq array<int>")
    path = models.Hmm(2, 2).fit(seqs, rounds=5).decode(seqs, "k").first().path
    assert path == [0] * 6 + [1] * 6


def test_stream_commits_each_url_once(spark, tmp_path):
    from funnelspark.streaming import ingest

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in ([("a", 1), ("b", 2), ("a", 1)], [("b", 2), ("c", 3)]):
        spark.createDataFrame(part, "url string, n long").coalesce(1).write.mode("append").parquet(src)
        q = ingest.commit_pages(ingest.read_files(spark, src, "url string, n long"), out, str(tmp_path / "check"))
        q.awaitTermination(120)
    assert sorted(r.url for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_parts_grow_in_number_not_in_rows(spark):
    from funnelspark.plans.fixtures import PART, dealt

    df = spark.range(100)
    assert dealt(df, 10 * PART + 1, "id").rdd.getNumPartitions() == 11  # few bytes, and yet not joined by adaptive execution
    assert dealt(df, 1, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    twice = spark.createDataFrame([(1,), (1,), (2,)], "page long")
    from funnelspark.operators import audit as A

    lost, kept = A.recovered(spark.createDataFrame([(2,)], "page long"), twice, spark.createDataFrame([(1, 7), (3, 8)], "page long, item int"), "page")
    assert [r.page for r in lost.collect()] == [1, 1] and [tuple(r) for r in kept.collect()] == [(1, 7)]
    assert "Aggregate" not in kept._jdf.queryExecution().optimizedPlan().toString()  # a semi join needs no distinct side
