"""Posterior draws, holdout fits and the learned page model."""

import hashlib

import numpy as np

from funnelspark.operators import bridge as B
from funnelspark.operators import mmm as M
from funnelspark.operators import page_model as P


def test_posterior_is_wide_where_sessions_are_few(spark):
    cells = spark.createDataFrame([("a", 100.0, 4, 2, 10.0), ("b", 100.0, 40_000, 20_000, 10.0)], "brand string, projected double, mentioned long, converted long, sales_value double")
    out = {r.brand: r for r in B.posterior_influenced(cells, 400, ["brand"]).collect()}
    assert out["a"].p95 / out["a"].p05 > out["b"].p95 / out["b"].p05
    assert abs(out["b"].p50 / B.posterior_influenced(cells, 400, ["brand"]).filter("brand = 'b'").first().p50 - 1) < 1e-12  # the same draws again
    totals = {r.metric: r for r in B.posterior_totals(cells, 400, ["brand"]).collect()}
    assert totals["panel_sampling"].log_variance < totals["ai_influenced_value"].log_variance
    assert totals["sales_value"].p50 == 20.0 and totals["ai_influenced_value"].p05 <= totals["ai_influenced_value"].p50 <= totals["ai_influenced_value"].p95


def test_holdout_and_prior(spark):
    g = np.random.default_rng(0)
    rows = [(w, float(x), float(5 + 3 * x + e)) for w in range(40) for x, e in [(g.uniform(0, 10), g.normal(0, 0.1))]]
    df = spark.createDataFrame(rows, "week_index long, x double, y double")
    c, r = M.holdout_fit(df, ["x"], "y", 8, ridge=0.0)
    b = {k.feature: k for k in c.collect()}
    assert abs(b["x"].coefficient - 3) < 0.05 and r["r2_holdout"] > 0.99 and (r["n_train"], r["n_holdout"]) == (32, 8)
    assert abs(sum(k.contribution_share for k in b.values()) - 1) < 1e-9
    prior = M.prior_from_total(df, "x", 0.0, 1000.0)
    pulled = {k.feature: k.coefficient for k in M.holdout_fit(df, ["x"], "y", 8, ridge=0.0, prior=prior)[0].collect()}
    assert pulled["x"] < 0.5 * b["x"].coefficient
    told = M.compare_variables(df.withColumn("z", -M.F.col("x")), ["x", "z"], [], "y").collect()
    assert [(t.sign, t.verdict) for t in told] == [("+", "well-conditioned"), ("-", "wrong sign, unusable")]


def test_page_model_learns_saves_and_votes(spark, tmp_path):
    kinds = {"pdp": "/product/{}-cream", "cart": "/cart/view/{}", "article": "/blog/how-to-{}"}
    rows = [(f"https://s{i % 7}.com{p.format(i)}", k, "human" if i % 5 == 0 else "rule") for k, p in kinds.items() for i in range(30)]
    samples = spark.createDataFrame(rows, "url string, subtype string, source string")
    model = P.train(samples, 60)
    fresh = spark.createDataFrame([("https://new.org/product/x-cream", "pdp"), ("https://new.org/cart/view/1", "article"), (None, "pdp")], "url string, page_subtype string")
    told = {r.url: r for r in P.votes(model, fresh).collect()}
    assert told["https://new.org/product/x-cream"].model_subtype == "pdp" and told["https://new.org/cart/view/1"].model_subtype == "cart"
    assert max(told["https://new.org/product/x-cream"].model_votes.values()) > 1.0 and len(told) == 3
    assert [r.url for r in P.disagreement(model, fresh.filter("url is not null")).collect()] == ["https://new.org/cart/view/1"]
    P.save(spark, model, str(tmp_path / "m"))
    again = P.load(spark, str(tmp_path / "m"))
    assert again.labels == model.labels and np.allclose(again.weights, model.weights)
    assert P.load(spark, str(tmp_path / "m"), 2) is None and P.load(spark, str(tmp_path / "none")) is None
    assert P.cross_validated(samples, 2, 40).agg(P.F.min("accuracy")).first()[0] > 0.9


def test_feature_hash(spark):
    words = ["path:cart", "site:x", "path:cart"]
    got = spark.createDataFrame([(words,)], "w array<string>").select(P.hashed(P.F.col("w")).alias("h")).first().h
    want = {}
    for w in words:
        n = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
        want[n % P.DIM] = want.get(n % P.DIM, 0) + (1 if n >> 62 & 1 else -1)
    length = sum(v * v for v in want.values()) ** 0.5
    assert {x.i: round(x.w, 9) for x in got} == {k: round(v / length, 9) for k, v in want.items()}


def test_logit_after_an_observation_in_the_session(spark):
    from pyspark.sql import Observation

    from funnelspark.operators import models

    seen = Observation()
    spark.range(5).observe(seen, M.F.count("*").alias("n")).collect()
    assert seen.get["n"] == 5  # now the session can't be sent to tasks, as after op4
    g = np.random.default_rng(1)
    rows = [(i, float(x), float(z), bool(g.uniform() < 1 / (1 + np.exp(-2 * x)))) for i, (x, z) in enumerate(g.normal(size=(400, 2)))]
    df = spark.createDataFrame(rows, "k long, u double, v double, y boolean")
    out = {r.feature: r for r in models.logit(df, ["u", "v"], "y", "k").collect()}
    held = {r.k for r in df.filter(M.F.pmod(M.F.xxhash64("k"), M.F.lit(1000)) < 300).collect()}
    sd = np.array([r[1:3] for r in rows if r[0] not in held]).std(axis=0, ddof=1)
    score = lambda r: sum(out[f].coefficient * r[i + 1] / sd[i] for i, f in enumerate("uv"))
    good, bad = ([score(r) for r in rows if r[0] in held and r[3] is y] for y in (True, False))
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert abs(out["u"].auc - auc) < 1e-9 and out["u"].coefficient > 1 and abs(out["v"].coefficient) < 0.5


def test_fits_run_the_plan_of_their_rows_once(spark):
    runs = spark.sparkContext.accumulator(0)

    @M.F.udf("double")
    def counted(x):
        runs.add(1)
        return x

    rows = [(w, float(w % 7), float(w % 5), float(3 * (w % 7) + w % 3)) for w in range(60)]
    df = spark.createDataFrame(rows, "week_index long, x double, z double, y double").withColumn("x", counted.asNondeterministic()("x"))
    assert len(M.compare_variables(df, ["x", "z"], [], "y", 8).collect()) == 2 and runs.value == 60
    assert set(M.two_stage(df, ["x"], "z", "y")) == {"x"} and runs.value == 120
    assert not df.storageLevel.useMemory  # it was let go
    with M.held(df.persist()) as d:
        assert d is df
    assert df.storageLevel.useMemory
    df.unpersist()


def _plain_step(h, seqs):
    s, x, o, ll = np.zeros(h.k), np.zeros((h.k, h.k)), np.zeros((h.k, h.m)), 0.0
    for q in seqs:
        n = len(q)
        a, b = np.zeros((n, h.k)), np.ones((n, h.k))
        for t in range(n):
            a[t] = (h.start if t == 0 else a[t - 1] @ h.move) * h.emit[:, q[t]]
        for t in range(n - 2, -1, -1):
            b[t] = h.move @ (h.emit[:, q[t + 1]] * b[t + 1])
        p = a[-1].sum()
        s += a[0] * b[0] / p
        for t in range(n):
            o[:, q[t]] += a[t] * b[t] / p
            if t:
                x += np.outer(a[t - 1], h.emit[:, q[t]] * b[t]) * h.move / p
        ll += np.log(p)
    return s + 1e-6, x + 1e-6, o + 1e-6


def test_hmm_equals_plain_sums_and_makes_its_sequences_once(spark):
    from funnelspark.operators import models

    g = np.random.default_rng(3)
    seqs = [g.integers(0, 4, n).tolist() for n in [1, 2, 2, 5, 9, 9, 30] * 4] + [[0, 1]] * 20
    runs = spark.sparkContext.accumulator(0)

    @M.F.udf("array<int>")
    def counted(x):
        runs.add(1)
        return x

    df = spark.createDataFrame([(i, q) for i, q in enumerate([*seqs, []])], "k long, seq array<int>").withColumn("seq", counted.asNondeterministic()("seq"))
    want = models.Hmm(3, 4)
    for _ in range(4):
        s, x, o = _plain_step(want, seqs)
        want.start, want.move, want.emit = s / s.sum(), x / x.sum(1, keepdims=True), o / o.sum(1, keepdims=True)
    got = models.Hmm(3, 4).fit(df, rounds=4, tol=0.0)
    assert runs.value == len(seqs) + 1
    assert all(np.allclose(getattr(got, c), getattr(want, c), rtol=1e-9, atol=1e-12) for c in ("start", "move", "emit"))
    paths = {r.k: list(r.path) for r in got.decode(df, "k").collect()}
    assert all(paths[i] == want.viterbi(q) for i, q in enumerate(seqs)) and paths[len(seqs)] == []
