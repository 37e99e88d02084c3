"""Sources, sinks and run state."""

import json

import pytest
from pyspark.sql.types import StructType

from funnelspark.sources import artifacts as A


def test_sources_and_stand_ins(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "url string, n int")
    rows.write.parquet(f"{tmp_path}/star/deep/fact_clicks.parquet")
    rows.write.parquet(f"{tmp_path}/star/dim_site.parquet")
    found = A.load_clickstream(spark, f"{tmp_path}/star", {"clicks": ("fact", "click"), "sites": ("site",)})
    assert {k: v.count() for k, v in found.items()} == {"clicks": 2, "sites": 2}
    assert A.resolve(spark, f"{tmp_path}/star/dim_site.parquet")[1] == "real"
    assert A.resolve(spark, f"{tmp_path}/none.parquet", synthetic=lambda s: s.range(3))[1] == "synthetic"
    with pytest.raises(FileNotFoundError):
        A.resolve(spark, f"{tmp_path}/none.parquet")
    assert list(A.saved_run(spark, f"{tmp_path}/star", {"pages": "pages.parquet"})) == ["pages"]
    seen = A.url_column(spark.createDataFrame([(" ", "x"), ("y", None), ("y", "z")], "url string, final_url string"))
    assert sorted(r.url for r in seen.collect()) == ["x", "y"]


def test_directory_and_ledger(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps([{"domain": "www.Shop.com", "role": "retailer", "category": "beauty_care"}, {"domain": "odd.com", "role": "pirate"}]))
    d = A.site_directory(spark, f"{tmp_path}/d.json", {"shop": {"description": "a shop"}, "seed": {"role": "brand"}})
    assert [(r.core, r.role, r.description) for r in d.orderBy("core").collect()] == [("odd", "", ""), ("seed", "brand", ""), ("shop", "retailer", "a shop")]
    got = A.with_directory(spark.createDataFrame([("https://www.shop.com/x",), ("https://b.org",)], "url string"), d).orderBy("url").collect()
    assert [(r.directory_role, r.directory_title) for r in got] == [(None, None), ("retailer", "shop beauty care")]
    A.save_ledger(spark, f"{tmp_path}/l.json", {"a": (1.0, 0.5, 2.0, "assumed")})
    assert A.load_ledger(spark, f"{tmp_path}/l.json", {"a": (9.0, 9.0, 9.0, "x"), "b": (1.0, 1.0, 1.0, "y")}) == {"a": (1.0, 0.5, 2.0, "assumed"), "b": (1.0, 1.0, 1.0, "y")}
    with pytest.raises(ValueError, match="unknown"):
        A.load_ledger(spark, f"{tmp_path}/l.json", {})


def test_offline_pages_and_content(spark):
    corpus = spark.createDataFrame([("http://a/x", "A"), ("http://b/", "B")], "url string, html string")
    cached = A.cacheable(spark.createDataFrame([("http://c", "c" * 600), ("http://d", "short")], "url string, html string"))
    got = A.offline_pages(spark.createDataFrame([("http://a/x",), ("http://b",), ("http://c",), ("http://d",)], "url string"), corpus, cached).collect()
    assert {r.url: (r.html and r.html[0], r.fetch_status) for r in got} == {"http://a/x": ("A", "ok"), "http://b": ("B", "ok"), "http://c": ("c", "ok"), "http://d": (None, "offline_miss")}
    rows = spark.createDataFrame([("old/p1.html", ""), ("p2.html", "words"), (None, None)], "html_path string, text_excerpt string").withColumn("url", A.F.lit("u"))
    assert sorted(r.content_source for r in A.page_content(rows, spark.createDataFrame([("new/p1.html", "x")], "path string, html string")).collect()) == ["cache", "row", "url"]


def test_parts_resume_and_finalize(spark, tmp_path):
    schema = StructType.fromDDL("page_id long, name string")
    rows = lambda *ids: spark.createDataFrame([(i, f"n{i}", "extra") for i in ids], "page_id long, name string, more string")
    assert [A.write_part(rows(1, 2, 2), f"{tmp_path}/p", schema, "page_id"), A.write_part(rows(2, 3), f"{tmp_path}/p", schema, "page_id")] == [0, 1]
    assert sorted(r.page_id for r in A.keys_of(spark, f"{tmp_path}/p", "page_id").collect()) == [1, 2, 3]
    done = A.finalize(spark, f"{tmp_path}/p", f"{tmp_path}/pages.parquet", schema, "page_id", 1)
    assert done.count() == 3 and done.columns == ["page_id", "name"]
    assert A.finalize(spark, f"{tmp_path}/p", f"{tmp_path}/pages.parquet", schema, "page_id").count() == 3
    A.write_pages(rows(1).selectExpr("page_id", "cast(null as string) name"), schema, f"{tmp_path}/back")
    assert spark.read.parquet(f"{tmp_path}/back").first().name == ""


def test_commit_log_keeps_products_of_committed_pages_only(spark, tmp_path):
    pages, products = spark.createDataFrame([(1, "a")], "page_id long, url string"), spark.createDataFrame([(1, "x"), (7, "y")], "page_id long, name string")
    for _ in range(2):  # a batch that runs again replaces itself
        A.commit(pages, products, f"{tmp_path}/log", 0)
    with open(tmp_path / "log" / "pages" / "batch=0" / "part-broken.json", "w") as f:
        f.write('{"page_id": 2, "url"')
    own, sold = A.committed(spark, f"{tmp_path}/log", "page_id long, url string", "page_id long, name string")
    assert [r.page_id for r in own.collect()] == [1] and [r.name for r in sold.collect()] == ["x"]


def test_run_identity_and_reset(spark, tmp_path):
    one, two = A.fingerprint(spark.range(5)), A.fingerprint(spark.range(6))
    at = f"{tmp_path}/run/manifest.json"
    assert one == A.fingerprint(spark.range(5).orderBy(A.F.desc("id"))) and one != two
    assert A.identify(spark, at, one, "real") == "new" and A.identify(spark, at, one, "other") == "resume"
    with pytest.raises(ValueError, match="other inputs"):
        A.identify(spark, at, two, "real")
    assert A.identify(spark, at, two, "real", "resume") == "resume" and A.identify(spark, at, two, "real", "fresh") == "fresh"
    assert "6 rows" in A.source_note(A.read_json(spark, at)) and "unknown" in A.source_note(None)
    A.write_json(spark, f"{tmp_path}/run/cache", {})
    assert A.reset(spark, f"{tmp_path}/run") == ["manifest.json"] and A.exists(spark, f"{tmp_path}/run/cache")


def test_review_sheet_and_report(spark, tmp_path):
    q = spark.createDataFrame([("u<1", 3.0, None), ("v", 1.0, "x")], "url string, suspicion double, note string")
    A.export_review(q, f"{tmp_path}/q")
    assert sorted((r.url, r.suspicion, r.note) for r in A.read_review(spark, f"{tmp_path}/q").collect()) == [("u<1", "3.0", ""), ("v", "1.0", "x")]
    page = A.html_report("Run", "synthetic & small", {"suspects": q})
    assert "u&lt;1" in page and "<script" not in page and "&amp; small" in page
    seen = A.last_profile(spark.createDataFrame([("d", 1, 0.2, "na"), ("d", 2, 0.9, "retailer"), ("d", 3, 0.1, "na")], "domain string, i int, relevance double, seller_type string"), "domain", [A.F.col("i")]).orderBy("i").collect()
    assert [(r.profile_relevance, r.profile_seller) for r in seen] == [(None, None), (0.2, None), (0.9, "retailer")]
