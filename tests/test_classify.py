"""The page classifier on pages whose class is known."""

import pytest

from funnelspark.operators import classify as C

CASES = [
    ("https://www.amazon.com/cart/add-to-cart/product/1", {"title": "Cart", "has_price": True, "has_add_to_cart": True}, ("shopping", "cart", "Purchase", True)),
    ("https://unheard-of.shop/checkouts/c/abc", {}, ("shopping", "checkout", "Purchase", True)),
    ("https://docs.google.com/document/d/1", {"title": "Retinol notes"}, ("unrelated", "tool", "Irrelevant", False)),
    ("https://www.google.com/search?q=best+retinol+serum", {}, ("search", "serp", "Intent", True)),
    ("https://www.google.com/search?q=gaming+laptops", {"title": "gaming laptops"}, ("unrelated", "serp", "Irrelevant", False)),
    ("https://plus.google.com/whatever/else", {}, ("unknown", "other", "Irrelevant", False)),
    ("https://www.cerave.com/", {}, ("brand_landing", "homepage", "Discovery", True)),
    ("https://www.sephora.com/", {}, ("catalogue", "marketplace", "Discovery", True)),
    ("https://www.sephora.com/careers", {}, ("unknown", "listing", "Irrelevant", False)),
    ("https://example.com/eye-cream-vs-eye-serum", {}, ("editorial", "article", "Evaluation", True)),
    ("https://www.facebook.com/marketplace/item/12", {"title": "Old engine"}, ("unrelated", "listing", "Irrelevant", False)),
    ("https://store.example.com/air-conditioner-parts-list", {"title": "air conditioner parts"}, ("unrelated", "article", "Irrelevant", False)),
    (None, {}, ("brand_landing", "homepage", None, None)),
]


def test_known_pages(spark):
    rows = [(i, u, c.get("title"), c.get("has_price"), c.get("has_add_to_cart")) for i, (u, c, _) in enumerate(CASES)]
    got = {r.id: r for r in C.classify(spark.createDataFrame(rows, "id int, url string, title string, has_price boolean, has_add_to_cart boolean")).collect()}
    for i, (url, _, want) in enumerate(CASES[:-1]):
        assert (got[i].page_category, got[i].page_subtype, got[i].funnel_stage, got[i].is_study_relevant) == want, url
    assert got[len(CASES) - 1].page_subtype == "homepage"


@pytest.mark.parametrize(("url", "proved"), [("https://a.com/basket.jsp", True), ("https://a.com/?ref_=nav_cart", False), ("https://a.com/hz/wishlist/x", True), ("https://a.com/checkout-now", False)])
def test_transactional_urls(spark, url, proved):
    assert spark.createDataFrame([(url,)], "u string").select(C.is_transactional_url(C.F.col("u"))).first()[0] is proved


def test_each_url_is_classified_once(spark):
    urls = ["https://www.cerave.com/", "https://www.cerave.com/", None, None, "", "https://example.com/cart/"]
    rows = spark.createDataFrame(list(enumerate(urls)), "id long, url string")
    plain, once = C.classify(rows), C.classify_urls(rows)
    assert once.columns == plain.columns and sorted(map(str, once.collect())) == sorted(map(str, plain.collect()))
    assert once.filter("url is null").count() == 2
    assert "Aggregate [url" in once._jdf.queryExecution().optimizedPlan().toString()
