"""Queries of the page classifier: urls are sites crossed with paths, dealt over the events, and their content derives from the event's number. The SQL computes all channels from the same lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from funnelspark import vocab
from funnelspark import vocab_sites as V
from funnelspark.functions.url import parse_url
from funnelspark.operators import classify as C
from funnelspark.plans.catalogue import query
from funnelspark.plans.fixtures import table

HOSTS = [
    "www.amazon.com", "aws.amazon.com", "google.com", "docs.google.com", "www.google.co.uk", "news.google.com", "cn.bing.com", "es.yahoo.com", "shop.cerave.com", "www.sephora.com", "reddit.com", "www.byrdie.com", "www.nih.gov",
    "lab.example.edu", "unknownstore.com", "m.facebook.com", "support.apple.com", "www.apple.com", "youtube.com", "jbca.com", "en.wikipedia.org", "www.target.com", "a.b.paulaschoice.co.uk",
]
PATHS = [
    "", "/", "/us", "/dp/B00X", "/p?sku=12&checkout=1", "/collections/serums", "/cart/", "/cart/add-to-cart/product/1", "/checkouts/c/abc", "/checkout-now", "/order-history", "/hz/wishlist", "/?ref_=nav_cart", "/search?q=best+retinol",
    "/search?q=gaming+laptops", "/search", "/blog/best-serum-for-acne", "/eye-cream-vs-eye-serum", "/how-to-choose-sunscreen", "/marketplace/item/12", "/marketplace", "/shopping", "/maps/place", "/careers", "/wiki/Retinol", "/shop",
    "/what-is-niacinamide", "/top-10-moisturizers-reviews", "/products/cerave-moisturizing-cream", "/gp/cart/view.html", "/air-conditioner-parts-list", "/news/today",
]
TYPES = [["Product"], ["ItemList", "WebSite"], ["Article"], ["SearchResultsPage"], ["QAPage"], ["FAQPage"], ["Organization"], []]
ROLES = ["retailer", "brand", "editorial", "marketplace", "search", ""]

_q = lambda x: "'" + x.replace("'", "''") + "'"
_in = lambda some: "(" + ", ".join(map(_q, some)) + ")"
_list = lambda some: "[" + ", ".join(map(_q, some)) + "]"


def _urls(spark, sf):
    pick = lambda some, at: F.element_at(F.array(*[F.lit(x) for x in some]), (at + 1).cast("int"))
    e = F.col("event_id")
    url = F.concat(F.lit("https://"), pick(HOSTS, e % len(HOSTS)), pick(PATHS, F.floor(e / len(HOSTS)) % len(PATHS)))
    return table(spark, sf, "events").select("event_id", url.alias("url"))


_URLS = f"SELECT event_id, 'https://' || {_list(HOSTS)}[(event_id % {len(HOSTS)} + 1)::INT] || {_list(PATHS)}[((event_id // {len(HOSTS)}) % {len(PATHS)} + 1)::INT] AS url FROM events"


def _pages(spark, sf):
    """Urls with content and knowledge of the site, by digits of the event's number."""
    e = F.floor(F.col("event_id") / 7)
    kinds = F.element_at(F.array(*[F.array(*[F.lit(x) for x in t]).cast("array<string>") for t in TYPES]), (e % len(TYPES) + 1).cast("int"))
    full = e % 3 > 0
    return _urls(spark, sf).withColumns(
        {
            "title": F.when(full, F.when(e % 2 == 0, "Gentle cleanser and serum").otherwise("Engine parts")),
            "text": F.when(full, F.when(e % 4 == 1, "sunscreen spf makeup").otherwise("plain words")),
            "schema_types": F.when(full, kinds),
            "has_price": full & (e % 5 == 0),
            "has_add_to_cart": full & (e % 6 == 0),
            "n_products": F.when(full, (e % 4).cast("int")),
            "content_scope": F.when(e % 10 == 9, "base").otherwise("page"),
            "platform": F.when(e % 7 == 0, "shopify"),
            "prior_page_type": F.when(e % 11 == 0, "pdp"),
            "profile_relevance": F.when(e % 13 == 0, 0.6),
            "profile_seller": F.when(e % 13 == 0, "retailer"),
            "directory_role": F.element_at(F.array(*[F.lit(r) for r in ROLES]), (e % len(ROLES) + 1).cast("int")),
        }
    )


_KINDS = "[" + ", ".join("[" + ", ".join(_q(x.lower()) for x in t) + "]::VARCHAR[]" for t in TYPES) + "]"
_PAGES = f"""SELECT event_id, url, CASE WHEN f THEN CASE WHEN e % 2 = 0 THEN 'Gentle cleanser and serum' ELSE 'Engine parts' END ELSE '' END AS title, CASE WHEN f THEN CASE WHEN e % 4 = 1 THEN 'sunscreen spf makeup' ELSE 'plain words' END ELSE '' END AS text,
  CASE WHEN f THEN {_KINDS}[(e % {len(TYPES)} + 1)::INT] ELSE []::VARCHAR[] END AS types, f AND e % 5 = 0 AS price, f AND e % 6 = 0 AS cart, CASE WHEN f THEN e % 4 ELSE 0 END AS products, e % 10 <> 9 AS own,
  e % 7 = 0 AS store, e % 11 = 0 AS prior, CASE WHEN e % 13 = 0 THEN 0.6 ELSE 0.0 END AS profile, e % 13 = 0 AS sells, {_list(ROLES)}[(e % {len(ROLES)} + 1)::INT] AS role FROM (SELECT *, event_id // 7 AS e, (event_id // 7) % 3 > 0 AS f FROM ({_URLS}))"""
_BARE = f"SELECT *, '' AS title, '' AS text, []::VARCHAR[] AS types, false AS price, false AS cart, 0 AS products, true AS own, false AS store, false AS prior, 0.0 AS profile, false AS sells, '' AS role FROM ({_URLS})"


def _channels(base: str) -> str:
    """CTEs up to all votes: u (parsed), sv (with the service), votes (event_id, ch, pos, sub, w)."""
    rules = ", ".join(f"({_q(f'{site}|{where}|{label}')}, {_q(f'{sub}:{w}' if sub else '')})" for site, where, sub, w, labels in V.SERVICES for label in labels)
    demoted = lambda v: f"CASE WHEN depth >= 2 THEN regexp_replace({v}, '^marketplace:', 'listing:') ELSE {v} END"
    store = f"core IN {_in(V.RETAILERS + V.MARKETPLACES)}"
    each: list[str] = []

    def vote(ch: str, sub: str, w: str | float, when: str, source: str = "sv") -> None:
        sub = sub if sub.startswith("split") else _q(sub)
        each.append(f"SELECT event_id, {C.CHANNELS.index(ch)} AS ch, {len(each)} AS pos, {sub} AS sub, {w}::DOUBLE AS w FROM {source} WHERE {when}")

    hits = [" OR ".join(f"regexp_matches({c}, {_q(p)})" for c, p in (("path", a), ("'?' || query", b)) if p) for _, _, a, b in V.URL_VOTES]
    vote("url", "homepage", 2.0, f"path IN {_in(V.ROOTS)}")
    for i, (s, w, _, _) in enumerate(V.URL_VOTES):
        vote("url", s, w, f"({hits[i]})" + (f" AND NOT ({hits[i - 1]})" if (s, w) in (("checkout", 1.8), ("article", 1.5)) else ""))
    vote("url", "article", 0.9, f"depth = 1 AND len(regexp_extract_all(seg, '-')) >= 2 AND NOT {store} AND NOT regexp_matches(seg, {_q(V.SLUG_OF_GOODS)})")
    vote("url", "wiki", 1.2, f"regexp_matches(path, {_q(V.WIKI_PATH)})")
    vote("service", "split_part(svc, ':', 1)", "split_part(svc, ':', 2)", "svc <> ''")
    for sub, w, when in (
        ("serp", 3.0, f"core IN {_in(V.SEARCH)}"),
        ("forum", 3.0, f"core IN {_in(V.COMMUNITY)}"),
        ("article", 2.5, f"core IN {_in(V.EDITORIAL)}"),
        ("wiki", 2.5, f"(core IN {_in(V.REFERENCE)} OR top IN ('gov', 'edu'))"),
        ("marketplace", 1.2, f"core IN {_in(V.MARKETPLACES)}"),
        ("listing", 0.6, store),
        ("marketplace", 2.6, f"{store} AND path IN {_in(V.ROOTS)}"),
        ("brand_site", 1.5, f"core IN {_in(V.BRAND_SITES)}"),
    ):
        vote("domain", sub, w, f"svc IS NULL AND {when}")
    has = lambda *t: f"list_has_any(types, {_list(t)})"
    for sub, w, when in (
        ("pdp", 1.5, f"({has('product')} OR price)"),
        ("collection", 1.8, has("itemlist", "offercatalog", "collectionpage")),
        ("article", 1.2, has("article", "blogposting", "newsarticle", "review")),
        ("serp", 2.0, has("searchresultspage")),
        ("forum", 2.0, has("qapage", "discussionforumposting", "socialmediaposting")),
        ("wiki", 1.2, has("faqpage", "medicalwebpage", "howto")),
        ("homepage", 0.8, f"{has('organization', 'website')} AND NOT price AND products = 0"),
        ("pdp", 1.0, "cart"),
        ("collection", 1.2, "products >= 3"),
        ("pdp", 1.0, "products = 1"),
    ):
        vote("markup", sub, w, when)
    for sub, w in (("brand_site", 1.2), ("pdp", 0.4), ("collection", 0.3)):
        vote("platform", sub, w, f"store AND NOT {store}")
    silent = f"svc IS NULL AND event_id NOT IN (SELECT event_id FROM ({' UNION ALL '.join(x for x in each if f'SELECT event_id, {C.CHANNELS.index("domain")} ' in x)}))"
    for role, votes in V.ROLE_VOTES.items():
        for sub, w in votes:
            vote("directory", sub, w, f"role = {_q(role)} AND {silent}")
    vote("directory", "marketplace", 2.6, f"role IN ('retailer', 'marketplace') AND path IN {_in(V.ROOTS)} AND {silent}")
    vote("prior", "pdp", C.PRIOR, "prior")
    return f"""WITH base AS ({base}), parts AS (
      SELECT *, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, CASE WHEN regexp_extract(url, '://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE lower(regexp_extract(url, '://[^/?#]*([^?#]*)', 1)) END AS path, lower(regexp_extract(url, '\\?([^#]*)', 1)) AS query FROM base
    ), labels AS (SELECT *, string_split(host, '.') AS l, len(string_split(host, '.')) AS n FROM parts
    ), kept AS (SELECT *, CASE WHEN n >= 3 AND array_to_string(l[n - 1 : n], '.') IN {_in(vocab.TWO_LABEL_TLDS)} THEN 3 WHEN n >= 2 THEN 2 ELSE n END AS k FROM labels
    ), u AS (
      SELECT *, l[n - k + 1] AS core, l[n] AS top, CASE WHEN k < n THEN l[n - k] ELSE '' END AS label, len(list_filter(string_split(path, '/'), lambda s: s <> '')) AS depth, regexp_extract(path, '^/*([^/]*)', 1) AS seg FROM kept
    ), rules(k, v) AS (VALUES {rules}
    ), named AS (SELECT *, CASE WHEN label IN {_in(V.VARIANTS)} OR regexp_matches(label, '^[a-z][a-z]$') THEN '' ELSE label END AS lab FROM u
    ), sv AS (
      SELECT named.*, CASE WHEN core NOT IN {_in(sorted({s[0] for s in V.SERVICES}))} THEN NULL WHEN lab <> '' THEN coalesce({demoted("h.v")}, f.v)
        ELSE coalesce({demoted("p.v")}, CASE WHEN path IN {_in(V.ROOTS)} THEN r.v END, f.v) END AS svc
      FROM named LEFT JOIN rules h ON h.k = core || '|host|' || lab LEFT JOIN rules p ON p.k = core || '|path|' || seg AND seg <> '' LEFT JOIN rules r ON r.k = core || '|root|' LEFT JOIN rules f ON f.k = core || '|fallback|'
    ), votes AS ({" UNION ALL ".join(each)})"""


def _classified(base: str) -> str:
    cats = ", ".join(f"({_q(a)}, {_q(b)})" for a, b in vocab.SUBTYPE_CATEGORY.items())
    stages = " ".join(f"WHEN {_q(a)} THEN {_q(b)}" for a, b in vocab.CATEGORY_STAGE.items())
    i = C.CHANNELS.index
    names = ", ".join(f"CASE WHEN list_contains(fired, {i(k)}) THEN {_q(k)} END" for k in C.CHANNELS)
    stores = f"core IN {_in(V.RETAILERS + V.MARKETPLACES)}"
    lists = f"(core IN {_in(V.RETAILERS + V.MARKETPLACES + V.BRAND_SITES + V.SEARCH + V.COMMUNITY + V.EDITORIAL + V.REFERENCE)} OR top IN ('gov', 'edu'))"
    words = "regexp_replace(concat_ws(' ', title, '', '', text, regexp_replace(path || ' ' || query, '[-_+/=&?.]', ' ', 'g')), " + _q(f"(?i){V.AIR_CONDITIONER}") + ", ' ', 'g')"
    named = "|".join(b for b in V.BRAND_SITES if len(b) > 3)
    return (
        _channels(base)
        + f""", sums AS (SELECT event_id, sub, sum(w) AS w, min(pos) AS first FROM votes GROUP BY event_id, sub
    ), told AS (SELECT event_id, arg_max(sub, (w, -first)) AS told FROM sums GROUP BY event_id
    ), proof AS (SELECT event_id, arg_max(sub, (w, -first)) AS proof FROM (SELECT event_id, sub, sum(w) AS w, min(pos) AS first FROM votes WHERE ch = 0 AND sub IN {_in(V.TRANSACTIONAL)} GROUP BY event_id, sub HAVING sum(w) >= 2.0) GROUP BY event_id
    ), cats(sub, cat) AS (VALUES {cats}
    ), conf AS (SELECT event_id, round_even(1 / sum(exp(w - top)), 3) AS confidence FROM (SELECT event_id, w, max(w) OVER (PARTITION BY event_id) AS top FROM (SELECT event_id, cat, sum(w) AS w FROM votes JOIN cats USING (sub) GROUP BY event_id, cat)) GROUP BY event_id
    ), who AS (SELECT event_id, list(DISTINCT ch) AS fired FROM votes GROUP BY event_id
    ), chosen AS (SELECT *, coalesce(proof, told) AS sub FROM told LEFT JOIN proof USING (event_id) LEFT JOIN conf USING (event_id) LEFT JOIN who USING (event_id)
    ), mine AS (SELECT event_id, sum(w) FILTER (WHERE ch = {i("url")}) AS url_w, sum(w) FILTER (WHERE ch = {i("markup")}) AS markup_w, sum(w) FILTER (WHERE ch = {i("prior")}) AS prior_w, sum(w) FILTER (WHERE ch = {i("domain")}) AS domain_w,
        sum(w) FILTER (WHERE ch = {i("service")}) AS service_w, sum(w) FILTER (WHERE ch = {i("directory")}) AS directory_w FROM votes JOIN chosen USING (event_id, sub) GROUP BY event_id
    ), rel AS (SELECT event_id, greatest(least(len(regexp_extract_all({words}, {_q("(?i)" + V.RELEVANCE)})) / 4.0, 1.0), CASE WHEN core IN {_in(V.BRAND_SITES)} THEN 0.5 ELSE 0.0 END,
        CASE WHEN regexp_matches(lower({words}), {_q(named)}) THEN 0.4 ELSE 0.0 END) AS r0 FROM sv
    ), facts AS (
      SELECT sv.*, c.sub, c.told, c.proof, c.confidence, coalesce(c.fired, []) AS fired, c.sub IS NOT NULL AS voted, round_even(r0, 3) AS r0, CASE WHEN c.sub IS NULL THEN round_even(r0, 3) ELSE greatest(round_even(r0, 3), profile) END AS rel, cats.cat,
        url_w IS NOT NULL OR markup_w IS NOT NULL OR prior_w IS NOT NULL OR coalesce(domain_w, 0) >= 2 OR coalesce(service_w, 0) >= 2 OR coalesce(directory_w, 0) >= 2 AS earned, {lists} OR profile >= 0.15 AS known,
        coalesce(c.sub IN {_in(V.TRANSACTIONAL)} AND url_w IS NOT NULL, false) AS proved, (title <> '' OR text <> '') AND own AS real
      FROM sv JOIN rel USING (event_id) LEFT JOIN chosen c USING (event_id) LEFT JOIN mine USING (event_id) LEFT JOIN cats ON cats.sub = c.sub
    ), judged AS (
      SELECT *, CASE WHEN NOT voted THEN rel >= 0.15 ELSE rel >= 0.15 OR (sub IN {_in(V.NEUTRAL)} AND earned AND known AND NOT (sub IN ('serp', 'site_search') AND regexp_matches('?' || query, {_q(V.QUERY_TEXT)}))) OR proved END AS relevant,
        coalesce(cat IN {_in(V.COMMERCE_CATEGORIES)} OR sub IN {_in(V.SOLD)}, false) AS sold, coalesce(sub = 'brand_site' OR core IN {_in(V.BRAND_SITES)} OR role = 'brand', false) AS brand_own, {stores} OR role IN ('retailer', 'marketplace') AS retail FROM facts
    ), final AS (
      SELECT *, CASE WHEN NOT voted OR cat = 'unknown' THEN 'unknown' WHEN NOT relevant THEN CASE WHEN real THEN 'unrelated' WHEN NOT (earned AND (known OR store OR proved)) THEN 'unknown' ELSE cat END
        WHEN NOT real AND NOT (earned OR proved) THEN 'unknown' ELSE cat END AS page_category, CASE WHEN voted THEN sub ELSE 'other' END AS page_subtype FROM judged
    ) SELECT event_id, page_category, page_subtype, CASE WHEN NOT voted OR NOT sold THEN 'na' WHEN brand_own THEN 'brand_owned' WHEN retail THEN 'retailer' WHEN sells THEN 'retailer' WHEN store THEN 'brand_owned' ELSE 'na' END AS seller_type,
      CASE WHEN page_category = 'shopping' AND page_subtype IN ('cart', 'checkout') THEN 'Purchase' WHEN page_category = 'shopping' AND page_subtype = 'order' THEN 'Post-Purchase' ELSE CASE page_category {stages} END END AS funnel_stage,
      coalesce(confidence, 0.0) AS confidence, CASE WHEN list_contains(fired, {i("prior")}) THEN 'rule+prior' ELSE 'rule' END AS method, rel AS relevance, relevant AND page_category <> 'unrelated' AS is_study_relevant,
      CASE WHEN NOT voted THEN '' WHEN core IN {_in(V.BRAND_SITES)} OR role = 'brand' THEN core ELSE '' END AS primary_brand,
      array_to_string(list_filter([{names}, CASE WHEN (title <> '' OR text <> '') AND NOT list_contains(fired, {i("markup")}) THEN 'content' END, CASE WHEN proof <> told THEN 'url_override' END,
        CASE WHEN voted AND (profile > r0 OR (sold AND NOT brand_own AND NOT retail AND sells)) THEN 'domain_profile' END], lambda x: x IS NOT NULL), ',') AS signals FROM final"""
    )


RESULT = ["page_category", "page_subtype", "seller_type", "funnel_stage", "confidence", "method", "relevance", "is_study_relevant", "primary_brand"]


@query(_classified(_BARE))
def q_classify_url(spark, sf):
    return C.classify_urls(_urls(spark, sf)).select("event_id", *RESULT, F.array_join("signals", ",").alias("signals"))


@query(_classified(_PAGES))
def q_classify_page(spark, sf):
    return C.classify(_pages(spark, sf)).select("event_id", *RESULT, F.array_join("signals", ",").alias("signals"))


@query(_channels(_BARE) + " SELECT event_id, svc AS service FROM sv")
def q_service_route(spark, sf):
    u = parse_url(F.col("url"))
    return _urls(spark, sf).select("event_id", C.service_of(u["core"], u["subdomain"], u["path"]).alias("service"))


@query(
    _channels(_BARE)
    + f""", s AS (SELECT event_id, sub, sum(w) AS w, min(pos) AS first FROM votes WHERE ch = 0 AND sub IN {_in(V.TRANSACTIONAL)} GROUP BY event_id, sub HAVING sum(w) >= 2.0)
    SELECT u.event_id, arg_max(s.sub, (s.w, -s.first)) AS proof, coalesce(any_value(c.nv), 0) AS n_votes FROM u LEFT JOIN s USING (event_id) LEFT JOIN (SELECT event_id, count(*) AS nv FROM votes WHERE ch = 0 GROUP BY event_id) c USING (event_id) GROUP BY u.event_id"""
)
def q_url_votes(spark, sf):
    u = parse_url(F.col("url"))
    t = _urls(spark, sf).select("event_id", C.url_votes(u["core"], u["path"], u["query"]).alias("v"))
    return t.select("event_id", C.transactional(F.col("v")).alias("proof"), F.size("v").cast("long").alias("n_votes"))
