"""Page classification by votes of independent channels, as one plan of Column expressions.

``classify`` reads ``url`` and, where the table has them, a page's content and what is
known of its site (see ``OPTIONAL``); without content it is the classification of the
bare url. A vote is (channel, subtype, weight); all votes of a page are one array, in
the order of channels, so sums, the first of equal subtypes and the question who voted
are array functions and nothing is shuffled.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelspark import vocab
from funnelspark import vocab_sites as V
from funnelspark.functions.url import parse_url
from funnelspark.operators.qa import category_of, stage_of

CHANNELS = ["url", "service", "domain", "markup", "platform", "directory", "model", "prior"]
#: Columns that a table of pages may have, with their types.
OPTIONAL = {
    "title": "string", "h1": "array<string>", "description": "string", "text": "string", "og": "map<string,string>", "schema_types": "array<string>", "has_price": "boolean", "has_add_to_cart": "boolean", "n_products": "int",
    "content_scope": "string", "platform": "string", "chat_brands": "array<string>", "prior_page_type": "string", "prior_category": "string", "prior_seller": "string", "prior_retailer": "string",
    "profile_relevance": "double", "profile_seller": "string", "directory_role": "string", "directory_category": "string", "model_votes": "map<string,double>",
}
VOTE = "array<struct<ch:int,sub:string,w:double>>"
#: Weight of the vendor's prior, least votes that earn a subtype or prove a transaction, least relevance, weight of the model.
PRIOR, EARNS, RELEVANT, MODEL = 3.0 * 0.5, 2.0, 0.15, 2.0


def _vote(channel: str, sub: Column | str, w: Column | float, when: Column) -> Column:
    sub, w = (x if isinstance(x, Column) else F.lit(x) for x in (sub, w))
    return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(CHANNELS.index(channel)).alias("ch"), sub.alias("sub"), w.cast("double").alias("w")))


def _votes(*each: Column) -> Column:
    return F.filter(F.array(*each), lambda v: v.isNotNull()).cast(VOTE)


def is_root(path: Column) -> Column:
    return path.isin(*V.ROOTS)


def url_votes(core: Column, path: Column, query: Column) -> Column:
    """What path and query say."""
    hits = {i: reduce(lambda a, b: a | b, [c.rlike(p) for c, p in ((path, on_path), (F.concat(F.lit("?"), query), on_query)) if p]) for i, (_, _, on_path, on_query) in enumerate(V.URL_VOTES)}
    for weaker in (("checkout", 1.8), ("article", 1.5)):  # counts only where the vote before it doesn't
        at = next(i for i, v in enumerate(V.URL_VOTES) if v[:2] == weaker)
        hits[at] = hits[at] & ~hits[at - 1]
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    slug = F.get(segments, F.lit(0))
    post = (F.size(segments) == 1) & (F.regexp_count(slug, F.lit("-")) >= 2) & ~core.isin(*V.RETAILERS, *V.MARKETPLACES) & ~slug.rlike(V.SLUG_OF_GOODS)
    return _votes(_vote("url", "homepage", 2.0, is_root(path)), *[_vote("url", s, w, hits[i]) for i, (s, w, *_) in enumerate(V.URL_VOTES)], _vote("url", "article", 0.9, post), _vote("url", "wiki", 1.2, path.rlike(V.WIKI_PATH)))


def service_of(core: Column, subdomain: Column, path: Column) -> Column:
    """'subtype:weight' of the service of a site with several, '' if such a site tells nothing, null on other sites."""
    table = {f"{site}|{where}|{label}": f"{sub}:{w}" if sub else "" for site, where, sub, w, labels in V.SERVICES for label in labels}
    rules = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    rule = lambda where, label: rules[F.concat(core, F.lit(f"|{where}|"), label)]
    label = F.regexp_extract(subdomain, r"([^.]*)$", 1)
    label = F.when(label.isin(*V.VARIANTS) | label.rlike("^[a-z]{2}$"), "").otherwise(label)
    segment = F.regexp_extract(path, "^/*([^/]*)", 1)
    deep = F.size(F.filter(F.split(path, "/"), lambda s: s != "")) >= 2
    item = lambda r: F.when(deep, F.regexp_replace(r, "^marketplace:", "listing:")).otherwise(r)
    fallback = rule("fallback", F.lit(""))
    on_path = F.coalesce(item(F.when(segment != "", rule("path", segment))), F.when(is_root(path), rule("root", F.lit(""))), fallback)
    return F.when(core.isin(*sorted({s[0] for s in V.SERVICES})), F.when(label != "", F.coalesce(item(rule("host", label)), fallback)).otherwise(on_path))


def service_votes(service: Column) -> Column:
    return _votes(_vote("service", F.split(service, ":")[0], F.split(service, ":")[1], F.coalesce(service, F.lit("")) != ""))


def domain_votes(core: Column, host: Column, registrable: Column, path: Column, brand_words: Column) -> Column:
    """What the lists of sites say; ``brand_words``: normalised names of the page's and the conversation's brands."""
    top = F.substring_index(registrable, ".", -1)
    like_brand = F.exists(brand_words, lambda b: (F.length(b) > 2) & (core != "") & (b.contains(core) | core.contains(b)))
    store = core.isin(*V.RETAILERS, *V.MARKETPLACES)
    return _votes(
        _vote("domain", "serp", 3.0, core.isin(*V.SEARCH)),
        _vote("domain", "forum", 3.0, core.isin(*V.COMMUNITY)),
        _vote("domain", "article", 2.5, core.isin(*V.EDITORIAL)),
        _vote("domain", "wiki", 2.5, core.isin(*V.REFERENCE) | top.isin("gov", "edu") | host.rlike(r"\.(gov|edu)$")),
        _vote("domain", "marketplace", 1.2, core.isin(*V.MARKETPLACES)),
        _vote("domain", "listing", 0.6, store),
        _vote("domain", "marketplace", 2.6, store & is_root(path)),
        _vote("domain", "brand_site", 1.5, core.isin(*V.BRAND_SITES) | like_brand),
    )


def markup_votes(types: Column, og: Column, has_price: Column, has_cart: Column, n_products: Column) -> Column:
    """What markup and products say."""
    any_of = lambda *t: F.arrays_overlap(types, F.array(*[F.lit(x) for x in t]))
    kind = F.lower(F.coalesce(F.try_element_at(og, F.lit("og:type")), F.lit("")))
    told = any_of("article", "blogposting", "newsarticle", "review", "webpage") & (kind == "article")
    return _votes(
        _vote("markup", "pdp", 1.5, any_of("product") | (kind == "product") | has_price),
        _vote("markup", "collection", 1.8, any_of("itemlist", "offercatalog", "collectionpage")),
        _vote("markup", "article", 1.5, told),
        _vote("markup", "article", 1.2, ~told & any_of("article", "blogposting", "newsarticle", "review")),
        _vote("markup", "serp", 2.0, any_of("searchresultspage")),
        _vote("markup", "forum", 2.0, any_of("qapage", "discussionforumposting", "socialmediaposting")),
        _vote("markup", "wiki", 1.2, any_of("faqpage", "medicalwebpage", "howto")),
        _vote("markup", "homepage", 0.8, any_of("organization", "website") & ~has_price & (n_products == 0)),
        _vote("markup", "pdp", 1.0, has_cart),
        _vote("markup", "collection", 1.2, n_products >= 3),
        _vote("markup", "pdp", 1.0, n_products == 1),
    )


def platform_votes(platform: Column, core: Column) -> Column:
    """A store's platform speaks where the lists know no retailer."""
    store = platform.isin(*vocab.COMMERCE) & ~core.isin(*V.RETAILERS, *V.MARKETPLACES)
    return _votes(*[_vote("platform", s, w, store) for s, w in (("brand_site", 1.2), ("pdp", 0.4), ("collection", 0.3))])


def directory_votes(role: Column, path: Column) -> Column:
    return _votes(*[_vote("directory", s, w, role == r) for r, votes in V.ROLE_VOTES.items() for s, w in votes], _vote("directory", "marketplace", 2.6, role.isin("retailer", "marketplace") & is_root(path)))


def _sums(votes: Column, name) -> Column:
    """(w, -place, name) of each distinct name of the votes."""
    names = F.array_distinct(F.transform(votes, name))
    return F.transform(names, lambda s, i: F.struct(F.aggregate(F.filter(votes, lambda v: name(v) == s), F.lit(0.0), lambda a, v: a + v["w"]).alias("w"), (-i).alias("place"), s.alias("name")))


def transactional(own: Column) -> Column:
    """The subtype that the url's votes prove, or null."""
    sums = F.filter(_sums(F.filter(own, lambda v: v["sub"].isin(*V.TRANSACTIONAL)), lambda v: v["sub"]), lambda s: s["w"] >= EARNS)
    return F.array_max(sums)["name"]


def is_transactional_url(url: Column) -> Column:
    u = parse_url(url)
    return transactional(url_votes(u["core"], u["path"], u["query"])).isNotNull()


def relevance(text: Column, core: Column, chat_brands: Column, site_category: Column, extra: tuple[str, ...] = ()) -> Column:
    """Topical score: a quarter for each word, with floors by site and brands."""
    terms = [r"\s+".join(re.escape(w) for w in t.split()) for t in extra if t.strip()]
    hits = F.regexp_count(F.regexp_replace(text, f"(?i){V.AIR_CONDITIONER}", " "), F.lit(f"(?i){V.RELEVANCE}"))
    hits = hits + (F.regexp_count(text, F.lit(rf"(?i)\b(?:{'|'.join(terms)})\b")) if terms else F.lit(0))
    blob = F.lower(F.trim(text))
    named = "|".join(re.escape(b) for b in V.BRAND_SITES if len(b) > 3)
    floor = lambda cond, x: F.when(F.coalesce(cond, F.lit(False)), x).otherwise(0.0)
    chat = F.exists(chat_brands, lambda b: (b != "") & blob.contains(b))
    score = F.greatest(F.least(hits / 4, F.lit(1.0)), floor(core.isin(*V.BRAND_SITES), 0.5), floor(blob.rlike(named), 0.4), floor(chat, 0.6), floor(F.lower(site_category).isin(*V.TOPICAL_SITES), 0.3))
    return F.bround(score, 3)


def classify(pages: DataFrame, extra_terms: tuple[str, ...] = ()) -> DataFrame:
    """``pages`` with page_category, page_subtype, seller_type, funnel_stage, confidence, method, relevance, is_study_relevant, primary_brand, signals."""
    c = {k: F.col(k).cast(t) if k in pages.columns else F.lit(None).cast(t) for k, t in OPTIONAL.items()}
    word = lambda k: F.coalesce(c[k], F.lit(""))
    texts = lambda k: F.coalesce(c[k], F.array().cast("array<string>"))
    norm = lambda x: F.lower(F.trim(x))
    own_brand = norm(F.coalesce(F.try_element_at(c["og"], F.lit("product:brand")), F.lit("")))
    u = parse_url(F.coalesce("url", F.lit("")))
    t = pages.withColumn("_u", F.struct(*[v.alias(k) for k, v in u.items()]))
    part = lambda k: F.col(f"_u.{k}")
    chat = F.transform(texts("chat_brands"), norm)
    t = t.withColumn("_service", service_of(part("core"), part("subdomain"), part("path"))).withColumn("_url", url_votes(part("core"), part("path"), part("query")))
    silent = F.array().cast(VOTE)
    brands = F.concat(F.array(own_brand), chat)
    t = t.withColumn("_domain", F.when(F.col("_service").isNull(), domain_votes(part("core"), part("host"), part("registrable"), part("path"), brands)).otherwise(silent))
    listed = F.col("_service").isNull() & (F.size("_domain") == 0)
    types = F.transform(texts("schema_types"), lambda x: F.lower(x))
    has_price, n_products = F.coalesce(c["has_price"], F.lit(False)), F.coalesce(c["n_products"], F.lit(0))
    prior = F.create_map(*[F.lit(x) for kv in vocab.PAGE_TYPE_SUBTYPE.items() for x in kv])[F.lower(word("prior_page_type"))]
    model = F.transform(F.map_entries(F.coalesce(c["model_votes"], F.create_map().cast("map<string,double>"))), lambda e: F.struct(F.lit(CHANNELS.index("model")).alias("ch"), e["key"].alias("sub"), e["value"].alias("w")))
    scope = F.coalesce(c["content_scope"], F.lit("page"))
    own_words = scope.isin("page", "stripped")
    every = F.concat(
        "_url",
        service_votes(F.col("_service")),
        "_domain",
        markup_votes(types, c["og"], has_price, F.coalesce(c["has_add_to_cart"], F.lit(False)), n_products),
        platform_votes(word("platform"), part("core")),
        F.when(listed, directory_votes(word("directory_role"), part("path"))).otherwise(silent),
        model.cast(VOTE),
        _votes(_vote("prior", prior, PRIOR, prior.isNotNull())),
    )
    t = t.withColumn("_votes", every)
    told = F.array_max(_sums(F.col("_votes"), lambda v: v["sub"]))["name"]
    t = t.withColumn("_told", told).withColumn("_proof", transactional(F.col("_url"))).withColumn("_sub", F.coalesce("_proof", "_told"))
    groups = F.filter(F.transform(_sums(F.transform("_votes", lambda v: F.struct(category_of(v["sub"]).alias("sub"), v["w"].alias("w"))), lambda v: v["sub"]), lambda s: s["w"]), lambda w: w > 0)
    t = t.withColumn("_category", category_of(F.col("_sub"))).withColumn("_groups", groups)
    softmax = F.bround(1 / F.aggregate("_groups", F.lit(0.0), lambda a, w: a + F.exp(w - F.array_max("_groups"))), 3)
    url_text = F.regexp_replace(F.concat_ws(" ", part("path"), part("query")), "[-_+/=&?.]", " ")
    text = F.concat_ws(" ", word("title"), word("description"), F.array_join(texts("h1"), " "), F.substring(word("text"), 1, 3000), url_text)
    site = F.when(word("prior_category") != "", c["prior_category"]).otherwise(word("directory_category"))
    t = t.withColumn("_own_rel", relevance(text, part("core"), chat, site, extra_terms))
    profile = F.coalesce(c["profile_relevance"], F.lit(0.0))
    voted = F.size("_votes") > 0
    rel = F.when(voted, F.greatest("_own_rel", F.bround(profile, 3))).otherwise(F.col("_own_rel"))
    lists = part("core").isin(*V.RETAILERS, *V.MARKETPLACES, *V.BRAND_SITES, *V.SEARCH, *V.COMMUNITY, *V.EDITORIAL, *V.REFERENCE) | F.substring_index(part("registrable"), ".", -1).isin("gov", "edu")
    by = lambda channel, least=None: F.exists("_votes", lambda v: (v["ch"] == CHANNELS.index(channel)) & (v["sub"] == F.col("_sub")) & (F.lit(True) if least is None else v["w"] >= least))
    summed = lambda channel: F.aggregate(F.filter("_votes", lambda v: (v["ch"] == CHANNELS.index(channel)) & (v["sub"] == F.col("_sub"))), F.lit(0.0), lambda a, v: a + v["w"])
    earned = by("url") | by("markup") | by("prior") | (summed("domain") >= EARNS) | by("service", EARNS) | (summed("directory") >= EARNS) | by("model", 0.5 * MODEL)
    t = t.withColumns({"_rel": rel, "_known": lists | (profile >= RELEVANT), "_earned": earned, "_proved": F.col("_sub").isin(*V.TRANSACTIONAL) & by("url")})
    asked = F.col("_sub").isin("serp", "site_search") & F.concat(F.lit("?"), part("query")).rlike(V.QUERY_TEXT)
    neutral = F.col("_sub").isin(*V.NEUTRAL) & F.col("_earned") & ~asked
    t = t.withColumn("_relevant", F.when(voted, (F.col("_rel") >= RELEVANT) | (neutral & F.col("_known")) | F.col("_proved")).otherwise(F.col("_rel") >= RELEVANT))
    store = part("core").isin(*V.RETAILERS, *V.MARKETPLACES)
    owned = word("platform").isin(*vocab.COMMERCE)
    brand_own = (F.col("_sub") == "brand_site") | part("core").isin(*V.BRAND_SITES) | (word("directory_role") == "brand")
    sold = F.col("_category").isin(*V.COMMERCE_CATEGORIES) | F.col("_sub").isin(*V.SOLD)
    retail = store | (word("prior_retailer") != "") | word("directory_role").isin("retailer", "marketplace") | F.lower(word("prior_seller")).isin("1p", "3p")
    by_profile = sold & ~brand_own & ~retail & word("profile_seller").isin("brand_owned", "retailer")
    seller = F.when(~sold, "na").when(brand_own, "brand_owned").when(retail, "retailer").when(by_profile, word("profile_seller")).when(owned, "brand_owned").otherwise("na")
    has_content = (word("title") != "") | (word("text") != "") | (F.size(F.coalesce(c["og"], F.create_map().cast("map<string,string>"))) > 0)
    real = has_content & own_words
    structural = F.col("_known") | owned
    off = F.when(real, "unrelated").when(~(F.col("_earned") & (structural | F.col("_proved"))), "unknown").otherwise(F.col("_category"))
    on = F.when(~real & ~(F.col("_earned") | F.col("_proved")), "unknown").otherwise(F.col("_category"))
    final = F.when(~voted, "unknown").when(F.col("_category") == "unknown", "unknown").when(~F.col("_relevant"), off).otherwise(on)
    fired = lambda k: F.exists("_votes", lambda v: v["ch"] == CHANNELS.index(k))
    used_profile = voted & ((profile > F.col("_own_rel")) | by_profile)
    names = [F.when(fired(k), k) for k in CHANNELS] + [F.when(has_content & ~fired("markup"), "content"), F.when(F.col("_proof").isNotNull() & (F.col("_proof") != F.col("_told")), "url_override"), F.when(used_profile, "domain_profile")]
    brand = F.when(part("core").isin(*V.BRAND_SITES) | (word("directory_role") == "brand"), part("core")).otherwise(own_brand)
    subtype = F.when(voted, F.col("_sub")).otherwise("other")
    out = t.withColumns(
        {
            "page_category": final,
            "page_subtype": subtype,
            "seller_type": F.when(voted, seller).otherwise("na"),
            "funnel_stage": stage_of(final, subtype),
            "confidence": F.when(voted & (F.size("_groups") > 0), softmax).otherwise(0.0),
            "method": F.when(fired("prior"), "rule+prior").otherwise("rule"),
            "relevance": F.col("_rel"),
            "is_study_relevant": F.col("_relevant") & (final != "unrelated"),
            "primary_brand": F.when(voted, brand).otherwise(""),
            "signals": F.filter(F.array(*names), lambda x: x.isNotNull()),
        }
    )
    return out.drop(*[x for x in out.columns if x.startswith("_")])


def classify_urls(rows: DataFrame) -> DataFrame:
    """``rows`` with the class of their ``url`` alone: each distinct url is classified once."""
    each = classify(rows.select("url").distinct()).withColumnRenamed("url", "_class_url")
    return rows.join(each, rows["url"].eqNullSafe(each["_class_url"]), "left").drop("_class_url")


def confident(classified: DataFrame, least: float) -> DataFrame:
    """Pages under the least confidence become unknown."""
    weak = F.col("confidence") < least
    return classified.withColumn("funnel_stage", F.when(weak, "Irrelevant").otherwise(F.col("funnel_stage"))).withColumn("page_category", F.when(weak, "unknown").otherwise(F.col("page_category")))


def scope_of(own_ok: Column, stripped_ok: Column, base_ok: Column, directory_ok: Column) -> Column:
    """Whose words stand for a page: its own, the stripped url's, the site's, the directory's, none."""
    return F.when(own_ok, "page").when(stripped_ok, "stripped").when(base_ok, "base").when(directory_ok, "directory").otherwise("none")
