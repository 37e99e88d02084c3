"""Products of pages against mentions of chats, and platforms of pages, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelspark import vocab
from funnelspark.functions import text as T

STRENGTHS = ("none", "likely", "strong", "exact")
NAME, NGRAM, FUZZY = 0.34, 0.45, 0.72


def _clean(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), vocab.UNIT_NOISE, " ")


def _squashed(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"\s+", " ")


def _every(arrays: Column) -> Column:
    return F.array_distinct(F.flatten(arrays))


def _forms(tokens: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in vocab.FORMS.items() for x in kv])
    return F.filter(F.transform(tokens, lambda t: table[t]), lambda f: f.isNotNull())


def pair_facts(pairs: DataFrame, stopwords: tuple[str, ...] = vocab.STOPWORDS) -> DataFrame:
    """What the tiers need of (name, brand, category, sku, description, page_brand) and (entity, brands, sub_brands, categories, skus)."""
    tok = lambda c: T.tokens(c, stopwords)
    low = lambda a: F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    p = pairs.withColumns({"_name": _clean(F.col("name")), "_ent": _clean(F.col("entity")), "_brands": low(F.col("brands")), "_own": F.coalesce(F.nullif(T.normalize(F.col("brand")), F.lit("")), T.normalize(F.col("page_brand")))})
    p = p.withColumn("_mbrands", F.array_union("_brands", low(F.col("sub_brands")))).withColumn("_mtok", _every(F.transform("_brands", lambda b: tok(b))))
    p = p.withColumn("_core", F.array_except(tok(F.col("_name")), _every(F.array(tok(F.col("brand")), tok(F.col("page_brand")), F.col("_mtok")))))
    p = p.withColumn("_contain", T.containment(F.col("_core"), F.array_union(tok(F.col("_ent")), F.col("_mtok"))))
    head = F.substring(F.col("_ent"), F.lit(1), F.length("_name"))
    p = p.withColumn("_ngram", F.greatest(T.trigram_cosine(_squashed(F.col("_name")), _squashed(F.col("_ent"))), T.trigram_cosine(_squashed(F.col("_name")), _squashed(head))))
    inside = F.exists("_mbrands", lambda b: b.contains(F.col("_own")) | F.col("_own").contains(b))
    fuzzy = F.exists("_mbrands", lambda b: T.trigram_cosine(F.col("_own"), b) >= FUZZY)
    own = F.filter(tok(F.col("_own")), lambda t: (F.length(t) >= 3) & ~t.isin(*vocab.GENERIC_BRAND))
    some = F.size("_mbrands") > 0
    brand = F.when(F.col("_own") == "", "unknown").when(some & (inside | fuzzy), "agree").when(some, "conflict").when(F.arrays_overlap(own, tok(F.col("entity"))), "agree").otherwise("unknown")
    spf_p, spf_m = T.spf_numbers(F.concat_ws(" ", "name", "description")), T.spf_numbers(F.col("entity"))
    form_p, form_m = _forms(tok(F.col("_name"))), _forms(tok(F.col("_ent")))
    both = lambda a, b: (F.size(a) > 0) & (F.size(b) > 0)
    said = lambda a, b: F.when(F.arrays_overlap(a, b), "agree").otherwise("conflict")
    attr = F.when(both(spf_p, spf_m), said(spf_p, spf_m)).when(both(form_p, form_m), said(form_p, form_m)).otherwise("neutral")
    cats = _every(F.transform(low(F.col("categories")), lambda c: tok(c)))
    return p.withColumns({"_brand_rel": brand, "_attr": attr, "_cat": F.arrays_overlap(tok(F.col("category")), cats), "_sku": F.array_contains(low(F.col("skus")), T.normalize(F.col("sku"))) & (T.normalize(F.col("sku")) != "")})


def tier(facts: DataFrame) -> DataFrame:
    """score, match_type and match_strength of each pair of ``pair_facts``; a brand or attribute conflict never gets above likely."""
    n, contain, ngram = F.size("_core"), F.col("_contain"), F.col("_ngram")
    sim = F.greatest(contain, ngram)
    fine, cat = F.col("_attr") != "conflict", F.coalesce("_cat", F.lit(False))
    named = (n >= 2) & ((contain >= NAME) | (ngram >= NGRAM))
    verdict = lambda score, kind, strength: F.struct(F.bround(score, 4).alias("score"), F.lit(kind).alias("match_type"), F.lit(strength).alias("match_strength"))
    at_most = lambda top, x: F.least(F.lit(top), x)
    agree = (
        F.when(fine & (n >= 2) & ((contain >= 0.6) | (ngram >= 0.6)), verdict(at_most(1.0, 0.85 + 0.15 * sim), "brand+name", "exact"))
        .when(fine & named, verdict(at_most(0.84, 0.65 + 0.1 * sim + F.when((F.col("_attr") == "agree") | cat, 0.05).otherwise(0.0)), "brand+name", "strong"))
        .otherwise(verdict(F.lit(0.45), "brand", "likely"))
    )
    unknown = (
        F.when(fine & ((n >= 3) & (contain >= 0.85) | (n >= 2) & (ngram >= 0.7)), verdict(at_most(0.84, 0.6 + 0.2 * sim), "name", "strong"))
        .when((n >= 2) & ((contain >= 0.5) | (ngram >= 0.5)), verdict(0.35 + 0.1 * sim, "name", "likely"))
        .when(cat, verdict(F.lit(0.3), "category", "likely"))
        .when(sim > 0, verdict(0.2 * sim, "name", "none"))
        .otherwise(verdict(F.lit(0.0), "none", "none"))
    )
    conflict = F.when((sim >= 0.5) | cat, verdict(at_most(0.3, 0.3 * F.greatest(sim, F.lit(0.5))), "name", "likely")).otherwise(verdict(F.lit(0.0), "none", "none"))
    v = F.when(F.coalesce("_sku", F.lit(False)), verdict(F.lit(1.0), "sku", "exact")).when(F.col("_brand_rel") == "agree", agree).when(F.col("_brand_rel") == "unknown", unknown).otherwise(conflict)
    return facts.withColumn("_v", v).select(*[c for c in facts.columns if not c.startswith("_")], "_v.*", F.col("_brand_rel").alias("brand_relation"), F.col("_attr").alias("attribute_relation"))


def best_matches(products: DataFrame, mentions: DataFrame, on: str = "message_id", stopwords: tuple[str, ...] = vocab.STOPWORDS) -> DataFrame:
    """Each product's best mention among those of its page's messages: strongest, then highest score, then first. ``products`` has a list ``message_ids``."""
    pairs = products.withColumn(on, F.explode("message_ids")).join(mentions, on)
    scored = tier(pair_facts(pairs, stopwords))
    rank = F.array_position(F.array(*[F.lit(s) for s in STRENGTHS]), F.col("match_strength"))
    best = F.row_number().over(Window.partitionBy("product_id").orderBy(rank.desc(), F.desc("score"), on, "mention_id"))
    out = scored.withColumn("_r", best).filter("_r = 1").drop("_r")
    return out.withColumn("coincides", F.col("match_strength").isin("exact", "strong"))


def detect_platform(headers: Column, html: Column, commerce: tuple[str, ...] = vocab.COMMERCE) -> Column:
    """The first sign of a commerce platform, else the first of any, else ''. ``headers``: map of header names to values."""
    names = F.transform(F.map_keys(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda k: F.lower(k))
    lowered = F.map_from_entries(F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]), F.lower(e["value"]))))
    server = F.concat_ws(" ", F.try_element_at(lowered, F.lit("server")), F.try_element_at(lowered, F.lit("x-powered-by")))
    page = F.lower(F.substring(F.coalesce(html, F.lit("")), 1, 200_000))
    header = lambda sign: F.exists(names, lambda k: k.startswith(sign))
    signs = [(header(s), p) for s, p in vocab.HEADER_SIGNS] + [(server.contains(s), p) for s, p in vocab.SERVER_SIGNS]
    for s, p in vocab.HTML_SIGNS:
        if p == "wordpress":
            signs.append((page.contains(s) & page.contains("woocommerce"), "woocommerce"))
        signs.append((page.contains(s), p))
    signs.append((page.contains("static1.squarespace.com") & page.contains("sqs-add-to-cart"), "squarespace_commerce"))
    first = lambda some: F.coalesce(*[F.when(c, p) for c, p in some])
    return F.coalesce(first([s for s in signs if s[1] in commerce]), first([s for s in signs if s[1] not in commerce]), F.lit(""))
