"""Default vocabularies. Every operator takes its vocabulary as a parameter; these are fixed values."""

STAGES = ["Awareness", "Discovery", "Evaluation", "Intent", "Purchase", "Post-Purchase"]

#: Regular expressions of each funnel stage, on lower-cased text.
STAGE_PATTERNS = {
    "Awareness": [r"what is\b", r"how does .* work", r"explain", r"what causes", r"is .* bad for", r"why (do|does|is)"],
    "Discovery": [r"what (products|options|brands)", r"recommend", r"best .* for", r"suggest", r"what should i (use|try)", r"any good", r"dupe"],
    "Evaluation": [r"\bvs\b", r"versus", r"compare", r"difference between", r"which (one )?is better", r"better than", r"worth it", r"reviews? (of|for)", r"pros and cons", r"ingredients (in|of)"],
    "Intent": [r"where (can i|to) buy", r"price of", r"how much (is|does)", r"in stock", r"coupon", r"discount", r"cheapest", r"under \$?\d+", r"should i (buy|get|order)", r"link to"],
    "Purchase": [r"i('m| am) (buying|ordering|purchasing)", r"just (bought|ordered)", r"add(ed)? to cart", r"checkout", r"placed (an|the) order"],
    "Post-Purchase": [r"i('ve| have) been using", r"i (bought|got|ordered) .* (and|but)", r"how (do i|to) (use|apply)", r"is it normal", r"after using", r"return (it|this)", r"refund", r"stopped working", r"irritat", r"breaking me out", r"got worse", r"side effect"],
}

#: Intents in their priority; the last is the default.
INTENT_PATTERNS = {
    "comparison": [r"\bvs\b", r"\bversus\b", r"which is better", r"difference between", r"\bor\b.*\?", r"compare"],
    "purchase": [r"best product", r"what do you recommend", r"recommend", r"where (can i|to) buy", r"worth it", r"which.*should i (buy|get)", r"\bbuy\b", r"\bdupe\b", r"best .* for", r"what should i (use|try)"],
    "troubleshooting": [r"irritat", r"got worse", r"reaction", r"breaking out", r"can i (combine|mix|use)", r"side effect", r"\bburn", r"how do i fix"],
    "routine": [r"routine", r"application order", r"morning and night", r"step by step"],
    "informational": [r"what is", r"how does", r"good for", r"explain", r"what does"],
}

POSITIVE = "love loved great amazing good works worked perfect gentle effective improved improvement happy best helps helped cleared glowing smooth recommend recommended favorite favourite nice excellent soothing hydrating".split()
NEGATIVE = "hate hated bad terrible awful irritating irritated irritation burn burns burning breakout breakouts worse worsened reaction allergic dry drying sting stings redness itchy disappointed waste useless harsh greasy".split()
NEGATORS = "not no never isn't wasn't doesn't didn't won't can't don't isnt wasnt doesnt didnt dont".split()

CATEGORY_STAGE = {"brand_landing": "Discovery", "catalogue": "Discovery", "editorial": "Evaluation", "community": "Evaluation", "reference": "Awareness", "search": "Intent", "shopping": "Intent", "unrelated": "Irrelevant", "unknown": "Irrelevant"}
SUBTYPE_CATEGORY = {
    "homepage": "brand_landing", "landing": "brand_landing", "brand_site": "brand_landing", "collection": "catalogue", "category": "catalogue", "marketplace": "catalogue", "listing": "catalogue",
    "pdp": "shopping", "cart": "shopping", "checkout": "shopping", "order": "shopping", "wishlist": "shopping", "article": "editorial", "review": "editorial", "listicle": "editorial", "serp": "search",
    "site_search": "search", "forum": "community", "social": "community", "qa": "community", "wiki": "reference", "health": "reference", "howto": "reference", "local": "reference", "tool": "unrelated",
    "account": "unrelated", "other": "unknown",
}
PAGE_TYPE_SUBTYPE = {"pdp": "pdp", "search": "serp", "checkout": "checkout", "marketplace": "marketplace", "category": "category", "retailer_site": "listing", "brand_site": "brand_site", "other": "other"}

#: Top-level domains of two labels.
TWO_LABEL_TLDS = ("co.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in", "com.mx", "co.kr", "com.tr", "co.za", "com.sg", "com.hk", "co.il")

#: Query keys that tell which page a url is.
IDENTITY_KEYS = ("q", "k", "p", "query", "search", "keyword", "page", "variant", "variant_id", "sku", "productid", "pid", "asin", "id", "itemid", "item", "v", "t", "tag")

#: Ledger: factor -> (central value, low, high, status). The first eight are the bottom-up chain.
LEDGER = {
    "device_coverage": (0.42, 0.30, 0.55, "benchmark"),
    "panel_representativeness": (1.0, 0.80, 1.25, "assumed"),
    "window_recovery": (1.35, 1.10, 1.90, "assumed"),
    "cart_to_order": (0.32, 0.20, 0.45, "benchmark"),
    "cross_device_completion": (1.15, 1.00, 1.40, "assumed"),
    "ropo_multiplier": (3.2, 1.5, 6.0, "placeholder"),
    "basket_value": (24.0, 14.0, 38.0, "placeholder"),
    "brand_match_precision": (0.85, 0.70, 0.95, "estimated"),
    "incrementality": (0.25, 0.10, 0.45, "placeholder"),
    "influence_given_exposure": (0.18, 0.06, 0.35, "placeholder"),
}

#: Words of products that tell nothing, units that are no identity, forms and their synonyms, brand words too generic to name a brand.
STOPWORDS = ("the", "and", "for", "with", "a", "an", "of", "to", "in", "on", "skin", "care", "skincare", "product", "products", "oz", "ml", "fl", "pack")
UNIT_NOISE = r"\b\d+(?:\.\d+)?\s?(?:ml|l|liter|litre|oz|fl ?oz|g|kg|mg|count|ct|pack|pk|pcs|pieces)\b"
FORMS = {
    "cream": "cream", "lotion": "lotion", "gel": "gel", "serum": "serum", "essence": "serum", "oil": "oil", "balm": "balm", "ointment": "balm", "wash": "cleanser", "cleanser": "cleanser", "foam": "cleanser",
    "soap": "cleanser", "spray": "spray", "mist": "spray", "stick": "stick", "bar": "bar", "mask": "mask", "conditioner": "conditioner", "shampoo": "shampoo", "toner": "toner", "exfoliant": "exfoliant", "peel": "exfoliant", "sunscreen": "sunscreen",
}
GENERIC_BRAND = "cosmetics beauty skincare labs lab inc llc co company brand official store shop the usa paris london simple pure natural fresh true real basic daily clean".split()

#: Platform signs: header prefixes, server substrings, html substrings, in their order; commerce platforms win over the others.
COMMERCE = ("shopify", "woocommerce", "bigcommerce", "magento", "salesforce_commerce", "prestashop", "shopware", "squarespace_commerce", "wix_stores")
HEADER_SIGNS = [
    ("x-shopify-stage", "shopify"), ("x-shopid", "shopify"), ("x-sorting-hat-shopid", "shopify"), ("x-shardid", "shopify"), ("x-storefront-renderer", "shopify"), ("x-bc-", "bigcommerce"), ("x-magento-", "magento"),
    ("x-dw-request-base-id", "salesforce_commerce"), ("x-sf-cc-", "salesforce_commerce"), ("x-prestashop-", "prestashop"), ("x-shopware-", "shopware"), ("x-wix-request-id", "wix"), ("x-wix-", "wix"), ("x-contextid", "squarespace"),
    ("cf-ray", "cloudflare"), ("cf-cache-status", "cloudflare"), ("x-akamai-", "akamai"), ("akamai-", "akamai"), ("x-vercel-", "vercel"), ("x-nf-request-id", "netlify"),
]
SERVER_SIGNS = [("cloudflare", "cloudflare"), ("akamai", "akamai"), ("bigcommerce", "bigcommerce"), ("squarespace", "squarespace")]
HTML_SIGNS = [
    ("cdn.shopify.com", "shopify"), ("shopify.theme", "shopify"), ("wp-content/plugins/woocommerce", "woocommerce"), ('content="woocommerce', "woocommerce"), ("mage/cookies", "magento"), ("magento_", "magento"),
    ("demandware.static", "salesforce_commerce"), ("cdn11.bigcommerce.com", "bigcommerce"), ("static.parastorage.com", "wix"), ("static1.squarespace.com", "squarespace"), ("prestashop", "prestashop"), ('content="wordpress', "wordpress"), ("assets.website-files.com", "webflow"),
]
