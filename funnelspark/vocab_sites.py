"""What sites are: fixed values of the page classifier. Operators take them as parameters."""

#: Registrable names without their top-level domain, by role. Marketplaces are retailers too.
MARKETPLACES = ["amazon", "walmart", "ebay", "etsy", "aliexpress", "target", "costco", "samsclub", "wish", "temu"]
RETAILERS = [
    "sephora", "ulta", "cvs", "walgreens", "riteaid", "kohls", "macys", "nordstrom", "dermstore", "lookfantastic", "iherb", "beautylish", "cultbeauty", "spacenk", "bluemercury", "skinstore", "yesstyle", "stylevana",
    "soko-glam", "sokoglam", "boots", "superdrug", "chemistwarehouse", "well", "thirteenlune", "credobeauty", "shoppersdrugmart",
]
SEARCH = ["google", "bing", "duckduckgo", "yahoo", "ecosia", "brave", "yandex", "baidu", "startpage", "kagi", "perplexity"]
COMMUNITY = ["reddit", "youtube", "tiktok", "instagram", "facebook", "pinterest", "quora", "twitter", "x", "threads", "makeupalley", "acne", "beautypedia", "trustpilot", "influenster"]
EDITORIAL = [
    "byrdie", "allure", "wirecutter", "nytimes", "cosmopolitan", "elle", "vogue", "harpersbazaar", "refinery29", "self", "glamour", "thecut", "goodhousekeeping", "prevention", "womenshealthmag", "instyle", "marieclaire",
    "realsimple", "buzzfeed", "businessinsider", "forbes", "rd", "today", "cnn", "nbcnews", "usatoday", "popsugar", "stylecraze", "who-what-wear", "whowhatwear", "dermstore-blog", "skincare",
]
REFERENCE = [
    "wikipedia", "webmd", "mayoclinic", "healthline", "medicalnewstoday", "aad", "nih", "ncbi", "nlm", "cdc", "everydayhealth", "verywellhealth", "clevelandclinic", "hopkinsmedicine", "medlineplus", "fda", "paulaschoice-eu",
]
BRAND_SITES = [
    "cerave", "theordinary", "deciem", "laroche-posay", "larocheposay", "cetaphil", "neutrogena", "olay", "paulaschoice", "drunkelephant", "theinkeylist", "glossier", "kiehls", "clinique", "esteelauder", "tatcha",
    "skinceuticals", "murad", "eltamd", "isdin", "bioderma", "avene", "vichy", "eucerin", "aveeno", "nivea", "garnier", "loreal", "lorealparisusa", "innisfree", "cosrx", "laneige", "beautyofjoseon", "supergoop",
    "firstaidbeauty", "youthtothepeople", "goodmolecules", "krave", "kravebeauty", "farmacybeauty", "biossance", "summerfridays", "versedskin", "cocokind", "naturium", "byoma", "herocosmetics", "tower28beauty", "drjart",
    "medicube", "anua", "skin1004", "torriden", "roundlab", "shiseido", "sk-ii", "lamer", "sundayriley", "glowrecipe", "mytopicals", "hellobubble", "elfcosmetics", "rocskincare", "vanicream", "stratiaskin",
]

#: Paths of a site's root, and labels of hosts that are variants of a site and no service.
ROOTS = ["", "/", "/index.html", "/home", "/us", "/en", "/en-us"]
VARIANTS = ["www", "www2", "m", "mobile", "amp", "en", "us", "l"]

#: Services of sites that have several: site, where they are told (host, path, root or fallback), subtype, weight, labels.
#: A fallback of no subtype means that an unknown service tells nothing; a site without one is read as any other.
SERVICES = [
    ("google", "host", "marketplace", 2.6, ["shopping"]),
    ("google", "host", "collection", 2.0, ["store"]),
    ("google", "host", "article", 2.5, ["news"]),
    ("google", "host", "wiki", 2.5, ["support", "scholar", "books", "developers"]),
    ("google", "host", "local", 2.5, ["maps"]),
    ("google", "host", "serp", 2.5, ["lens", "images"]),
    ("google", "host", "tool", 2.5, ["docs", "drive", "mail", "calendar", "meet", "photos", "translate", "pay", "gemini", "ads", "analytics", "cloud", "firebase", "colab", "sites"]),
    ("google", "host", "forum", 2.5, ["groups"]),
    ("google", "host", "account", 2.5, ["accounts", "myaccount"]),
    ("google", "host", "marketplace", 2.0, ["play"]),
    ("google", "path", "serp", 3.0, ["search", "webhp", "imghp"]),
    ("google", "path", "marketplace", 2.6, ["shopping"]),
    ("google", "path", "local", 2.5, ["maps"]),
    ("google", "path", "tool", 2.5, ["travel", "flights", "forms", "sheets", "slides", "drive", "intl", "business", "chrome"]),
    ("google", "path", "article", 2.0, ["finance"]),
    ("google", "path", "wiki", 2.5, ["books"]),
    ("google", "path", "tool", 1.0, ["url"]),
    ("google", "root", "serp", 3.0, [""]),
    ("google", "fallback", "", 0.0, [""]),
    ("bing", "path", "serp", 3.0, ["search"]),
    ("bing", "path", "serp", 2.5, ["images", "videos", "news"]),
    ("bing", "path", "marketplace", 2.4, ["shop"]),
    ("bing", "path", "local", 2.5, ["maps"]),
    ("bing", "path", "tool", 1.0, ["ck"]),
    ("bing", "root", "serp", 3.0, [""]),
    ("bing", "fallback", "serp", 1.5, [""]),
    ("yahoo", "host", "serp", 3.0, ["search"]),
    ("yahoo", "host", "tool", 2.5, ["mail"]),
    ("yahoo", "host", "article", 2.0, ["finance"]),
    ("yahoo", "host", "article", 2.5, ["news", "sports"]),
    ("yahoo", "host", "marketplace", 2.4, ["shopping"]),
    ("yahoo", "host", "account", 2.5, ["login"]),
    ("yahoo", "path", "article", 2.5, ["news"]),
    ("yahoo", "path", "article", 2.0, ["lifestyle", "entertainment"]),
    ("yahoo", "root", "serp", 3.0, [""]),
    ("yahoo", "fallback", "", 0.0, [""]),
    ("amazon", "host", "tool", 2.5, ["aws", "music", "advertising", "affiliate-program", "sellercentral", "kdp", "read"]),
    ("amazon", "host", "wiki", 2.5, ["developer"]),
    ("facebook", "host", "tool", 2.5, ["business", "ads"]),
    ("facebook", "host", "wiki", 2.5, ["developers"]),
    ("facebook", "path", "marketplace", 2.6, ["marketplace"]),
    ("facebook", "path", "tool", 2.5, ["business"]),
    ("facebook", "path", "wiki", 2.5, ["help", "policies"]),
    ("facebook", "path", "account", 2.5, ["login"]),
    ("instagram", "path", "marketplace", 2.2, ["shop"]),
    ("instagram", "path", "account", 2.5, ["accounts"]),
    ("youtube", "host", "tool", 2.5, ["music", "studio"]),
    ("youtube", "host", "wiki", 2.5, ["support"]),
    ("youtube", "path", "marketplace", 2.2, ["shopping"]),
    ("x", "host", "tool", 2.5, ["ads", "business"]),
    ("x", "host", "wiki", 2.5, ["help", "developer"]),
    ("twitter", "host", "tool", 2.5, ["ads", "business"]),
    ("twitter", "host", "wiki", 2.5, ["help", "developer"]),
    ("apple", "host", "wiki", 2.5, ["support", "developer"]),
    ("apple", "host", "tool", 2.5, ["music", "tv", "podcasts", "books", "appstoreconnect", "icloud"]),
    ("apple", "host", "marketplace", 2.0, ["apps"]),
    ("apple", "host", "account", 2.5, ["id"]),
    ("apple", "path", "collection", 2.0, ["shop", "store"]),
    ("microsoft", "host", "wiki", 2.5, ["support", "learn", "docs"]),
    ("microsoft", "host", "tool", 2.5, ["azure"]),
    ("microsoft", "host", "account", 2.5, ["login", "account"]),
    ("microsoft", "path", "marketplace", 2.0, ["store"]),
]

#: Votes of a path or query: subtype, weight, pattern on the path, pattern on "?" and the query; either one votes.
#: A "checkout" in the path counts only where the pattern before it doesn't; likewise for slugs of articles.
URL_VOTES = [
    ("pdp", 2.0, r"/(dp|gp/product|ip|product|products|p|prod|pd|itm)(/|$|-)", r"[?&](sku|productid|pid|asin)="),
    ("collection", 1.6, r"/(collections?|categor(y|ies)|shop|browse|store|c|b|departments?)(/|$)", None),
    ("cart", 2.5, r"/(cart|basket|(shopping-)?bag)(/|$|\.)|/gp/cart|/gp/aw/c", None),
    ("checkout", 2.5, r"/(checkouts?|payments?|buy)(/|$|\.)|/gp/buy", None),
    ("checkout", 1.8, r"checkout", None),
    ("order", 2.2, r"/(orders?|order-history|purchase-history)(/|$|\.)", None),
    ("wishlist", 2.2, r"/wishlist(/|$|\.)|/hz/wishlist", None),
    ("cart", 1.0, None, r"(^.|[?&_=-])cart\b"),
    ("checkout", 0.8, None, r"checkout"),
    ("serp", 2.0, r"/search", r"[?&](q|k|query|search|keyword)="),
    ("article", 1.8, r"/(blog|article|news|reviews?|guide|guides|best|stories|tips)(/|$)|best-.*-for|-review(s)?(-|/|$)|top-\d+", None),
    ("article", 1.5, r"(^|/|-)best-[a-z0-9]|(^|/)how-to-[a-z0-9]", None),
    (
        "article", 1.6,
        r"[a-z0-9]-vs-[a-z0-9]|difference-between|what-(is|are)-|why-(you|your|is|do|does)-|when-to-|which-[a-z0-9]+-(is|to)-|should-(you|i)-|do(es)?-you-need|benefits-of-|(^|/|-)benefits(/|-|$)|guide-to-|-explained(/|-|$)|-myths(/|-|$)|-mistakes(/|-|$)|can-you-use|is-it-(safe|worth|ok)",
        None,
    ),
]
WIKI_PATH = r"/(wiki|health|conditions?|how-to|howto|learn|ingredient)(/|$)"
SLUG_OF_GOODS = r"product|item|shop|cart|checkout|sku"
QUERY_TEXT = r"[?&](q|k|query|search|keyword)=[^&]+"

#: Votes of a directory's role.
ROLE_VOTES = {
    "search": [("serp", 3.0)], "community": [("forum", 3.0)], "editorial": [("article", 2.5)], "reference": [("wiki", 2.5)], "brand": [("brand_site", 1.5)], "retailer": [("listing", 0.6)],
    "marketplace": [("marketplace", 1.2), ("listing", 0.6)],
}

#: Subtypes that are neutral as to topic, that a url proves, and that have a seller whatever their category.
NEUTRAL = ["cart", "checkout", "order", "serp", "site_search", "marketplace", "homepage"]
TRANSACTIONAL = ["cart", "checkout", "order", "wishlist"]
SOLD = ["brand_site", "marketplace", "listing", "pdp", "collection"]
COMMERCE_CATEGORIES = ["brand_landing", "catalogue", "shopping"]
TOPICAL_SITES = ["beauty_and_cosmetics", "health", "e-commerce_and_shopping"]

#: Words of the topic; the last pattern's exception is an air conditioner.
RELEVANCE = (
    r"\b(skin ?care|serums?|moisturi[sz]ers?|cleansers?|sunscreen|spf|retinol|niacinamide|hyaluronic|salicylic|glycolic|vitamin c|ceramides?|toners?|exfoliants?|acne|blackheads?|wrinkles?|dark spots?|hyperpigmentation|"
    r"dermatolog\w*|pores?|breakouts?|rosacea|eczema|face ?creams?|eye ?creams?|peptides?|azelaic|anti[- ]ag(?:e?ing)|hair ?care|shampoos?|hair (?:masks?|oils?|serums?|sprays?|gels?|dyes?|loss|growth|types?|routines?|styling)|"
    r"scalp|dandruff|frizz|split ends|heat protectants?|leave[- ]in|keratin|curl (?:creams?|defin\w*)|curly hair|salon[- ]quality|body ?care|personal care|body (?:wash(?:es)?|lotions?|butters?|scrubs?|oils?)|hand creams?|"
    r"lip balms?|deodorants?|antiperspirants?|shower gels?|(?:sulfate|paraben|cruelty)[- ]free|shea butter|argan|jojoba|aloe vera|cosmetics|makeup|mascara|lipsticks?|lip gloss|eyeliners?|eyeshadows?|concealers?|bronzers?|"
    r"nail polish|setting sprays?|fragrances?|perfumes?|eau de (?:parfum|toilette)|k[- ]beauty|beauty (?:products?|routines?|brands?|editors?|tips?|essentials?)|conditioners?)\b"
)
AIR_CONDITIONER = r"\bair[ -]conditioners?\b"
