"""Secret scans, with DataFrame functions only.

Base kinds are found by pattern. The method adds spans of kind ``random``: runs of 20
or more characters of key alphabets that look random and don't look like ordinary
text. The narrowest encoding that has all characters of a run is inferred (hex, one
case of letters, base32, base36, letters, base58, base62, base64), and three tests are
made of it, each read under two hypotheses.

* Random: characters are uniform and independent. Chi-squared test over the alphabet,
  runs about its middle, serial correlation of neighbours, combined by Fisher's
  method. A run that is rejected at ``DISMISS`` is no secret.
* Ordinary: characters are those of words, joined by case, digits or signs, as the
  whole table has them. The same three figures get one-sided p-values for being too
  random: the uniformity statistic is too small for the letters' frequencies, case and
  kind change too often for the length of words, and neighbours are too improbable
  after each other by the table's letter pairs. Fisher's method combines them.

The discoveries whose false share is bounded are the reported secrets:
Benjamini-Hochberg control at ``FDR`` over the p-values under "ordinary" (1 where
"random" was rejected) of all candidates of the table, by classes of length.

The letter pairs, frequencies and lengths of words come from all tokens of letters and
digits of under 20 characters in all texts (grouped before they are counted). A candidate
may also be ordinary by those of the words ``COMMON``; of both p-values the larger counts. p-values are counted in
bins of 1/8 nat (at most 401 for each of 33 classes), so no task ranks all candidates.

Defined cases: null text is empty; offsets count code points; repeated rows and ties
get equal results; texts of any length are scanned whole, in time that grows with
their length; an empty table gives an empty result; other columns are left alone
whatever their names are.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelspark.llm.workspace import Workspace, unused

#: The kinds in their order and their patterns.
ASSIGN = r"""(?=[pPsStTaA])(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_HEAD = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

#: What every match of ASSIGN with 6 characters in its group 2 holds; most texts hold none.
ASSIGN_PART = r"""[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6}"""

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Candidates of the randomness tests: characters and least length. Listed one by one, characters are tested by one lookup instead of range after range.
LEAST = 20
_PLAIN = _UPPER + _LOWER + _DIGITS
_CLASS = f"[{_PLAIN}+/_=-]"
CANDIDATE = f"{_CLASS}{{{LEAST},}}"
#: What parts tokens: all but letters, digits and ``+/_=-``.
BETWEEN = f"[^{_CLASS}[\\p{{L}}\\p{{N}}]]+"
#: Encodings from the narrowest on: pattern of the whole candidate (without padding, ``-_`` as ``+/``), alphabet.
ENCODINGS = (
    ("[0-9a-f]+", _DIGITS + "abcdef"),
    ("[0-9A-F]+", _DIGITS + "ABCDEF"),
    ("[a-z]+", _LOWER),
    ("[A-Z]+", _UPPER),
    ("[a-z2-7]+", _LOWER + "234567"),
    ("[A-Z2-7]+", _UPPER + "234567"),
    ("[a-z0-9]+", _LOWER + _DIGITS),
    ("[A-Z0-9]+", _UPPER + _DIGITS),
    ("[A-Za-z]+", _UPPER + _LOWER),
    ("[1-9A-HJ-NP-Za-km-z]+", "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"),
    ("[A-Za-z0-9]+", _DIGITS + _UPPER + _LOWER),
    ("[A-Za-z0-9+/]+", _UPPER + _LOWER + _DIGITS + "+/"),
)
#: Share of false secrets among the reported ones; level at which a candidate is dismissed as not random.
FDR, DISMISS = 0.01, 0.001
BINS, CLASSES = 400, 32
#: Common words, mostly English ones that names are made of: what ordinary text is where a table's own words are few or of another kind.
COMMON = (
    "the", "of", "and", "to", "in", "is", "for", "on", "with", "as", "by", "this", "that", "from", "not", "are", "have", "all", "new", "more", "other", "time", "year", "first", "last", "next", "work", "people", "day", "part",
    "get", "set", "has", "add", "remove", "user", "name", "value", "data", "file", "list", "string", "number", "type", "class", "index", "item", "object", "account", "service", "request", "response", "message", "error",
    "handler", "manager", "create", "update", "delete", "default", "version", "document", "report", "config", "option", "system", "table", "image", "content", "project", "process", "format", "public", "private", "change",
    "country", "question", "company", "school", "family", "student", "problem", "program", "government", "history", "community", "president", "business", "research", "education", "market", "language", "development",
    "quarterly", "annual", "average", "water", "money", "story", "month", "right", "study", "health", "person", "product", "customer", "support", "quality", "security", "network", "library", "function", "variable",
    "parameter", "property", "interface", "component", "template", "directory", "context", "connection", "database", "transaction", "schedule", "calendar", "position", "location", "address", "language", "summary", "details",
    "example", "archive", "backup", "upload", "download", "browser", "keyboard", "graphic", "colour", "width", "height", "weight", "journal", "library", "chapter", "article", "author", "general", "special", "simple", "complex",
    "der", "die", "und", "nicht", "eine", "les", "des", "est", "une", "pour", "los", "una", "por", "que", "con", "2", "3", "10", "2023", "2024", "v1", "v2", "q3", "id7",
)
#: Symbols of the pair model: a word's edge, a digit, letters.
SYMBOLS = "^0" + _LOWER
#: What is added to the count of each pair.
SMOOTH = 0.5
#: Matches that are added up, or pieces that are cut, together.
BLOCK = 128


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _blocks(z: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the number of each block of BLOCK elements; ``z`` is not empty."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / BLOCK).cast("int")), body)


def _running(sizes: Column) -> Column:
    """Running totals of an array of int; blocks keep the copying of partial results small."""
    grow = lambda a, x: F.array_append(a, F.coalesce(F.element_at(a, F.when(F.size(a) > 0, -1)), F.lit(0)) + x)
    sums = lambda arr: F.aggregate(arr, F.array().cast("array<int>"), grow)
    within = lambda z: _blocks(z, lambda i: _let(F.slice(z, i * BLOCK + 1, F.lit(BLOCK)), sums))
    before = lambda each: F.concat(F.array(F.lit(0)), sums(F.transform(each, lambda b: F.element_at(b, -1))))
    shifted = lambda each: _let(before(each), lambda o: F.flatten(F.zip_with(each, F.slice(o, F.lit(1), F.size(each)), lambda b, at: F.transform(b, lambda x: x + at))))
    return _let(sizes, lambda z: F.when(F.size(z) == 0, F.array().cast("array<int>")).otherwise(_let(within(z), shifted)))


def _spans(text: Column, pattern: str, part: str = "") -> Column:
    """array<struct<s, e, m>> of the leftmost non-overlapping matches; offsets in code points. None where the text doesn't hold ``part``."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    none = F.array().cast("array<struct<s:int,e:int,m:string>>")
    found = _let(
        F.struct(hits.alias("h"), gaps.alias("g")),
        lambda x: _let(
            _running(F.zip_with(F.slice(x["g"], F.lit(1), F.size(x["h"])), x["h"], lambda g, h: g + F.length(h))), lambda ends: F.zip_with(ends, x["h"], lambda e, h: F.struct((e - F.length(h)).alias("s"), e.alias("e"), h.alias("m")))
        ),
    )
    return F.when(text.rlike(part) & text.rlike(pattern) if part else text.rlike(pattern), found).otherwise(none)


def _kind(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e")))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",")


def _tail(z: Column) -> Column:
    """P(N(0, 1) > z), by a rational approximation (error under 2e-7) and, far out, by the asymptotic bound."""
    t = 1 / (1 + 0.3275911 * F.abs(z) / 2**0.5)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    upper = 0.5 * poly * F.exp(-z * z / 2)
    return F.greatest(F.when(z >= 0, upper).otherwise(1 - upper), F.lit(1e-300))


def _fisher(*p: Column) -> Column:
    """-log of the combined p-value of three."""
    half = -sum((F.log(F.least(F.lit(1.0), x)) for x in p), F.lit(0.0))
    return half - F.log(1 + half + half * half / 2)


def _symbols(word: Column) -> Column:
    """The word as symbols of the pair model, between edges; a capital after a small letter or digit begins a word."""
    parted = F.regexp_replace(F.regexp_replace(word, "(?<=[a-z0-9])(?=[A-Z])", "^"), "[+/_=-]+", "^")
    return F.regexp_replace(F.concat(F.lit("^"), F.regexp_replace(F.lower(parted), "[0-9]", "0"), F.lit("^")), r"\^{2,}", "^")


def _places(symbols: Column) -> Column:
    """Place of each neighbouring pair in the table of pairs, from 1."""
    codes = F.transform(F.filter(F.split(symbols, ""), lambda c: c != ""), lambda c: F.instr(F.lit(SYMBOLS), c))  # substring would walk from the start for each
    return _let(codes, lambda z: F.zip_with(F.slice(z, F.lit(1), F.size(z) - 1), F.slice(z, F.lit(2), F.size(z) - 1), lambda a, b: (a - 1) * len(SYMBOLS) + b))


def _total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)


@dataclass
class Ordinary:
    """What words look like: cost of each pair, its mean and deviation over distinct words (names are made of rarer ones than prose), frequencies' second and third moments, changes of kind for each character."""

    cost: list[float]
    mean: float
    deviation: float
    a2: float
    a3: float
    changes: float

    def surprise(self, symbols: Column) -> Column:
        """Sum of the pairs' costs."""
        table = F.split(F.lit(",".join(f"{c:.9f}" for c in self.cost)), ",").cast("array<double>")  # folded to one literal
        return _let(table, lambda t: _total(F.transform(_places(symbols), lambda i: F.element_at(t, i))))


def _costs(count: list[list[float]]) -> list[float]:
    return [-math.log(c / sum(row)) for row in count for c in row]


def _shares(count: list[list[float]]) -> dict[str, float]:
    """The moments of the characters' frequencies, digits taken as equally frequent."""
    k = len(SYMBOLS)
    letters = [sum(count[i][j] for i in range(k)) for j in range(1, k)]
    share = [letters[0] / sum(letters) / 10] * 10 + [x / sum(letters) for x in letters[1:]]
    return {"a2": sum(x**2 for x in share), "a3": sum(x**3 for x in share)}


def _moments(s: float, n: float, ss: float, sn: float, nn: float) -> tuple[float, float]:
    """Mean cost of a pair and its deviation, from sums of words' costs and lengths."""
    mean = s / n
    return mean, math.sqrt(max(ss - 2 * mean * sn + mean**2 * nn, 1e-9) / n)


def common() -> Ordinary:
    """The model of the words COMMON; a word's own pairs don't count in its cost."""
    k = len(SYMBOLS)
    count = [[SMOOTH] * k for _ in range(k)]
    places = []
    for w in COMMON:
        y = [SYMBOLS.index("0" if c in _DIGITS else c) for c in f"^{w}^"]
        places.append(list(zip(y, y[1:], strict=False)))
        for a, b in places[-1]:
            count[a][b] += 1
    each = [(sum(-math.log((count[a][b] - own.count((a, b))) / (sum(count[a]) - sum(x == a for x, _ in own))) for a, b in own), len(own)) for own in places]
    mean, deviation = _moments(sum(s for s, _ in each), sum(n for _, n in each), sum(s * s for s, _ in each), sum(s * n for s, n in each), sum(n * n for _, n in each))
    return Ordinary(_costs(count), mean, deviation, changes=2 * len(COMMON) / sum(map(len, COMMON)), **_shares(count))


def learned(texts: DataFrame, work: Workspace) -> Ordinary | None:
    """The model of all words in the column ``t``; None without words."""
    tokens = texts.select(F.explode(F.split("t", BETWEEN)).alias("w")).filter((F.octet_length("w") < LEAST) & F.col("w").rlike(f"^[{_PLAIN}]+$"))
    words = work.write(tokens.groupBy("w").agg(F.count("*").alias("c")).select("c", F.length("w").alias("n"), _symbols(F.col("w")).alias("y")), "words")
    k = len(SYMBOLS)
    count = [[SMOOTH] * k for _ in range(k)]
    for r in words.select("c", F.explode(_places(F.col("y"))).alias("at")).groupBy("at").agg(F.sum("c").alias("c")).collect():  # a row for each pair of symbols at most
        count[(r["at"] - 1) // k][(r["at"] - 1) % k] += r["c"]
    model = Ordinary(_costs(count), 0.0, 0.0, changes=0.0, **_shares(count))
    each = _with(words.filter("n > 1"), s=model.surprise(F.col("y")), steps=(F.length("y") - 1).cast("double"))
    sums = [F.sum(a * b).alias(name) for name, a, b in (("s", F.col("s"), F.lit(1.0)), ("n", F.col("steps"), F.lit(1.0)), ("ss", F.col("s"), F.col("s")), ("sn", F.col("s"), F.col("steps")), ("nn", F.col("steps"), F.col("steps")))]
    m = each.agg(*sums, F.count("*").alias("words"), F.sum(F.col("n")).alias("chars")).first()
    if not m.words:
        return None
    model.mean, model.deviation = _moments(m.s, m.n, m.ss, m.sn, m.nn)
    model.changes = min(0.5, 2 * m.words / m.chars)
    return model


def _with(t: DataFrame, **columns: Column) -> DataFrame:
    """``t`` with more columns, which later expressions read and don't repeat."""
    return t.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def _squares(chars: Column) -> Column:
    """Sum over distinct characters of count * (count - 1)."""
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, d: _let(F.size(F.filter(chars, lambda x: x == d)).cast("double"), lambda c: a + c * (c - 1)))


def _tested(found: DataFrame, models: list[Ordinary]) -> DataFrame:
    """rid, s, e, bin (of the p-value under "ordinary"), size (class of length) of each candidate."""
    bare = F.translate(F.rtrim(F.col("m"), F.lit("=")), "-_", "+/")
    code = F.lit(None).cast("string")
    for pattern, alphabet in reversed(ENCODINGS):
        code = F.when(F.col("bare").rlike(f"^{pattern}$"), alphabet).otherwise(code)
    t = found.select("rid", "s", "e", bare.alias("bare")).filter((F.length("bare") >= LEAST) & F.col("bare").rlike("[A-Za-z]"))
    letters = lambda x: F.filter(F.split(x, ""), lambda c: c != "")
    kinds = F.translate("bare", _DIGITS + _LOWER + _UPPER + "+/", "0" * 10 + "a" * 26 + "A" * 26 + "++")
    changes = (F.regexp_count(kinds, F.lit("0+|a+|A+|\\++")) - 1).cast("double")
    t = _with(t, code=code, chars=letters(F.col("bare")), folded=letters(F.regexp_replace(F.lower("bare"), "[^a-z0-9]", "")), y=_symbols(F.col("bare")), changes=changes)
    centred = F.transform("chars", lambda c: F.instr(F.col("code"), c).cast("double") - (F.length("code") + 1) / 2)
    t = _with(t.filter("code is not null"), n=F.size("chars").cast("double"), k=F.length("code").cast("double"), f=F.size("folded").cast("double"), steps=(F.length("y") - 1).cast("double"), at=centred)
    t = _with(t, **{f"cost{i}": m.surprise(F.col("y")) for i, m in enumerate(models)})
    ahead = F.arrays_zip(F.slice("at", F.lit(1), F.size("at") - 1).alias("x"), F.slice("at", F.lit(2), F.size("at") - 1).alias("y"))
    t = _with(t, pairs=ahead, mean=_total(F.col("at")) / F.col("n"), same=_squares(F.col("at")), own=_squares(F.col("folded")), high=_total(F.transform("at", lambda x: F.when(x > 0, 1.0).otherwise(0.0))))
    t = _with(
        t,
        runs=_total(F.transform("pairs", lambda p: F.when((p["x"] > 0) != (p["y"] > 0), 1.0).otherwise(0.0))) + 1,
        cov=_total(F.transform("pairs", lambda p: (p["x"] - F.col("mean")) * (p["y"] - F.col("mean")))),
        var=_total(F.transform("at", lambda x: F.pow(x - F.col("mean"), F.lit(2.0)))),
        mu=2 * F.col("high") * (F.col("n") - F.col("high")) / F.col("n") + 1,
        chi=F.greatest((F.col("same") + F.col("n")) * F.col("k") / F.col("n") - F.col("n"), F.lit(0.0)),
    )
    n, d, f = F.col("n"), F.col("k") - 1, F.col("f")
    sd = F.sqrt(F.greatest((F.col("mu") - 1) * (F.col("mu") - 2) / F.greatest(n - 1, F.lit(1.0)), F.lit(1e-9)))
    z = {
        "chi": (F.pow(F.col("chi") / d, F.lit(1 / 3)) - (1 - 2 / (9 * d))) / F.sqrt(2 / (9 * d)),
        "runs": F.when((F.col("high") == 0) | (F.col("high") == n), F.sqrt(n)).otherwise(F.abs(F.col("runs") - F.col("mu")) / sd),
        "serial": F.when(F.col("var") <= 0, F.sqrt(n)).otherwise(F.abs(F.col("cov") / F.col("var") * F.sqrt(n) + 1 / F.sqrt(n))),
    }
    for i, m in enumerate(models):
        spread = F.sqrt(F.greatest(2 * f * (f - 1) * (m.a2 + 2 * (f - 2) * m.a3 - (2 * f - 3) * m.a2**2), F.lit(1e-9)))
        z[f"even{i}"] = (f * (f - 1) * m.a2 - F.col("own")) / spread
        z[f"mixed{i}"] = (F.col("changes") - 0.5 - (n - 1) * m.changes) / F.sqrt((n - 1) * m.changes * (1 - m.changes))
        z[f"odd{i}"] = (F.col(f"cost{i}") - F.col("steps") * m.mean) / (F.sqrt("steps") * m.deviation)
    t = _with(t.select("rid", "s", "e", "n", *[x.alias(f"z_{k}") for k, x in z.items()]), **{f"p_{k}": _tail(F.col(f"z_{k}")) for k in z})
    least = lambda *k: _fisher(*[F.col(f"p_{x}") for x in k])
    both = {f"q{i}": least(f"even{i}", f"mixed{i}", f"odd{i}") for i in range(len(models))}
    t = _with(t, random=_fisher(F.col("p_chi"), 2 * F.col("p_runs"), 2 * F.col("p_serial")), **both)
    ordinary = F.when(F.col("random") > -math.log(DISMISS), 0.0).otherwise(F.least(*both, F.lit(BINS / 8)))
    size = F.least(F.floor(F.log2("n") * 2), F.lit(CLASSES)).cast("int")
    return t.select("rid", "s", "e", F.least(F.floor(F.greatest(ordinary, F.lit(0.0)) * 8), F.lit(BINS)).cast("int").alias("bin"), size.alias("size"))


def _free(rows: DataFrame) -> DataFrame:
    """rid, s, e, m of the candidates that overlap no base span."""
    some = rows.filter(F.size("found") > 0)
    alone = some.filter(F.size("base") == 0).select("rid", F.inline("found"))
    both = some.filter(F.size("base") > 0)
    events = both.select("rid", F.inline("found")).withColumn("own", F.lit(False)).unionByName(both.select("rid", F.inline("base")).select("rid", "s", "e", F.lit(None).cast("string").alias("m"), F.lit(True).alias("own")))
    ahead = Window.partitionBy("rid").orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    behind = Window.partitionBy("rid").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before, after = F.max(F.when(F.col("own"), F.col("e"))).over(ahead), F.min(F.when(F.col("own"), F.col("s"))).over(behind)
    placed = events.withColumn("before", before).withColumn("after", after).filter("not own and (before is null or before <= s) and (after is null or after >= e)")
    return alone.unionByName(placed.select("rid", "s", "e", "m"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """One row per document: id_col, rid (hash of id and text), base and spans: arrays of (s start, k index in KINDS, e end) by s, k."""
    work = Workspace(docs.sparkSession, "secrets")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col).cast("string")).alias("rid"), text.alias("t"))
    models = [m for m in (common(), learned(rows.select("t"), work)) if m]
    assign = F.filter(_spans(F.col("t"), ASSIGN, ASSIGN_PART), lambda x: F.length(F.regexp_replace(x["m"], ASSIGN_HEAD, "")) >= 6)
    base = F.array_sort(F.concat(_kind(assign, 0), _kind(_spans(F.col("t"), ACCESS, CANDIDATE), 1), _kind(_spans(F.col("t"), HEX, CANDIDATE), 2)))  # both hold a candidate
    rows = work.write(rows.select("id", "rid", base.alias("base"), _spans(F.col("t"), CANDIDATE).alias("found")), "found")
    tested = work.write(_tested(_free(rows), models), "tested")
    hist = tested.groupBy("size", "bin").agg(F.count("*").alias("n"))
    least_p = Window.partitionBy("size").orderBy(F.desc("bin"))
    ranked = hist.withColumn("rank", F.sum("n").over(least_p)).withColumn("m", F.sum("n").over(Window.partitionBy("size")))
    cut = ranked.filter(F.exp(-F.col("bin") / 8) <= F.lit(fdr) * F.col("rank") / F.col("m")).groupBy("size").agg(F.min("bin").alias("cut"))
    random = tested.join(F.broadcast(cut), "size").filter(F.col("bin") >= F.col("cut"))  # at most CLASSES + 1 rows
    random = random.groupBy("rid").agg(F.collect_set(F.struct("s", F.lit(3).alias("k"), "e")).alias("more"))
    out = rows.select("id", "rid", "base").join(random, "rid", "left")
    spans = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more")))
    return out.select(F.col("id").alias(id_col), "rid", "base", spans.alias("spans"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind, digest of the base spans and all spans as text."""
    n = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select(id_col, n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _merged(found: DataFrame) -> DataFrame:
    """rid, spans: (s, e) in order, overlapping ones as one."""
    each = found.select("rid", F.inline("spans")).select("rid", "s", "e").distinct()
    order = Window.partitionBy("rid").orderBy("s", "e")
    top = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parts = each.withColumn("new", F.coalesce(F.col("s") >= top, F.lit(True)).cast("int")).withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = parts.groupBy("rid", "part").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return whole.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span found (overlapping ones as one) replaced by ``mark``; rows without spans are as they were."""
    key, spans, rid = (unused(c, docs.columns) for c in ("_key", "_spans", "_rid"))
    found = _merged(scan(docs, id_col, text_col)).select(F.col("rid").alias(rid), F.col("spans").alias(spans))
    text = F.col(text_col)

    def block(z: Column, i: Column) -> Column:
        begin = F.when(i == 0, 0).otherwise(F.element_at(z, F.greatest(i * BLOCK, F.lit(1)))["e"])

        def pieces(own: Column) -> Column:
            """Each piece before a span, with the mark, from one cut of the text."""
            body = F.substring(text, begin + 1, F.element_at(own, -1)["e"] - begin)
            before = F.slice(F.concat(F.array(begin), F.transform(own, lambda x: x["e"])), F.lit(1), F.size(own))
            return _let(body, lambda t: F.array_join(F.zip_with(own, before, lambda x, at: F.concat(F.substring(t, at - begin + 1, x["s"] - at), F.lit(mark))), ""))

        return _let(F.slice(z, i * BLOCK + 1, F.lit(BLOCK)), pieces)

    clean = _let(F.col(spans), lambda z: F.concat(F.array_join(_blocks(z, lambda i: block(z, i)), ""), F.substring(text, F.element_at(z, -1)["e"] + 1, F.length(text))))
    keyed = docs.withColumn(key, F.xxhash64(F.col(id_col), text.cast("string")))
    joined = keyed.join(found, F.col(key) == F.col(rid), "left")
    return joined.withColumn(text_col, F.when(F.col(spans).isNull(), text).otherwise(clean)).select(*docs.columns)
