"""URL filters by a path-template tree.

Rules come first: of those that fit a url's host (or a domain above it) and the start
of its path, the longest decides. For all other urls the tree decides, whose labels are
the verdicts of the rules. It is built per host, level by level, until no path goes on:

* Variable segments become classes: a segment with a digit before its first dot keeps
  its first character and what follows the dot (``1*``, ``8*.html``); so does every
  segment of a node with more than ``WIDE`` different ones that has fewer than two urls
  for each on average.
* Branches that are statistically similar merge into ``*``: those whose share of blocked
  urls doesn't differ from that of their siblings (two-proportion z-test). The host's own
  labels decide if it has ``ENOUGH`` on both sides; else those of all hosts at the same
  template do.
* A template without siblings below it ends in ``**``, so single long paths cost no levels.
* A template is rejected when its smoothed share of blocked urls is ``REJECT`` or more: a
  host's own share is shrunk towards that of the same template over all hosts, and this
  one towards the share of all urls, with the weight of ``PRIOR`` urls each.

Only counts per host and path of classes are moved, so a host with a third of all urls
costs what its paths cost; one job a level. Defined cases: null urls and urls without
``://`` have an empty host and path, are a template of their own and get its verdict;
urls of any length are read whole; without decided urls every verdict is allow; repeated
rows are judged alike (there are no ties: all equal paths of a host have one template);
an empty table gives an empty result; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelspark.llm.workspace import Workspace

#: A node with more different segments than this may be one of variable segments.
WIDE = 16
#: Labelled urls that a host needs in a branch, and beside it, to decide by its own.
ENOUGH = 8
#: A branch keeps its name from this many standard errors on.
DIFFERS = 3.0
#: Weight of the prior share in urls, and the share from which a template is rejected.
PRIOR, REJECT = 4.0, 0.75


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(url)), r"^[^?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """(rule like ``net/``, verdict) of the longest rule that fits; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def classes(path: Column) -> Column:
    """The path's segments, those with digits as classes."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    return F.transform(parts, lambda s: F.regexp_replace(s, r"^(?=[^.]*[0-9])([^.])[^.]*", "$1*"))


def _differs(k1: Column, b1: Column, k: Column, b: Column) -> Column:
    """Whether b1 of k1 differ from the others of b of k; false without others or without both kinds."""
    k2, b2 = k - k1, b - b1
    share = F.try_divide(b, k)
    error = F.sqrt(share * (1 - share) * (F.try_divide(F.lit(1), k1) + F.try_divide(F.lit(1), k2)))
    return F.coalesce((error > 0) & (F.abs(F.try_divide(b1, k1) - F.try_divide(b2, k2)) > DIFFERS * error), F.lit(False))


def _level(nodes: DataFrame, depth: int, work: Workspace) -> DataFrame:
    """Nodes whose templates have one segment more; ``open`` nodes only, others as they are."""
    done = nodes.filter(~F.col("open"))
    one = nodes.filter("open").groupBy("host", "t").agg(F.count("*").alias("rows"), F.countDistinct(F.element_at("seg", depth + 1)).alias("d"), F.sum("n").alias("whole"))
    here = nodes.filter("open").join(one, ["host", "t"])
    s = F.element_at("seg", depth + 1)
    first = F.concat(F.substring(s, 1, 1), F.lit("*"), F.regexp_extract(s, r"[^.](\..*)?$", 1))
    here = here.withColumn("s", F.when((F.col("d") > WIDE) & (2 * F.col("d") > F.col("whole")) & ~s.contains("*"), first).otherwise(s))
    here = work.write(here.select("host", "general", "seg", "t", "s", "n", "k", "b", (F.col("rows") == 1).alias("single")), "here")
    sums = [F.sum("k").alias("k"), F.sum("b").alias("b")]
    own = here.groupBy("host", "t", "s").agg(*sums)
    total = own.groupBy("host", "t").agg(F.sum("k").alias("hk"), F.sum("b").alias("hb"))
    all_ = own.groupBy("t", "s").agg(F.sum("k").alias("ak"), F.sum("b").alias("ab"))
    all_total = all_.groupBy("t").agg(F.sum("ak").alias("tk"), F.sum("ab").alias("tb"))
    shared = all_.join(all_total, "t").select("t", "s", _differs(F.col("ak"), F.col("ab"), F.col("tk"), F.col("tb")).alias("everywhere"))
    enough = (F.col("k") >= ENOUGH) & (F.col("hk") - F.col("k") >= ENOUGH)
    named = F.when(enough, _differs(F.col("k"), F.col("b"), F.col("hk"), F.col("hb"))).otherwise(F.col("everywhere"))
    stats = own.join(total, ["host", "t"]).join(shared, ["t", "s"]).select("host", "t", "s", named.alias("named"))
    out = here.join(stats, ["host", "t", "s"])
    longer = F.concat("t", F.lit("/"), F.when(F.col("named"), F.col("s")).otherwise("*"))
    ends = F.col("single") | (F.size("seg") <= depth + 1)
    t = F.when(F.col("single") & (F.size("seg") > depth + 1), F.concat(longer, F.lit("/**"))).otherwise(longer)
    return done.unionByName(out.select("host", "general", "seg", t.alias("t"), "n", "k", "b", (~ends).alias("open")))


def templates(judged: DataFrame) -> DataFrame:
    """host, general (array of classes), template, share of blocked urls, verdict. judged: host, general, ruled (verdict of a rule or null)."""
    nodes = judged.groupBy("host", F.array_join("general", "/").alias("general")).agg(F.first("general").alias("seg"), F.count("*").alias("n"), F.count("ruled").alias("k"), F.count(F.when(F.col("ruled") == "block", 1)).alias("b"))
    work = Workspace(judged.sparkSession, "urls")
    nodes = work.write(nodes.select("host", "general", "seg", F.lit("").alias("t"), "n", "k", "b", F.lit(True).alias("open")), "nodes")
    depth = 0
    while nodes.filter("open").take(1):  # a level is read several times by the next: written, the plan doesn't grow
        nodes = work.write(_level(nodes, depth, work), "level")
        depth += 1
    above = nodes.agg((F.coalesce(F.sum("b"), F.lit(0)) / F.greatest(F.coalesce(F.sum("k"), F.lit(0)), F.lit(1))).alias("all"))
    own = nodes.groupBy("host", "t").agg(F.sum("k").alias("k"), F.sum("b").alias("b"))
    anywhere = own.groupBy("t").agg(F.sum("k").alias("gk"), F.sum("b").alias("gb")).crossJoin(F.broadcast(above))  # above has one row
    prior = anywhere.select("t", ((F.col("gb") + PRIOR * F.col("all")) / (F.col("gk") + PRIOR)).alias("prior"))
    share = (F.col("b") + PRIOR * F.col("prior")) / (F.col("k") + PRIOR)
    shares = own.join(prior, "t").select("host", "t", share.alias("share"))
    out = nodes.select("host", "general", "t").join(shares, ["host", "t"])
    return out.select("host", "general", F.col("t").alias("template"), "share", F.when(F.col("share") >= REJECT, "block").otherwise("allow").alias("verdict"))


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id_col, host, path, rule, verdict, template, share."""
    host, path = host_path(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rule, ruled = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("id", "host", "path", rule.alias("rule"), ruled.alias("ruled"), classes(F.col("path")).alias("general"))
    tree = templates(rows).withColumnRenamed("verdict", "learned")
    out = rows.withColumn("general", F.array_join("general", "/")).join(tree, ["host", "general"])
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", "learned").alias("verdict"), "template", "share")
