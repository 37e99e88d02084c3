"""URL functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from funnelspark import vocab


def parse_url(url: Column, two_label: tuple[str, ...] = vocab.TWO_LABEL_TLDS) -> dict[str, Column]:
    """scheme, host, subdomain ('' for www), registrable, core, path and query (both lower-cased)."""
    whole = F.when(F.coalesce(url, F.lit("")).contains("://"), url).otherwise(F.concat(F.lit("http://"), F.coalesce(url, F.lit(""))))
    part = lambda i: F.regexp_extract(whole, r"^([^:/?#]+)://([^/?#]*)([^?#]*)(?:\?([^#]*))?", i)
    host = F.ltrim(F.regexp_replace(F.regexp_replace(F.lower(part(2)), r"^.*@", ""), r":\d*$", ""), F.lit("."))
    labels = F.split(host, r"\.")
    n = F.size(labels)
    wide = F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), F.lit(2)), ".").isin(*two_label) & (n >= 3)
    keep = F.when(wide, 3).when(n >= 2, 2).otherwise(n)
    registrable = F.array_join(F.slice(labels, F.greatest(n - keep + 1, F.lit(1)), keep), ".")
    sub = F.array_join(F.slice(labels, F.lit(1), F.greatest(n - keep, F.lit(0))), ".")
    path = F.when(part(3) == "", "/").otherwise(F.lower(part(3)))
    return {"scheme": F.lower(part(1)), "host": host, "subdomain": F.when(sub == "www", "").otherwise(sub), "registrable": registrable, "core": F.substring_index(registrable, ".", 1), "path": path, "query": F.lower(part(4))}


def base_url(url: Column) -> Column:
    """scheme://host/, or '' if the url is its site's root already."""
    root = F.regexp_extract(url, r"^([^:/?#]+://[^/?#]+)", 1)
    rest = F.substring(url, F.length(root) + 1, F.length(url))
    return F.when((root == "") | rest.isin("", "/"), "").otherwise(F.concat(root, F.lit("/")))


def query_stripped(url: Column, keys: tuple[str, ...] = vocab.IDENTITY_KEYS) -> Column:
    """The url without query and fragment; '' if there is no query, a key tells the page, or the root would be left."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    names = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.lower(F.trim(F.substring_index(p, "=", 1))))
    bare = F.regexp_extract(url, r"^[^?#]*", 0)
    root = F.regexp_replace(F.regexp_replace(bare, r"^[^:/?#]+://[^/?#]+", ""), "/", "") == ""
    return F.when((query == "") | F.arrays_overlap(names, F.array(*[F.lit(k) for k in keys])) | root, "").otherwise(bare)


def page_id(url: Column) -> Column:
    return F.substring(F.sha1(url.cast("binary")), 1, 16)


def cache_key(url: Column) -> Column:
    return F.substring(F.sha2(url.cast("binary"), 256), 1, 24)
