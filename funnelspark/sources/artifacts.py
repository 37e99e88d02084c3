"""What a run reads and leaves: sources with stand-ins, directories of sites, ledgers, part files, commit logs, manifests, saved runs, review sheets.

Tables stay tables. Small JSON files (manifests, ledgers, model descriptions) are read and
written whole on the driver through Spark's file system, under a new name that is then
renamed, so a reader never sees half a file.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from funnelspark import vocab_sites as V
from funnelspark.functions.url import cache_key, parse_url
from funnelspark.sources.readers import conform, read_any

# files


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def listing(spark: SparkSession, path: str, deep: bool = True) -> list[str]:
    """Files and tables of a folder and, if ``deep``, of its folders that are no tables; sorted."""
    p, fs = _fs(spark, path)
    out = []
    for s in fs.listStatus(p):
        at = s.getPath()
        if at.getName().startswith(("_", ".")):
            continue
        table = "." in at.getName()
        out += [at.toString()] if s.isFile() or table or not deep else listing(spark, at.toString(), False)
    return sorted(out)


def read_json(spark: SparkSession, path: str):
    """A small JSON file, whole; None without one."""
    if not exists(spark, path):
        return None
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def write_json(spark: SparkSession, path: str, value) -> None:
    """Write under another name, then rename."""
    p, fs = _fs(spark, path)
    draft, _ = _fs(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
    out.close()
    fs.delete(p, False)
    if not fs.rename(draft, p):
        raise OSError(f"can't write {path}")


# sources


def resolve(spark: SparkSession, path: str | None, real: Callable[[SparkSession, str], DataFrame] = read_any, synthetic: Callable[[SparkSession], DataFrame] | None = None) -> tuple[DataFrame, str]:
    """The real table if it is there, else the synthetic one, else an error; and which it was."""
    if path and exists(spark, path):
        return real(spark, path), "real"
    if synthetic is None:
        raise FileNotFoundError(path or "no source is given")
    return synthetic(spark), "synthetic"


def load_clickstream(spark: SparkSession, path: str, hints: dict[str, tuple[str, ...]]) -> dict[str, DataFrame]:
    """Tables of a star schema by what their file names hold, in the folder or one level below; one file is the table of facts."""
    if path.rstrip("/").endswith((".parquet", ".csv", ".json", ".jsonl")):
        return {next(iter(hints)): read_any(spark, path)}
    found: dict[str, DataFrame] = {}
    for file in listing(spark, path):
        name = file.rstrip("/").rpartition("/")[2].lower()
        for table, parts in hints.items():
            if table not in found and any(h in name for h in parts):
                found[table] = read_any(spark, file)
                break
    return found


def site_directory(spark: SparkSession, path: str | None, seed: dict[str, dict] | None = None, roles: tuple[str, ...] = tuple(V.ROLE_VOTES)) -> DataFrame:
    """core, role, category, description of sites: a JSON object by site or list of objects over the seed; unknown roles are blank."""
    got = read_json(spark, path) if path else None
    rows = got if isinstance(got, list) else [{"domain": k, **v} for k, v in (got or {}).items()]
    merged = {k.lower(): v for k, v in (seed or {}).items()}
    for r in rows:
        key = str(r.get("domain") or "").lower().removeprefix("www.").split(".")[0]
        if key:
            merged[key] = {**merged.get(key, {}), **{k: v for k, v in r.items() if v}}
    clean = [(k, v.get("role") if v.get("role") in roles else "", str(v.get("category") or ""), str(v.get("description") or "")) for k, v in sorted(merged.items())]
    return spark.createDataFrame(clean, "core string, role string, category string, description string")


def with_directory(urls: DataFrame, directory: DataFrame, url: str = "url") -> DataFrame:
    """Urls with directory_role, directory_category and the stand-in content of their site."""
    d = directory.select(F.col("core").alias("_core"), F.col("role").alias("directory_role"), F.col("category").alias("directory_category"), "description")
    out = urls.withColumn("_core", parse_url(F.col(url))["core"]).join(d, "_core", "left")
    title = F.when(F.col("directory_role").isNotNull(), F.concat_ws(" ", "_core", F.regexp_replace("directory_category", "_", " ")))
    return out.withColumn("directory_title", title).withColumnRenamed("description", "directory_description").drop("_core")


def load_ledger(spark: SparkSession, path: str | None, defaults: dict[str, tuple]) -> dict[str, tuple]:
    """Factors (value, low, high, status) with the file's fields over the defaults; unknown factors are an error."""
    out = dict(defaults)
    for name, own in ((read_json(spark, path) if path else None) or {}).items():
        if name not in out:
            raise ValueError(f"unknown factor: {name}")
        value, low, high, status = out[name]
        out[name] = (float(own.get("value", value)), float(own.get("low", low)), float(own.get("high", high)), own.get("status", status))
    return out


def save_ledger(spark: SparkSession, path: str, ledger: dict[str, tuple]) -> None:
    write_json(spark, path, {k: dict(zip(("value", "low", "high", "status"), v, strict=True)) for k, v in ledger.items()})


def offline_pages(urls: DataFrame, corpus: DataFrame, cache: DataFrame | None = None, url: str = "url", html: str = "html") -> DataFrame:
    """Urls with html and fetch_status from a saved corpus: the exact url, else but for a last slash, else the cache, else ``offline_miss``."""
    bare = lambda c: F.rtrim(F.col(c), F.lit("/"))
    exact = corpus.groupBy(url).agg(F.min(html).alias("_exact"))
    loose = corpus.groupBy(bare(url).alias("_bare")).agg(F.min_by(html, url).alias("_loose"))
    out = urls.join(exact, url, "left").withColumn("_bare", bare(url)).join(loose, "_bare", "left")
    if cache is not None:
        out = out.withColumn("key", cache_key(F.col(url))).join(cache.select("key", F.col(html).alias("_cached")).dropDuplicates(["key"]), "key", "left").drop("key")
    else:
        out = out.withColumn("_cached", F.lit(None).cast("string"))
    found = F.coalesce("_exact", "_loose", "_cached")
    return out.withColumn(html, found).withColumn("fetch_status", F.when(found.isNotNull(), "ok").otherwise("offline_miss")).drop("_exact", "_loose", "_cached", "_bare")


def cacheable(pages: DataFrame, url: str = "url", html: str = "html", least: int = 512) -> DataFrame:
    """key and html of pages that a cache keeps: bodies of ``least`` characters or more, one for each url."""
    return pages.filter(F.length(html) >= least).groupBy(cache_key(F.col(url)).alias("key")).agg(F.min(html).alias(html))


def saved_run(spark: SparkSession, path: str, names: dict[str, str]) -> dict[str, DataFrame]:
    """The named tables of a run's folder, as far as they are there; without any of them, the folder's first table as the first name."""
    found = {k: spark.read.parquet(f"{path}/{v}") for k, v in names.items() if exists(spark, f"{path}/{v}")}
    if not found:
        tables = [f for f in listing(spark, path) if f.endswith(".parquet")]
        if not tables:
            raise FileNotFoundError(path)
        found = {next(iter(names)): spark.read.parquet(tables[0])}
    return found


def url_column(df: DataFrame, names: tuple[str, ...] = ("url", "surfaced_url", "final_url")) -> DataFrame:
    """Distinct non-blank urls of the first known column that has one."""
    known = [F.when(F.trim(F.col(c)) != "", F.trim(F.col(c))) for c in names if c in df.columns]
    if not known:
        raise ValueError(f"none of the columns {', '.join(names)}")
    return df.select(F.coalesce(*known).alias("url")).filter("url is not null").distinct()


def page_content(rows: DataFrame, cache: DataFrame, path: str = "html_path", url: str = "url") -> DataFrame:
    """Rows with html and content_source: the cached page by its path's last part, else the row's own excerpt, else the url alone."""
    base = F.substring_index(F.col(path), "/", -1)
    own = cache.select(F.substring_index("path", "/", -1).alias("_base"), "html").dropDuplicates(["_base"])
    out = rows.withColumn("_base", base).join(own, "_base", "left").drop("_base")
    has_row = F.coalesce(F.length(F.trim(F.col("text_excerpt"))), F.lit(0)) > 0
    return out.withColumn("content_source", F.when(F.col("html").isNotNull(), "cache").when(has_row, "row").otherwise("url"))


def export_review(queue: DataFrame, path: str) -> None:
    queue.select([F.col(c).cast("string").alias(c) for c in queue.columns]).coalesce(1).write.mode("overwrite").option("header", True).csv(path)  # a queue is a top-k


def read_review(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, blanks for missing values."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path).na.fill("")


# sinks


def write_part(df: DataFrame, folder: str, schema: StructType, key: str) -> int:
    """Append rows whose key the parts don't have; the number of parts is the next part's number."""
    spark = df.sparkSession
    done = exists(spark, folder)
    number = len(listing(spark, folder, False)) if done else 0
    rows = df.dropDuplicates([key])
    if done:
        rows = rows.join(keys_of(spark, folder, key), key, "left_anti")
    conform(rows, schema).write.parquet(f"{folder}/part-{number:06d}.parquet")
    return number


def parts(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(folder)


def keys_of(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """The distinct values of one column over all parts; the scan reads no other."""
    return spark.read.option("recursiveFileLookup", True).parquet(folder).select(key).distinct()


def finalize(spark: SparkSession, folder: str, target: str, schema: StructType, key: str, files: int | None = None) -> DataFrame:
    """All parts as one table of the pinned schema, one row for each key, under its name only when it is whole."""
    every = parts(spark, folder, schema).dropDuplicates([key])
    draft = f"{target}.{uuid.uuid4().hex}.part"
    conform(every.coalesce(files) if files else every, schema).write.parquet(draft)
    remove(spark, target)
    p, fs = _fs(spark, target)
    if not fs.rename(_fs(spark, draft)[0], p):
        raise OSError(f"can't write {target}")
    return spark.read.schema(schema).parquet(target)


def commit(pages: DataFrame, products: DataFrame, log: str, batch: int) -> None:
    """Products first, pages last: a batch is committed when its pages are there; one that runs again replaces itself."""
    products.write.mode("overwrite").json(f"{log}/products/batch={batch}")
    pages.write.mode("overwrite").json(f"{log}/pages/batch={batch}")


def committed(spark: SparkSession, log: str, page_schema: str, product_schema: str, page: str = "page_id") -> tuple[DataFrame, DataFrame]:
    """Pages of the log, broken lines left out, and the products of those pages."""
    read = lambda what, schema: spark.read.schema(schema).option("mode", "DROPMALFORMED").json(f"{log}/{what}")
    own = read("pages", page_schema).filter(F.col(page).isNotNull()).dropDuplicates([page])
    if not exists(spark, f"{log}/products"):
        return own, spark.createDataFrame([], product_schema)
    return own, read("products", product_schema).join(own.select(page), page, "left_semi")


def fingerprint(df: DataFrame) -> str:
    """A number of the rows that doesn't depend on their order, and how many there are."""
    names = sorted(df.columns)
    r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*names).cast("decimal(38,0)")).alias("h")).first()
    return f"{','.join(names)}:{r.n}:{r.h or 0}"


def identify(spark: SparkSession, path: str, inputs: str, label: str, on_mismatch: str = "error") -> str:
    """``new``, ``resume`` or ``fresh`` by the manifest of the run before; another input is an error unless ``on_mismatch`` is resume or fresh. Another label alone resumes."""
    before = read_json(spark, path)
    if before and before.get("inputs") != inputs:
        if on_mismatch == "error":
            raise ValueError("the run was begun on other inputs")
        if on_mismatch == "resume":
            return "resume"
    verdict = "new" if not before else "resume" if before.get("inputs") == inputs else "fresh"
    write_json(spark, path, {"inputs": inputs, "label": label, "runs": 1 + (before or {}).get("runs", 0)})
    return verdict


def reset(spark: SparkSession, root: str, keep: tuple[str, ...] = ("cache", "model")) -> list[str]:
    """Remove a run's state but for what is to be kept; the names that went."""
    gone = []
    p, fs = _fs(spark, root)
    for s in fs.listStatus(p) if fs.exists(p) else []:
        if s.getPath().getName() not in keep:
            fs.delete(s.getPath(), True)
            gone.append(s.getPath().getName())
    return sorted(gone)


def source_note(manifest: dict | None) -> str:
    """One line on where a run's data came from."""
    if not manifest:
        return "source unknown: the run has no manifest"
    kind = manifest.get("label") or "unlabelled"
    return f"{kind} data, {str(manifest.get('inputs', '')).split(':')[-2:][0] or '?'} rows, run {manifest.get('runs', 1)}"


def save_profiles(profiles: DataFrame, path: str) -> None:
    profiles.write.mode("overwrite").parquet(path)


def write_pages(df: DataFrame, schema: StructType, path: str) -> None:
    """A frame that went through other tools, back in the page schema: blank text for missing text."""
    out = conform(df, schema)
    text = [f.name for f in schema if f.dataType.simpleString() == "string"]
    out.select([F.coalesce(c, F.lit("")).alias(c) if c in text else F.col(c) for c in out.columns]).write.mode("overwrite").parquet(path)


def html_report(title: str, note: str, tables: dict[str, DataFrame], limit: int = 50) -> str:
    """A page without scripts: a table with bars for each small frame (name, number); the largest ``limit`` rows of each."""
    esc = lambda x: str(x).replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")
    out = [f"<!doctype html><meta charset=utf-8><title>{esc(title)}</title><h1>{esc(title)}</h1><p>{esc(note)}</p>"]
    for name, df in tables.items():
        label, value = df.columns[:2]
        rows = df.orderBy(F.desc(value), label).limit(limit).collect()
        top = max((float(r[1] or 0) for r in rows), default=0) or 1
        bars = "".join(f"<tr><td>{esc(r[0])}<td>{esc(r[1])}<td><svg width=200 height=10><rect width={200 * float(r[1] or 0) / top:.0f} height=10 /></svg>" for r in rows)
        out.append(f"<h2>{esc(name)}</h2><table><tr><th>{esc(label)}<th>{esc(value)}<th>{bars}</table>")
    return "".join(out)


def last_profile(pages: DataFrame, domain: str, order: list[Column]) -> DataFrame:
    """Pages with what the domain's earlier pages taught: largest relevance and first seller before each."""
    before = Window.partitionBy(domain).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seller = F.when(F.col("seller_type").isin("brand_owned", "retailer"), F.col("seller_type"))
    return pages.withColumn("profile_relevance", F.max("relevance").over(before)).withColumn("profile_seller", F.first(seller, ignorenulls=True).over(before))
