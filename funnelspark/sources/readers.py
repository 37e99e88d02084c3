"""Readers by extension, tolerant conversation input, pinned output schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from funnelspark.operators.conversations import session_pos

RECORDS = "array<struct<request_time:string,requested_site:string,url:string>>"


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """parquet, csv (with header), jsonl, json by the extension."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "csv":
        return spark.read.option("header", True).csv(path)
    if kind in ("jsonl", "json"):
        return spark.read.option("multiLine", kind == "json").option("mode", "DROPMALFORMED").json(path)
    raise ValueError(f"unsupported file type: {path}")


def link_records(cell: Column) -> Column:
    """A cell of links as records: JSON, with single quotes too, or one bare url; blank, none and null are empty."""
    text = F.trim(F.coalesce(cell.cast("string"), F.lit("")))
    parsed = F.from_json(text, RECORDS, {"allowSingleQuotes": "true"})
    plain = F.transform(F.from_json(text, "array<string>", {"allowSingleQuotes": "true"}), lambda u: _record(u))
    empty = F.array().cast(RECORDS)
    return F.when(F.lower(text).isin("", "none", "nan", "[]", "null"), empty).when(text.startswith("[") & text.contains("{"), F.coalesce(parsed, empty)).when(text.startswith("["), F.coalesce(plain, empty)).otherwise(F.array(_record(text)))


def _record(url: Column) -> Column:
    return F.struct(F.lit(None).cast("string").alias("request_time"), url.alias("requested_site"), F.lit(None).cast("string").alias("url"))


def link_urls(records: Column) -> Column:
    urls = F.transform(records, lambda r: F.trim(F.coalesce(r["requested_site"], r["url"], F.lit(""))))
    return F.filter(urls, lambda u: u != "")


def event_time_ms(text: Column) -> Column:
    return F.trim(text).try_cast("bigint")


def load_conversations(df: DataFrame) -> DataFrame:
    """Turns with required session_id and message_id; missing optional columns are made, times parsed, positions set."""
    missing = [c for c in ("session_id", "message_id") if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    for c in ("question", "answer"):
        df = df.withColumn(c, F.coalesce(F.col(c), F.lit("")) if c in df.columns else F.lit(""))
    df = df.withColumn("user_id", F.coalesce("user_id", "session_id") if "user_id" in df.columns else F.col("session_id"))
    for c, out in (("a_links_source", "links_cited"), ("ai_click", "links_clicked"), ("next_10_urls", "trail")):
        df = df.withColumn(out, link_urls(link_records(F.col(c))) if c in df.columns else F.array().cast("array<string>"))
    when = F.try_to_timestamp(F.col("prompt_datetime").cast("string")) if "prompt_datetime" in df.columns else F.lit(None).cast("timestamp")
    return session_pos(df.withColumn("prompt_dt", when), "session_id", F.col("prompt_dt"), F.col("message_id"))


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """The schema's columns, cast; missing ones null, NaN null, others dropped."""
    cols = []
    for f in schema:
        kind = f.dataType.simpleString()
        c = F.lit(None) if f.name not in df.columns else F.col(f.name)
        if f.name in df.columns and dict(df.dtypes)[f.name] in ("double", "float"):
            c = F.when(~F.isnan(c), c)
        cols.append(c.cast(kind).alias(f.name))
    return df.select(*cols)


def write_table(df: DataFrame, schema: StructType, path: str, mode: str = "overwrite") -> None:
    conform(df, schema).write.mode(mode).parquet(path)
