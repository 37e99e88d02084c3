"""Incremental ingest on Structured Streaming: each url is committed once, profiles fold over what came."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from funnelspark.operators.qa import pending


def read_files(spark: SparkSession, path: str, schema, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def commit_pages(stream: DataFrame, target: str, checkpoint: str, key: str = "url"):
    """Append rows whose key the target hasn't, one row per key; a batch that is run again adds nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.filter(F.coalesce("fetch_status", F.lit("ok")) != "dns_unavailable") if "fetch_status" in batch.columns else batch
        rows = rows.dropDuplicates([key])
        try:
            done = spark.read.parquet(target)
        except Exception as e:  # the first batch has no target yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            done = None
        (pending(rows, done, key) if done is not None else rows).write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def profile_stream(pages: DataFrame, domain: str = "domain") -> DataFrame:
    """The associative part of a domain's profile as a streaming aggregate."""
    return pages.groupBy(domain).agg(F.max("relevance").alias("max_relevance"), F.count("*").alias("n_pages"))


def circuit_breaker(attempts: DataFrame, limit: int = 3) -> DataFrame:
    """domain, failures, open: opens after ``limit`` failures in a row without a success, or at once when the name is dead.

    attempts: domain, at (order), status (ok, failed, dns_dead). State is two numbers per domain.
    """

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        row, good = state.get if state.exists else (0, False)
        dead = False
        for f in frames:
            for s in f.sort_values("at")["status"]:
                good |= s == "ok"
                row = 0 if s == "ok" else row + 1
                dead |= s == "dns_dead"
        row = max(row, limit) if dead else row
        state.update((int(row), bool(good)))
        yield pd.DataFrame({"domain": [key[0]], "failures": [int(row)], "open": [bool(dead or row >= limit and not good)]})

    return attempts.groupBy("domain").applyInPandasWithState(step, "domain string, failures long, open boolean", "failures long, good boolean", "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, time: str = "ts", late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts by event_type and window; events later than ``late`` are left out (a Spark addition)."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), "event_type").agg(F.count("*").alias("n"))
