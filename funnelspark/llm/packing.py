"""Packing into optimal length buckets.

A dynamic programme over the global histogram of lengths chooses the bucket bounds
with the least padding; inside each bucket, documents fill batches up to a token
budget. The histogram has one bin for each length up to ``EXACT`` and 64 for each
doubling above, so it stays small; a bin's bound is the largest length in it.

Rows are numbered without sorting a bucket in one task: each bucket is dealt into
chunks by a hash, rows are numbered in their chunk, and chunks by running totals.

Defined cases: null text has no tokens; a text longer than the budget is a batch of
its own, whole; repeated rows are rows of their own; an empty table gives an empty
result; columns of the input that clash with the new ones are replaced.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelspark.llm.workspace import unused

#: Number of length buckets, and tokens (padding included) of a batch.
BUCKETS, BUDGET = 16, 65_536
#: Lengths up to this have a histogram bin each.
EXACT = 4096
#: Rows of a chunk, about.
CHUNK = 20_000
NEW = ("n_tokens", "bucket", "bucket_len", "batch", "slot")


def n_words(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def length_bin(n: Column) -> Column:
    """The length itself, or above EXACT 64 bins for each doubling."""
    return F.when(n <= EXACT, n).otherwise(F.lit(EXACT) + 1 + F.floor(F.log2(n / EXACT) * 64)).cast("long")


def best_bounds(length: np.ndarray, count: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least total padding; lengths ascend."""
    if not len(length):
        return []
    n = len(length)
    below = np.concatenate([[0.0], np.cumsum(count, dtype=float)])
    length = length.astype(float)
    cost = np.concatenate([[0.0], length * below[1:]])  # padded tokens of the first j bins in one bucket
    cuts = []
    for _ in range(min(buckets, n) - 1):
        new, cut = cost.copy(), np.full(n + 1, -1)
        for j in range(1, n + 1):
            total = cost[:j] + length[j - 1] * (below[j] - below[:j])
            i = int(np.argmin(total))
            if total[i] < new[j]:
                new[j], cut[j] = total[i], i
        cuts.append(cut)
        cost = new
    bounds, j = [], n
    for cut in reversed(cuts):
        if cut[j] >= 0:
            bounds.append(int(length[j - 1]))
            j = int(cut[j])
    if j:
        bounds.append(int(length[j - 1]))
    return bounds[::-1]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, budget: int = BUDGET, length: Column | None = None) -> DataFrame:
    """The rows of ``docs`` with n_tokens, bucket, bucket_len (its bound), batch (in the bucket, from 0), slot (in the batch, from 0)."""
    h, chunk, before_, at = (unused(c, docs.columns) for c in ("_h", "_chunk", "_before", "_at"))
    docs = docs.drop(*NEW).withColumn("n_tokens", n_words(F.col(text_col).cast("string")) if length is None else length)
    bins = docs.groupBy(length_bin(F.col("n_tokens")).alias("bin")).agg(F.count("*").alias("n"), F.max("n_tokens").alias("top")).orderBy("bin").collect()
    top, n = np.array([r.top for r in bins], np.int64), np.array([r.n for r in bins], np.int64)
    bounds = best_bounds(top, n, buckets) or [0]
    bucket = reduce(lambda a, b: a + b, [(F.col("n_tokens") > b).cast("int") for b in bounds[:-1]], F.lit(0))
    bound = F.element_at(F.array(*[F.lit(b).cast("long") for b in bounds]), F.col("bucket") + 1)
    chunks = max(1, int(n.sum()) // CHUNK)
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    rows = docs.withColumn("bucket", bucket).withColumn("bucket_len", bound).withColumn(h, key).withColumn(chunk, F.pmod(h, F.lit(chunks)))
    sizes = docs.select(bucket.alias("bucket"), F.pmod(key, F.lit(chunks)).alias(chunk)).groupBy("bucket", chunk).agg(F.count("*").alias("n"))
    before = Window.partitionBy("bucket").orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn(before_, F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    rank = F.row_number().over(Window.partitionBy("bucket", chunk).orderBy(h, id_col)) - 1 + F.col(before_)
    fits = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_len"), F.lit(1)))).cast("long")
    out = rows.join(sizes, ["bucket", chunk]).withColumn(at, rank).withColumn("batch", F.floor(F.col(at) / fits).cast("long")).withColumn("slot", F.pmod(at, fits).cast("long"))
    return out.select(*[c for c in docs.columns if c != "n_tokens"], *NEW)
