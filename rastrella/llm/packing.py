"""Packing into length buckets whose bounds minimise the padding, found by dynamic programming."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, n_words, spread_rank, table

BUCKETS = 16
TOKEN_BUDGET = 65_536


def best_bounds(histogram: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most ``buckets`` length buckets with the least total padding.

    With C and S the prefix sums of counts and of count x length, a bucket over lengths i+1..j costs
    L_j (C_j - C_i) - (S_j - S_i). So each layer of the programme is a minimum over lines in L_j, which the lower envelope
    answers in amortised constant time: time and memory follow the number of different lengths.
    """
    lengths = sorted(histogram)
    if not lengths:
        return []
    count = np.cumsum([0, *(histogram[x] for x in lengths)]).tolist()
    mass = np.cumsum([0, *(x * histogram[x] for x in lengths)]).tolist()
    n, infinity = len(lengths), float("inf")
    best, back = [0, *[infinity] * n], []
    for _ in range(min(buckets, n)):
        now, chosen, hull = [infinity] * (n + 1), [0] * (n + 1), []  # hull: (slope, intercept, i), slopes falling
        at = 0
        for j in range(1, n + 1):
            i = j - 1
            if best[i] < infinity:
                line = (-count[i], best[i] + mass[i], i)
                while len(hull) >= 2 and (line[1] - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - line[0]):
                    hull.pop()
                hull.append(line)
            if not hull:
                continue
            x, at = lengths[j - 1], min(at, len(hull) - 1)
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                at += 1
            now[j] = hull[at][0] * x + hull[at][1] + x * count[j] - mass[j]
            chosen[j] = hull[at][2]
        back.append(chosen)
        best = now
    bounds, j = [], n
    for chosen in reversed(back):
        if j == 0:
            break
        bounds.append(lengths[j - 1])
        j = chosen[j]
    return bounds[::-1]


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", buckets: int = BUCKETS, budget: int = TOKEN_BUDGET) -> DataFrame:
    """Identifiers with ``n_tokens``, ``bucket``, ``bucket_len``, ``batch``, ``place``, ``padding`` and ``batch_rows``.

    Tokens are words. The driver gets the histogram of lengths (no more entries than the longest document has words) and
    chooses the bounds. Inside a bucket, rows in hash order fill batches of ``budget // bucket_len`` rows, so that a
    padded batch never exceeds the budget; a document longer than the budget is a batch of its own. Batches are numbered
    from 0 in each bucket, places from 0 in each batch; only a bucket's last batch may be short. Null and empty texts have
    no tokens and share the bucket of the shortest documents. An empty table gives no rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    rows = cut(docs.select(F.col(doc_id).alias("doc_id"), n_words(F.col(text)).alias("n_tokens"), F.xxhash64(F.col(text)).alias("_t")))
    lengths = rows.groupBy("n_tokens").agg(F.count("*").alias("n"))
    histogram = {r["n_tokens"]: r["n"] for r in lengths.collect()}
    bounds = best_bounds(histogram, buckets)
    edges = [(int(x), b, int(bounds[b])) for x in histogram for b in [int(np.searchsorted(bounds, x))]]
    plan = spark.createDataFrame(edges, "n_tokens long, bucket int, bucket_len long")
    ranked = spread_rank(rows.join(plan, "n_tokens"), ["bucket"], [F.col("doc_id"), F.col("_t")])
    size = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_len"), F.lit(1)))).cast("long")
    out = ranked.withColumn("batch_rows", size)
    return out.select("doc_id", "n_tokens", "bucket", "bucket_len", F.floor(F.col("rank") / F.col("batch_rows")).cast("long").alias("batch"), (F.col("rank") % F.col("batch_rows")).alias("place"), (F.col("bucket_len") - F.col("n_tokens")).alias("padding"), "batch_rows")


def op7_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in token-budget batches of optimal length buckets."""
    return pack(table(spark, sf_dir, "documents"))
