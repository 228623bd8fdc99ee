"""Mixing sources to target weights by cuts of hash-random orders."""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, n_words, packed, spread_rank, table, unpacked

WEIGHTS = (3, 1, 2)
SHARE = Fraction(3, 2)
MOST_EPOCHS = 2


def targets(sizes: dict, weights: Sequence[int] = WEIGHTS, share: Fraction = SHARE, most: int = MOST_EPOCHS) -> dict:
    """Target of each source, as fractions.

    Sources sort by code point, null last, and weigh ``weights`` in turn. They share ``share`` of all sizes by weight; no
    target exceeds ``most`` times its source, and what is above is shared anew by weight among those below.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out = share * sum(sizes.values()), {}
    free = list(order)
    while free:
        whole = sum(weight[s] for s in free)
        full = [s for s in free if left * weight[s] > most * sizes[s] * whole]
        if not full:
            return out | {s: Fraction(left * weight[s], whole) for s in free}
        for s in full:
            out[s] = Fraction(most * sizes[s])
        left -= sum(out[s] for s in full)
        free = [s for s in free if s not in out]
    return out


def order_key(doc_id: Column, text: Column) -> Column:
    """The first 60 bits of an MD5 hash of identifier and text: an order that looks random and that SQL can give too."""
    name = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.md5(text.cast("binary")), F.lit("")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: Sequence[int] = WEIGHTS, share: Fraction = SHARE, most: int = MOST_EPOCHS, carry: bool = False) -> DataFrame:
    """Identifiers with ``size``, ``source_size``, ``target``, ``copies`` and ``taken``; all columns too if ``carry``.

    Each source is ordered by an MD5 hash of identifier and text. Distributed prefix sums give the words in front of each
    document. Whole epochs of a source are taken as often as they fit in its target; the last epoch is cut where the
    running sum comes nearest to the rest, at a document's end. So a document is taken at most ``most`` times and a
    source misses its target by half a document at most. The driver gets one row for each source. A null text has no
    words (taken 0); a null source is a source; equal rows are ordered alike and interchangeable, so reruns agree.
    """
    spark = docs.sparkSession
    source_key = F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`")), F.lit(""))
    keep = [packed(docs.columns).alias("_row")] if carry else []
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), n_words(F.col(f"`{text}`")).alias("_size"), source_key.alias("_src"), order_key(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).alias("_t"), *keep)
    slim = cut(rows.drop("_row"))  # words are counted once for the sums; whole rows are never checkpointed
    sizes = {r["_src"]: r["n"] for r in slim.groupBy("_src").agg(F.sum("_size").alias("n")).collect()}
    named = {k[1:] if k else None: v for k, v in sizes.items()}
    plan = []
    for name, target in targets(named, weights, share, most).items():
        whole = int(target // named[name]) if named[name] else 0
        plan.append(("" if name is None else "=" + name, int(named[name]), float(target), whole, float(target - whole * named[name])))
    plan = spark.createDataFrame(plan, "_src string, source_size long, target double, _whole int, _rest double")
    ranked = spread_rank(rows if carry else slim, ["_src"], [F.col("doc_id"), F.col("_t")], weight=F.col("_size"), slim=slim, key=F.col("_t"))
    out = ranked.join(plan, "_src").withColumn("copies", F.col("_whole") + ((F.col("_rest") > 0) & (F.col("before") + F.col("_size") / 2 <= F.col("_rest"))).cast("int"))
    out = out.withColumn("copies", F.least("copies", F.lit(most))).withColumn("taken", (F.col("copies") * F.col("_size")).cast("long"))
    cols = ["doc_id", F.col("_size").alias("size"), "source_size", "target", "copies", "taken"]
    return out.select(*cols, *(["_row"] if carry else []))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows that the mix takes, each as often as it is taken, with the columns of ``docs``, whatever their names."""
    out = mix(docs, carry=True, **options).filter("copies > 0")
    return out.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_epoch")).select(*unpacked("_row", docs.columns))


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of each."""
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


#: Targets by water-filling: sources in the order of size over weight are full as long as their share of the rest exceeds
#: twice their size. Amounts are doubled so that all stay whole numbers until the last division.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
             CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '')), 1, 15) AS BIGINT) AS k FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY source),
s1 AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM s0),
s2 AS (SELECT *, row_number() OVER (ORDER BY n / w, source) AS i FROM s1),
s3 AS (SELECT *, 3 * sum(n) OVER () - 4 * (sum(n) OVER (ORDER BY i) - n) AS rem, sum(w) OVER () - sum(w) OVER (ORDER BY i) + w AS ws FROM s2),
f AS (SELECT CAST(arg_min(rem, i) AS BIGINT) AS rem, CAST(arg_min(ws, i) AS BIGINT) AS ws, min(i) AS i FROM s3 WHERE NOT rem * w > 4 * n * ws),
t AS (SELECT s3.source, n, CASE WHEN s3.i < f.i THEN 4 * n * f.ws ELSE f.rem * w END AS num, f.ws FROM s3, f),
p AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE num // (2 * ws * n) END AS whole FROM t),
b AS (SELECT d.*, n, CAST(num AS DOUBLE) / (2 * ws) AS target, whole, CAST(num - whole * n * 2 * ws AS DOUBLE) / (2 * ws) AS rest,
        sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) - size AS before FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, n AS source_size, target, CAST(least(whole + CASE WHEN rest > 0 AND before + size / 2.0 <= rest THEN 1 ELSE 0 END, 2) * size AS BIGINT) AS taken FROM b
"""
