"""Exact deduplication by content sort, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, table

#: A text with more copies than this share of the mean range partition is counted map-side instead of being sorted.
HOT_SHARE = 0.25
#: Characters of a text that take part in the splitters.
PREFIX = 32


def content_sort(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: str = "smallest", partitions: int | None = None, normalise: Column | None = None) -> DataFrame:
    """All columns of ``docs`` with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    The normalised texts (by default unchanged; null counts as empty) are range-partitioned on sampled splitters and
    sorted externally inside the ranges, so that equal texts are neighbours; the comparison of whole neighbouring texts
    bounds the groups. A text of which a range partition would get too many copies is found first, by its hash counts
    (at most ``partitions / HOT_SHARE`` such hashes exist, whatever the input); its rows are not sorted but totalled by a
    map-side aggregation on the whole text, and the few totals are sent back to them.

    Of equal texts the row with the smallest (or ``keep="largest"``) identifier stays. Null identifiers lose against all
    others. Rows that repeat an identifier and its text are one group, and exactly one of them stays: they are numbered
    once, on one path through the plan, so that a recomputed task cannot number them otherwise elsewhere. An empty table
    gives an empty result. Columns named like the added ones are replaced; no other name can clash.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [c for c in docs.columns if c not in ("keep_id", "group_size", "kept", "text_sha256")]
    body = normalise if normalise is not None else F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rest = [c for c in names if c != text or normalise is not None]
    tie = F.xxhash64(*(F.col(f"`{c}`") for c in rest if "map<" not in docs.schema[c].dataType.simpleString()), F.lit(0))
    rows = docs.select(packed(rest).alias("_row"), F.col(f"`{doc_id}`").alias("_id"), body.alias("_t"), F.col(f"`{text}`").isNull().alias("_null"), tie.alias("_tie")).withColumn("_h", F.xxhash64("_t"))
    hashes = docs.select(F.xxhash64(body).alias("_h")).groupBy("_h").agg(F.count("*").alias("_c"))
    total = hashes.agg(F.sum("_c").alias("_all"))
    # count > all * share / n holds for fewer than n / share hashes: a proven bound for the broadcast
    hot = hashes.join(F.broadcast(total)).filter((F.col("_c") > 32) & (F.col("_c") > F.col("_all") * F.lit(HOT_SHARE / n))).select("_h")
    best, first = (F.max("_id"), F.col("_id").desc_nulls_last()) if keep == "largest" else (F.min("_id"), F.col("_id").asc_nulls_last())
    sha = F.sha2(F.col("_t").cast("binary"), 256).alias("text_sha256")
    shown = ["_row", "_t", "_null", "keep_id", "group_size", "kept", "text_sha256"]

    # splitters are sampled from the first bytes, and from a hash where these tie, so that the driver sees no whole text
    cold = rows.withColumn("_p", F.substring("_t", 1, PREFIX)).join(F.broadcast(hot), "_h", "left_anti").repartitionByRange(n, "_p", "_h")
    group = Window.partitionBy("_p", "_h", "_t")
    ordered = group.orderBy(first, "_tie")
    cold = cold.withColumns({"keep_id": F.first("_id").over(ordered), "kept": F.row_number().over(ordered) == 1, "group_size": F.count("*").over(group), "text_sha256": sha})

    many = rows.join(F.broadcast(hot), "_h", "left_semi")
    # by whole text, combined on the map side; fewer groups than hot hashes plus their collisions
    totals = many.groupBy("_t").agg(best.alias("keep_id"), F.count("*").alias("group_size")).select(sha, "keep_id", "group_size")
    many = many.withColumn("text_sha256", sha).join(F.broadcast(totals), "text_sha256")
    wins = F.col("_id").eqNullSafe(F.col("keep_id"))
    # rows that share the identifier that stays: the first of each task, then the first of those
    task = many.filter(wins).withColumn("_task", F.spark_partition_id())
    task = task.withColumn("_first", F.row_number().over(Window.partitionBy("text_sha256", "_task").orderBy("_tie")) == 1)
    one = Window.partitionBy("text_sha256", F.when(F.col("_first"), -1).otherwise(F.col("_task"))).orderBy("_tie")
    task = task.withColumn("kept", F.col("_first") & (F.row_number().over(one) == 1))
    lost = many.filter(~wins).withColumn("kept", F.lit(False))
    back = [F.when(~F.col("_null"), F.col("_t")).alias(c) if c == text and normalise is None else F.col("_row")[f"c{rest.index(c)}"].alias(c) for c in names]
    out = cold.select(*shown).unionByName(task.select(*shown)).unionByName(lost.select(*shown))
    return out.select(*back, "keep_id", "group_size", "kept", "text_sha256")


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with its group of equal texts; the largest doc_id of a group stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return content_sort(docs, keep="largest").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
