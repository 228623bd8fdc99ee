"""Helpers that the corpus operators share: checkpoints, word counts, distributed ranks."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space is the six ASCII characters; everything else belongs to words.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WS_BYTES = b" \t\n\r\x0b\x0c"
#: Log2 of the number of buckets into which ranks and prefix sums cut a key.
RANK_BITS = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of the folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder that the session names in ``spark.checkpoint.dir``.

    Only where no folder is set, as in local tests, one in the temporary folder is chosen.
    """
    context = df.sparkSession.sparkContext
    if not context.getConf().get("spark.checkpoint.dir") and context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(tempfile.mkdtemp(prefix="rastrella-checkpoint-"))
    return df.checkpoint(eager=True)


def packed(columns: Sequence[str]) -> Column:
    """A struct of the named columns whose fields are called by place, so that no column's name can clash."""
    return F.struct(F.lit(0).alias("c"), *(F.col(f"`{name}`").alias(f"c{i}") for i, name in enumerate(columns)))


def unpacked(struct: str, columns: Sequence[str]) -> list[Column]:
    """The columns of a ``packed`` struct under their own names."""
    return [F.col(struct)[f"c{i}"].alias(name) for i, name in enumerate(columns)]


def n_words(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def utf8_bytes(text: Column) -> Column:
    """Bytes of the UTF-8 form; a null text has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """Whether the row is in the fold that no model may learn labels from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def among_least(hash_: str, total: str, k: int) -> Column:
    """Whether a row may be among the ``k`` of ``total`` rows with the least 63-bit hash.

    Four times as many rows are expected to pass as are needed, so that a sample of fixed size costs each task and the
    shuffle no more on more data.
    """
    return F.col(hash_) <= F.lit(2.0**63) * F.least(F.lit(1.0), F.lit(4.0 * k) / F.col(total))


def spread_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], weight: Column | None = None, bits: int = RANK_BITS, slim: DataFrame | None = None, key: Column | None = None) -> DataFrame:
    """Add ``rank`` (0-based place within the keys) and, with a weight, ``before`` (the sum of the weights in front).

    Rows of one key are ordered by a hash of ``order``, or by a 60-bit ``key`` if it is given. The hash range is cut into ``2**bits`` buckets; rows are
    numbered inside a bucket, and the buckets' totals, one small row each, are summed to the bucket's offset. So no
    task has to hold a whole key, however many rows it has. Keys must not be null. ``df`` is read twice, or once if
    ``slim`` has the same rows with fewer columns.
    """
    keys = list(keys)

    def mark(rows: DataFrame) -> DataFrame:
        hashed, width = (F.shiftrightunsigned(F.xxhash64(*order), 1), 63) if key is None else (key, 60)
        rows = rows.withColumn("_k", hashed).withColumn("_b", F.shiftright("_k", width - bits).cast("int"))
        return rows.withColumn("_w", weight if weight is not None else F.lit(0))

    marked = mark(df)
    sums = mark(slim if slim is not None else df).groupBy(*keys, "_b").agg(F.count("*").alias("_n"), F.sum("_w").alias("_s"))
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_s0"))
    inside = Window.partitionBy(*keys, "_b").orderBy("_k", *order)
    placed = marked.withColumn("_r", F.row_number().over(inside) - 1).withColumn("_a", F.sum("_w").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_w"))
    out = placed.join(offsets, [*keys, "_b"]).withColumn("rank", (F.col("_r") + F.col("_n0")).cast("long"))
    if weight is not None:
        out = out.withColumn("before", F.col("_a") + F.col("_s0"))
    return out.drop("_k", "_b", "_w", "_r", "_a", "_n0", "_s0")
