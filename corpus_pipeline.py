"""A corpus pipeline of five stages, each of which reads what the one before has written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from rastrella.llm import exact_dedup, mixing, packing, simhash, toxicity
from rastrella.llm.common import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network does not call toxic; it learns from the given documents and the labels.

    Null, empty and very long texts are scored like any other; without labels of both kinds nothing is learned, and the
    label's share is the score. Repeated rows are judged alike; an empty table gives none.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the smallest identifier; null texts count as empty.

    Null identifiers lose against all others; of rows that repeat an identifier and its text exactly one stays.
    """
    return exact_dedup.content_sort(docs).filter("kept").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts whose five-word shingles have a Jaccard similarity of 0.8 or more, found by SimHash.

    The one with the smallest identifier stays; rows with a null identifier stay too, as they cannot be told apart. Null
    and empty texts and those of white space are alike.
    """
    return simhash.drop_near_duplicates(docs, words=5, similarity=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by source weight, repeated where the target needs more than an epoch.

    A null source is a source; documents without words belong to every cut before which no words stand. Equal rows are
    interchangeable, so reruns agree.
    """
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and token-budget batches of all that is left; texts without words share the shortest bucket."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("SimHash near-dedup", drop_near_copies), ("mixing", mix), ("packing", pack)]

#: SQL can express neither the network nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; each result is written to the shared folder and read again.

    A stage's files go when the next stage's are written, but for those that the last stage reads.
    """
    from rastrella.llm.token_files import shared_folder

    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
            _delete(spark, f"{folder}/{i - 1}")
    return docs


def _delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of whatever store it is in, if it is there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
