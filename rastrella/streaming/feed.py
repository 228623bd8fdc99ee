"""A feed of requests, one a line, read as a stream; each batch of it becomes a part of the run's manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rastrella.functions import requests


def plan_requests(lines: DataFrame, column: str = "value") -> DataFrame:
    """A row for each request with what it asks for; requests that are not valid are marked, not dropped."""
    request = F.trim(F.col(column))
    return lines.filter(request != "").select(
        request.alias("request"), requests.feature(request).alias("feature"), requests.files(request).alias("files"), requests.output_name(request).alias("name"),
        requests.option(request, "q").alias("quality"), requests.option(request, "s").alias("scale"), requests.valid(request).alias("valid"),
    )


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Plan the requests in new files of ``folder`` and append them to the manifest ``out`` exactly once."""
    lines = spark.readStream.schema("value string").text(folder)
    return plan_requests(lines).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
