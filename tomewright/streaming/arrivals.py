"""File arrivals as a stream (an extension; the batch scan is the catalog's own way).

Listings dropped into a folder are read as they come; files whose fingerprint row is still good are
left out, and the rest is passed on batch by batch, each batch once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tomewright.operators.decisions import fresh_fingerprints

LISTING = "path string, size long, mtime timestamp"


def new_files(spark: SparkSession, listings: str, known: Callable[[], DataFrame], handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Start the query: every batch of listings, without the files that ``known()`` (the fingerprints table) has, goes to ``handle``."""

    def batch(rows: DataFrame, number: int) -> None:
        handle(fresh_fingerprints(rows.dropDuplicates(["path"]), known()).where("fp IS NULL").drop("fp"), number)

    stream = spark.readStream.schema(LISTING).json(listings)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
