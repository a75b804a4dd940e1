"""Sources: archives of JSON and XML documents, streamed JSON, the catalogue's CSV, sign lists."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tellgrid.session import ship
from tellgrid.sources.archives import JsonItems, ZipMembers


def register(spark: SparkSession) -> None:
    """Make the formats zip_members and json_items known to ``spark.read.format``."""
    ship(spark)
    spark.dataSource.register(ZipMembers)
    spark.dataSource.register(JsonItems)
