"""Sources of adverts, pages and statistics."""

from pyspark.sql import SparkSession

from .adverts import RestAdverts
from .cube import RestCubes


def register(spark: SparkSession) -> SparkSession:
    """Make format("adverts") and format("cubes") known to the session, and let filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RestAdverts)
    spark.dataSource.register(RestCubes)
    return spark
