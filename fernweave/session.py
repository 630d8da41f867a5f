"""Settings that results depend on in this version of Spark."""

from pyspark.sql import SparkSession


def prepared(spark: SparkSession) -> SparkSession:
    """Spark 4.1 zips the inputs of a union by partition if they are hashed alike, and fails if adaptive execution has since coalesced one of them. So unions say nothing of how they're partitioned."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark
