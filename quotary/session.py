"""Session settings the operators count on."""

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # a shuffle on the ticker alone must not stand in for one on (ticker, bucket)
    "spark.sql.requireAllClusterKeysForDistribution": "true",
    # split a hot ticker in a join even where that costs one more shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tuned(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
