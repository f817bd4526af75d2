"""Session settings the plans count on."""

from __future__ import annotations

import os
import zipfile

from pyspark import SparkFiles
from pyspark.sql import SparkSession

# runtime settings only: nothing here sizes a cluster
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key even if that costs the operator above it another shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


PACKAGE = os.path.dirname(os.path.abspath(__file__))
ARCHIVE = os.path.basename(PACKAGE) + ".zip"


def ship(spark: SparkSession) -> None:
    """Give the workers this package, compiled, once per application, so that they need no ``PYTHONPATH``."""
    sc = spark.sparkContext
    # Spark's own folder for files of this application; it goes with it
    target = os.path.join(SparkFiles.getRootDirectory(), ARCHIVE)
    if os.path.exists(target):
        return
    with zipfile.PyZipFile(target, "w") as archive:
        archive.writepy(PACKAGE)
    sc.addPyFile(target)


def settle(spark: SparkSession) -> SparkSession:
    ship(spark)
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark
