"""Session set-up for applications that do not bring their own session."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "discern", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the settings the operators expect.

    On a cluster leave ``master`` to spark-submit.  The advisory partition size
    lets adaptive execution merge small shuffle partitions, so the shuffle
    partition count can be set high for large inputs without hurting small ones.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings: dict[str, object] = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()
