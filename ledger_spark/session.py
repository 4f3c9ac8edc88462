"""Session settings the package is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(
    app_name: str = "ledger_spark",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Session with adaptive execution on and a fixed UTC clock.

    On a cluster leave ``shuffle_partitions`` unset and let adaptive execution
    coalesce from the configured initial number; in local mode pass about the
    number of cores.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # A reply may repeat a key within one object; the last one counts.
        "spark.sql.variant.allowDuplicateKeys": "true",
        **(extra or {}),
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()
