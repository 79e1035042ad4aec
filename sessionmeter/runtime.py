"""Session settings the library relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# allowDuplicateKeys: a repeated JSON key keeps its last value instead of failing.
# LAST_WIN: the same for key=value arguments.
# hugeMethodLimit: the JVM compiles no method above 8,000 bytes; Spark then evaluates the steps in smaller ones.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}
# Checkpoint files go when nothing refers to them; read when the session's context starts.
CLEANING = {"spark.cleaner.referenceTracking.cleanCheckpoints": "true"}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a running session; all of them are runtime settings."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def new_session(app: str = "sessionmeter", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {**SETTINGS, **CLEANING, **conf}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpointed(df):
    """Write a frame to the cluster's checkpoint folder and go on from there.

    The folder comes from ``spark.checkpoint.dir``. Where it is unset a local session gets a
    temporary one; on a cluster that is an error, since other machines could not read it.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="sessionmeter-")
        context.setCheckpointDir(folder)
    return df.checkpoint()
