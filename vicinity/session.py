"""Session defaults and the few places where the library touches session state."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "vicinity", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings every plan here relies on: UTC and adaptive execution."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for reliable checkpoints: the cluster's own setting.

    Where it is unset, a folder of this run under the warehouse is used in local
    mode; on a cluster, where machines do not share local folders, that is an error.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if configured:
        if current is None:
            context.setCheckpointDir(configured)
        return configured
    if current is None:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        home = re.sub("^file:/*", "/", spark.conf.get("spark.sql.warehouse.dir"))
        os.makedirs(home, exist_ok=True)
        current = tempfile.mkdtemp(prefix="checkpoint-", dir=home)
        context.setCheckpointDir(current)
        atexit.register(shutil.rmtree, current, ignore_errors=True)
    return current


def stable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so that two readers see the same rows.

    With ``spark.cleaner.referenceTracking.cleanCheckpoints`` (set by ``build_session``)
    Spark deletes the files when nothing refers to the rows any more.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
