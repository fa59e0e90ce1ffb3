"""Session helpers: a configured session for tests and benches, table loading, lineage cutting."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "siltstone", cpus: str | int = "*", **extra: str) -> SparkSession:
    """A local session with the settings every operator assumes (UTC, AQE, Arrow).

    On a cluster the session is the caller's; the operators only read it.
    """
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    }
    conf.update(extra)
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints, shared by all executors.

    The cluster names it in ``spark.checkpoint.dir``; only in local mode (tests, a laptop),
    where it is unset, a local folder is chosen.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if not named and not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = named or os.path.join(tempfile.gettempdir(), "siltstone-checkpoints")
    sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and return it as a fresh plan.

    Reliable checkpoints survive the loss of an executor, unlike local ones.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
