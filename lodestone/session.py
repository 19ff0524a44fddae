"""Sessions for local work, and what Python workers need to find this package."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cores: str = "*", memory: str = "4g", partitions: int = 8) -> SparkSession:
    """A UTC session on this machine; clusters bring their own."""
    conf = {"spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": memory, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.host": "127.0.0.1"}
    spark = SparkSession.builder.master(f"local[{cores}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Lets Python workers that see this folder import the package; elsewhere submit it with ``--py-files``."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, have]))


def shipped(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``query`` with the package made importable on the workers first."""

    @functools.wraps(query)
    def run(spark: SparkSession, *args: object) -> DataFrame:
        ship(spark)
        return query(spark, *args)

    return run
