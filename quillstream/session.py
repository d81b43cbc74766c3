"""Session defaults for tests, benches and scripts; on a cluster the session is the caller's."""

from __future__ import annotations

import os
import tempfile
from functools import cache

from pyspark.sql import SparkSession


@cache
def _own_folder() -> str:
    """One temporary folder for this process, for tests on one machine."""
    return f"file://{tempfile.mkdtemp(prefix='quillstream-')}"


def shared_folder(spark: SparkSession) -> str:
    """The folder shared by the driver and all executors that the session names; where none is named, one of this process, if all is local.

    No setting of the session is changed.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = _own_folder()
    return at.rstrip("/")


def local_session(cpus: int | str = 8, memory: str = "8g", **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("quillstream")
    defaults = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.host": "127.0.0.1",
        "spark.sql.warehouse.dir": os.path.join("/tmp", "quillstream-warehouse"),
    }
    spark = builder.config(map={**defaults, **conf}).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
