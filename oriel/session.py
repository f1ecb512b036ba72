"""Session helpers.

The library never creates its own cluster settings on a real cluster: it reads
what the session already has.  ``local_session`` is for tests and the bench
only.  ``checkpoint_dir`` returns the shared folder named by
``spark.checkpoint.dir``; only when that is unset (local tests) a scratch
folder is configured.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "oriel") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("ORIEL_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder.  Where none is configured, a local master
    gets a scratch folder and a cluster an error: a machine-local folder there
    would not be seen by other executors."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="oriel-ckpt-", dir=os.environ.get("ORIEL_SCRATCH", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def on_request(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition a text table by ``key`` into ``oriel.text.partitions``
    partitions, where the session asks for it (a single-file input on one
    machine); else the scan's own partitions stay."""
    n = df.sparkSession.conf.get("oriel.text.partitions", None)
    return df.repartition(int(n), key) if n else df
