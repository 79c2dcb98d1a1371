"""Session set-up and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import NullType


def build_session(app_name: str = "marketlab", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, ANSI mode and adaptive execution.

    Cluster settings (executors, memory, shuffle partitions) are left to
    spark-submit; only semantics-relevant options are fixed here.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    fixed = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for key, value in {**fixed, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point reliable checkpoints at the shared folder the cluster names.

    ``spark.checkpoint.dir`` wins. Only when neither it nor a checkpoint
    folder is set (single-machine tests) is a local one created.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if shared:
        if current is None or urlparse(shared).path.rstrip("/") not in current:
            sc.setCheckpointDir(shared)
        return
    if current is None:
        local = sc.master.startswith("local")
        if not local:
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp")))


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the copy.

    Parquet keeps later passes narrow: they read only their columns. Frames
    with untyped null columns cannot be Parquet and use a reliable checkpoint.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    if any(isinstance(f.dataType, NullType) for f in df.schema.fields):
        return df.checkpoint(eager=True)
    path = f"{spark.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
