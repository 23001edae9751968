"""Tables written between the steps of a long plan."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """The frame, written below spark.checkpoint.dir and read again, so that what follows is planned on its own.

    Where the setting is absent a temporary folder serves on a local master; elsewhere it is needed.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = os.path.join(tempfile.gettempdir(), "checkpoints")
    path, schema = f"{root.rstrip('/')}/chartwave-{uuid.uuid4().hex}", df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of tables that stored() returned and nothing needs any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
