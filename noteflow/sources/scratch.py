"""Tables that a job writes once and reads again, in the folder that the whole cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_FOLDER = "/tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """URI of the shared folder: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local session (tests) gets a folder of its own; a
    cluster session raises, since a machine-local folder would lose rows there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = f"file://{LOCAL_FOLDER}/noteflow-{uuid.uuid4().hex}"
    spark.sparkContext.setCheckpointDir(folder)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(spark: SparkSession, frame: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``frame`` once and read it back: cuts lineage and survives lost executors."""
    path = new_folder(spark, name)
    frame.write.option("compression", codec).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
