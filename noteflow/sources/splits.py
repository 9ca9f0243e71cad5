"""Splits for work in Python: enough of them for the cores of the session."""

from pyspark.sql import DataFrame


def spread(frame: DataFrame) -> DataFrame:
    """``frame`` dealt evenly over the session's cores where its files give fewer splits than that, otherwise as it is.

    Only small inputs (one file of one row group, say) are moved by it.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame
