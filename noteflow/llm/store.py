"""Written tables in the folder that the whole cluster shares, lookups with hot keys, and names for working columns."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteflow.sources.scratch import new_folder, shared_folder, written

__all__ = ["free_names", "lookup", "new_folder", "shared_folder", "written"]

#: Most keys that are treated as frequent, and counters of the summary that finds them.
HOT_KEYS, COUNTERS = 1024, 8192
#: Most rows of a slim table (under 100 bytes a row) that is broadcast whole.
MAP_SIDE = 100_000


def free_names(frame: DataFrame, *names: str) -> list[str]:
    """The names, each made longer until no column of ``frame`` has it."""
    taken, out = {c.lower() for c in frame.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def lookup(spark: SparkSession, rows: DataFrame, table: DataFrame, key: str, how: str = "left", stable: bool = False) -> DataFrame:
    """``rows`` joined (left or inner) with ``table`` (written, slim, one row per key) on ``key``.

    A table of at most MAP_SIDE rows is broadcast. Of a larger one, the keys
    that a Misra-Gries summary of ``rows`` names are settled on the map side (at
    most HOT_KEYS rows of it are broadcast), and the rest are shuffled. ``rows``
    are written for that, unless they are ``stable`` (the same when read again).
    """
    if table.limit(MAP_SIDE + 1).count() <= MAP_SIDE:
        return rows.join(F.broadcast(table), key, how)
    rows = rows if stable else written(spark, rows, "looked_up")
    binary = dict(rows.dtypes)[key] == "binary"  # which the summary does not count: it gets them as hex digits
    top = rows.agg(F.expr(f"approx_top_k({f'hex({key})' if binary else key}, {HOT_KEYS}, {COUNTERS})").alias("top")).select(F.explode("top.item").alias(key))
    top = written(spark, top.select(F.unhex(key).alias(key)) if binary else top, "top")
    hot = F.broadcast(table.join(F.broadcast(top), key))
    common = rows.join(F.broadcast(top), key, "left_semi").join(hot, key, how)
    return common.unionByName(rows.join(F.broadcast(top), key, "left_anti").join(table, key, how))
