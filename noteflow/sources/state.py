"""Keyed tables that a stream keeps between its batches, written in deltas.

Rows lie in a fixed number of parts by the hash of their key. A batch writes the
rows of the keys that it touches to ``data/v=<batch>/part=<p>`` and the list of
versions that each part now consists of to ``heads/v=<batch>``, so a batch costs
what it changes and reads no more than the parts that it asks for. A part of
more than ``MOST_DELTAS`` versions is written anew as one. A batch that runs
again starts from the head before it and writes the same version, so a lost run
leaves no trace.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

PARTS, MOST_DELTAS = 64, 8

Head = dict[int, list[str]]


class KeyedTable:
    """The rows of a key are those that its newest version wrote; a key may have any number of rows."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: list[str], parts: int = PARTS, most: int = MOST_DELTAS) -> None:
        self.spark, self.folder, self.keys, self.parts, self.most = spark, folder, keys, parts, most
        self.schema = StructType.fromDDL(schema)
        self.stored = StructType([*self.schema.fields, StructField("gone", BooleanType())])

    def part(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int")

    def head(self, before: int | None = None) -> Head:
        """Versions of each part, oldest first, as they were before a batch (None: now)."""
        try:
            heads = self.spark.read.parquet(f"{self.folder}/heads")
        except Exception as error:  # AnalysisException: nothing was written yet
            if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
                return {}
            raise
        heads = heads if before is None else heads.where(F.col("v") < before)
        last = heads.agg(F.max("v")).first()[0]
        if last is None:
            return {}
        return {r.part: list(r.versions) for r in heads.where(F.col("v") == last).collect()}  # at most ``parts`` rows

    def touched(self, rows: DataFrame) -> list[int]:
        return [r[0] for r in rows.select(self.part()).distinct().collect()]  # at most ``parts`` numbers

    def rows(self, head: Head, parts: list[int] | None = None) -> DataFrame:
        """The current rows, of some parts or of all."""
        wanted = {p: v for p, v in head.items() if parts is None or p in parts}
        frames = []
        for n in range(max(map(len, wanted.values()), default=0)):  # at most MOST_DELTAS
            paths = [f"{self.folder}/data/v={v[n]}/part={p}" for p, v in wanted.items() if n < len(v)]
            frames.append(self.spark.read.schema(self.stored).parquet(*paths).withColumn("v", F.lit(n)))
        if not frames:
            return self.spark.createDataFrame([], self.schema)
        every = reduce(DataFrame.unionByName, frames)
        newest = F.max("v").over(Window.partitionBy(*self.keys))
        return every.withColumn("newest", newest).where("v = newest AND NOT gone").select(*self.schema.names)

    def write(self, number: int, head: Head, rows: DataFrame, gone: DataFrame | None = None) -> Head:
        """Batch ``number``: ``rows`` are from now on all rows of their keys; the keys in ``gone`` have none."""
        new = rows.select(*self.schema.names).withColumn("gone", F.lit(False))
        if gone is not None:
            empty = [F.col(c) if c in self.keys else F.lit(None).cast(t).alias(c) for c, t in new.dtypes if c != "gone"]
            new = new.unionByName(gone.select(*self.keys).distinct().select(*empty, F.lit(True).alias("gone")))
        path = f"{self.folder}/data/v={number}"
        new.withColumn("part", self.part()).repartition("part").write.mode("overwrite").partitionBy("part").parquet(path)
        out = {p: list(v) for p, v in head.items()}
        for p in self._parts_of(path):
            out.setdefault(p, []).append(str(number))
        long = [p for p, v in out.items() if len(v) > self.most]
        if long:
            whole = self.rows({p: out[p] for p in long}).withColumn("gone", F.lit(False)).withColumn("part", self.part())
            whole.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}w")
            left = self._parts_of(f"{path}w")
            out = {p: [f"{number}w"] if p in long else v for p, v in out.items() if p not in long or p in left}
        heads = self.spark.createDataFrame(list(out.items()), "part int, versions array<string>")
        heads.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/heads/v={number}")
        return out

    def _parts_of(self, path: str) -> list[int]:
        written = self.spark.read.schema(self.stored).parquet(path)
        return [r[0] for r in written.select(F.regexp_extract(F.input_file_name(), r"/part=(\d+)/", 1).cast("int")).distinct().collect()]
