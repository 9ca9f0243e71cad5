"""Bounded labelled samples for the classifiers, and a word table for their workers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled rows that a classifier learns from; where there are more, those of the smallest hashes.
TRAIN_ROWS = 20_000
HELD_OUT_FOLDS = 5
#: Distinct words that a worker remembers before it starts anew.
CACHE_WORDS = 200_000


def held_out(id_col: str = "doc_id") -> Column:
    """True for the fifth of the ids that no model learns from; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % HELD_OUT_FOLDS == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """text, y of at most ``rows`` labelled documents that are not held out; rows without id or label are left out."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.select(F.col("doc_id").alias("key"), F.col(label).cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("key"), "key", "y").limit(rows)
    joined = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("key"))  # bounded by rows
    return joined.select(F.coalesce("text", F.lit("")).alias("text"), "y")


class WordTable:
    """Numbers of what ``describe(word)`` gives, one row per distinct word, kept for a bounded number of words."""

    def __init__(self, describe: Callable[[str], tuple], width: int, dtype: type = np.int64) -> None:
        self.describe, self.width, self.dtype = describe, width, dtype
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, self.width), self.dtype)

    def look_up(self, words: list[str]) -> np.ndarray:
        """(len(words), width)"""
        distinct = set(words)
        if len(self.known) + len(distinct) > CACHE_WORDS:
            self.forget()
        new = [w for w in distinct if w not in self.known]
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.rows = np.concatenate([self.rows, np.array([self.describe(w) for w in new], self.dtype).reshape(-1, self.width)])
        return self.rows[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]
