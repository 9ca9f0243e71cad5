"""Quality classifier: logistic regression over hashed word n-grams, learned by
follow-the-regularised-leader (FTRL-proximal) updates.

A text's features are its words, pairs of neighbouring words, the same two of
the words' shapes (character classes, so that words never seen before count
too), and marks of a word that repeats one of the words just before it; all are
hashed into ``2 ** BITS`` weights. Words of over ``PIECE`` characters (texts
without spaces) count as their pieces of that length. A score is one sparse dot
product per text.

The model learns from a bounded sample (``labelled.TRAIN_ROWS``), document by
document in one task, which streams the sample once per epoch and holds one
batch of it. Null text counts as empty: its score is that of the bias alone, as
is every score if no labelled row exists (0.5 then). Repeated rows are scored
alike, each for itself; where labels repeat an id, each label is learned from;
equal sample rows are interchangeable; an empty table gives an empty result.
Columns other than the id and the text are not read, and may have any names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteflow.llm.labelled import TRAIN_ROWS, WordTable, held_out, labelled_sample
from noteflow.sources.splits import spread

BITS = 20
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 0.02, 1.0, 2
#: Feature values add up to this in each text.
SCALE = 30.0
THRESHOLD = 0.3
MASK = np.uint64((1 << BITS) - 1)
LOOK_BACK = 3
PIECE = 64
BATCH_CHARS = 4 << 20
SHAPE = (re.compile(r"[^\W\d_]"), re.compile(r"\d"), re.compile(r"(.)\1+"))


def shape(word: str) -> str:
    """Upper-case letters as X, lower-case as x, digits as 9, runs as one."""
    out = "".join("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in word)
    return SHAPE[2].sub(r"\1", out)


def describe(word: str) -> tuple[int, int]:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")), zlib.crc32(b"\0" + shape(word).encode("utf-8", "surrogatepass"))


def _mixed(a: np.ndarray, b: np.ndarray | int, kind: int) -> np.ndarray:
    """Hash of a pair and of the kind of feature."""
    x = (a * np.uint64(0x9E3779B97F4A7C15) + b) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(kind * 0x94D049BB + 1)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - BITS)


def words_of(text: str) -> list[str]:
    """The words of a text, long ones in pieces."""
    words = text.split()
    if max(map(len, words), default=0) <= PIECE:
        return words
    return [w[i : i + PIECE] for w in words for i in range(0, len(w), PIECE)]


def counted(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of a text and their values."""
    at, count = np.unique(flat, return_counts=True)
    return at.astype(np.int32), (count * (SCALE / max(len(flat), 1))).astype(np.float32)


def features(texts: list[str], table: WordTable) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts end to end, text after text, and how many each has."""
    per_text = [words_of(t) for t in texts]
    sizes = np.array([len(w) for w in per_text], np.int64)
    every = [w for words in per_text for w in words]
    word, form = table.look_up(every).astype(np.uint64).T if every else np.zeros((2, 0), np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    found, owners = [_mixed(word, np.uint64(0), 1), _mixed(form, np.uint64(0), 2)], [owner, owner]
    if len(every) > 1:
        same = owner[1:] == owner[:-1]
        found += [_mixed(word[:-1], word[1:], 3)[same], _mixed(form[:-1], form[1:], 4)[same]]
        owners += [owner[1:][same], owner[1:][same]]
    for back in range(1, LOOK_BACK + 1):
        again = np.nonzero((word[back:] == word[:-back]) & (owner[back:] == owner[:-back]))[0] + back
        found.append(_mixed(np.full(len(again), back, np.uint64), np.uint64(0), 5))
        owners.append(owner[again])
    flat, owner = np.concatenate(found).astype(np.int64), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return flat[order], np.bincount(owner, minlength=len(texts))


def batches_of(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of a bounded number of characters (or one text)."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > BATCH_CHARS:
            yield begin, i
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)


class Learner:
    """FTRL-proximal; the last weight is the bias."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def update(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] += g * g


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> np.ndarray:
    """The weights, learned in one task from a bounded sample of labelled documents."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = WordTable(describe, 2)
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in batches_of(texts):
                flat, sizes = features(texts[a:b], table)
                found = [counted(part) for part in np.split(flat, np.cumsum(sizes)[:-1])]
                place = [zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in texts[a:b]]
                yield pd.DataFrame({"place": place, "y": batch["y"].iloc[a:b].to_numpy(), "at": [x for x, _ in found], "x": [x for _, x in found]})

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        learner, bias = Learner(), 1 << BITS
        for batch in batches:
            for at, x, y in zip(batch["at"], batch["x"], batch["y"]):
                learner.update(np.r_[at, bias], np.r_[x, 1.0], int(y))
        w = learner.weights(slice(None)).astype(np.float32)
        at = np.nonzero(w)[0]
        yield pd.DataFrame({"at": at, "w": w[at]})

    sample = labelled_sample(spread(docs), labels, label, rows).mapInPandas(hashed, "place long, y int, at array<int>, x array<float>")
    epochs = sample.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(EPOCHS))))  # each a pass in the same order
    fit = epochs.repartition(1).sortWithinPartitions("epoch", "place", "y", "at").select("y", "at", "x")
    fit = fit.mapInPandas(fitted, "at long, w float").toPandas()  # at most 2 ** BITS + 1 weights
    weights = np.zeros((1 << BITS) + 1, np.float32)
    weights[fit["at"].to_numpy()] = fit["w"].to_numpy()
    return weights


def scores(texts: list[str], weights: np.ndarray, table: WordTable) -> np.ndarray:
    flat, sizes = features(texts, table)
    total = np.add.reduceat(np.r_[weights[flat].astype(np.float64), 0.0], np.cumsum(sizes) - sizes) if len(texts) else np.zeros(0)
    total = np.where(sizes > 0, total, 0.0) * SCALE / np.maximum(sizes, 1) + weights[-1]
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def score_documents(spark: SparkSession, docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, score of every document; the weights are broadcast (a fixed size)."""
    shared = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = WordTable(describe, 2)
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in batches_of(texts):
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[a:b].astype("Int64"), "score": scores(texts[a:b], shared.value, table)})

    rows = spread(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(run, "doc_id long, score double")


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score_documents(spark, docs, train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
