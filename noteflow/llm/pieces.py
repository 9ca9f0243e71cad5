"""SentencePiece encoding and decoding by vectorised merge rounds.

The texts of a batch are cut into words where no piece of the vocabulary can
reach across (before a space mark that follows another character), and each
distinct word is encoded once. All new words lie in flat numpy arrays of
symbols; a round finds the smallest pair rank of every word by a segmented
minimum, merges all its leftmost occurrences at once, and compacts; words
without a pair left retire. Inside a word, places where no piece holds the two
neighbouring characters are cut too, so scripts without spaces stay short.
Pairs are looked up in a hash table (``Places``).

Merging all occurrences at once equals the library's one-by-one order unless
the merged symbol can take part in a pair of the same or better rank: such
ranks are known from the vocabulary, and of them a round merges only the first
occurrence in each word.

Null text counts as empty and gives no ids. Characters outside the vocabulary
give their UTF-8 bytes. The model file's path is a parameter; every Python
worker loads it once.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteflow.sources.splits import spread

MARK = "▁"
NONE = np.int32(1 << 30)
#: Words that a worker remembers before it starts anew (those of one batch may come on top), and characters that it encodes at once.
CACHE_WORDS, BATCH_CHARS = 200_000, 2 << 20
WORD = re.compile(f"{MARK}+[^{MARK}]*")


class Places:
    """Where a key (a pair of numbers below 2^31) lies in a list of distinct keys, by a hash table with linear probing."""

    def __init__(self, left: np.ndarray, right: np.ndarray) -> None:
        self.code = left.astype(np.int64) << 32 | right
        bits = max(8, (8 * len(left)).bit_length())
        self.down, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.table = np.full(1 << bits, -1, dtype=np.int32)
        todo = np.arange(len(left), dtype=np.int32)
        slot = self.slots(self.code)
        while len(todo):
            free = self.table[slot] < 0
            self.table[slot[free]] = todo[free]
            lost = self.table[slot] != todo
            todo, slot = todo[lost], (slot[lost] + 1) & self.last

    def slots(self, code: np.ndarray) -> np.ndarray:
        return (code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.down).view(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each key, negative where it is none of the list."""
        code = left.astype(np.int64) << 32 | right
        slot = self.slots(code)
        at = self.table[slot]
        # an empty slot reads the last key, and meets it only if that key is the one looked for
        other = np.flatnonzero((self.code[at] != code) & (at >= 0))
        slot, code = slot[other], code[other]
        while len(other):
            slot = (slot + 1) & self.last
            at[other] = now = self.table[slot]
            more = (self.code[now] != code) & (now >= 0)
            other, slot, code = other[more], slot[more], code[more]
        return at


class Vocabulary:
    """Pieces, pair ranks and cuts of a byte-fallback BPE model, as arrays."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib = self.library
        n = self.n = lib.get_piece_size()
        plain = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))]
        ids = {lib.id_to_piece(i): i for i in plain}
        self.byte = np.array([lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)
        # a character outside the vocabulary stands for itself, above all piece numbers
        self.symbol = np.arange(n, n + 0x110000, dtype=np.int32)
        for piece, i in ids.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        scores = {i: lib.get_score(i) for i in plain}
        rank_of_score = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        left, right, merged = [], [], []
        for piece, i in ids.items():
            for cut in range(1, len(piece)):
                a, b = ids.get(piece[:cut]), ids.get(piece[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(i)
        left, right, merged = (np.array(x, dtype=np.int32) for x in (left, right, merged))
        self.pairs = Places(left, right)
        rank = np.full(n, NONE, dtype=np.int32)
        for i, s in scores.items():
            rank[i] = rank_of_score[s]
        # the last entry is that of no pair
        self.merged, self.rank = np.r_[merged, np.int32(0)], np.r_[rank[merged], NONE]
        # ranks whose merged symbol is part of a pair that is at least as good
        best_use = np.full(n, NONE, dtype=np.int32)
        np.minimum.at(best_use, left, rank[merged])
        np.minimum.at(best_use, right, rank[merged])
        self.one_by_one = np.zeros(len(rank_of_score), dtype=bool)
        made = np.unique(merged)
        self.one_by_one[rank[made[best_use[made] <= rank[made]]]] = True
        neighbours = np.array(sorted({(ord(a), ord(b)) for piece in ids for a, b in zip(piece, piece[1:])}), dtype=np.int32).reshape(-1, 2)
        self.neighbours = Places(neighbours[:, 0], neighbours[:, 1])
        text = [f"{i},".encode() for i in range(n)]
        self.decimal = np.array(text, dtype=f"S{max(map(len, text))}")
        self.decimal_size = np.array(list(map(len, text)), dtype=np.int32)

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE: no pair) and merged symbol of each pair."""
        at = self.pairs.find(left, right)
        return self.rank[at], self.merged[at]

    def decimals(self, ids: list[np.ndarray]) -> Iterator[bytes]:
        """The ids of each text in decimal, with commas between them."""
        flat = np.concatenate(ids)
        data = self.decimal[flat].tobytes().translate(None, b"\0")  # shorter numbers are filled up with zero bytes
        ends = np.r_[0, np.cumsum(self.decimal_size[flat], dtype=np.int64)][np.cumsum([len(x) for x in ids])].tolist()
        for begin, end in itertools.pairwise([0, *ends]):
            yield data[begin : max(begin, end - 1)]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and how many each word has. Words carry their marks and are not empty."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.int32)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        starts = np.cumsum(lengths) - lengths
        cut = np.ones(len(points), dtype=bool)  # a segment starts here
        cut[1:] = self.neighbours.find(points[:-1], points[1:]) < 0
        cut[starts] = True
        out = self.rounds(self.symbol[points], np.cumsum(cut, dtype=np.int32))
        kept = out >= 0
        ids, place = out[kept], np.nonzero(kept)[0]
        counts = np.add.reduceat(kept.astype(np.int64), starts)
        strange = ids >= self.n
        if strange.any():
            size = np.ones(len(ids), dtype=np.int64)
            code = ids[strange] - self.n
            size[strange] = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
            spread = np.repeat(ids, size)
            data = "".join(map(chr, code.tolist())).encode("utf-8", "surrogatepass")
            spread[np.repeat(strange, size)] = self.byte[np.frombuffer(data, dtype=np.uint8)]
            counts = counts + np.add.reduceat(np.bincount(place, size - 1, minlength=len(out)).astype(np.int64), starts)
            ids = spread
        return ids, counts

    def rounds(self, sym: np.ndarray, seg: np.ndarray) -> np.ndarray:
        """Merge rounds over segments (numbered, ascending): the symbol that starts at each place, -1 elsewhere."""
        out = np.full(len(sym), -1, dtype=np.int32)
        place = np.arange(len(sym), dtype=np.int32)
        rank = np.full(len(sym), NONE, dtype=np.int32)  # of the pair that starts here
        into = np.zeros(len(sym), dtype=np.int32)
        inner = np.flatnonzero(seg[:-1] == seg[1:])
        rank[inner], into[inner] = self.pair(sym[inner], sym[inner + 1])
        while len(sym):
            starts = np.r_[0, np.flatnonzero(seg[1:] != seg[:-1]) + 1]
            sizes = np.diff(starts, append=len(seg))
            least = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            stay = least != NONE
            gone = np.flatnonzero(~stay)  # finished segments leave
            out[place[gone]] = sym[gone]
            at = np.flatnonzero((rank == least) & stay)
            owner = seg[at]
            first = np.r_[True, owner[1:] != owner[:-1]][: len(at)]
            alone = np.r_[True, at[1:] != at[:-1] + 1][: len(at)]  # overlapping pairs: every other one from the left
            number = np.arange(len(at))
            odd = (number - np.maximum.accumulate(np.where(alone, number, 0))) & 1
            at = at[first | (~self.one_by_one[rank[at]] & (odd == 0))]
            sym[at] = into[at]
            rank[at] = NONE
            stay[at + 1] = False
            changed = np.zeros(len(sym), dtype=bool)
            changed[at] = True
            kept = np.flatnonzero(stay)
            sym, seg, place, rank, into, changed = sym[kept], seg[kept], place[kept], rank[kept], into[kept], changed[kept]
            near = np.flatnonzero((changed[:-1] | changed[1:]) & (seg[:-1] == seg[1:]))
            rank[near], into[near] = self.pair(sym[near], sym[near + 1])
        return out


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes batches of texts; remembers a bounded number of words."""

    def __init__(self, path: str) -> None:
        self.vocabulary = vocabulary(path)
        self.forget()

    def forget(self) -> None:
        #: the number of each word, given at its first look-up
        self.known: dict[str, int] = defaultdict(itertools.count().__next__)
        self.ids, self.starts, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self) -> None:
        """Encode the words that have a number but no ids."""
        new = [MARK + w for w in itertools.islice(self.known, len(self.counts), None)]
        if not new:
            return
        ids, counts = self.vocabulary.encode_words(new)
        self.starts = np.r_[self.starts, len(self.ids) + np.cumsum(counts) - counts]
        self.counts, self.ids = np.r_[self.counts, counts], np.r_[self.ids, ids]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. A word is named by what follows its first mark; all words begin with one."""
        if len(self.known) > CACHE_WORDS:
            self.forget()
        per_text = []
        for text in texts:
            words = text.split(" ") if text else []
            if "" in words or MARK in text:
                words = [w[1:] for w in WORD.findall(MARK + text.replace(" ", MARK))]
            per_text.append(words)
        sizes = [len(words) for words in per_text]
        word = np.fromiter(map(self.known.__getitem__, itertools.chain.from_iterable(per_text)), dtype=np.int64, count=sum(sizes))
        self.learn()
        counts = self.counts[word]
        ends = np.cumsum(counts)
        flat = self.ids[np.repeat(self.starts[word] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]
        upto = np.r_[0, ends][np.cumsum(sizes)]
        return np.split(flat, upto[:-1])

    def decode(self, ids: np.ndarray) -> str:
        return self.vocabulary.library.decode(ids.tolist())


def _batches(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold a bounded number of characters (or one row)."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > BATCH_CHARS:
            yield begin, i
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, decoded: the ids of each whole text and their decoding."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(path)
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in _batches(texts):
                ids = encoder.encode(texts[a:b])
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[a:b].astype("Int64"), "ids": ids, "decoded": [encoder.decode(x) for x in ids]})

    rows = spread(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    return rows.mapInPandas(run, "doc_id long, ids array<int>, decoded string")


def encoded_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(path)
        digest = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in _batches(texts):
                ids = encoder.encode(texts[a:b])
                yield pd.DataFrame({
                    "doc_id": batch["doc_id"].iloc[a:b].astype("Int64"),
                    "n_tokens": [len(x) for x in ids],
                    "ids_sha256": [digest(x) for x in encoder.vocabulary.decimals(ids)],
                    "decoded_sha256": [digest(encoder.decode(x).encode("utf-8", "surrogatepass")) for x in ids],
                })

    rows = spread(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    return rows.mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
