"""Periodic run detection by online dyadic square catching.

A run is a maximal stretch of consecutive words with a smallest period q: words
q apart are identical, and no neighbouring word keeps that up. Words arrive by
``SquareCatcher.append``, one by one or in pieces of any length, and after each
piece the caught squares are those of all words so far:

* every completed block of 2^k words, at a multiple of 2^k, gets a catcher that
  waits for its block to come back between two and four block lengths later. A
  half of a square of that period holds such a block, so no square escapes; an
  appended word ends one suffix of 2^k words a level, which is compared with the
  two live catchers of the level (three for single words);
* where they agree a comparison opens: it goes left over less than a block, and
  right with every word appended, until two words differ. Once it has held for a
  whole period it has caught a square, and what it covers when it ends is a run.
  Squares of the same run meet in one comparison, and multiples of a period
  within its own run are not opened again.

Suffixes are compared by 64-bit hashes, and every run is verified word by word
at its end, so no run is reported that is not there. Texts are put end to end
with a word of its own after each, which no square can hold; their words are
appended in bounded slices, and the state is linear in the longest text.

Null text counts as empty; texts without words have no runs; equal texts have
equal runs; a null id is kept; an empty table gives an empty result. Other
columns are not read, and may have any names.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteflow.llm.quality import batches_of
from noteflow.sources.splits import spread

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A run counts from this many words, and from this many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words appended at once.
SLICE = 1 << 15

Run = tuple[int, int, int]  # start, length, period
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Level:
    """Suffix hashes and block hashes of one block size."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.backs = (1, 2, 3) if size == 1 else (2, 3)
        self.first = 0  # start of the first suffix that ``hashes`` still holds
        self.hashes = np.zeros(0, np.uint64)
        self.blocks = np.zeros(0, np.uint64)  # of all completed blocks
        self.done = 0  # suffix starts that have been hashed

    def add(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Take the hashes of the next suffix starts; (suffix start, block start) of each comparison that opens."""
        size, begin = self.size, self.done
        self.done += len(hashes)
        self.hashes = np.concatenate([self.hashes, hashes])
        self.blocks = np.concatenate([self.blocks, hashes[-begin % size :: size]])
        at, found = np.arange(begin, self.done), []
        for back in self.backs:
            block = at // size - back
            skip = np.searchsorted(block, 0)
            x, b = at[skip:], block[skip:]
            hit = hashes[skip:] == self.blocks[b]
            x, b = x[hit], b[hit]
            before = np.maximum(x - size - self.first, 0)
            chained = (b > 0) & (self.hashes[before] == self.blocks[b - 1])  # the block before came back as well, by the same shift
            found.append((x[~chained], b[~chained] * size))
        return np.concatenate([x for x, _ in found]), np.concatenate([b for _, b in found])

    def forget(self) -> None:
        """Drop suffixes that no later comparison reads."""
        first = max(0, self.done - self.size)
        self.hashes, self.first = self.hashes[first - self.first :], first


class SquareCatcher:
    """Squares, and the runs that they merge into, of a growing sequence of numbered words."""

    def __init__(self, longest: int) -> None:
        """longest: no square longer than that is looked for."""
        self.words, self.n = np.zeros(1024, np.int64), 0
        self.levels = [Level(1)]
        while 4 * (size := 2 * self.levels[-1].size) <= longest:
            self.levels.append(Level(size))
        self.open: list[list[int]] = []  # start, end of what agrees so far, period
        self.runs: list[Run] = []

    def append(self, codes: np.ndarray) -> None:
        n = self.n + len(codes)
        if n > len(self.words):
            self.words = np.concatenate([self.words[: self.n], np.zeros(max(n, 2 * self.n) - self.n, np.int64)])
        self.words[self.n : n] = codes
        self.n = n
        going, self.open = sorted(self.open, key=lambda c: c[2]), []
        caught: list[Run] = []
        for start, end, period in going:
            self._advance(start, end, period, caught)
        hashes = _mix(codes.astype(np.uint64) + np.uint64(1))
        for k, level in enumerate(self.levels):
            if k:
                below, half, last = self.levels[k - 1], level.size // 2, n - level.size + 1
                if last <= level.done:
                    break
                a = below.hashes[level.done - below.first : last - below.first]
                b = below.hashes[level.done + half - below.first : last + half - below.first]
                hashes = _mix(a * np.uint64(0xD6E8FEB86659FD93) + b)
            self._open(*level.add(hashes), level.size, caught)
        for level in self.levels:
            level.forget()
        starts: set[int] = set()  # of an open square, the smallest period tells all of its multiples
        kept = []
        for c in sorted(self.open, key=lambda c: c[2]):
            square = c[1] - c[0] >= c[2]
            if not (square and c[0] in starts):
                kept.append(c)
            if square:
                starts.add(c[0])
        self.open = kept
        self.runs += caught

    def _open(self, x: np.ndarray, block: np.ndarray, size: int, caught: list[Run]) -> None:
        """Comparisons of blocks that came back at x, without those that cannot become a new square."""
        if not len(x):
            return
        period, words, last = x - block, self.words, self.n - 1
        fits = np.ones(len(x), bool)
        for ahead in (np.zeros_like(period), period - 2 * size):  # less than a block agrees before it, so these words after it must
            y = x + size + ahead
            fits &= (y > last) | (period < 2 * size) | (words[np.minimum(y, last)] == words[np.minimum(y - period, last)])
        x, block, period = x[fits], block[fits], period[fits]
        known = [(s, e + q, q) for s, e, q in self.open] + [(s, s + n, q) for s, n, q in self.runs[::-1][:64] + caught]
        for start, end, q in known if len(x) else ():
            if end - start >= 3 * size:
                new = (block < start) | (x + size > end) | (period % q != 0) | (period == q)
                x, block, period = x[new], block[new], period[new]
        for b, p in sorted(zip(block.tolist(), period.tolist())):
            low = max(0, b - size)
            differs = np.nonzero(words[low:b] != words[low + p : b + p])[0]
            self._advance(low + int(differs[-1]) + 1 if len(differs) else low, b + size, p, caught)

    def _advance(self, start: int, end: int, period: int, caught: list[Run]) -> None:
        """Compare on from ``end``, to the first difference or to the last word so far."""
        step, stop, words = 64, self.n - period, self.words
        while end < stop:
            upto = min(stop, end + step)
            differs = words[end:upto] != words[end + period : upto + period]
            at = int(differs.argmax())
            if differs[at]:
                end += at
                if end - start >= period:
                    caught.append((start, end + period - start, period))
                return
            end, step = upto, step * 2
        self.open.append([start, end, period])

    def found(self) -> list[Run]:
        """The runs of all words so far, of at least two periods, each with its smallest period; by start, then period."""
        every = self.runs + [(s, e + q - s, q) for s, e, q in self.open if e - s >= q]
        best: dict[tuple[int, int], int] = {}
        for start, length, period in every:
            if np.array_equal(self.words[start : start + length - period], self.words[start + period : start + length]):
                best[start, length] = min(period, best.get((start, length), period))
        return sorted((start, length, period) for (start, length), period in best.items())


def groups_of(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SLICE words (or one text)."""
    begin, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > SLICE:
            yield begin, i
            begin, total = i, 0
        total += size + 1
    if begin < len(sizes):
        yield begin, len(sizes)


def runs_of(texts: list[list[str]], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[list[Run]]:
    """The runs of each text (a list of words), by start, then period."""
    out: list[list[Run]] = []
    for a, b in groups_of([len(t) for t in texts]):
        numbers: dict[str, int] = {}
        catcher = SquareCatcher(max(map(len, texts[a:b])))
        parts, begins, n = [], [], 0
        for i, words in enumerate(texts[a:b]):
            parts += [np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)), np.array([-i - 2])]
            begins.append(n)
            n += len(words) + 1
        every = np.concatenate(parts)
        for i in range(0, n, SLICE):
            catcher.append(every[i : i + SLICE])
        rows: list[list[Run]] = [[] for _ in begins]
        for start, length, period in catcher.found():
            if length >= max(least_words, least_periods * period):
                i = int(np.searchsorted(begins, start, "right")) - 1
                rows[i].append((start - begins[i], length, period))
        out += rows
    return out


def collapsed(words: list[str], runs: list[Run]) -> list[str]:
    """The words without those that a run repeats after its first period."""
    if not runs:
        return words
    stays = np.ones(len(words), bool)
    for start, length, period in runs:
        stays[start + period : start + length] = False
    return [words[i] for i in np.nonzero(stays)[0]]


def looped(doc_id: int | None, words: list[str]) -> list[str]:
    """The words; for about a tenth of the ids, by their checksum, those from some place on repeat with a period."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def strongest(runs: list[Run]) -> tuple[int | None, ...]:
    """start, length, period, thousandths of periods of the run with most periods; of equal ones the first, then the shortest period."""
    if not runs:
        return (None,) * 4
    start, length, period = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
    return start, length, period, 1000 * length // period


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", change: Callable[[int | None, list[str]], list[str]] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_runs, the strongest run, digests of all runs and of the collapsed text, and both in full.

    ``runs`` is a list of (start, length, period), ``collapsed`` the text in
    which each run is cut to its first period. ``change`` may alter the words
    (given the id) before runs are looked for.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, texts = [None if pd.isna(i) else int(i) for i in batch["id"]], batch["text"].tolist()
            for a, b in batches_of(texts):
                words = [WORD.findall(t) for t in texts[a:b]]
                if change:
                    words = [change(i, w) for i, w in zip(ids[a:b], words)]
                found = runs_of(words)
                short = [" ".join(collapsed(w, r)) for w, r in zip(words, found)]
                rows = [
                    (i, len(r), *strongest(r), _sha("".join(f"{s},{n},{p}\n" for s, n, p in r)), _sha(text), [{"start": s, "length": n, "period": p} for s, n, p in r], text)
                    for i, r, text in zip(ids[a:b], found, short)
                ]
                out = pd.DataFrame(rows, columns=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed"])
                yield out.astype({c: "Int64" for c in ("doc_id", "start", "length", "period", "exponent_milli")})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return spread(rows).mapInPandas(run, f"{SCHEMA}, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def brute_force(words: list[str], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[Run]:
    """The same by trying all periods (for tests)."""
    found: dict[tuple[int, int], int] = {}
    n = len(words)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i >= p:
                found.setdefault((i, j + p - i), p)
            i = max(j, i) + 1
    return sorted((s, m, p) for (s, m), p in found.items() if m >= max(least_words, least_periods * p))
