"""Toxicity by a weighted finite-state pattern grammar.

Words are mapped to classes by a lexical transducer: insults (stems and words
learned from labelled rows, each with its log odds as weight), threats, targets,
negations, reporting words, all else. Small transducers over the classes are
composed into one: negation and reported speech rewrite the insults and threats
that they govern, target binds those near a person, context binds other insults
to what their clause says besides, and the last gives each match its kind.
Clauses run through the composed machine, after reported speech has run over
them from their end, for what the reporting word follows. A clause counts once
for each kind, with its strongest match; a text's score is a logistic function
of the sums over its clauses. A word counts only as a part of a match: an insult
that is its whole clause, or a threat without a target, a negation or a report,
matches nothing. An insult aimed at no one counts in full only if the text has
another one, neither negated nor reported, in the same clause or elsewhere; alone
it is too weak to reject a text. So are negated and reported kinds, which count
once a text, and one threat, until a labelled text shows such threats.

The lexicon and the weights of the kinds are learned from a bounded sample
(``labelled.TRAIN_ROWS``); it holds words and beginnings of words of MIN_STEM to
MAX_STEM letters. Null and empty texts match nothing and have the score of the
bias; without labelled rows of both kinds the lexicon is empty. Repeated rows
are scored alike, each for itself; where labels repeat an id, each label counts;
equally good stems are taken in alphabetical order; an empty table gives an
empty result. Columns other than the id and the text are not read, and may have
any names.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteflow.llm.labelled import TRAIN_ROWS, held_out, labelled_sample
from noteflow.llm.store import written
from noteflow.sources.splits import spread

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)
NOT_INSULT, NOT_THREAT, SAID_INSULT, SAID_THREAT, AT_INSULT, AT_THREAT, OBJECT = range(7, 14)
SYMBOLS = 14
#: A text's insults aimed at no one if no other insult backs them; no symbol of a clause.
LONE = 14
#: Kinds of matches, as the last transducer gives them, and what each is worth before anything is learned.
KINDS = {INSULT: 1.0, NOT_INSULT: 0.4, NOT_THREAT: 0.1, SAID_INSULT: 0.4, SAID_THREAT: 0.1, AT_INSULT: 1.5, AT_THREAT: 2.0, LONE: 0.4}
KIND_ORDER = tuple(KINDS)
#: Weight of a threat verb, before it is scaled by its kind.
THREAT_WEIGHT = 3.0
#: Kinds that count once a text, and the most that each may be worth: of its plain kind, and of what rejects a text.
WEAK = {NOT_INSULT: INSULT, SAID_INSULT: INSULT, NOT_THREAT: AT_THREAT, SAID_THREAT: AT_THREAT}
OF_PLAIN, OF_LIMIT = 0.4, 0.22
#: The most that a lone insult, and a threat while no labelled text shows one, may be worth of what rejects a text.
UNDER = 0.9

# Closed word classes of the four languages of the corpus.
CLASS_WORDS = {
    THREAT: "kill murder hurt destroy beat stab shoot hang strangle töten umbringen verprügeln erschießen tuer frapper égorger matar golpear degollar",
    TARGET: "your yours he his she they their du dein deine ihr euer er tu ton ta tes votre vos leur tú tus",
    # targets that a threat may have for its object
    OBJECT: "you yourself him her them dich dir euch ihn ihm te toi vous lui ti usted ustedes vosotros ellos",
    NEGATION: "not never no isn't aren't wasn't don't won't nobody nicht nie kein keine niemals ne pas jamais nunca jamás tampoco",
    REPORT: "said says wrote writes called calls quoted reported claims claimed sagte schrieb nannte dit écrit appelle dijo escribió llamó",
}
#: How many other words a negation or a target reaches over.
REACH = 3
MIN_STEM, MAX_STEM = 4, 8
MIN_TEXTS, MIN_PURITY = 3, 0.95
#: Chance that any stem of no meaning is taken, by the tail bound; share of its texts that a longer stem must keep.
FALSE_STEMS, KEEPS = 0.25, 0.95
CACHE_WORDS = 200_000
#: Stems that a task counts before it passes the counts on.
COUNTED_STEMS = 500_000

#: Shouts do not end a clause: they are read with what is around them.
CLAUSE_END = re.compile(r"[.?;:\n]")
LETTERS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")


class Transducer:
    """A deterministic letter transducer over the symbols: (state, symbol) to (state, symbol). Symbols without an arc pass unchanged and lead to ``rest[state]``."""

    def __init__(self, rest: list[int], arcs: dict[tuple[int, int], tuple[int, int]]) -> None:
        self.next = np.repeat(np.array(rest)[:, None], SYMBOLS, axis=1)
        self.out = np.tile(np.arange(SYMBOLS), (len(rest), 1))
        for (state, symbol), (to, out) in arcs.items():
            self.next[state, symbol], self.out[state, symbol] = to, out

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this one gives is read by the other; states are pairs of states."""
        n, m = len(self.next), len(other.next)
        both = Transducer([0] * (n * m), {})
        for a in range(n):
            for b in range(m):
                mid = self.out[a]
                both.next[a * m + b] = self.next[a] * m + other.next[b, mid]
                both.out[a * m + b] = other.out[b, mid]
        return both

    def run(self, symbols: list[int]) -> list[int]:
        state, out = 0, []
        for s in symbols:
            out.append(int(self.out[state, s]))
            state = int(self.next[state, s])
        return out


def negation() -> Transducer:
    """Within REACH other words after a negation, insults and threats are negated ones. State: words that the reach has left."""
    rest = [max(0, k - 1) for k in range(REACH + 2)]
    arcs = {}
    for k in range(REACH + 2):
        arcs[k, NEGATION] = (REACH + 1, NEGATION)
        arcs[k, END] = (0, END)
        if k:
            arcs[k, INSULT], arcs[k, THREAT] = (k - 1, NOT_INSULT), (k - 1, NOT_THREAT)
    return Transducer(rest, arcs)


def reported() -> Transducer:
    """From a reporting word to the end of its clause, insults and threats are reported ones."""
    arcs = {(0, REPORT): (1, REPORT), (1, INSULT): (1, SAID_INSULT), (1, THREAT): (1, SAID_THREAT), (1, END): (0, END)}
    return Transducer([0, 1], arcs)


def targeted() -> Transducer:
    """Within REACH other words after a target, an insult is aimed at it. A threat is aimed at an object that follows it at once, or at a target as near before it if its clause ends with it.

    States: words that a target's reach has left, then those behind a threat: with no target before it, with one. A threat is given out where it turns out to be aimed.
    """
    free, aimed = REACH + 2, REACH + 3
    arcs = {}
    for k in range(REACH + 4):
        arcs[k, TARGET], arcs[k, OBJECT], arcs[k, END] = (REACH + 1, TARGET), (REACH + 1, OBJECT), (0, END)
        arcs[k, THREAT] = (free if k in (0, free) else aimed, THREAT)
        if k not in (0, free):
            arcs[k, INSULT] = (REACH + 1, AT_INSULT)
    arcs[free, OBJECT] = arcs[aimed, OBJECT] = (REACH + 1, AT_THREAT)
    arcs[aimed, END] = (0, AT_THREAT)
    return Transducer([max(0, k - 1) for k in range(REACH + 2)] + [0, REACH], arcs)


REPORTED = reported()
IS_WEAK = np.array([k in WEAK for k in KIND_ORDER])


def in_context() -> Transducer:
    """Insults with another word of their clause before them stay; one that begins its clause is given out at the next word; one that is all of it is not."""
    arcs = {(0, INSULT): (2, OTHER), (0, END): (0, END), (1, END): (0, END), (2, END): (0, END)}
    return Transducer([1, 1, 1], arcs | {(2, s): (1, INSULT) for s in (OTHER, THREAT, TARGET, OBJECT, NEGATION, REPORT)})


def matches() -> Transducer:
    """Matched symbols stay, all others become OTHER."""
    return Transducer([0], {(0, s): (0, OTHER) for s in range(SYMBOLS) if s not in KINDS})


def grammar() -> Transducer:
    return negation().then(reported()).then(targeted()).then(in_context()).then(matches())


class Lexicon:
    """The lexical transducer: a word to its class and weight. ``stems`` maps a stem, or a whole word and ``$``, to its weight."""

    def __init__(self, stems: dict[str, float]) -> None:
        self.stems = stems
        self.closed = {w: k for k, words in CLASS_WORDS.items() for w in words.split()}
        self.known: dict[str, tuple[int, float]] = {}
        # finds where an insult or a threat may stand; texts without such a place are done at once
        self.places = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for word in [s.rstrip("$") for s in stems] + CLASS_WORDS[THREAT].split():
            self.places.add_word(word)
        self.places.make_automaton()

    def classify(self, word: str) -> tuple[int, float]:
        """Class and weight of a word in lower case."""
        if word not in self.known:
            if len(self.known) >= CACHE_WORDS:
                self.known = {}
            found = [self.stems[s] for s in stems_of(word) if s in self.stems]
            kind = INSULT if found else self.closed.get(word, OTHER)
            self.known[word] = kind, max(found) if found else THREAT_WEIGHT if kind == THREAT else 0.0
        return self.known[word]


def stems_of(word: str) -> list[str]:
    """What a word may be known by: its beginnings and itself as a whole."""
    return [word[:k] for k in range(MIN_STEM, min(MAX_STEM, len(word)) + 1)] + [f"{word}$"]


def clause_matches(text: str, lexicon: Lexicon, machine: Transducer) -> Iterator[tuple[np.ndarray, int]]:
    """The strongest match of each kind of each clause, and its insults that are neither negated nor reported."""
    small = text.lower()
    places = [end for end, _ in lexicon.places.iter(small)]
    # only the clauses that may hold an insult or a threat run through the machine
    cuts = [0, *(m.end() for m in CLAUSE_END.finditer(small)), len(small)] if places else []
    done = -1
    for place in places:
        if place < done:
            continue
        i = bisect.bisect_right(cuts, place)
        begin, done = cuts[i - 1], cuts[min(i, len(cuts) - 1)]
        clause = [lexicon.classify(w) for w in LETTERS.findall(small, begin, done)]
        if any(kind == INSULT or kind == THREAT for kind, _ in clause):
            best, meant = np.zeros(len(KIND_ORDER)), sum(kind == INSULT for kind, _ in clause)
            kinds = REPORTED.run([k for k, _ in reversed(clause)])[::-1] + [END]
            for symbol, (kind, weight) in zip(machine.run(kinds), [*clause, (END, 0.0)]):
                if symbol in KINDS:
                    if symbol == INSULT != kind:  # given out behind its word, which began the clause
                        weight = clause[0][1]
                    elif symbol == AT_THREAT:
                        weight = THREAT_WEIGHT
                    meant -= symbol in (NOT_INSULT, SAID_INSULT)
                    at = KIND_ORDER.index(symbol)
                    best[at] = max(best[at], weight)
            yield best, meant


def clause_weights(text: str, lexicon: Lexicon, machine: Transducer) -> np.ndarray:
    """Sum over a text's clauses of the strongest match of each kind."""
    return sum((best for best, _ in clause_matches(text, lexicon, machine)), np.zeros(len(KIND_ORDER)))


def text_weights(text: str, lexicon: Lexicon, machine: Transducer) -> np.ndarray:
    """What a text counts with of each kind: an insult aimed at no one needs a second one, weak kinds count once."""
    total, most, meant = np.zeros(len(KIND_ORDER)), np.zeros(len(KIND_ORDER)), 0
    for best, insults in clause_matches(text, lexicon, machine):
        total += best
        most = np.maximum(most, best)
        meant += insults
    if meant < 2:
        plain, lone = KIND_ORDER.index(INSULT), KIND_ORDER.index(LONE)
        total[lone], total[plain] = total[plain], 0.0
    return np.where(IS_WEAK, most, total)


def learned_stems(sample: DataFrame) -> dict[str, float]:
    """Stems whose texts are toxic beyond chance, with their log odds.

    A stem is taken if it stands in enough texts, nearly all of them toxic, and
    the binomial tail bound says that none of all the stems would look so by
    chance. Of stems that begin with each other the shortest is taken, made
    longer as long as it loses hardly any text. Words of under MIN_STEM letters
    are known as whole words only. Copies of a text count once: they are no
    further witnesses.
    """
    sample = sample.dropDuplicates(["text", "y"])

    def counts_of(toxic: Counter, clean: Counter) -> Iterator[pd.DataFrame]:
        stems = list(dict.fromkeys([*toxic, *clean]))
        for i in range(0, len(stems), 50_000):
            some = stems[i : i + 50_000]
            yield pd.DataFrame({"stem": some, "t": [toxic[x] for x in some], "c": [clean[x] for x in some]})

    def stem_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, y in zip(batch["text"], batch["y"]):
                (toxic if y == 1 else clean).update({s for w in set(LETTERS.findall(text.lower())) for s in stems_of(w)})
                if len(toxic) + len(clean) > COUNTED_STEMS:
                    yield from counts_of(toxic, clean)
                    toxic, clean = Counter(), Counter()
        yield from counts_of(toxic, clean)

    size = sample.agg(F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)).first()
    toxic, clean = int(size[0]), int(size[1])
    if not toxic or not clean:
        return {}
    base = toxic / (toxic + clean)
    counts = sample.where("y IN (0, 1)").mapInPandas(stem_counts, "stem string, t long, c long").groupBy("stem").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    counts = written(sample.sparkSession, counts.where(F.col("t") >= MIN_TEXTS), "stems")
    least = float(np.log(max(counts.count(), 1) / FALSE_STEMS))
    share = F.least(F.col("t") / (F.col("t") + F.col("c")), F.lit(1 - 1e-9))
    tail = (F.col("t") + F.col("c")) * (share * F.log(share / base) + (1 - share) * F.log((1 - share) / (1 - base)))
    best = counts.where((share >= MIN_PURITY) & (tail >= least)).toPandas()  # only stems that pass; the sample is bounded
    best["odds"] = np.log((best["t"] + 0.5) / (toxic + 1)) - np.log((best["c"] + 0.5) / (clean + 1))
    known = {stem: (float(weight), int(t)) for stem, weight, t in zip(best["stem"], best["odds"], best["t"])}
    longer: dict[str, list[str]] = {}
    for stem in known:
        longer.setdefault(stem[:-1], []).append(stem)
    roots: set[str] = set()
    for stem in sorted(known, key=lambda x: (len(x), x)):
        if not any(s in roots for s in (stem[:k] for k in range(MIN_STEM, len(stem)))):
            roots.add(stem)
    taken: dict[str, float] = {}
    for stem in roots:
        while further := max((x for x in longer.get(stem, []) if known[x][1] >= KEEPS * known[stem][1]), key=lambda x: (known[x][1], x), default=""):
            stem = further
        taken[stem] = known[stem][0]
    return taken


def fit_kinds(weights: np.ndarray, y: np.ndarray, heaviest: float, strength: float = 1.0, steps: int = 50) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps; kinds that the sample hardly shows stay near their prior worth, weak kinds below their plain ones."""
    prior = np.r_[[KINDS[k] for k in KIND_ORDER], -2.0]
    x = np.c_[weights, np.ones(len(y))]
    w, ridge = prior.copy(), np.r_[np.full(len(KIND_ORDER), strength), 0.01]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        gradient = x.T @ (p - y) + ridge * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), gradient)
        w -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    kinds, bias = np.maximum(w[:-1], 0.0), float(w[-1])
    limit = max(-bias, 0.0)  # what rejects a text
    at = {k: i for i, k in enumerate(KIND_ORDER)}
    if not weights[y == 1, at[AT_THREAT]].any():
        kinds[at[AT_THREAT]] = min(kinds[at[AT_THREAT]], UNDER * limit / THREAT_WEIGHT)
    kinds[at[LONE]] = min(kinds[at[LONE]], UNDER * limit / max(heaviest, THREAT_WEIGHT))
    for kind, plain in WEAK.items():
        kinds[at[kind]] = min(kinds[at[kind]], OF_PLAIN * kinds[at[plain]], OF_LIMIT * limit / max(heaviest, THREAT_WEIGHT))
    return kinds, bias


class Model:
    def __init__(self, stems: dict[str, float], kinds: np.ndarray, bias: float) -> None:
        self.stems, self.kinds, self.bias = stems, kinds, bias


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    sample = written(docs.sparkSession, labelled_sample(docs, labels, label, rows), "sample")
    stems = learned_stems(sample)

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon, machine = Lexicon(stems), grammar()
        for batch in batches:
            yield pd.DataFrame({"y": batch["y"], "x": [text_weights(t, lexicon, machine) for t in batch["text"]]})

    seen = sample.mapInPandas(weigh, "y int, x array<double>").toPandas()  # bounded by rows
    if not len(seen):
        return Model(stems, np.array([KINDS[k] for k in KIND_ORDER]), -2.0)
    kinds, bias = fit_kinds(np.stack(seen["x"].to_numpy()), seen["y"].to_numpy(float), max(stems.values(), default=0.0))
    return Model(stems, kinds, bias)


def score_documents(spark: SparkSession, docs: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """doc_id, score of every whole text; the lexicon is broadcast (stems of the bounded sample that passed the tests)."""
    shared = spark.sparkContext.broadcast((model.stems, model.kinds, model.bias))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stems, kinds, bias = shared.value
        lexicon, machine = Lexicon(stems), grammar()
        for batch in batches:
            total = np.array([text_weights(t, lexicon, machine) @ kinds for t in batch["text"]]) + bias
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": 1 / (1 + np.exp(-np.clip(total, -35, 35)))})

    rows = spread(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(run, "doc_id long, score double")


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score_documents(spark, docs, train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def clean_documents(spark: SparkSession, docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, all columns as they were, in one pass without a shuffle."""
    shared = spark.sparkContext.broadcast((model.stems, model.kinds, model.bias))

    @F.pandas_udf("boolean")
    def toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        stems, kinds, bias = shared.value
        lexicon, machine = Lexicon(stems), grammar()
        least = np.log(threshold / (1 - threshold))
        for texts in batches:
            yield pd.Series([bool(text_weights(t, lexicon, machine) @ kinds + bias >= least) for t in texts], dtype=bool)

    return spread(docs).where(~toxic(F.coalesce("text", F.lit(""))))
