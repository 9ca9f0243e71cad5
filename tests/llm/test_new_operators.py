"""Run detection, NN-descent and the Merkle manifest against brute force, with the usual odd inputs."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from noteflow.llm import manifest, nn_descent, runs

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def clashing(frame):
    names = ["tree", "idx", "size", "digest", "leaf", "path", "node", "near", "sim", "n", "vec", "id", "runs", "key", "tie", "start"]
    return frame.withColumns({n: F.lit("x") for n in names if n not in frame.columns})


# 11: runs


def words_with_runs(rng):
    n, k = rng.randrange(0, 90), rng.choice([1, 2, 2, 3, 4, 30])
    words = [rng.choice("abcdefghijklmnopqrstuvwxyzABCD"[:k]) for _ in range(n)]
    for _ in range(rng.randrange(3) if n else 0):
        a, p, m = rng.randrange(n), rng.randrange(1, 12), rng.randrange(1, 60)
        words[a : a + m] = [words[a + i % p] if a + i % p < len(words) else "z" for i in range(m)]
    return words


def test_runs_against_all_periods():
    rng = random.Random(1)
    for _ in range(400):
        texts = [words_with_runs(rng) for _ in range(rng.randrange(1, 5))]
        assert runs.runs_of(texts, 2, 2) == [runs.brute_force(t, 2, 2) for t in texts]
        assert runs.runs_of(texts) == [runs.brute_force(t) for t in texts]


def test_squares_are_caught_online():
    """After any word the caught runs are those of the words so far, whatever the pieces."""
    rng = random.Random(2)
    for _ in range(120):
        words = words_with_runs(rng)
        catcher, numbers, i = runs.SquareCatcher(len(words)), {}, 0
        while i < len(words):
            m = rng.choice([1, 1, 2, 5, 20])
            catcher.append(np.array([numbers.setdefault(w, len(numbers)) for w in words[i : i + m]]))
            i += m
            assert catcher.found() == runs.brute_force(words[:i], 2, 2)


@pytest.mark.parametrize("words, count", [(["a"] * 70_000, 1), (["a", "b"] * 40_000, 1), ([str(i % 300) for i in range(70_000)], 1), ([str(i) for i in range(70_000)], 0)])
def test_long_texts_in_slices(words, count):
    assert len(runs.runs_of([words])[0]) == count


def test_periodic_runs_rows(spark):
    rng = random.Random(3)
    texts = [None, "", " \n", "a", "x " * 20, "x " * 20, "a b " * 9 + "c", "é é " * 8, "long " * 30_000] + [" ".join(words_with_runs(rng)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "q " * 12), (4, "x " * 20)]
    docs = clashing(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS))
    got = defaultdict(list)
    for r in runs.periodic_runs(docs, change=runs.looped).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(rows)
    for i, t in rows:
        words = runs.WORD.findall(t or "")
        if i is not None and (h := zlib.crc32(str(i).encode())) % 10 == 0 and words:
            g, n = h // 10, len(words)
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [w if j < a else words[a + (j - a) % p] for j, w in enumerate(words)]
        found = [r for r in runs.brute_force(words)] if len(words) < 1000 else [(0, 30_000, 1)]
        gone = {j for s, n, p in found for j in range(s + p, s + n)}
        kept = " ".join(w for j, w in enumerate(words) if j not in gone)
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in found)
        for r in got[i]:
            if i == 4 or got[i][0] is r or len(got[i]) == 1:
                assert (r.n_runs, r.runs_sha256, r.collapsed_sha256) == (len(found), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())
                best = max(found, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
                assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
    assert runs.periodic_runs(docs.limit(0)).count() == 0


# 12: near-duplicate vectors


def cosine_truth(vectors, threshold):
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    link = [set() for _ in vectors]
    for i, a in enumerate(vectors):
        for j, b in enumerate(vectors):
            if i != j and good[i] and good[j] and len(a) == len(b):
                x, y = np.array(a, np.float64), np.array(b, np.float64)
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                    link[i].add(j)
    return link


@pytest.mark.parametrize("block", [512, 7])
def test_near_duplicates_against_all_pairs(spark, block, monkeypatch):
    """Tight and loose groups, copies, scaled copies, chains over the threshold, other lengths, bad vectors, repeated ids."""
    monkeypatch.setattr(nn_descent, "BLOCK", block)
    rng = np.random.default_rng(5)
    vectors = [list(rng.standard_normal(16)) for _ in range(150)]
    for size, noise in ((60, 0.02), (50, 0.3), (30, 0.15)):
        centre = rng.standard_normal(16)
        vectors += [list(centre + noise * rng.standard_normal(16)) for _ in range(size)]
    chain = rng.standard_normal((2, 16))
    vectors += [list(np.cos(t) * chain[0] + np.sin(t) * chain[1]) for t in np.linspace(0, 1.2, 12)]
    vectors += [vectors[3]] * 20 + [[2.0 * x for x in vectors[3]]] + [[0.0] * 16, None, [], [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] * 16, [1.0, 2.0], [2.0, 4.1], [1.0, -2.0]]
    vectors = [None if v is None else [None if x is None else float(np.float32(x)) for x in v] for v in vectors]
    truth = cosine_truth(vectors, 0.9)
    frame = clashing(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>"))
    recalls = []
    got = {r.vec_id: r for r in nn_descent.near_duplicates(spark, frame, room=6, report=recalls.append).collect()}
    assert len(got) == len(vectors) and recalls[-1] >= 0.995
    root = list(range(len(vectors)))
    for _ in vectors:
        root = [min([root[i], *(root[j] for j in truth[i])]) for i in range(len(vectors))]
    for i in range(len(vectors)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(truth[i]), root[i], root[i] == i), i


def test_vector_edge_cases(spark):
    schema = "vec_id long, embedding array<double>"
    assert nn_descent.near_duplicates(spark, spark.createDataFrame([], schema)).count() == 0
    rows = [(7, [1.0, 0.0]), (7, [1.0, 0.0]), (None, [2.0, 0.0]), (3, [0.0, 1.0]), (9, None), (None, None)]
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in nn_descent.near_duplicates(spark, spark.createDataFrame(rows, schema)).collect())
    assert got == [("3", 0, "3", True), ("7", 2, "7", True), ("7", 2, "7", True), ("9", 0, "9", True), ("None", 0, "None", True), ("None", 2, "7", False)]


# 13: Merkle manifest


def test_near_duplicates_of_many_vectors(spark, monkeypatch):
    """More vectors than are looked up on the map side: digests are shuffled, frequent ones settled apart."""
    from noteflow.llm import store

    rng = np.random.default_rng(3)
    vectors = [v.tolist() for v in rng.standard_normal((12, 6))]
    rows = list(enumerate([*vectors, *[vectors[0]] * 9, [x + 0.01 for x in vectors[1]], [0.0] * 6, None]))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    key = lambda r: (r.vec_id, r.n_links, r.component_id, r.kept)
    wanted = sorted(map(key, nn_descent.near_duplicates(spark, frame).collect()))
    monkeypatch.setattr(store, "MAP_SIDE", 3)
    assert sorted(map(key, nn_descent.near_duplicates(spark, frame).collect())) == wanted
    assert wanted[20][:3] == (20, 9, 0) and wanted[21] == (21, 1, 1, False) and wanted[23] == (23, 0, 23, True)


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc, more=0):
    shown = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    doc_id, text, lang, source, n_chars = doc
    return H(shown(doc_id), shown(source), shown(lang), shown(None if n_chars is None else n_chars + more), shown(text))


def levels_of(nodes, fan):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + fan]) for i in range(0, len(out[-1]), fan)])
    return out


def folded(node, i, levels, fan):
    proof = []
    for level in levels[:-1]:
        a = i - i % fan
        run = level[a : a + fan]
        proof += run[: i - a] + run[i - a + 1 :]
        node, i = H(*run[: i - a], node, *run[i - a + 1 :]), i // fan
    return node, proof


def manifest_truth(docs, fan):
    parts = defaultdict(list)
    for d in docs:
        parts[d[2]].append(d)
    trees = {p: sorted(ds, key=lambda d: (d[0] is not None, d[0] or 0, leaf_of(d))) for p, ds in parts.items()}
    order = sorted(trees, key=lambda p: (p is not None, (p or "").encode()))
    levels = {p: levels_of([leaf_of(d) for d in trees[p]], fan) for p in order}
    top = levels_of([levels[p][-1][0] for p in order], fan)
    out = []
    for k, p in enumerate(order):
        for i, d in enumerate(trees[p]):
            hit = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 7 == 0
            inside, proof = folded(leaf_of(d, int(hit)), i, levels[p], fan)
            up, more = folded(inside, k, top, fan)
            out.append((d[0], leaf_of(d), levels[p][-1][0], top[-1][0], H(*proof, *more), up, up == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("n, fan", [(1, 2), (2, 2), (9, 2), (133, 2), (133, 3), (64, 4)])
def test_manifest_against_its_definition(spark, n, fan):
    rng = random.Random(n * fan)
    docs = [(i, rng.choice([None, "", "é text", "long " * 3000, f"t{i}"]), rng.choice(["en", "en", "en", "de", "é", None]), rng.choice(["s", None]), rng.choice([None, i, 5])) for i in range(n)]
    if n > 100:
        docs += docs[3:6] + [(None, "no id", "en", "s", 1), (None, "no id", "en", "s", 1), (12, "other row of an id", "en", "s", 2), (5, "alone", "zz", "s", 2)]
    frame = clashing(spark.createDataFrame(docs, DOCS))
    got = [tuple(r)[:7] for r in manifest.manifest(spark, frame, fan=fan).collect()]
    assert sorted(got, key=str) == manifest_truth(docs, fan)


def test_manifest_of_nothing(spark):
    frame = spark.createDataFrame([], DOCS)
    assert manifest.manifest(spark, frame).count() == 0


# 6: ties between licences


def test_a_full_text_is_its_own_licence():
    from noteflow.llm import licences

    templates = licences.Templates(licences.all_templates())
    for name, texts in licences.all_templates().items():
        full = max(texts, key=len)
        found = licences.sized_matches("words before\n" + full, templates)
        assert min(found, key=lambda n: (-found[n][0], -found[n][1], n)) == name or len(full) < 800
