"""The numbered operators against brute force, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import time
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from noteflow.llm import exact_dedup, jaccard_join, labelled, licences, mixing, pieces, quality, secret_ledger, store, telephony, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", f"s{i % 3}" if i % 5 else None, 1) for i, t in enumerate(texts)], DOCS)


def strip(text):
    return re.sub(r"[\x20\x09-\x0D]+", "", text or "")


def clashing(docs):
    """Extra columns with names that operators use inside."""
    names = ["text_sha256", "size", "key", "cls", "unit", "blob", "path", "payload", "media", "slice", "taken", "row_no", "best", "y"]
    return docs.withColumns({n: F.lit("x") for n in names})


TEXTS = [None, "", " ", "a b", "ab", "a\tb ", "a  b", "long " * 30_000, "x", "x", " ", "😀 é", "a b"]


# 8: exact dedup


def expected_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[strip(t)].append((-len(t or ""), i is None, i or 0, i))
    return {k: (min(g)[3], len(g)) for k, g in groups.items()}


@pytest.mark.parametrize("heavy", [1024, 1])
def test_exact_groups(spark, heavy, monkeypatch):
    monkeypatch.setattr(exact_dedup, "heavy_winners", lambda prints, f=exact_dedup.heavy_winners: f(prints, heavy))
    rows = [(i, t) for i, t in enumerate(TEXTS + ["hot"] * 50 + ["h ot"])] + [(None, "n"), (None, "x")]
    docs = clashing(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS))
    want = expected_groups(rows)
    got = exact_dedup.duplicate_groups(spark, docs).collect()
    assert len(got) == len(rows)
    text_of = dict(rows[:-2])
    for r in got:
        if r.doc_id is not None:
            t = strip(text_of[r.doc_id])
            assert (r.keep_id, r.group_size) == want[t] and r.text_sha256 == hashlib.sha256(t.encode()).hexdigest() and r.kept == (r.doc_id == want[t][0])
    kept = exact_dedup.deduplicate(spark, docs)
    assert kept.columns == docs.columns
    assert sorted((strip(r.text), r.doc_id is None or r.doc_id) for r in kept.collect()) == sorted((k, v[0] is None or v[0]) for k, v in want.items())


def test_repeated_rows_keep_one(spark):
    docs = spark.createDataFrame([(1, "a", "en", "s", 1)] * 5 + [(2, None, None, None, None)], DOCS)
    assert sum(r.kept for r in exact_dedup.duplicate_groups(spark, docs).collect()) == 2
    assert exact_dedup.deduplicate(spark, docs).count() == 2
    assert exact_dedup.duplicate_groups(spark, docs.limit(0)).count() == 0 and exact_dedup.deduplicate(spark, docs.limit(0)).count() == 0


# 3: mixing


def water(sizes):
    """Targets by repeated sharing."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, free, left = dict.fromkeys(names, 0.0), set(names), 1.5 * sum(sizes.values())
    while left > 1e-9 and free:
        total = sum(weight[s] for s in free)
        share = {s: left * weight[s] / total for s in free}
        left = 0.0
        for s in list(free):
            target[s] += share[s]
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                free.discard(s)
    return target


def test_mixing_meets_every_budget(spark):
    rng = random.Random(2)
    rows = [(i, None if i % 41 == 0 else " ".join("w" * rng.randint(1, 5) for _ in range(rng.choice([0, 1, 5, 200]))), "en", rng.choice(["a", "b", "c", "d", "e", "é", None, "a"]), 1) for i in range(600)]
    docs = clashing(spark.createDataFrame(rows, DOCS).repartition(5))
    got = mixing.mix(spark, docs).collect()
    size, taken, target = defaultdict(int), defaultdict(int), {}
    source = {r[0]: r[3] for r in rows}
    for r in got:
        text = next(x[1] for x in rows if x[0] == r.doc_id)
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", text or "")) and 0 <= r.taken <= 2 * r.size
        size[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    for s, t in water(size).items():
        assert abs(target[s] - t) < 1e-6 * max(t, 1) and abs(taken[s] - t) <= 1
    again = mixing.mix(spark, docs.repartition(3)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    out = mixing.mixed_documents(spark, docs)
    words = out.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()
    assert out.columns == docs.columns and {r.source: r.n for r in words} == {s: n for s, n in taken.items() if n}


def test_mixing_of_empty_tables(spark):
    docs = docs_of(spark, [None, "", " "])
    assert [(r.size, r.taken) for r in mixing.mix(spark, docs).collect()] == [(0, 0)] * 3
    repeated = spark.createDataFrame([(1, "a b c", "en", "s", 1)] * 3 + [(None, "d " * 50_000, "en", "t", 1)], DOCS)
    assert sorted(r.taken for r in mixing.mix(spark, repeated).collect())[-1] <= 100_000 and mixing.mix(spark, repeated).count() == 4
    assert mixing.mix(spark, docs.limit(0)).count() == 0 and mixing.mixed_documents(spark, docs).count() == 0


# 1: WARC


def test_warc_round_trip(spark):
    rows = [
        (1, "http://a\r\nb", "é€😀" * 3000), (2, None, None), (3, "u", ""), (4, "u", "x" * 1000), (5, "u", "x" * 1000), (6, "u", "y" * 999), (7, "u", "y" * 999), (None, "u", "x" * 1000),
        (9, "u", "a\r\n\r\nWARC/1.1\r\nContent-Length: 7\r\n\r\nb" * 700), (10, "u", "x" * 1000 + "\n"),
        (None, None, "z" * 9000),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x"))
    folder = store.new_folder(spark, "warc")
    warc.write_archives(pages, folder, segment_bytes=7001)
    chunks = warc.read_chunks(spark, folder, chunk_bytes=1000)
    every = warc.records(chunks).collect()
    assert sorted(r.payload_digest for r in every) == sorted(hashlib.sha1((h or "").encode()).hexdigest() for _, _, h in rows)
    got = {r.page_id: r for r in every if r.payload_bytes != 9000}
    for key, _, html in rows[:-1]:
        data = (html or "").encode()
        assert (got[key].payload_bytes, got[key].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
    assert {k: r.refers_to for k, r in got.items() if r.record_type == "revisit"} == {4: 5, None: 5}
    one = chunks.where("record_id = '<urn:page:1>'").orderBy("chunk_no").collect()
    assert b"".join(bytes(r.data) for r in one) == rows[0][2].encode() and max(len(r.data) for r in one) <= 1000
    assert [r.chunk_no for r in one] == list(range(len(one))) and one[-1].last and all(r.sha1_so_far != one[-1].sha1_so_far for r in one[:-1])


def test_warc_of_very_long_header_lines(tmp_path):
    url = "u" * (3 << 20)
    http = b"HTTP/1.1 200 OK\r\nX: " + b"y" * (2 << 20) + b"\r\nContent-Length: 2\r\n\r\n"
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Target-URI: {url}\r\nContent-Type: application/http\r\nContent-Length: {len(http) + 2}\r\n\r\n"
    path = tmp_path / "a.warc"
    path.write_bytes(head.encode() + http + b"ok\r\n\r\n")
    with open(path, "rb") as stream:
        (row,) = warc.stream_chunks(stream)
    assert (row[2], row[5], row[6], row[8]) == (url, b"ok", 2, 2)


def test_warc_of_no_pages(spark):
    folder = store.new_folder(spark, "warc")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.records(warc.read_chunks(spark, folder)).count() == 0


def test_warc_damage_is_noticed(tmp_path):
    import io

    with pytest.raises(ValueError, match="cut short"):
        list(warc.stream_chunks(io.BytesIO(b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <x>\r\nContent-Length: 9\r\n\r\nabc")))
    with pytest.raises(ValueError, match="not a WARC"):
        list(warc.stream_chunks(io.BytesIO(b"hello\r\n")))


# 4: secrets


def test_ledger_scans_only_what_is_new(spark, monkeypatch):
    texts = [None, "", "token = abcdefghijkl", 'API_KEY: "short"', "AKIA" + "A1" * 8, "password=token=abcdefghijklmnop", "token: password:abcdefghijklm", "deadbeef" * 3, "ſecret=abcdefghijkl", "x " * 50_000 + "0123456789abcdef", "deadbeef" * 3, "Apikey   =   'a.b/c+d=e-f_g'"]
    first = clashing(docs_of(spark, texts[:8])).withColumnRenamed("text", "content")
    ledger = secret_ledger.fresh_ledger(spark)
    got = secret_ledger.scan_versions(spark, first.drop("blob", "path"), ledger, "doc_id", "content").collect()
    for r in got:
        n_assign, n_access, n_hex, _, spans = secret_ledger.brute_force(texts[r.path])
        assert (r.n_assign, r.n_access, r.n_hex, r.spans) == (n_assign, n_access, n_hex, spans)
    before = spark.read.parquet(ledger).count()
    assert before == 7  # null and empty are one blob
    again = secret_ledger.scan_versions(spark, docs_of(spark, texts), ledger, "doc_id", "text").collect()
    assert {r.path: r.spans for r in again} == {i: secret_ledger.brute_force(t)[4] for i, t in enumerate(texts)}
    assert spark.read.parquet(ledger).count() == before + 3
    monkeypatch.setattr(secret_ledger, "RULES_VERSION", 2)  # a new version of the rules sees every blob again
    assert secret_ledger.scan_versions(spark, docs_of(spark, texts).limit(0), ledger, "doc_id", "text").count() == 0


# 5: SentencePiece


@pytest.fixture(scope="module")
def encoder():
    public = pytest.importorskip("public_tokenizers")
    return pieces.Encoder(public.path("piece_bpe_32k.model"))


def test_pieces_equal_the_library(encoder):
    rng = random.Random(1)
    alphabet = list("abcdefghij  ▁\n\t.,0123éß中文한ﬁ😀́") + ["the", "ing", " a", "\x00", "tion", "▁▁", "  ", "   "]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(3000)] + ["".join(rng.choices("etaoinshrl", k=80)) for _ in range(500)]
    texts += ["", " ", "a" * 5000, " " * 333, "ababab" * 300, "x   " + " " * 17 + "y", "word " * 20_000]
    library = encoder.vocabulary.library
    assert [x.tolist() for x in encoder.encode(texts)] == library.encode(texts, num_threads=1)


def test_pieces_cost_little_more_than_the_library(encoder):
    """CPU of the encoder, with nothing remembered, against that of the library on the same texts (2.3 times before pairs were hashed)."""
    rng = random.Random(2)
    parts = ["the", "ing", "tion", "er", "an", "ou", "sch", "eau", "ó", "in", "st", "re", "on", "ble"]
    words = ["".join(rng.choices(parts, k=rng.randint(1, 5))) + rng.choice(["", "", ".", ",", "\n"]) for _ in range(160_000)]
    texts = [" ".join(words[i : i + 400]) for i in range(0, len(words), 400)]
    library = encoder.vocabulary.library

    def cost(work):
        spent = []
        for _ in range(5):
            encoder.forget()
            start = time.process_time()
            work()
            spent.append(time.process_time() - start)
        return min(spent)

    assert cost(lambda: encoder.encode(texts)) < 1.7 * cost(lambda: library.encode(texts, num_threads=1))


def test_places_of_pairs():
    rng = random.Random(4)
    keys = list({(rng.randint(0, 99) << rng.choice([0, 9, 20]), rng.randint(0, 99)) for _ in range(3000)} | {(2**31 - 1, 2**31 - 1), (0, 0)})
    odd = [(a, b + 100) for a, b in keys[:2000] if b < 100] + [(b, a) for a, b in keys]
    left, right = (np.array(x, dtype=np.int32) for x in zip(*(keys + odd)))
    where = {k: i for i, k in enumerate(keys)}
    places = pieces.Places(left[: len(keys)], right[: len(keys)])
    assert [max(x, -1) for x in places.find(left, right).tolist()] == [where.get(k, -1) for k in keys + odd]
    # every key at one and the same slot
    crowded = type("Crowded", (pieces.Places,), {"slots": lambda self, code: np.full(len(code), self.last - 2)})
    places = crowded(left[:50], right[:50])
    assert [max(x, -1) for x in places.find(left[:90], right[:90]).tolist()] == list(range(50)) + [-1] * 40


def test_decimals_of_ids(encoder):
    ids = [np.array(x, dtype=np.int32) for x in ([], [0], [10, 9, 31_999], [], [7])]
    assert list(encoder.vocabulary.decimals(ids)) == [b"", b"0", b"10,9,31999", b"", b"7"]


def test_pieces_when_the_memory_of_words_is_full(encoder, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_WORDS", 3)
    encoder.forget()
    library = encoder.vocabulary.library
    for texts in (["one two three four five"], ["two  one", ""], ["six one"], [""], ["seven eight nine one ten"], ["ten ten two"]):
        assert [x.tolist() for x in encoder.encode(texts)] == library.encode(texts)
        assert len(encoder.known) <= 3 + sum(len(t.split()) + 1 for t in texts)


def test_pieces_of_a_table(spark, encoder, monkeypatch):
    monkeypatch.setattr(pieces, "BATCH_CHARS", 10)
    import public_tokenizers

    rows = pieces.encoded_digests(clashing(docs_of(spark, TEXTS)), public_tokenizers.path("piece_bpe_32k.model")).collect()
    library = encoder.vocabulary.library
    for r in rows:
        ids = library.encode(TEXTS[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert len(rows) == len(TEXTS)


# 7: n-gram Jaccard join


def shingles(text):
    w = (text or "").split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def true_links(texts):
    sets = sorted({shingles(t) for t in texts if shingles(t)}, key=lambda s: sorted(s))
    links = defaultdict(list)
    for i, a in enumerate(sets):
        for b in sets[i + 1 :]:
            if len(a & b) >= 0.8 * len(a | b):
                links[a].append(b)
                links[b].append(a)
    return links


@pytest.mark.parametrize("small", [False, True])
def test_jaccard_join_finds_the_links(spark, small, monkeypatch):
    if small:  # small blocks, several copies of a centre, and the way of large tables
        for name, value in {"RARE": 3, "NODES": 16, "PART": 16, "LATER": 8}.items():
            monkeypatch.setattr(jaccard_join, name, value)
        monkeypatch.setattr(store, "MAP_SIDE", 0)
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(150)]
    texts = []
    for _ in range(90):  # one dense group
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randint(0, 149)] = f"e{rng.randint(0, 9999)}"
        w = w[: rng.choice([120, 150, 150])] + [f"foot{k}" for k in range(10)] * (rng.random() < 0.3)
        texts.append(" ".join(w))
    for _ in range(60):  # a common passage in texts that are otherwise apart
        texts.append(" ".join([f"r{rng.randint(0, 99999)}" for _ in range(100)] + base[:30]))
    for _ in range(30):  # pairs
        w = [f"p{rng.randint(0, 99999)}" for _ in range(120)]
        texts += [" ".join(w), " ".join(w[:-4] + ["z"] * 4)]
    for _ in range(60):  # variants of one text, mostly too far apart, some with variants of their own
        w = list(base[::-1])
        for _ in range(rng.randint(3, 20)):
            w[rng.randint(0, 149)] = f"e{rng.randint(0, 9999)}"
        texts += [" ".join(w), *(" ".join(w[:-2] + [x, x]) for x in "yz"[: rng.randint(0, 2)])]
    texts += [None, "", "a b", "a  b", texts[0], texts[0] + " "]
    docs = clashing(docs_of(spark, texts))
    got = {r.doc_id: r for r in jaccard_join.join_classes(spark, docs).collect()}
    joined = true_links(texts)
    want = {s: len(joined[s]) for s in map(shingles, texts)}
    assert len(got) == len(texts)
    found = {i: got[i].n_links for i in range(len(texts))}
    assert all(found[i] <= want[shingles(t)] for i, t in enumerate(texts))
    assert sum(found.values()) >= 0.99 * sum(want[shingles(t)] for t in texts)
    first = {}  # the smallest row of each set's component
    for i, t in enumerate(texts):
        front = [shingles(t)]
        while front:
            s = front.pop()
            if s not in first:
                first[s] = i
                front += joined[s]
    assert all(got[i].class_id == first[shingles(t)] for i, t in enumerate(texts))
    assert got[len(texts) - 5].class_id == len(texts) - 6 and got[len(texts) - 3].class_id == len(texts) - 4
    if not small:
        again = jaccard_join.join_classes(spark, docs.union(docs)).collect()  # rows repeated in full
        assert len(again) == 2 * len(texts) and all((r.class_id, r.n_links) == (got[r.doc_id].class_id, got[r.doc_id].n_links) for r in again)
    kept = jaccard_join.one_of_each(spark, docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({r.class_id for r in got.values()})


def test_shared_counts_of_long_sets_in_bounded_memory(monkeypatch):
    rng = np.random.default_rng(5)
    pool = rng.integers(-(2**62), 2**62, 40_000)
    sets = [rng.choice(pool, 8192, replace=False) for _ in range(500)] + [pool[:0]]
    tracemalloc.start()
    got = jaccard_join.shared_counts(sets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 128e6  # the sets have 33 MB
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i, j in [(0, 0), (0, 1), (7, 499), (499, 7), (3, 500), (500, 500)])
    short = [s[:50] for s in sets[:20]]
    want = jaccard_join.shared_counts(short)
    monkeypatch.setattr(jaccard_join, "ELEMENTS", 7)
    assert (jaccard_join.shared_counts(short) == want).all() and not jaccard_join.shared_counts([pool[:0]] * 2).any()


def test_jaccard_join_of_empty_tables(spark):
    docs = docs_of(spark, [None, ""])
    assert [(r.class_id, r.n_links) for r in jaccard_join.join_classes(spark, docs).collect()] == [(0, 0), (0, 0)]
    assert jaccard_join.join_classes(spark, docs.limit(0)).count() == 0


def test_runs_follow_from_recall():
    assert jaccard_join.runs_for(0.5, 1) == 1 and jaccard_join.runs_for(0.99, 1) == 5 and jaccard_join.runs_for() == 10


# 9: telephony


def test_telephony_keeps_every_byte(spark):
    stored = lambda docs: telephony.stored_pcm(spark, telephony.stored_media(spark, docs))
    rows = telephony.features(stored(clashing(docs_of(spark, TEXTS)))).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        data = (TEXTS[r.doc_id] or "").encode()
        full = telephony.padded(data)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
        assert len(full) % 192 == 0 and len(full) > 0
        codec = ("mulaw", "alaw", "ima_adpcm")[zlib.crc32(full) % 3]
        assert r.feature.startswith(f"{codec};rate=2000;samples=")
    assert telephony.features(stored(docs_of(spark, TEXTS).limit(0))).count() == 0
    repeated = telephony.features(stored(spark.createDataFrame([(1, "ab")] * 3 + [(None, None)], "doc_id long, text string"))).collect()
    assert len(repeated) == 4 and len({str(r) for r in repeated}) == 2
    pcm = telephony.to_pcm(telephony.stored_media(spark, docs_of(spark, TEXTS)), 11025).collect()
    assert {r.rate for r in pcm} == {11025} and all(len(r.pcm) % 2 == 0 for r in pcm)


def test_telephony_tables():
    mu, a = telephony.mulaw_table(), telephony.alaw_table()
    assert (mu[0], mu[0x7F], mu[0x80], mu[0xFF]) == (-32124, 0, 32124, 0)
    assert (a[0x55], a[0xD5], a[0x2A], a[0xAA]) == (-8, 8, -32256, 32256)
    assert len(set(a.tolist())) == 256 and sorted(mu[:128].tolist()) == mu[:128].tolist()


def test_adpcm_equals_one_sample_at_a_time():
    rng = np.random.default_rng(4)
    blocks = rng.integers(0, 256, (7, telephony.BLOCK), dtype=np.uint8)
    for block, got in zip(blocks, telephony.decode_adpcm(blocks)):
        value, index = int(np.frombuffer(block[:2].tobytes(), "<i2")[0]), min(int(block[2]), 88)
        want = [value]
        for byte in block[4:].tolist():
            for code in (byte & 15, byte >> 4):
                step = int(telephony.STEPS[index])
                change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - change if code & 8 else value + change))
                index = max(0, min(88, index + int(telephony.INDEX_CHANGE[code & 7])))
                want.append(value)
        assert got.tolist() == want


def test_resampling():
    x = np.array([0, 100, -101, 7], np.int16)
    assert telephony.resample(x, 8000, 16000).tolist() == [0, 50, 100, -1, -101, -47, 7, 7]
    assert telephony.resample(x, 8000, 8000) is x and len(telephony.resample(x, 8000, 6000)) == 3
    assert telephony.resample(x, 8000, 4000).tolist() == [50, -47] and telephony.resample(x[:3], 8000, 4000).tolist() == [50, -101]


def test_stored_sound_equals_plain_decoding(spark):
    """Media and features against tables and a decoder written anew, sample by sample."""
    texts = ["x" * 500, "long text " * 60, "éà" * 300, "", "abc", "def"]

    def mulaw(code):
        code = ~code & 255
        size = (((code & 15) * 8 + 132) << (code >> 4 & 7)) - 132
        return -size if code & 128 else size

    def alaw(code):
        code ^= 85
        size = (code & 15) * 16 + 8
        if code >> 4 & 7:
            size = (size + 256) << ((code >> 4 & 7) - 1)
        return size if code & 128 else -size

    for r in telephony.features(telephony.stored_pcm(spark, telephony.stored_media(spark, docs_of(spark, texts)))).collect():
        full = telephony.padded(texts[r.doc_id].encode())
        kind = zlib.crc32(full) % 3
        rate = {0: 8000, 1: 8000, 2: 8000 * 192 // 377}[kind]
        head = {0: (7, 1, 8), 1: (6, 1, 8), 2: (17, 192, 4)}[kind]
        form = head[0].to_bytes(2, "little") + b"\1\0" + (8000).to_bytes(4, "little") + rate.to_bytes(4, "little") + head[1].to_bytes(2, "little") + head[2].to_bytes(2, "little")
        form += b"\2\0" + (377).to_bytes(2, "little") if kind == 2 else b"\0\0"
        samples = len(full) // 192 * 377 if kind == 2 else len(full)
        body = b"WAVEfmt " + len(form).to_bytes(4, "little") + form + b"fact\4\0\0\0" + samples.to_bytes(4, "little") + b"data" + len(full).to_bytes(4, "little") + full
        media = b"RIFF" + len(body).to_bytes(4, "little") + body
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        if kind < 2:
            wide = [(mulaw, alaw)[kind](c) for c in full]
            part = [sum(wide[i : i + 4]) // 4 for i in range(0, len(wide), 4)]
            rms = int((sum(x * x for x in part) // len(part)) ** 0.5)
            turns = sum((a < 0) != (b < 0) for a, b in zip(part, part[1:]))
            check = zlib.crc32(b"".join(x.to_bytes(2, "little", signed=True) for x in part))
            assert r.feature == f"{('mulaw', 'alaw')[kind]};rate=2000;samples={len(part)};rms={rms};peak={max(map(abs, part))};turns={turns};pcm={check:08x}"


# 6: licences


def test_licences_equal_brute_force(spark):
    notice = licences.NOTICES["MIT"][0]
    texts = [None, "", notice, f"Intro line\n{notice.upper()}\nmore", "Some words. " + notice + " Other words.", " ".join(f"{w}!!" for w in notice.split()), "Released under the MIT", "\n\n".join(x for v in licences.NOTICES.values() for x in v), "of the " * 20_000]
    rows = licences.scan(clashing(docs_of(spark, texts))).collect()
    templates = licences.Templates(licences.NOTICES)
    for r in rows:
        best = {}
        for unit in licences.units(texts[r.doc_id] or ""):
            a = licences.bigrams(unit)
            for name, b in templates.all:
                dice = 2 * len(a & b) / (len(a) + len(b))
                if dice >= licences.LEAST:
                    best[name] = max(dice, best.get(name, 0))
        assert r.licences == ",".join(f"{k}:{v:.4f}" for k, v in sorted(best.items())) and r.n_licences == len(best)
    assert {r.doc_id: r.licence for r in rows if r.doc_id in (2, 3, 4, 5)} == dict.fromkeys((2, 3, 4, 5), "MIT")


def window_dice(text, template):
    """Every run of words, by definition."""
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    pairs = lambda w: list(zip(w, w[1:]))
    a, b = pairs(words(text)), set(pairs(words(template)))
    best = 0.0
    for i in range(len(a)):
        seen = set()
        for p in a[i:]:
            seen.add(p)
            best = max(best, 2 * len(seen & b) / (len(seen) + len(b)))
    return best


def test_licences_in_any_window(spark):
    inline = "Our tool is old. " + licences.NOTICES["Apache-2.0"][1] + " It came from a friend of ours."
    words = licences.NOTICES["GPL-3.0"][1].split()
    wrapped = "About it:\n" + "\n".join(" ".join(words[i : i + 12]) for i in range(0, len(words), 12)) + "\nand so on"
    rng = random.Random(6)
    pool = [w for v in licences.NOTICES.values() for t in v[:1] for w in t.split()]
    mixed = [" ".join(rng.choices(pool, k=60)) for _ in range(8)] + ["under the MIT under the " * 30 + "License", "MIT License. Licensed under the MIT", "a b " * 40 + "Licensed under the MIT\n\nLicense. " + "the MIT " * 40]
    texts = [inline, wrapped, *mixed]
    for r in licences.scan(docs_of(spark, texts), notices=licences.NOTICES).collect():
        best = {name: max(window_dice(texts[r.doc_id], t) for t in v) for name, v in licences.NOTICES.items()}
        assert r.licences == ",".join(f"{k}:{v:.4f}" for k, v in sorted(best.items()) if v >= licences.LEAST)
        assert r.doc_id > 1 or (r.licence, r.dice) == (("Apache-2.0", "GPL-3.0")[r.doc_id], 1.0)


def test_full_licence_texts(spark):
    """A full text inside a longer one, its lines joined, is found under its name."""
    full = {name: " ".join(licences.all_templates()[name][-1 if name != "MIT" else -2].split()) for name in licences.FULL_TEXTS}
    assert {"MIT", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "AGPL-3.0", "MPL-2.0"} <= set(full)
    names = sorted(full)
    rows = licences.scan(docs_of(spark, [f"Before it {full[n]} and after it." for n in names])).collect()
    # the text of BSD-3-Clause holds the notice of BSD-2-Clause as well
    assert all(r.dice == 1.0 and f"{names[r.doc_id]}:1.0000" in r.licences.split(",") for r in rows)
    assert all(r.licence == names[r.doc_id] for r in rows if names[r.doc_id] != "BSD-3-Clause")


# 2 and 10: classifiers


def sample_tables(spark, n=500):
    rng = random.Random(6)
    words = ["".join(rng.choices("bdfgklmnprst", k=2)) + rng.choice(["a", "e", "o"]) + rng.choice("nrst") for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        w = rng.choices(words, k=60)
        good, toxic = i % 4 != 0, i % 5 == 0
        if toxic:
            for _ in range(3):
                w[rng.randint(0, 59)] = rng.choice(["zorkish", "zorked", "blarg"])
        text = " ".join(w) if good else " ".join(x.upper() for x in w) + "!!"
        docs.append((i, text, "en", "s", 1))
        labels.append((i, int(good), int(toxic)))
    docs += [(n, None, None, None, None), (n + 1, "", "en", "s", 0), (None, "x", "en", "s", 1)]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels + [(n, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module, column", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_on_held_out_rows(spark, module, column):
    docs, labels = sample_tables(spark)
    got = module.classify(spark, clashing(docs), labels).collect()
    assert len(got) == 503 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    truth = {r.doc_id: r[column] for r in labels.collect()}
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(502) if zlib.crc32(str(i).encode()) % 5 == 0}
    judged = [r.predicted == truth[r.doc_id] for r in held if r.doc_id < 500]
    assert sum(judged) / len(judged) >= 0.97
    assert module.classify(spark, docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_without_labels(spark, module):
    docs, labels = sample_tables(spark, 20)
    got = module.classify(spark, docs, labels.limit(0)).collect()
    assert len(got) == 23 and len({r.score for r in got}) == 1


def test_learner_equals_plain_ftrl():
    rng = np.random.default_rng(0)
    learner, z, n, w = quality.Learner(), defaultdict(float), defaultdict(float), {}
    for _ in range(200):
        at = np.unique(rng.integers(0, 50, 5))
        x, y = rng.random(len(at)), int(rng.integers(0, 2))
        for i in at.tolist():
            w[i] = 0.0 if abs(z[i]) <= quality.L1 else (np.sign(z[i]) * quality.L1 - z[i]) / ((quality.BETA + n[i] ** 0.5) / quality.ALPHA + quality.L2)
        p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in zip(at.tolist(), x))))
        for i, v in zip(at.tolist(), x):
            g = (p - y) * v
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / quality.ALPHA * w[i]
            n[i] += g * g
        learner.update(at, x, y)
    assert np.allclose([learner.z[i] for i in z], list(z.values()))


def test_toxic_grammar_weighs_clauses():
    lexicon, machine = toxicity.Lexicon({"zork": 4.0, "blarg$": 5.0}), toxicity.grammar()
    kinds = lambda text: {k: w for k, w in zip(toxicity.KIND_ORDER, toxicity.clause_weights(text, lexicon, machine)) if w}
    assert kinds("what a Zorkish, thing") == {toxicity.INSULT: 4.0}
    assert kinds("you are a blarg") == {toxicity.AT_INSULT: 5.0}
    assert kinds("they are not a blarg. blargs") == {toxicity.NOT_INSULT: 5.0}
    assert kinds("Blarg! blarg!!") == {toxicity.INSULT: 5.0}
    assert kinds("it is not. a blarg") == {toxicity.INSULT: 5.0}
    assert kinds("she said that one is a zork") == {toxicity.SAID_INSULT: 4.0}
    assert kinds("I kill you") == {toxicity.AT_THREAT: 3.0} and kinds("you I kill") == {toxicity.AT_THREAT: 3.0}
    assert kinds("Zork. Blarg: kill them all. time to kill") == {toxicity.AT_THREAT: 3.0}  # no word counts alone
    assert kinds("blarg that zork is") == {toxicity.INSULT: 5.0} and kinds("a zork and a zork. a zork") == {toxicity.INSULT: 8.0}
    assert kinds("nothing here") == {} and kinds("") == {}


def test_toxic_texts_by_what_their_clauses_say():
    lexicon, machine = toxicity.Lexicon({"zork": 4.0, "blarg$": 5.0}), toxicity.grammar()
    kinds = lambda text: {k: w for k, w in zip(toxicity.KIND_ORDER, toxicity.text_weights(text, lexicon, machine)) if w}
    assert kinds("the next blarg word") == {toxicity.LONE: 5.0} and kinds("blarg") == {}
    assert kinds("the blarg word. a zork too") == {toxicity.INSULT: 9.0} and kinds("so zork and blarg") == {toxicity.INSULT: 5.0}
    assert kinds("the blarg word. not a zork. no blarg") == {toxicity.LONE: 5.0, toxicity.NOT_INSULT: 5.0}
    assert kinds("that zork, they said. he says a blarg") == {toxicity.SAID_INSULT: 5.0}
    assert kinds("The film beat expectations, they said.") == {toxicity.SAID_THREAT: 3.0}
    assert kinds("You should kill the process and restart.") == {} and kinds("they beat your record") == {}
    assert kinds("we kill them") == kinds("ich werde dich töten") == {toxicity.AT_THREAT: 3.0}


def test_weak_kinds_reject_no_text():
    rng = np.random.default_rng(1)
    y = (np.arange(400) % 4 == 0).astype(float)
    at = {k: i for i, k in enumerate(toxicity.KIND_ORDER)}
    x = np.zeros((400, len(at)))
    x[y == 1, at[toxicity.INSULT]] = 6.0
    for kind in (toxicity.NOT_INSULT, toxicity.SAID_INSULT, toxicity.LONE):  # labels that call for more
        x[(y == 1) & (rng.random(400) < 0.5), at[kind]] = 6.0
    kinds, bias = toxicity.fit_kinds(x, y, 6.0)
    worth = dict(zip(toxicity.KIND_ORDER, kinds))
    assert worth[toxicity.INSULT] * 6 + bias > 0
    assert worth[toxicity.LONE] * 6 + bias < 0 and worth[toxicity.AT_THREAT] * toxicity.THREAT_WEIGHT + bias < 0
    weak = [worth[k] for k in toxicity.WEAK]
    assert sum(w * 6 for w in weak) + bias < 0
    assert all(worth[k] < worth[plain] for k, plain in toxicity.WEAK.items())


def test_composition_equals_running_in_turn():
    rng = random.Random(9)
    parts = [toxicity.negation(), toxicity.reported(), toxicity.targeted(), toxicity.in_context(), toxicity.matches()]
    for _ in range(200):
        symbols = [rng.randint(0, 6) for _ in range(30)]
        out = symbols
        for p in parts:
            out = p.run(out)
        assert toxicity.grammar().run(symbols) == out


def test_clean_documents_keep_columns(spark):
    docs, labels = sample_tables(spark)
    model = toxicity.train(docs, labels)
    kept = toxicity.clean_documents(spark, clashing(docs), model)
    assert kept.columns == clashing(docs).columns
    scores = {r.doc_id: r.score for r in toxicity.score_documents(spark, docs, model).collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, s in scores.items() if s < 0.5}


def test_sample_is_bounded(spark):
    docs, labels = sample_tables(spark)
    assert labelled.labelled_sample(docs, labels, "toxic", 50).count() == 50


def test_words_without_end_count_whole():
    table = labelled.WordTable(quality.describe, 2)
    a, b = (quality.features(["中" * 5000 + x * 5000], table)[0] for x in ("国", "aZ9!"))
    assert len(a) > 300 and len(set(b.tolist()) - set(a.tolist())) > 2
    assert quality.shape("a" * 70 + "9") != quality.shape("a" * 70 + "!")


def test_working_columns_of_the_stages_may_clash(spark):
    names = ["digest", "points", "heavy_neg", "heavy_id", "rank", "own_key", "mix_key", "mix_id", "mix_size", "mix_taken", "mix_left", "gone_id", "gone_key"]
    docs = docs_of(spark, ["a b c d e f g"] * 3 + ["x y", None]).withColumns({n: F.concat(F.lit(n), F.col("doc_id")) for n in names})
    for stage in (exact_dedup.deduplicate, mixing.mixed_documents, jaccard_join.one_of_each):
        out = stage(spark, docs)
        assert out.columns == docs.columns and all(r[n] == f"{n}{r.doc_id}" for r in out.collect() for n in names)


def test_feature_batches_do_not_mix_texts():
    table = labelled.WordTable(quality.describe, 2)
    texts = ["a b a", "", "c", "a b a"]
    flat, sizes = quality.features(texts, table)
    alone = [np.sort(quality.features([t], table)[0]) for t in texts]
    parts = np.split(flat, np.cumsum(sizes)[:-1])
    assert all(np.array_equal(np.sort(p), q) for p, q in zip(parts, alone))


def test_rare_and_short_insults_are_learned(spark):
    """More neutral stems, each in more toxic texts than the insults are, and an insult of three letters."""
    rng = random.Random(8)
    block = " ".join("".join(rng.choices("abcdefghijklmnop", k=9)) for _ in range(5000))
    rows = [(f"{block} {i} {'grumvel' if i < 10 else ''} {'zyx' if i % 3 == 0 else ''}", 1) for i in range(40)]
    rows += [(f"{block} {i}", 0) for i in range(40)] + [(f"some calm words of no harm {i}", 0) for i in range(720)]
    rows += [("a copied text of toxic kind", 1)] * 50
    stems = toxicity.learned_stems(spark.createDataFrame(rows, "text string, y int").repartition(4))
    assert set(stems) == {"grumvel$", "zyx$"}
