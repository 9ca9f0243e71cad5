from __future__ import annotations

import random
import re

import pytest

from noteflow.functions import notes as N

HEAD = "---\ntitle: T\ntype: rule\nproject: p\ndomain: d\nstatus: current\npriority: low\nvisibility: public\ntags:\n  - a\n  - 'b c'\nvectorize: true\ncreated: 2024-01-01\nupdated: 2024-01-02\n---\n"


def test_fields():
    lines, body = N.split_note(HEAD + "x")
    fields = N.checked_fields(N.parse_fields(lines))
    assert body == "x" and fields["tags"] == ["a", "b c"] and fields["vectorize"] is True and list(fields) == list(N.FIELDS)


@pytest.mark.parametrize(
    "note, error",
    [
        ("x", "required"), ("---\na: b\n", "closing"), ("---\n  a: b\n---\n", "nested"), ("---\na\n---\n", "key: value"), ("---\n: b\n---\n", "empty"), ("---\n---\n", "missing required"),
        (HEAD.replace("type: rule", "type: poem"), "type has an unsupported"), (HEAD.replace("vectorize: true", "vectorize: yes"), "vectorize must be a boolean"), (HEAD.replace("2024-01-02", "2 Jan"), "updated must use"),
    ],
)
def test_errors(note, error):
    with pytest.raises(N.NoteError, match=re.escape(error)):
        N.checked_fields(N.parse_fields(N.split_note(note)[0]))


def test_last_duplicate_key_wins():
    assert N.parse_fields(["a: 1", "a: [x, 'y']", "b:", "# c", "c: []"]) == {"a": ["x", "y"], "b": "", "c": []}


def test_heading_paths_and_fences():
    body = "intro\n# A\na\n### B ##\nb\n```\n# no\n~~~\n```\n## C\nc\n###### D\nd"
    assert [p for p, _ in N.sections(body)] == [(), ("A",), ("A", "B"), ("A", "C"), ("A", "C", "D")]


def test_short_sections_merge():
    body = "# A\n" + "x " * 10 + "\n## B\n" + "y " * 200 + "\n# C\nz"
    chunks = N.chunks_of(body)
    assert len(chunks) == 1 and chunks[0][0] == ("A",) and chunks[0][1].endswith("z")


def test_cap_and_overlap():
    paragraphs = [" ".join(f"w{i}_{j}" for j in range(60)) for i in range(40)]
    chunks = N.chunks_of("# A\n" + "\n\n".join(paragraphs), 150, 400, 100)
    assert all(N.tokens(t) <= 500 for _, t in chunks) and len(chunks) > 5
    assert chunks[1][1].startswith(" ".join(f"w{5}_{j}" for j in range(20, 60))) or chunks[1][1].split("\n\n")[0] in chunks[0][1]


def test_one_long_line():
    chunks = N.chunks_of("word " * 4000, 150, 1200, 0)
    assert [N.tokens(t) for _, t in chunks] == [1200, 1200, 1200, 400]


def test_random_bodies_are_covered():
    rng = random.Random(7)
    for _ in range(200):
        body = "".join(rng.choice(["w ", "wörd ", "\n", "\n\n", "# h\n", "## k\n", "!? ", "```\n"]) for _ in range(rng.randint(0, 400)))
        chunks = N.chunks_of(body, 20, 50, 0)
        assert "".join("".join(t for _, t in chunks).split()) == "".join(body.split())
        # a merged section is cut only above the cap
        assert all(N.tokens(t) <= 50 for _, t in chunks)


def test_long_lines_take_linear_time():
    import time

    began = time.perf_counter()
    chunks = N.chunks_of("word " * 200_000, 150, 1200, 0)
    assert [N.tokens(t) for _, t in chunks] == [1200] * 166 + [800] and time.perf_counter() - began < 5


def test_parts_against_their_definition():
    """Every chunk fits, all tokens come in their order, and a chunk begins with no more than the overlap of the one before."""
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(" ".join(f"w{rng.random()}{rng.choice(['', ',', ' (é)'])}" for _ in range(rng.choice([1, 3, 10, 40]))) + rng.choice(["\n", "\n\n", "\n \n"]) for _ in range(rng.randrange(1, 9))).strip()
        most, overlap = rng.choice([3, 8, 20]), rng.choice([0, 2, 7])
        chunks = N.cut(text, most, overlap)
        if N.tokens(text) <= most:
            assert chunks == [text]
            continue
        assert all(N.tokens(c) <= most + overlap for c in chunks)
        whole = N.TOKEN.findall(text)
        at = 0
        for c in chunks:
            found = N.TOKEN.findall(c)
            back = next(k for k in range(min(overlap, at) + 1) if whole[at - k : at - k + len(found)] == found)
            at += len(found) - back
        assert at == len(whole)
