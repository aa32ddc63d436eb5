import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewheel.llm import spans as S

LEAST = 24


def brute(texts, least=LEAST):
    """Pairs that share `least` characters, and the covered characters of each text."""
    grams = {}
    for d, t in texts.items():
        for i in range(len(t) - least + 1):
            grams.setdefault(t[i : i + least], set()).add(d)
    pairs, covered = set(), {}
    for d, t in texts.items():
        mark = np.zeros(len(t), bool)
        for i in range(len(t) - least + 1):
            others = grams[t[i : i + least]] - {d}
            pairs |= {(min(d, o), max(d, o)) for o in others}
            if others:
                mark[i : i + least] = True
        covered[d] = int(mark.sum())
    return pairs, covered


def some_texts(seed, n=30, letters="abcde "):
    rng = np.random.default_rng(seed)
    say = lambda k: "".join(rng.choice(list(letters), k))
    texts = {i: say(int(rng.integers(0, 160))) for i in range(n)}
    for _ in range(n):
        a, b = rng.integers(0, n, 2)
        k = int(rng.integers(LEAST - 3, 60))
        at = int(rng.integers(0, max(len(texts[a]) - k, 1)))
        cut = int(rng.integers(0, len(texts[b]) + 1))
        texts[b] = texts[b][:cut] + texts[a][at : at + k] + texts[b][cut:]
    return texts


@settings(max_examples=60, deadline=None)
@given(st.text("ab", max_size=120), st.text("ab", max_size=120))
def test_two_texts(a, b):
    """Maximal spans of periodic and plain texts, found as a table of all alignments has them."""
    want = set()
    for i in range(len(a)):
        for j in range(len(b)):
            if a[i] == b[j] and (not i or not j or a[i - 1] != b[j - 1]):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                    k += 1
                if k >= LEAST:
                    want.add((i, j, k))
    got = set(S.Reference([(0, a)], LEAST).spans([(0, b)]))
    assert got <= want
    cover = lambda spans: {p for _, j, k in spans for p in range(j, j + k)}
    assert cover(got) == cover(want)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from(["ab", "abcdefgh é😀"]))
def test_anchors_meet(seed, letters):
    """Texts that share a span have an anchor in common."""
    texts = some_texts(seed, 8, letters)
    doc, at, h = S.anchors_of(list(texts.values()), LEAST)
    own = [set(h[doc == i].tolist()) for i in texts]
    for a, b in brute(texts)[0]:
        assert own[a] & own[b]
    again = [S.anchors_of([t], LEAST) for t in texts.values()]
    assert own == [set(x[2].tolist()) for x in again]


@pytest.mark.parametrize("letters", ["abcde ", "a", "ab\n"])
def test_pairs_and_coverage(spark, letters):
    texts = some_texts(5, 24, letters)
    texts |= {100: texts[3], 101: texts[3], 102: "short", 103: "", 104: "x" * 40 + texts[7] + "y" * 40}
    rows = [(i, t, "clash") for i, t in texts.items()] + [(105, None, "clash"), (None, texts[3], "clash"), (100, texts[3], "clash")]
    df = spark.createDataFrame(rows, "doc_id long, text string, hash string")
    pairs, covered = brute(texts)
    spans, members = S.shared_spans(df, "doc_id", "text", LEAST)
    got = S.document_pairs(spans, members).collect()
    assert {(r.doc_id_a, r.doc_id_b) for r in got} == pairs and len(got) == len(pairs)
    cov = {r.doc_id: (r.n_chars, r.shared_chars) for r in S.coverage(df, "doc_id", "text", LEAST).collect()}
    assert cov == {**{i: (len(t), covered[i]) for i, t in texts.items()}, 105: (0, 0)}


def test_many_copies(spark):
    """All pairs where they are asked for, whatever the number of copies; as classes, each copy with its representative."""
    text = "the same long text for everyone, "
    df = spark.createDataFrame([(i, text) for i in range(80)] + [(200, text + "and a little more")], "doc_id long, text string")
    found = S.shared_spans(df, "doc_id", "text", LEAST, one=True)
    pairs = lambda d: {(r.doc_id_a, r.doc_id_b) for r in d.collect()}
    assert pairs(S.document_pairs(*found)) == {(i, j) for i in range(80) for j in [*range(i + 1, 80), 200]}
    assert pairs(S.document_pairs(*found, copies="classes")) == {(0, i) for i in [*range(1, 80), 200]}
    assert {tuple(r) for r in S.classes(*found).collect()} == {(i, 0, 80, 1) for i in range(80)} | {(200, 200, 1, 1)}


def test_boilerplate_in_many_texts(spark, monkeypatch):
    """A span of very many texts: pairs are dealt out in blocks, and coverage matches each text with a few others only."""
    monkeypatch.setattr(S, "PARTNERS", 4)
    rng = np.random.default_rng(3)
    say = lambda k: "".join(rng.choice(list("abcdefghij "), k))
    core = say(40)
    texts = {i: say(30) + core + say(30) for i in range(60)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    spans, members = S.shared_spans(df, "doc_id", "text", LEAST)
    assert {(r.doc_id_a, r.doc_id_b) for r in S.document_pairs(spans, members).collect()} == brute(texts)[0]
    assert {r.doc_id: r.shared_chars for r in S.coverage(df, "doc_id", "text", LEAST).collect()} == brute(texts)[1]


def test_pieces_of_long_texts(monkeypatch):
    monkeypatch.setattr(S, "PIECE", 100)
    text = some_texts(1, 1, "abcdef")[0] * 9
    whole = S.anchors_of([text, "z" * 30, text[5:]], LEAST)
    monkeypatch.undo()
    assert all((a == b).all() for a, b in zip(whole, S.anchors_of([text, "z" * 30, text[5:]], LEAST)))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.document_pairs(*S.shared_spans(df, "doc_id", "text")).count() == 0
    assert S.coverage(df, "doc_id", "text").count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_blocks_of_repeating_texts(seed):
    """By blocks, a stretch that stands several times in the reference counts wherever its ends agree most."""
    rng = np.random.default_rng(seed)
    say = lambda k: "".join(rng.choice(list("abcdefghijklmnop "), k))
    core, left, right = say(int(rng.integers(215, 240))), say(40), say(40)
    copies = [(int(rng.integers(0, 20)), int(rng.integers(0, 20))) for _ in range(8)]
    text = " ".join(say(9) + left[len(left) - x :] + core + right[:y] + say(9) for x, y in copies)
    other = say(100) + left + core + right + say(100) + (core + right[:6]) * 2
    for mine, theirs in ((text, other), (other, text)):
        reference = S.Reference([(0, mine)])
        got = reference.spans([(0, theirs)])
        assert list(reference.forms) == [False]
        assert all(mine[a : a + n] == theirs[b : b + n] and n >= 240 for a, b, n in got)
        grams = {mine[i : i + 240] for i in range(len(mine) - 239)}
        want = {p for i in range(len(theirs) - 239) if theirs[i : i + 240] in grams for p in range(i, i + 240)}
        assert {p for _, b, n in got for p in range(b, b + n)} == want


@pytest.mark.parametrize("letters", ["a", "abcdefghijklmnop "])
def test_breaks_never_match(letters):
    """Pieces that agree on both sides of a break share two short stretches, not one long one."""
    rng = np.random.default_rng(1)
    first, second = ("".join(rng.choice(list(letters), 150)) for _ in range(2))
    reference = S.Reference([(0, "1" * 20 + first), (900, second + "2" * 20)])
    assert reference.spans([(0, "3" * 20 + first), (700, second + "4" * 20)]) == []
