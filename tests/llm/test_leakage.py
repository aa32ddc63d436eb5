import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewheel.llm import leakage as L


def test_words():
    assert L.words_of("Ｆｕｌｌ wi­dth_A-1 É́ İx") == ["full", "width", "a", "1", "é", "i", "x"]
    assert L.words_of(None) == L.words_of("  ") == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-1, 3), max_size=60))
def test_gate_keeps_every_run(ids):
    """Every run of 12 known words lies in a passage that is kept."""
    r = L.Retrieval()
    a = np.array(ids, np.int64)
    starts = L.passage_starts(a, r)
    for i in range(len(a) - 11):
        if (a[i : i + 12] >= 0).all():
            assert any(s <= i and i + 12 <= s + r.window for s in starts)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000))
def test_runs_and_subsequences(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-2, 3, (1, 10)), rng.integers(-2, 3, (1, 10))
    x, y, best = a[0], b[0], 0
    table = np.zeros((11, 11), int)
    for i in range(10):
        for j in range(10):
            k = 0
            while i + k < 10 and j + k < 10 and x[i + k] == y[j + k] >= 0:
                k += 1
            best = max(best, k)
            table[i + 1, j + 1] = table[i, j] + 1 if x[i] == y[j] >= 0 else max(table[i, j + 1], table[i + 1, j])
    assert (int(L.common_run(a, b)[0]), int(L.common_subsequence(a, b)[0])) == (best, table[10, 10])


def tables(spark, seed=0):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, say(30), 9) for i in range(40)] + [(100, say(5), 9), (101, None, 9), (102, "", 9), (None, say(20), 9), (0, None, 9)]
    docs = []
    for d in range(150):
        text = say(80).split()
        if d % 3 == 0:
            w = items[int(rng.integers(40))][1].split()
            n = int(rng.integers(8, 20))
            s = int(rng.integers(0, 30 - n))
            at = int(rng.integers(80))
            text[at:at] = w[s : s + n]
        docs.append((d, (", " if d % 2 else " ").join(text).upper() if d % 5 else " ".join(text), "x"))
    docs += [(500, None, "x"), (501, "", "x"), (None, items[0][1], "x"), (502, items[1][1] + " " + "long " * 50_000, "x"), (0, docs[0][1], "x")]
    return spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string, cosine int"), docs, items


def test_found(spark):
    d, i, docs, items = tables(spark)
    want = set()
    for item, t, _ in items:
        w = L.words_of(t)
        runs = {tuple(w[k : k + 12]) for k in range(len(w) - 11)}
        for doc, text, _ in docs:
            x = L.words_of(text)
            if item is not None and doc is not None and any(tuple(x[k : k + 12]) in runs for k in range(len(x) - 11)):
                want.add((doc, item))
    assert len(want) > 20
    got = L.leaks(d, "doc_id", "text", i, "item_id", "text").collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    blocks = L.candidates(d, "doc_id", "text", i, "item_id", "text", L.Retrieval(block_items=15, block_words=400)).filter("run >= 12").collect()
    assert {(r.doc_id, r.item_id) for r in blocks} == want


def test_empty(spark):
    d, i, _, _ = tables(spark)
    assert L.leaks(d.limit(0), "doc_id", "text", i, "item_id", "text").count() == 0
    assert L.leaks(d, "doc_id", "text", i.limit(0), "item_id", "text").count() == 0


def test_paraphrase(spark):
    _, i, docs, items = tables(spark)
    w = items[3][1].split()[:24]
    changed = " ".join(x if k % 6 else "other" for k, x in enumerate(w))  # no five words in a row are left
    d = spark.createDataFrame([(1, f"{changed} and more"), (2, docs[1][1])], "doc_id long, text string")
    got = L.paraphrases(d, "doc_id", "text", i, "item_id", "text").collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 3)] and got[0].run == 5


def test_tree_sum(spark):
    """The space is the same however the passages are spread over tasks."""
    d, i, _, items = tables(spark)
    r = L.Retrieval(rank=8)
    exam = L.Exam([(k, L.words_of(t)) for k, t, _ in items if k is not None and L.words_of(t)], r)
    made = d.filter("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(L._read_passages(exam, r), "doc_id long, at long, ids array<int>").filter("doc_id is not null")
    idf = np.ones(len(exam.vocabulary), np.float32)
    a, b = (L.randomised_svd(made.repartition(n), exam, idf, r) for n in (1, 40))
    assert np.linalg.svd(a.T @ b)[1].min() > 0.99


def test_paraphrase_behind_a_longer_run(spark):
    """A passage that passes counts, though another one of the same document and item has a longer run and fails."""
    _, _, _, items = tables(spark)
    w = [f"q{i}" for i in range(36)]
    i = spark.createDataFrame([(7, " ".join(w))] + [(k, t) for k, t, _ in items[:5]], "item_id long, text string")
    kept = [x if k % 6 else "other" for k, x in enumerate(w[:24])]
    text = " ".join(kept + ["other"] * 24 + w[26:34] + items[0][1].split()[:4] + ["other"] * 12)
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = L.paraphrases(d, "doc_id", "text", i, "item_id", "text", facts=0.0).collect()
    assert [(r.doc_id, r.item_id, r.run, r.lcs) for r in got] == [(1, 7, 5, 20)]


def test_paraphrase_at_every_offset(spark):
    _, i, _, items = tables(spark)
    w = items[3][1].split()[:24]
    kept = [x if k not in (4, 5, 6, 11, 12, 17, 18) else "other" for k, x in enumerate(w)]  # 17 of 24, in runs of four and five
    d = spark.createDataFrame([(k, " ".join(["before"] * k + kept + ["behind"] * 30)) for k in range(25)], "doc_id long, text string")
    got = L.paraphrases(d, "doc_id", "text", i, "item_id", "text", facts=0.0).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(k, 3) for k in range(25)}


def test_paraphrase_without_runs(spark):
    """Every fourth word is another one; and a short item, in a document with few words of the evaluation set."""
    _, i, _, items = tables(spark)
    w = items[3][1].split()[:24]
    i = i.select("item_id", "text").union(spark.createDataFrame([(200, " ".join(f"q{k}" for k in range(9)))], "item_id long, text string"))
    short = ["q0", "q1", "x", "q3", "q4", "y", "q6", "q7", "q8"]
    d = spark.createDataFrame([(1, " ".join(x if k % 4 else "other" for k, x in enumerate(w))), (2, " ".join(["long"] * 7 + short + ["long"] * 40)), (3, " ".join(short))], "doc_id long, text string")
    got = L.paraphrases(d, "doc_id", "text", i, "item_id", "text", facts=0.0).collect()
    assert {(r.doc_id, r.item_id, r.run, r.lcs) for r in got} == {(1, 3, 3, 18), (2, 200, 3, 7), (3, 200, 3, 7)}


def test_found_whatever_the_rank(spark):
    """A latent space too small for the evaluation set loses nothing."""
    d, i, _, _ = tables(spark)
    pairs = lambda r: {(x.doc_id, x.item_id) for x in L.candidates(d, "doc_id", "text", i, "item_id", "text", r).collect()}
    assert pairs(L.Retrieval(rank=2, cosine=0.9)) == pairs(L.Retrieval()) != set()


@pytest.mark.parametrize("kind", ["replaced", "inserted", "dropped"])
def test_paraphrase_recall(spark, kind):
    """Every fifth word changed, in forty items at all offsets: nearly all are found, and nothing else."""
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(400)]
    items = [(k, [str(x) for x in rng.choice(words, 24)]) for k in range(40)]
    change = {"replaced": lambda k, x: [x] if k % 5 else ["other"], "inserted": lambda k, x: [x] if k % 5 else [x, "other"], "dropped": lambda k, x: [x] if k % 5 else []}[kind]
    docs = [(24 * k + o, " ".join(["before"] * o + [y for j, x in enumerate(w) for y in change(j, x)] + ["behind"] * 30)) for k, w in items for o in range(24)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in L.paraphrases(d, "doc_id", "text", i, "item_id", "text").collect()}
    want = {(doc, doc // 24) for doc, _ in docs}
    assert len(got & want) >= 0.97 * len(want) and got <= want
