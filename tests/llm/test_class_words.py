"""Every word of the class model has a class of its own neighbours, not only the most frequent ones."""

import math
import random
from collections import Counter

import numpy as np

from masklake.llm import classlm


def test_best_moves_equals_best_move():
    rng = np.random.RandomState(1)
    size, m = 5, 40
    table = rng.poisson(40, (size, size)).astype(float) + 60
    right, left = (rng.poisson(0.8, (m, size)).astype(float) for _ in range(2))
    now = rng.randint(1, size, m)
    own = np.minimum(np.minimum(right[np.arange(m), now], left[np.arange(m), now]), rng.randint(0, 2, m))
    best, gain = classlm.best_moves(table, right, left, own, now)
    for i in range(m):
        want, most = classlm.best_move(table, right[i], left[i], own[i], int(now[i]))
        assert math.isclose(gain[i], most, abs_tol=1e-8) and (best[i] == want or abs(most) < 1e-8)


def texts():
    """Nouns and verbs in turn: two frequent ones of each, and many others of one ending and length, hence of one type."""
    rng = random.Random(3)
    nouns, verbs = ([f"{c}{a}{b}xx" for a in "abcd" for b in "abcde"] for c in "nv")
    pick = lambda few, many: rng.choice(few if rng.random() < 0.6 else many)
    noun, verb = lambda: pick(["dog", "cat"], nouns), lambda: pick(["sees", "hits"], verbs)
    return [" ".join(f"the {noun()} can {verb()} a {noun()} ." for _ in range(8)) for _ in range(150)] + ["", "the the nqqxx"]


def scored(spark, direct):
    docs = spark.createDataFrame([*enumerate(texts()), (900, None), (901, "new words can only be xx")], "doc_id bigint, text string").repartition(3)
    model = classlm.train(docs.where("doc_id < 900"), head=8, n_classes=6, direct=direct)
    return model, {r.doc_id: r for r in classlm.score(docs, model).collect()}


def test_words_outside_the_head_are_placed_by_their_own_neighbours(spark, monkeypatch):
    monkeypatch.setattr(classlm, "_FLUSH", 100)
    model, got = scored(spark, 5000)
    word_of = {int(classlm.Words(classlm.pa.array([w]), classlm.WHITE, nul_is_word=True).hash.view(np.int64)[0]): w for t in texts() for w in t.split()}
    rows = {word_of[r.word]: r for r in model.counts.collect()}
    assert {w: r.n for w, r in rows.items()} == Counter(w for t in texts() for w in t.split())
    of = lambda first: [r["class"] for w, r in rows.items() if w[0] == first and w.endswith("xx") and r.n > 5]
    assert set(of("n")).isdisjoint(of("v")) and len({r.tail for w, r in rows.items() if w.endswith("xx")}) == 1
    # transitions and emissions are those of the words' own classes
    table = np.zeros((6, 6))
    for t in texts():
        cls = [0, *(rows[w]["class"] for w in t.split()), 0]
        np.add.at(table, (cls[:-1], cls[1:]), 1)
    total = table.sum(0)
    share = (total + 1) / (total.sum() + 6)
    assert np.allclose(model.transition, np.log10((table + 5 * share) / (table.sum(1, keepdims=True) + 5)))
    per_class = Counter(r["class"] for r in rows.values())
    spread = np.log10(total + 0.1 * (np.array([1 + 0] + [per_class[k] for k in range(1, 6)]) + 1))
    for i, t in enumerate(texts()):
        cls = [0, *(rows[w]["class"] for w in t.split()), 0]
        want = sum(math.log10(rows[w].n + 0.1) for w in t.split()) + math.log10(152.1) + sum(
            model.transition[a, b] - spread[b] for a, b in zip(cls, cls[1:], strict=False))
        assert math.isclose(got[i].score, want, rel_tol=1e-9)


def test_looked_up_and_joined_words_score_alike(spark):
    """The same model with all words in the tasks' table, and with the 8 of the head and few others."""
    (model, got), (few, same) = scored(spark, 5000), scored(spark, 12)
    assert 8 <= len(few.vocabulary.words) <= 12 < len(model.vocabulary.words)
    key = lambda m: sorted((r.word, r.n, r["class"]) for r in m.counts.collect())
    assert key(few) == key(model) and np.allclose(few.transition, model.transition)
    for i, r in got.items():
        assert (r.n_tokens, r.n_known) == (same[i].n_tokens, same[i].n_known)
        assert math.isclose(r.base_score, same[i].base_score, rel_tol=1e-9) and math.isclose(r.score, same[i].score, rel_tol=1e-9)
