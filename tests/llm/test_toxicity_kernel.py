"""The subsequence kernel, its Nystroem machine and the folded table against direct enumeration."""

import collections
from itertools import combinations

import numpy as np
import pytest

from quirefold.llm import toxicity as t


def features(word):
    """Weight of each subsequence of three or four letters (the begin mark is one) over at most five places."""
    codes = [t.BEGIN] + [int(t._CODES[min(ord(c), 0xFFFF)]) for c in word]
    out = collections.Counter()
    for p in t.ORDERS:
        for at in combinations(range(len(codes)), p):
            if at[-1] - at[0] < t.STRETCH and all(codes[i] for i in at):
                out[p, tuple(codes[i] for i in at)] += t.DECAY ** (at[-1] - at[0] + 1)
    return out


def kernel(a, b):
    def size(f):
        return max(np.sqrt(sum(v * v for v in f.values())), t._NORMS[t.SHORT])

    x, y = features(a), features(b)
    return sum(v * y[k] for k, v in x.items()) / size(x) / size(y)


WORDS = ["idiot", "id-iot", "i.d.i.o.t", "idxiot", "naïve", "Straße", "banana", "aaaaaa", "q", "", "12345", "日本語", "moron", "morning", "x" * 24]


@pytest.fixture(scope="module")
def machine():
    good = collections.Counter({"idiot": 9, "moron": 5, "moronic": 3, "scumbag": 4})
    bad = collections.Counter({"morning": 9, "idiom": 3, "banana": 4, "the": 20, "scholar": 2, "baggage": 2})
    tables, bias = t._fit(good, bad, [], 10)
    return good, bad, t.Model(tables, bias)


def test_decision_is_a_sum_of_kernels(machine):
    """Each decision is the bias and a combination of kernels with the landmarks, found from the decisions of these."""
    good, bad, model = machine
    marks = [w for w, _ in good.most_common(2)] + [w for w, _ in bad.most_common()]
    marks = marks[:10]
    gram = np.array([[kernel(a, b) for b in marks] for a in marks])
    exact = np.array([decision(model, w) - model.bias for w in marks])
    weights = np.linalg.lstsq(gram, exact, rcond=None)[0]
    for w in WORDS:
        want = sum(a * kernel(w, z) for a, z in zip(weights, marks, strict=True))
        assert decision(model, w) - model.bias == pytest.approx(want, abs=2e-3), w


def decision(model, word):
    """The folded table, looked up one subsequence at a time."""
    f = features(word)
    size = max(np.sqrt(sum(v * v for v in f.values())), t._NORMS[t.SHORT])
    total = 0.0
    for (p, codes), v in f.items():
        number = 0
        for c in codes:
            number = number * t.LETTERS + c
        total += v * float(model.tables[p][number])
    return total / size + model.bias


def test_scored_words_are_the_folded_table(machine):
    good, bad, model = machine
    words = [*WORDS, *good, *bad, "idiotic", "mo-ron", "scum bag"]
    got = model.words(words)
    for w, v in zip(words, got, strict=True):
        want = decision(model, w)
        assert v == pytest.approx(want, abs=1e-4) if want > -0.45 else v <= -0.4, w


def test_kernel_matrix():
    marks = ["idiot", "morning", "banana"]
    m = t._matrix(marks, t.WIDTH)
    index, total = {}, 0
    for p in t.ORDERS:
        seen = np.unique(np.concatenate([c.ravel() for c, _ in t._subsequences(m, p)]))
        seen = seen[seen > 0]
        index[p] = np.full(t.LETTERS**p, -1, dtype=np.int32)
        index[p][seen] = total + np.arange(len(seen))
        total += len(seen)
    weights = np.zeros((total, len(marks)))
    for p in t.ORDERS:
        for code, weight in t._subsequences(m, p):
            row, col = np.nonzero(code)
            np.add.at(weights, (index[p][code[row, col]], row), weight)
    got = t._kernel(WORDS, index, weights / t._sizes(m)[None, :])
    for w, row in zip(WORDS, got, strict=True):
        assert row == pytest.approx([kernel(w, z) for z in marks], abs=1e-9), w


def test_long_words_are_learnt_whole():
    hidden = "w" * 30 + "idiot" + "v" * 30
    model = t.fit([hidden + " day", "a fine day"] * 40, [1, 0] * 40, 0.5)
    assert model.words([hidden])[0] > model.words(["day"])[0] + 0.5


def test_constants_and_repeats():
    assert t.fit([], [], 0.3).probability(np.zeros((1, 2)))[0] == pytest.approx(0.3)
    assert t.fit(["a"] * 9, [0] * 9, 0.2).probability(np.zeros((1, 2)))[0] == pytest.approx(0.2)
    twice = [t.fit([None, "", "you idiot", "fine day"] * 20, [0, 0, 1, 0] * 20, 0.25) for _ in range(2)]
    assert np.array_equal(twice[0].words(WORDS), twice[1].words(WORDS))


def test_long_runs_of_blanks_take_linear_time():
    import time

    from quirefold.llm.toxicity import tokens

    began = time.time()
    for text in ("a" + " " * 1_000_000, "a" + " " * 500_000 + "b" + "\t" * 500_000, "a . " * 250_000, "_ " * 400_000, "x" + "-" * 900_000 + " y"):
        list(tokens(text))
    assert time.time() - began < 5
    assert "idiot" in tokens("you i d  i-  o   t here") and "abc" in tokens("a , b ,, c.")
