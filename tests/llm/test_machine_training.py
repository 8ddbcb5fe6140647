"""Training of the factorisation machine against the same steps written with explicit pairs, and its gradient by differences."""

from __future__ import annotations

import math

import numpy as np
import pytest

from panelfx.llm import quality_fm as fm

TEXTS = [b"good words in a long calm line", b"buy buy buy now!!! $$$", b"a calm line\nof good words", b"buy now $$$ #1", b"words", b"now now calm buy good", b"", b"line line line 12 34"]
LABELS = np.array([1, 0, 1, 0, 1, 0, 0, 1])


def by_pairs(bias, w, v, doc):
    """The score of (feature, value) pairs, every two features multiplied in turn."""
    z = bias + sum(w[i] * x for i, x in doc)
    for a, (i, x) in enumerate(doc):
        for j, y in doc[a + 1 :]:
            z += float(v[i] @ v[j]) * x * y
    return z


def naive(machine, docs, y, steps, rate=0.02, shrink=2e-4):
    """Full batches of Adam; the slope of a feature's factors is its value times the sum of all other features' factors by their values."""
    bias, w, v = machine.bias, machine.w.copy(), machine.v.copy()
    held = {k: [0.0, 0.0] for k in ("bias", "w", "v")}
    for step in range(1, steps + 1):
        g0, gw, gv = 0.0, shrink * w, shrink * v
        for doc, label in zip(docs, y):
            g = (1 / (1 + math.exp(-by_pairs(bias, w, v, doc))) - label) / len(docs)
            g0 += g
            for a, (i, x) in enumerate(doc):
                gw[i] += g * x
                gv[i] += g * x * sum((v[j] * u for b, (j, u) in enumerate(doc) if b != a), np.zeros(v.shape[1]))
        lr = rate * (1 - (step - 1) / steps * 0.8)
        new = []
        for k, p, gr in (("bias", bias, g0), ("w", w, gw), ("v", v, gv)):
            held[k] = [0.9 * held[k][0] + 0.1 * gr, 0.999 * held[k][1] + 0.001 * gr**2]
            new.append(p - lr * (held[k][0] / (1 - 0.9**step)) / (np.sqrt(held[k][1] / (1 - 0.999**step)) + 1e-8))
        bias, w, v = new
    return bias, w, v


def features(machine, parts):
    index, x, first = machine.inputs(*parts)
    return [list(zip(index[a:b].tolist(), x[a:b].tolist())) for a, b in zip(first, first[1:])]


@pytest.mark.parametrize("epochs", [1, 2, 5])
def test_training_equals_explicit_pairs(epochs):
    parts = fm.describe(TEXTS)
    start = fm.fit(parts, LABELS, epochs=0)
    got = fm.fit(parts, LABELS, epochs=epochs)
    docs = features(start, parts)
    bias, w, v = naive(start, docs, LABELS, epochs)
    assert got.bias == pytest.approx(bias, abs=1e-9)
    assert np.abs(got.w - w).max() < 1e-7 and np.abs(got.v - v).max() < 1e-7
    want = [1 / (1 + math.exp(-by_pairs(bias, w, v, d))) for d in docs]
    assert got.score(TEXTS) == pytest.approx(want, abs=1e-7)


def test_slope_by_differences():
    """A small move of one number changes the loss by the slope that the pairs give."""
    parts = fm.describe(TEXTS)
    m = fm.fit(parts, LABELS, epochs=3)
    docs = features(m, parts)
    loss = lambda v: float(np.mean([math.log1p(math.exp(-(2 * y - 1) * by_pairs(m.bias, m.w, v, d))) for d, y in zip(docs, LABELS)]))
    i, k, h = docs[0][1][0], 2, 1e-5
    up, down = m.v.copy(), m.v.copy()
    up[i, k] += h
    down[i, k] -= h
    slope = sum(
        (1 / (1 + math.exp(-by_pairs(m.bias, m.w, m.v, d))) - y) / len(docs) * x * sum(m.v[j, k] * u for j, u in d if j != i)
        for d, y in zip(docs, LABELS) for f, x in d if f == i
    )
    assert (loss(up) - loss(down)) / (2 * h) == pytest.approx(slope, rel=1e-4, abs=1e-9)


def test_training_lowers_the_loss_and_repeats():
    parts = fm.describe(TEXTS)
    one, two = fm.fit(parts, LABELS), fm.fit(parts, LABELS)
    assert (one.v == two.v).all() and one.bias == two.bias
    p = one.score(TEXTS)
    assert ((p > 0.5) == (LABELS == 1)).mean() >= 0.75
    same = fm.fit(parts, np.ones(len(TEXTS)))
    assert ((same.score(TEXTS) > 0.5) & (same.score(TEXTS) <= 1)).all()
