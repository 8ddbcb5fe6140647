"""Mixture inference of many texts at once against expectation-maximisation of each text on its own, word by word."""

from __future__ import annotations

import math

import numpy as np
import pytest

from panelfx.llm import language_id as li


def naive_em(like, allowed, rounds):
    pi = [a / sum(allowed) for a in allowed]
    for _ in range(rounds):
        new = [0.0] * len(pi)
        for row in like:
            joint = [float(v) * p for v, p in zip(row, pi)]
            for k, v in enumerate(joint):
                new[k] += v / (sum(joint) + 1e-30) / len(like)
        moved = max(abs(a - b) for a, b in zip(new, pi))
        pi = new
        if moved < 1e-3:
            break
    return pi, sum(math.log(sum(float(v) * p for v, p in zip(row, pi)) + 1e-30) for row in like)


def naive_infer(text, model, rounds=20, penalty=0.5):
    """The best single language, unless a set of the text's leading languages, each with some share, has the greater penalised likelihood."""
    like, _ = li._words(*li._clean([text]), model)
    k = len(model.languages)
    if not len(like):
        return [0.0] * k, 0
    pi, _ = naive_em(like, [1] * k, rounds)
    order = sorted(range(k), key=lambda j: (-pi[j], j))
    alone = [sum(math.log(float(row[j]) + 1e-30) for row in like) for j in range(k)]
    if k == 1 or pi[order[1]] < li.LEAST_SHARE:
        return [float(j == order[0]) for j in range(k)], 1
    first = max(range(k), key=lambda j: (alone[j], -j))
    best, top, size = [float(j == first) for j in range(k)], alone[first], 1
    for s in range(2, k + 1):
        if pi[order[s - 1]] < li.LEAST_SHARE:
            break
        p, ll = naive_em(like, [int(j in order[:s]) for j in range(k)], rounds)
        ll -= penalty * (s - 1) * math.log(max(len(like), 2))
        if ll > top:
            best, top, size = p, ll, s
    return best, size


def model_of(spark, parts):
    rows = [(lang, t) for lang, texts in parts.items() for t in texts]
    return li.train(spark.createDataFrame(rows, "lang string, text string"))


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_many_texts_as_each_alone(spark, seed):
    r = np.random.default_rng(seed)
    letters = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "mnopqrst", "dd": "qrstuvwx"}
    word = lambda lang: "".join(r.choice(list(letters[lang]), r.integers(2, 8)))
    line = lambda langs, n: " ".join(word(langs[i * len(langs) // n]) for i in range(n))
    model = model_of(spark, {lang: [line([lang], 40) for _ in range(6)] for lang in letters})
    texts = [line([lang], int(n)) for lang in letters for n in (1, 3, 30)]
    texts += [line(mix, 60) for mix in (["aa", "cc"], ["bb", "dd"], ["aa", "cc", "dd"], ["aa", "bb"], ["aa", "bb", "cc", "dd"], ["aa"] * 9 + ["cc"])]
    texts += ["", "123 !!", "zzz yyy", "a", line(["cc"], 400)]
    raw = [t.encode() for t in texts]
    has, props, chosen = li.infer(raw, model)
    for i, t in enumerate(raw):
        want, size = naive_infer(t, model)
        assert chosen[i] == size and props[i] == pytest.approx(want, abs=1e-5), texts[i]
        assert has[i] == (size > 0)
    assert chosen[12] == 2 and chosen[14] == 3  # clear mixtures are found
    # a text's result doesn't hang on its neighbours
    alone = [li.infer([t], model)[1][0] for t in raw]
    assert np.abs(np.array(alone) - props).max() < 1e-6
