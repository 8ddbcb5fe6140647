"""Toxic expressions of ordinary words, copies, and shared counts by word."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from panelfx.llm import toxicity
from panelfx.llm.common import uniform
from panelfx.llm.textvec import words_of


def fit(spark, texts, toxic, corpus=()):
    rows = [(k, t, y) for k, (t, y) in enumerate(zip(texts, toxic, strict=True))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    whole = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-1 - k, t) for k, t in enumerate(corpus)], "doc_id long, text string"))
    return toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), whole)


def test_expressions_of_ordinary_words(spark):
    """No expression occurs in a hundred places, and its single words are as frequent in ordinary texts."""
    r = np.random.default_rng(3)
    words = [f"w{k}" for k in range(200)]
    expressions = [(words[2 * k], words[2 * k + 1]) for k in range(24)]

    def text(toxic):
        w = list(r.choice(words, 30))
        for k in r.choice(24, 2, replace=False):
            w[5:5] = expressions[k] if toxic else expressions[k][::-1]
        return " ".join(w)

    toxic = [k % 2 for k in range(1000)]
    model = fit(spark, [text(y) for y in toxic], toxic)
    held = [k % 2 for k in range(300)]
    got = model.score([text(y).encode() for y in held])
    low, high = got[0::2], got[1::2]
    assert (high[:, None] > low[None, :]).mean() > 0.9


def test_copies_count_once(spark):
    r = np.random.default_rng(4)
    texts = [" ".join(r.choice(["a", "b", "c", "d"], 12)) + f" {k}" for k in range(80)]
    toxic = [k % 2 for k in range(80)]
    once = fit(spark, texts, toxic)
    copied = fit(spark, texts + texts[:40] * 5, toxic + toxic[:40] * 5, [])
    for p, q in ((once.toxic, copied.toxic), (once.ordinary, copied.ordinary)):
        assert np.array_equal(p.pairs, q.pairs) and np.array_equal(p.context, q.context)


def test_naive_kneser_ney(spark):
    """Both classes' probabilities of every bigram against sums over dictionaries."""
    r = np.random.default_rng(8)
    words = [f"w{k}" for k in range(30)]
    texts = [" ".join(r.choice(words, r.integers(1, 25), p=np.arange(30, 0, -1) / 465)) for _ in range(120)]
    toxic = [k % 2 for k in range(120)]
    model = fit(spark, texts, toxic)
    shared = Counter(w for t in texts for w in t.split())
    total = sum(shared.values()) + 0.5 * (len(shared) + 1)

    # the curve's share isn't counted
    side = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", (uniform(F.col("t"), F.lit("curve")) < toxicity.CURVE_SHARE).alias("c"))
    chosen = {texts[r["k"]]: toxic[r["k"]] for r in side.collect() if not r["c"]}
    for label, strength in ((1, 10.0), (0, 100.0)):
        own = [t.split() for t, y in chosen.items() if y == label]
        two = Counter()
        for t in own:
            two.update(set(zip(["^", *t], t, strict=False)))
        one = Counter(w for _, w in two)  # distinct words before it

        def discount(counts):
            c = Counter(min(n, 5) for n in counts.values())
            y = c[1] / (c[1] + 2 * c[2])
            d, last = {}, 0.5
            for k in (1, 2, 3):
                last = d[k] = min(max(k - (k + 1) * y * c[k + 1] / c[k], 0.1), k) if c[k] and c[k + 1] else last
            if not (c[3] and c[4]):
                d[3] = last
            return lambda n: d[min(n, 3)]

        d1, d2 = discount(one), discount(two)
        n1 = sum(one.values())
        rest = 1 - sum((n - d1(n)) / n1 for n in one.values())

        def lower(w):
            return (one[w] - d1(one[w])) / n1 + rest * (shared[w] + 0.5) / total if one[w] else rest * (shared[w] + 0.5) / total

        for a in ["^", "w0", "w3", "w29"]:
            out = {w: n for (b, w), n in two.items() if b == a}
            many = sum(out.values())
            for w in words:
                if w not in {x for t in chosen for x in t.split()}:
                    continue
                want = (out[w] - d2(out[w]) if w in out else 0) + (sum(d2(n) for n in out.values()) + strength) * lower(w)
                want /= many + strength
                _, before, word = toxicity._words([f"{a} {w}".encode() if a != "^" else w.encode()])
                got = model.likelihoods(before[-1:], word[-1:], strength)[0 if label else 1][0]
                assert got == pytest.approx(np.log(want), abs=1e-5), (a, w)


def test_repeated_ids_give_one_model(spark):
    """Ids that repeat in labels and documents, in any order of rows."""
    rows = [(k % 40, f"word{k % 7} and word{k % 11} " + "bad " * (k % 2)) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k % 40, k % 2) for k in range(200)], "doc_id long, toxic int")
    a = toxicity.train(docs, labels, sample=15)
    b = toxicity.train(docs.repartition(5), labels.repartition(3), sample=15)
    assert np.array_equal(a.bigrams, b.bigrams) and np.allclose(a.curve, b.curve)


def test_frequent_word_takes_nothing_from_rare_one(spark):
    """Two rare toxic words in the same places score alike, though one has its first 18 bits from a frequent word."""
    names = [f"x{k}" for k in range(400_000)]
    top = words_of([" ".join(names).encode()]).hash >> np.uint64(46)
    order = np.argsort(top, kind="stable")
    twin = np.flatnonzero(top[order][1:] == top[order][:-1])[0]
    often, near, far = names[order[twin]], names[order[twin + 1]], names[order[twin + 9_000]]
    r = np.random.default_rng(5)
    filler = [f"f{k}" for k in range(100)]
    texts, toxic = [], []
    for k in range(300):
        w = list(r.choice(filler, 20))
        for word in (near, far):
            texts.append(" ".join([*w[:10], word, *w[10:]] if k % 2 else w + [str(word == near)]))
            toxic.append(k % 2)
    model = fit(spark, texts, toxic, [" ".join([often] * 2_000)] * 400)
    greatest = []
    for word in (near, far):
        _, before, hashes = toxicity._words([" ".join([*filler[:10], word, *filler[10:20]]).encode()])
        toxic, ordinary = model.likelihoods(before, hashes, 100.0)
        greatest.append((toxic - ordinary).max())
    assert greatest[0] > 0.8 * greatest[1] > 1


def test_shared_counts_are_by_word(spark):
    docs = spark.createDataFrame([(" ".join(f"n{k}" for k in range(300_000)),), ("n1 n1 n2",)], "text string")
    got = toxicity.shared_counts(docs).agg(F.count("*"), F.sum("n"), F.max("n")).first()
    assert tuple(got) == (300_000, 300_003, 3)


def test_every_labelled_document_counts(spark):
    """No class is cut at a number of documents."""
    n = 12_000
    docs = spark.range(n + 60).select(F.col("id").alias("doc_id"), F.concat(F.lit("plain words "), F.col("id").cast("string"), F.when(F.col("id") % 200 == 0, " telling").otherwise("")).alias("text"))
    model = toxicity.train(docs, docs.select("doc_id", (F.col("doc_id") % 200 == 0).cast("int").alias("toxic")))
    share = F.count(F.when(uniform(F.col("text"), F.lit("curve")) >= toxicity.CURVE_SHARE, 1))
    want = {r["y"]: r["n"] for r in docs.groupBy((F.col("doc_id") % 200 == 0).alias("y")).agg(share.alias("n")).collect()}
    got = model.pairs.where(f"a = {toxicity.START}").agg(F.sum("t"), F.sum("o")).first()
    assert tuple(got) == (want[True], want[False]) and got[1] > 0.65 * n


@pytest.mark.parametrize("most", [1 << 16, 12, 0])
def test_tables_score_as_the_model_held_here(spark, monkeypatch, most):
    """However little a task may hold, and with repeated, null and empty texts."""
    monkeypatch.setattr(toxicity, "MOST_WORDS", most)
    monkeypatch.setattr(toxicity, "MOST_CONTEXTS", most)
    monkeypatch.setattr(toxicity, "MOST_BITS", max(1 << 13, most))
    r = np.random.default_rng(12)
    words = [f"w{k}" for k in range(80)]
    p = np.arange(80, 0, -1) / 3240
    text = lambda y: " ".join([*r.choice(words, r.integers(5, 60), p=p), *(r.choice(["bad", "worse", "w7 w3"], 2) if y else ["w3 w7"])])
    toxic = [int(k % 4 == 0) for k in range(400)]
    model = fit(spark, [text(y) for y in toxic], toxic)
    held = [text(k % 2) + f" new{k} bad" for k in range(60)] + ["", None, "bad bad bad bad"] + ["w1 bad new"] * 3
    rows = [(k if k % 9 else None, k % 2 == 0, t) for k, t in enumerate(held)]
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, held_out boolean, text string").repartition(3), model, ["doc_id", "held_out"]).collect()
    want = model.score([(t or "").encode() for t in held])
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2])
    got, want = sorted([tuple(x) for x in got], key=key), sorted([(a, b, s) for (a, b, _), s in zip(rows, want, strict=True)], key=key)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want], abs=1e-8)
    assert np.ptp([x[2] for x in got]) > 0.5
