"""Toxicity by class-conditional Kneser-Ney models.

One bigram model of toxic and one of ordinary text, counted over all labelled documents but those that the curve is fitted on.
Both back off from bigrams to words and from those to shared counts over the whole corpus. A bigram counts the distinct
texts in which it occurs, so that copies and repeats within a text don't pass for evidence; a word counts the distinct words that it
follows, which is Kneser-Ney's lower order. Discounts are estimated
from counts of counts (modified Kneser-Ney), level by level and class by class. A context that was
seen little says little: ``strength`` pseudo-counts of every context follow the word level.

A document's number is the mean over its words of what the
toxic model's log-likelihood exceeds the ordinary one's by, beyond EXCESS: a plain mean of the difference does worse. Words that no
class counted say nothing. A logistic curve of that number and the
text's length, fitted on the labelled documents that were not counted, makes it a probability; the strength is that
of STRENGTHS whose curve fits best.

Words go by their 64-bit hash. Bigrams and words are distributed tables with a row for each distinct one, which no machine holds. A word
exceeds after another by ``f(context) + g(word) - EXCESS`` if the pair wasn't counted, else by that and a difference of the pair's own. Few words and
pairs exceed at all, so tasks hold a bounded filter (``Lookup``): the greatest f and g, and a Bloom filter of the pairs that differ. What it
settles is summed at once, what it can't settle goes to the tables in one join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import tree_sum
from ..shipping import ship
from .common import drop_saved, save, uniform
from .textvec import mix, slices, words_of

#: Numbers of the start of a text (also its hash) and of words that no class counted; others follow.
START, UNKNOWN, KNOWN = 0, 1, 2
#: A task holds so many distinct words of the shared counts before it passes them on.
MOST_HELD = 1 << 19
#: The share of the labelled documents that fits the curve.
CURVE_SHARE = 0.3
#: What tasks hold at most: words, contexts and bits of the Bloom filter. The rest is looked up in the tables.
MOST_WORDS, MOST_CONTEXTS, MOST_BITS = 1 << 22, 1 << 20, 1 << 29
#: A word counts by what its log ratio exceeds this by: rare words that one class happens to have seen stay below.
EXCESS = 1.0
#: Pseudo-counts of a context that are tried: about the counts of rare, common and the commonest contexts.
STRENGTHS = (5.0, 50.0, 500.0, 5_000.0)
_BLANK = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
TOXIC, ORDINARY = 1, 0


def _words(texts: list[bytes]):
    w = words_of([t.translate(_BLANK) for t in texts])
    word = np.maximum(w.hash, 1).view(np.int64)
    before = np.concatenate(([START], word[:-1])) if len(word) else word
    if len(word):
        starts = w.first[:-1][np.diff(w.first) > 0]
        before[starts] = START  # the start of a text is a word of its own
    return w, before, word


def _find(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places of ``x`` in a sorted array, its length for what isn't there."""
    if not len(sorted_):
        return np.zeros(len(x), dtype=np.int64)
    at = np.searchsorted(sorted_, x)
    at[sorted_[np.minimum(at, len(sorted_) - 1)] != x] = len(sorted_)
    return at


def _discounts(c: list[int]) -> np.ndarray:
    """What counts of 1, 2 and 3 or more lose (index 0: nothing), by Chen and Goodman from how many counts are 1, 2, 3 and 4 (``c[k]``).

    A discount is at least 0.1, so that something is left to the backoff, and at most its count; where
    counts of counts are missing it is that of the next lower count (0.5 for the first).
    """
    y = c[1] / max(c[1] + 2 * c[2], 1)
    out = [0.0, 0.5]
    for k in (1, 2, 3):
        d = k - (k + 1) * y * c[k + 1] / c[k] if c[k] and c[k + 1] else out[-1]
        out[k:] = [float(np.clip(d, 0.1, k))] * (2 if k < 3 else 1)
    return np.array(out)


@dataclass
class Side:
    """One class: discounted bigram counts (by the model's list of bigrams, 0 after it), and by number the counts
    of contexts, what discounts took from them, and probabilities of words."""

    pairs: np.ndarray
    context: np.ndarray
    taken: np.ndarray
    words: np.ndarray

    def prob(self, before: np.ndarray, word: np.ndarray, pair: np.ndarray, strength: float) -> np.ndarray:
        return (self.pairs[pair] + (self.taken[before] + strength) * self.words[word]) / (self.context[before] + strength)


@dataclass
class Held:
    """A model's counts on one machine, for small models and single texts; ``score`` of a table reads the tables themselves."""

    toxic: Side
    ordinary: Side
    vocabulary: np.ndarray  # sorted hashes of the words that a class counted
    bigrams: np.ndarray  # sorted pairs of numbers
    shared: np.ndarray  # shared probabilities by number

    def number(self, hashes: np.ndarray) -> np.ndarray:
        at = _find(self.vocabulary, hashes)
        return np.where(at < len(self.vocabulary), at + KNOWN, np.where(hashes == START, START, UNKNOWN))

    def likelihoods(self, before: np.ndarray, word: np.ndarray, strength: float) -> tuple[np.ndarray, np.ndarray]:
        b, w = self.number(before), self.number(word)
        pair = _find(self.bigrams, b * len(self.shared) + w)
        return np.log(self.toxic.prob(b, w, pair, strength)), np.log(self.ordinary.prob(b, w, pair, strength))


@dataclass
class Class:
    """One class's totals: discounts of bigrams and of words, the sum of words' counts, and what is left to the shared counts."""

    off: np.ndarray
    off_words: np.ndarray
    total: int
    rest: float


@dataclass
class Model:
    """``pairs(a, w, t, o)``: in how many toxic and ordinary texts w follows a. ``words``: a row a word of the corpus, with its count ``n``, the distinct words before
    it (``kt``, ``ko``) and, as a context, its counts (``ct``, ``co``) and how many followers were counted once, twice and more (``t1`` to ``o3``).
    ``differing``: the pairs that may exceed by other than f and g say. All are stored tables."""

    pairs: DataFrame
    words: DataFrame
    toxic_class: Class
    ordinary_class: Class
    size: float  # of the shared counts, smoothed
    differing: DataFrame | None = None
    strength: float = STRENGTHS[0]
    curve: np.ndarray | None = None

    def levels(self) -> DataFrame:
        """``(w, known, pt, po, g, ct, tt, co, oo)``: words and contexts that a class counted, with probabilities, and what discounts took of a context."""
        shared = (F.col("n") + 0.5) / self.size

        def prob(k: str, c: Class) -> Column:
            return (F.col(k) - _less(k, c.off_words)) / max(c.total, 1) + shared * c.rest

        def taken(k: str, c: Class) -> Column:
            return reduce(lambda x, y: x + y, [F.col(f"{k}{i}") * F.lit(float(c.off[i])) for i in (1, 2, 3)])

        rows = self.words.where("kt + ko + ct + co > 0")
        rows = rows.select("w", (F.col("kt") + F.col("ko") > 0).alias("known"), prob("kt", self.toxic_class).alias("pt"), prob("ko", self.ordinary_class).alias("po"), "ct", taken("t", self.toxic_class).alias("tt"), "co", taken("o", self.ordinary_class).alias("oo"))
        return rows.withColumn("g", F.log("pt") - F.log("po"))

    @cached_property
    def held(self) -> Held:
        rows = self.words.where("kt + ko + ct + co > 0").toArrow().sort_by("w").to_pydict()
        w, kt, ko = (np.array(rows[c], dtype=np.int64) for c in ("w", "kt", "ko"))
        known = kt + ko > 0
        shared = np.full(int(known.sum()) + KNOWN, 0.5)
        shared[KNOWN:] += np.array(rows["n"], dtype=np.int64)[known]
        held = Held(None, None, w[known], np.zeros(0, dtype=np.int64), shared / self.size)
        pairs = self.pairs.toArrow()
        key = held.number(pairs.column("a").to_numpy()) * len(shared) + held.number(pairs.column("w").to_numpy())
        order = np.argsort(key)
        held.bigrams = key[order]
        for name, n, k, c in (("toxic", "t", kt, self.toxic_class), ("ordinary", "o", ko, self.ordinary_class)):
            n = pairs.column(n).to_numpy()[order]
            off, before = c.off[np.minimum(n, 3)], held.bigrams // len(shared)
            words = np.zeros(len(shared))
            words[KNOWN:] = (k[known] - c.off_words[np.minimum(k[known], 3)]) / max(c.total, 1)
            add = lambda x: np.bincount(before, weights=x, minlength=len(shared))  # noqa: B023, E731
            setattr(held, name, Side(np.append(n - off, 0.0), add(n), add(off), words + c.rest * held.shared))
        return held

    toxic = property(lambda self: self.held.toxic)
    ordinary = property(lambda self: self.held.ordinary)
    bigrams = property(lambda self: self.held.bigrams)

    def likelihoods(self, before: np.ndarray, word: np.ndarray, strength: float) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihoods of words (hashes) after words, toxic and ordinary; unknown words share one probability."""
        return self.held.likelihoods(before, word, strength)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Scores of single texts, from the model held here."""
        w, before, word = _words(texts)
        words = np.diff(w.first)
        toxic, ordinary = self.held.likelihoods(before, word, self.strength)
        over = np.where(self.held.number(word) >= KNOWN, np.maximum(toxic - ordinary - EXCESS, 0), 0.0)
        x = np.bincount(w.doc, weights=over, minlength=len(texts)) / np.maximum(words, 1)
        return 1 / (1 + np.exp(-np.clip(_design(words.astype(float), x) @ self.curve, -35, 35)))


def _less(k: str, off: np.ndarray) -> Column:
    """What a count in column ``k`` is discounted by."""
    return F.when(F.col(k) >= 3, float(off[3])).when(F.col(k) == 2, float(off[2])).when(F.col(k) == 1, float(off[1])).otherwise(0.0)


def _backed(strength: float) -> Column:
    """f: by how much a context's backoff weight exceeds in the toxic model."""
    return F.log((F.col("tt") + strength) / (F.col("ct") + strength)) - F.log((F.col("oo") + strength) / (F.col("co") + strength))


def _design(words: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """The ratio counts for more in long texts, where less of it is chance."""
    size = np.log1p(words) / 6
    return np.stack((np.ones(len(words)), 10 * ratio, size, 10 * ratio * size), axis=1)


def _logistic(sums: Callable[[np.ndarray], np.ndarray], many: int, ridge: float = 1e-2) -> tuple[np.ndarray, np.ndarray]:
    """Newton steps for ``many`` curves at once, halved where they would raise the loss: coefficients and losses.

    ``sums(b)`` gives a row a curve: its loss, gradient (4) and second derivatives (16) at its row of ``b``.
    """

    def look(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        got = sums(b).reshape(many, 21)
        return got[:, 0] + ridge / 2 * (b * b).sum(axis=1), got[:, 1:5] + ridge * b, got[:, 5:].reshape(many, 4, 4) + ridge * np.eye(4)

    b, size = np.zeros((many, 4)), np.ones(many)
    now, slope, bend = look(b)
    for _ in range(80):
        step = -np.linalg.solve(bend, slope[:, :, None])[:, :, 0]
        there = b + size[:, None] * step
        then, s, h = look(there)
        better = then <= now
        gained = np.where(better, now - then, 0.0)
        b, now, slope, bend = np.where(better[:, None], there, b), np.where(better, then, now), np.where(better[:, None], s, slope), np.where(better[:, None, None], h, bend)
        size = np.where(better, 1.0, size / 2)
        if ((better & (gained < 1e-10 * (1 + now))) | (size < 1e-6)).all():
            break
    return b, now


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (label, text) to (a, w, t, o): in how many toxic and ordinary texts w follows a."""
    for b in batches:
        labels = b.column(0).to_numpy()
        for at, texts in slices(b.column(1)):
            w, before, word = _words(texts)
            own = labels[at : at + len(texts)].astype(np.int64)
            key = _distinct(np.stack((before, word, w.doc), axis=1))[0]
            toxic = (own[key[:, 2]] == TOXIC).astype(np.int64)
            first = np.flatnonzero(np.concatenate(([True], (key[1:, :2] != key[:-1, :2]).any(axis=1)))) if len(key) else np.zeros(0, dtype=np.int64)
            n = np.diff(np.concatenate((first, [len(key)])))
            t = np.add.reduceat(toxic, first) if len(first) else n
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[first, 0], key[first, 1], t, n - t)], names=["a", "w", "t", "o"])


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and how often each occurs."""
    rows = rows[np.lexsort(rows.T[::-1])]
    first = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]).any(axis=1)))) if len(rows) else np.zeros(0, dtype=np.int64)
    return rows[first], np.diff(np.concatenate((first, [len(rows)])))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        k, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        return k, np.bincount(at, weights=np.concatenate([h[1] for h in held])).astype(np.int64)

    for b in batches:
        for _, texts in slices(b.column(0)):
            held.append(np.unique(_words(texts)[2], return_counts=True))
            size += len(held[-1][0])
            if size > MOST_HELD:
                held = [merged()]
                size = len(held[0][0])
                if size > MOST_HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["w", "n"])
                    held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], names=["w", "n"])


def shared_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(w, n)``: how often each distinct word (by hash) occurs in the whole corpus; a task sends what it holds once."""
    ship(docs.sparkSession)
    return docs.select(text_col).mapInArrow(_count_words, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))


def _counted(counts: DataFrame, corpus_counts: DataFrame) -> Model:
    """Tables and totals of both classes from ``counts(a, w, t, o)``; all but a row of totals stays where it is."""
    pairs = save(counts, "toxicity-pairs")
    columns = ("n", "kt", "ko", "ct", "t1", "t2", "t3", "co", "o1", "o2", "o3")

    def wide(rows: DataFrame, key: str, **given: Column) -> DataFrame:
        return rows.groupBy(F.col(key).alias("w")).agg(*[F.sum(given[c]).cast("long").alias(c) if c in given else F.lit(0).cast("long").alias(c) for c in columns])

    seen = {"kt": (F.col("t") > 0).cast("long"), "ko": (F.col("o") > 0).cast("long")}
    after = {"ct": F.col("t"), "co": F.col("o")} | {f"{k}{i}": (F.col(k) == i if i < 3 else F.col(k) >= 3).cast("long") for k in ("t", "o") for i in (1, 2, 3)}
    rows = wide(corpus_counts, "w", n=F.col("n")).unionByName(wide(pairs, "w", **seen)).unionByName(wide(pairs, "a", **after))
    words = save(rows.groupBy("w").agg(*[F.sum(c).alias(c) for c in columns]), "toxicity-words")
    equal = lambda k: [F.count(F.when(F.col(k) == i, 1)).alias(f"{k}{i}") for i in (1, 2, 3, 4)] + [F.count(F.when(F.col(k) >= 3, 1)).alias(f"{k}5")]
    of_pairs = pairs.agg(*equal("t"), *equal("o")).first()
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("words"), *equal("kt"), *equal("ko"), *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("kt", "ko")]).first()

    def of(pair: str, word: str) -> Class:
        off, many = _discounts([0, *(of_pairs[f"{pair}{i}"] for i in (1, 2, 3, 4))]), [total[f"{word}{i}"] for i in (1, 2, 3, 4, 5)]
        lower = _discounts([0, *many[:4]])
        taken = lower[1] * many[0] + lower[2] * many[1] + lower[3] * many[4]
        left = 1 - (total[word] - taken) / max(total[word], 1)
        return Class(off, lower, total[word], max(left, 1e-6))

    return Model(pairs, words, of("t", "kt"), of("o", "ko"), total["n"] + 0.5 * (total["words"] + 1))


def _edge(table: DataFrame, value: Column, most: int) -> float:
    """A number that at most ``most`` rows reach and not far above any that more would reach: minus infinity if all may be held."""
    bins = sorted(((r["b"], r["n"]) for r in table.groupBy(F.floor(value * 100).alias("b")).agg(F.count("*").alias("n")).collect()), reverse=True)
    so_far = 0
    for k, (_, n) in enumerate(bins):
        so_far += n
        if so_far > most:
            return (bins[k][0] + 1) / 100
    return -np.inf


@dataclass
class Lookup:
    """What tasks hold of a model for some strengths. Words that aren't held have a g below ``words_below``, contexts an f below ``contexts_below``;
    minus infinity says that the others can't exceed, or (contexts) weren't counted. ``bits``: the Bloom filter of differing pairs, in parts."""

    words: np.ndarray
    g: np.ndarray
    contexts: np.ndarray
    f: np.ndarray
    words_below: float
    contexts_below: float
    bits: np.ndarray | None = None

    @classmethod
    def of(cls, model: Model, strengths: tuple[float, ...]) -> Lookup:
        levels = model.levels()
        f = [_backed(s) for s in strengths]
        most = F.greatest(*f) if len(f) > 1 else f[0]
        contexts = levels.where("ct + co > 0")
        below = _edge(contexts, most, MOST_CONTEXTS)
        held = contexts.where(most >= below).select("w", *[x.alias(f"f{i}") for i, x in enumerate(f)]).toArrow().sort_by("w")
        matrix = np.stack([held.column(f"f{i}").to_numpy() for i in range(len(f))], axis=1)
        other = max(below, 0.0)  # f of contexts that aren't held is no more
        least = EXCESS - matrix.max(initial=other)  # no context lifts a word of less
        telling = levels.where("known").where(F.col("g") > least)
        edge = min(_edge(telling, F.col("g"), MOST_WORDS), EXCESS - other)  # so that of a word and its context one is held
        words = telling.where(F.col("g") >= edge).select("w", "g").toArrow().sort_by("w")
        return cls(words.column("w").to_numpy(), words.column("g").to_numpy(), held.column("w").to_numpy(), matrix, edge if edge > least else -np.inf, below)

    def word(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """g (minus infinity where it isn't held), and where it is."""
        at = _find(self.words, hashes)
        return np.append(self.g, -np.inf)[at], at < len(self.words)

    def context(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """f by strength (0 where it isn't held), and where it is."""
        at = _find(self.contexts, hashes)
        return np.vstack((self.f, np.zeros((1, self.f.shape[1]))))[at], at < len(self.contexts) if self.contexts_below > -np.inf else np.ones(len(at), dtype=bool)

    def may_exceed(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Whether a word may exceed after a context by backoff, whatever is held."""
        g, _ = self.word(word)
        f, known = self.context(before)
        top = np.where(known, f.max(axis=1), max(self.contexts_below, 0.0))
        return np.maximum(g, self.words_below) + top > EXCESS

    def differs(self, keys: np.ndarray) -> np.ndarray:
        """Whether pairs may differ (by key)."""
        part, *places = _places(keys, self.bits.shape)
        found = np.ones(len(keys), dtype=bool)
        for p in places:
            found &= (self.bits[part, p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


def _pair_key(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(mix(before.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + word.view(np.uint64))


def _places(keys: np.ndarray, shape: tuple[int, int]) -> list[np.ndarray]:
    """The part of a Bloom filter of so many parts and bytes (powers of two) that a key falls in, and its bits there."""
    again = mix(keys ^ np.uint64(0x5851F42D4C957F2D))
    low, high = again & np.uint64(0xFFFFFFFF), (again >> np.uint64(32)) | np.uint64(1)
    return [keys >> np.uint64(64 - (shape[0].bit_length() - 1)) if shape[0] > 1 else np.zeros(len(keys), dtype=np.uint64), *((low + np.uint64(k) * high) & np.uint64(8 * shape[1] - 1) for k in range(4))]


def _bloom(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of ``keys(key)``, its parts filled by tasks: some 16 bits a key, MOST_BITS at most."""
    n = keys.count()
    bits = min(max(1 << (16 * n).bit_length(), 1 << 13), MOST_BITS)
    shape = (min(4096, bits >> 13), bits // 8 // min(4096, bits >> 13))
    shift = 64 - (shape[0].bit_length() - 1)

    def fill(table: pa.Table) -> pa.Table:
        part, *places = _places(table.column("key").to_numpy().view(np.uint64), shape)
        held = np.zeros(8 * shape[1], dtype=bool)
        for p in places:
            held[p] = True
        return pa.table({"part": pa.array([int(part[0])], type=pa.int32()), "bits": pa.array([np.packbits(held, bitorder="little").tobytes()], type=pa.binary())})

    part = F.shiftrightunsigned("key", shift).cast("int") if shape[0] > 1 else F.lit(0)
    got = keys.select("key", part.alias("part")).groupBy("part").applyInArrow(fill, "part int, bits binary").toArrow()
    out = np.zeros(shape, dtype=np.uint8)
    for p, b in zip(got.column("part").to_pylist(), got.column("bits").to_pylist(), strict=True):
        out[p] = np.frombuffer(b, dtype=np.uint8)
    return out


def _differing(model: Model, lookup: Lookup) -> DataFrame:
    """``(key, t, o, pt, po, g, ct, tt, co, oo)`` of the counted pairs that may exceed: toxic ones, and ordinary ones that backoff alone would let exceed."""
    shared = model.pairs.sparkSession.sparkContext.broadcast(lookup)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, w, t = (b.column(c).to_numpy() for c in ("a", "w", "t"))
            keep = np.flatnonzero((t > 0) | shared.value.may_exceed(a, w))
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(keep)) for c in b.columns), pa.array(_pair_key(a[keep], w[keep]).view(np.int64))], names=["a", "w", "t", "o", "key"])

    levels = model.levels()
    rows = model.pairs.select("a", "w", "t", "o").mapInArrow(run, "a long, w long, t long, o long, key long")
    rows = rows.join(levels.select("w", "pt", "po", "g"), "w").join(levels.select(F.col("w").alias("a"), "ct", "tt", "co", "oo"), "a")
    out = save(rows.select("key", "t", "o", "pt", "po", "g", "ct", "tt", "co", "oo"), "toxicity-differing")
    shared.destroy()
    return out


def _differences(model: Model, strengths: tuple[float, ...]) -> DataFrame:
    """``(key, v0, ...)``: by strength, what a counted pair exceeds by less what backoff alone would; pairs without a difference are left out."""
    t, o = (F.col(k) - _less(k, c.off) for k, c in (("t", model.toxic_class), ("o", model.ordinary_class)))
    out = []
    for i, s in enumerate(strengths):
        own = F.log((t + (F.col("tt") + s) * F.col("pt")) / (F.col("ct") + s)) - F.log((o + (F.col("oo") + s) * F.col("po")) / (F.col("co") + s))
        over = lambda x: F.greatest(x - EXCESS, F.lit(0.0))
        out.append((over(own) - over(_backed(s) + F.col("g"))).alias(f"v{i}"))
    rows = model.differing.select("key", *out)
    return rows.where(" OR ".join(f"v{i} <> 0" for i in range(len(strengths))))


#: Kinds of rows: a text with what was settled; a differing pair, a context or a word that is to be looked up.
TEXT, PAIR, CONTEXT, LEXICAL = 0, 1, 2, 3


def _exceeding(texts: DataFrame, model: Model, strengths: tuple[float, ...], lookup: Lookup | None = None) -> DataFrame:
    """Of ``texts(text, *others)``: ``others``, number of words, and by strength the sum ``x0, ...`` of what its words exceed by."""
    spark, many = texts.sparkSession, len(strengths)
    lookup = lookup or Lookup.of(model, strengths)
    differences = _differences(model, strengths)
    lookup.bits = _bloom(differences.select("key"))
    shared = spark.sparkContext.broadcast(lookup)
    others = [c for c in texts.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = shared.value, TaskContext.get().partitionId() << 36
        for b in batches:
            for at, some in slices(b.column(0)):
                yield from _settle(held, some, number, [b.column(1 + c).slice(at, len(some)) for c in range(len(others))], others, many)
                number += len(some)

    kinds = {f.name: f.dataType.simpleString() for f in texts.schema.fields}
    schema = ", ".join(["k long", "kind int", "key long", "m long", "n_words long", *(f"h{i} double" for i in range(many)), *(f"`{c}` {kinds[c]}" for c in others)])
    rows = texts.select("text", *others).mapInArrow(run, schema)
    v = [f"v{i}" for i in range(many)]
    table = differences.select(F.lit(PAIR).alias("kind"), "key", *v)
    levels, backed = model.levels(), [_backed(s) for s in strengths]
    if lookup.contexts_below > -np.inf:
        rest = levels.where("ct + co > 0").where((F.greatest(*backed) if many > 1 else backed[0]) < lookup.contexts_below)
        table = table.unionByName(rest.select(F.lit(CONTEXT).alias("kind"), F.col("w").alias("key"), *[x.alias(c) for x, c in zip(backed, v, strict=True)]))
    if lookup.words_below > -np.inf:
        table = table.unionByName(levels.where("known").where(F.col("g") < lookup.words_below).select(F.lit(LEXICAL).alias("kind"), F.col("w").alias("key"), *[F.col("g").alias(c) for c in v]))
    found = rows.join(table, ["kind", "key"], "left")
    # a context that wasn't counted has f = 0; a word that no class counted says nothing
    over = [F.when(F.col("kind") == TEXT, F.col(f"h{i}")).when(F.col("kind") == PAIR, F.col("m") * F.coalesce(f"v{i}", F.lit(0.0)))
            .when((F.col("kind") == LEXICAL) & F.col(f"v{i}").isNull(), 0.0)
            .otherwise(F.col("m") * F.greatest(F.col(f"h{i}") + F.coalesce(f"v{i}", F.lit(0.0)) - EXCESS, F.lit(0.0))) for i in range(many)]
    own = [F.first(F.when(F.col("kind") == TEXT, F.col(c)), ignorenulls=True).alias(c) for c in others]
    return found.groupBy("k").agg(*own, F.max("n_words").alias("n_words"), *[F.sum(x).alias(f"x{i}") for i, x in enumerate(over)]).drop("k")


def _settle(held: Lookup, texts: list[bytes], number: int, given: list[pa.Array], names: list[str], many: int) -> Iterator[pa.RecordBatch]:
    """A row for each text with the sums that the lookup settles, then one for each thing of a text that it doesn't."""
    w, before, word = _words(texts)
    g, is_word = held.word(word)
    x = np.zeros((len(texts), many))
    todo = []

    def ask(kind: int, at: np.ndarray, key: np.ndarray, h: np.ndarray) -> None:
        rows, n = _distinct(np.stack((w.doc[at].astype(np.int64), key.view(np.int64), *np.ascontiguousarray(h).T.view(np.int64)), axis=1))
        todo.append((np.full(len(rows), kind), rows[:, 0], rows[:, 1], n, np.ascontiguousarray(rows[:, 2:]).view(np.float64)))

    at = np.flatnonzero(is_word)
    f, known = held.context(before[at])
    sure = at[known]
    for i in range(many):
        x[:, i] = np.bincount(w.doc[sure], weights=np.maximum(f[known, i] + g[sure] - EXCESS, 0), minlength=len(texts))
    unsure = at[~known]
    unsure = unsure[g[unsure] + max(held.contexts_below, 0.0) > EXCESS]
    if len(unsure):
        ask(CONTEXT, unsure, before[unsure], np.repeat(g[unsure, None], many, axis=1))
    if held.words_below > -np.inf:
        at = np.flatnonzero(~is_word)
        f, known = held.context(before[at])
        few = f.max(axis=1, initial=-np.inf) + held.words_below > EXCESS
        if few.any():
            ask(LEXICAL, at[few], word[at[few]], f[few])
    keys = _pair_key(before, word)
    at = np.flatnonzero(held.differs(keys))
    if len(at):
        ask(PAIR, at, keys[at], np.zeros((len(at), many)))
    own = number + np.arange(len(texts))
    schema = ["k", "kind", "key", "m", "n_words", *(f"h{i}" for i in range(many)), *names]
    # a text's own row goes to any task
    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(texts), TEXT, dtype=np.int32)), pa.array(mix(own.astype(np.uint64)).view(np.int64)), pa.array(np.ones(len(texts), dtype=np.int64)), pa.array(np.diff(w.first).astype(np.int64)), *(pa.array(x[:, i]) for i in range(many)), *given], names=schema)
    for kind, doc, key, n, h in todo:
        yield pa.RecordBatch.from_arrays([pa.array(number + doc), pa.array(kind.astype(np.int32)), pa.array(key), pa.array(n), pa.nulls(len(doc), pa.int64()), *(pa.array(h[:, i]) for i in range(many)), *(pa.nulls(len(doc), c.type) for c in given)], names=schema)


def _chosen(docs: DataFrame, named: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``(text, z)`` of all documents, and ``(z, label, curve, rows)`` of those that are learned from: one text an id, and of copies with one label, if counted, one id.

    Texts go by two hashes here, so that none is moved.
    """
    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = own.withColumn("h", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit("copy"), "text")).withColumn("z", F.xxhash64("_id", "h", "h2"))
    # all copies of a text fall on one side
    marks = own.select("_id", "h", "h2", "z", (uniform(F.col("text"), F.lit("curve")) < CURVE_SHARE).alias("curve")).join(named, "_id")
    marks = marks.groupBy("_id", "label", "h", "h2", "z", "curve").agg(F.count("*").alias("rows"))
    marks = marks.groupBy("_id", "label").agg(F.min(F.struct("h", "h2", "z", "curve", "rows")).alias("s")).select("_id", "label", "s.*")
    counted = marks.where("NOT curve").groupBy("label", "h", "h2").agg(F.min(F.struct("z", "rows")).alias("s")).select("s.z", "label", F.lit(False).alias("curve"), "s.rows")
    return own.select("text", "z"), save(counted.unionByName(marks.where("curve").select("z", "label", "curve", "rows")), "toxicity-chosen")


def _texts(own: DataFrame, chosen: DataFrame) -> DataFrame:
    """``(label, text)`` of chosen documents, each once; only rows that are there more than once are moved."""
    pick = lambda which: own.join(F.broadcast(chosen.where(which).select("z", "label")), "z")
    out = pick("rows = 1").select("label", "text")
    if chosen.where("rows > 1").limit(1).count():
        out = out.unionByName(pick("rows > 1").distinct().select("label", "text"))
    return out


def _add(many: int, weights: dict[int, float], b: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Loss, gradient and second derivatives of each curve, summed over a task's rows ``(label, n_words, x0, ...)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((many, 21))
        for r in batches:
            y, words = r.column("label").to_numpy() == TOXIC, r.column("n_words").to_numpy().astype(float)
            weight = np.where(y, weights[TOXIC], weights[ORDINARY])
            for i in range(many):
                d = _design(words, r.column(f"x{i}").to_numpy() / np.maximum(words, 1))
                z = d @ b[i]
                p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
                total[i, 0] += weight @ np.logaddexp(0, np.where(y, -z, z))
                total[i, 1:5] += d.T @ (weight * (p - y))
                total[i, 5:] += ((d * (weight * p * (1 - p))[:, None]).T @ d).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], type=pa.int32()), pa.array([total.ravel()], type=pa.list_(pa.float64()))], names=["part", "v"])

    return run


def train(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int | None = None) -> Model:
    """Fit on all labelled documents (for trials, on ``sample`` of each class, those of least hash).

    An id that labels name more than once is toxic if any row says so; of documents that share an id one
    is used, by hash of its text. The shared counts come from all of ``corpus`` (``docs`` if none is given). With no
    labelled row of a class, its model is the shared one and the score the smoothed rate of the labels.
    """
    ship(docs.sparkSession)
    named = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.when(F.col(label_col) == TOXIC, TOXIC).otherwise(ORDINARY)).alias("label"))
    rates = {r["label"]: r["n"] for r in named.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if sample is not None:
        order = [F.xxhash64("_id", F.lit("toxicity")), F.col("_id")]
        named = named.where(F.col("label") == TOXIC).orderBy(*order).limit(sample).unionByName(named.where(F.col("label") == ORDINARY).orderBy(*order).limit(sample))
    own, chosen = _chosen(docs, named, id_col, text_col)
    counted = _texts(own, chosen.where("NOT curve")).mapInArrow(_count_pairs, "a long, w long, t long, o long")
    model = _counted(counted.groupBy("a", "w").agg(F.sum("t").alias("t"), F.sum("o").alias("o")), shared_counts(docs if corpus is None else corpus, text_col))
    lookup = Lookup.of(model, STRENGTHS)
    model.differing = _differing(model, lookup)
    features = save(_exceeding(_texts(own, chosen.where("curve")), model, STRENGTHS, lookup), "toxicity-curve")
    drop_saved(chosen)
    seen = {r["label"]: r["n"] for r in features.groupBy("label").agg(F.count("*").alias("n")).collect()}
    # the classes may be sampled at different rates
    weights = {k: rates.get(k, 0) / max(seen.get(k, 0), 1) for k in (TOXIC, ORDINARY)}
    mean = sum(weights[k] * n for k, n in seen.items()) / max(sum(seen.values()), 1)
    weights = {k: w / max(mean, 1e-9) for k, w in weights.items()}
    if len(seen) < 2:  # the smoothed rate of the labels there are
        model.curve = np.zeros(4)
        if seen:
            n = {k: weights[k] * seen.get(k, 0) for k in weights}
            model.curve[0] = np.log((n[TOXIC] + 0.5) / (n[ORDINARY] + 0.5))
        else:
            model.curve[0] = -3.0
    else:
        sums = lambda b: tree_sum(features.mapInArrow(_add(len(STRENGTHS), weights, b), "part int, v array<double>"))
        b, loss = _logistic(sums, len(STRENGTHS))
        model.curve, model.strength = b[int(np.argmin(loss))], STRENGTHS[int(np.argmin(loss))]
    drop_saved(features)
    return model


def score(docs: DataFrame, model: Model, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """``id_cols`` and score in (0, 1) for every row.

    Null and empty texts are scored as texts without words; texts of any length whole. Repeated rows
    score alike; other columns are not read, so their names can't clash.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col(text_col).alias("text"), *[F.col(c).alias(f"_own{i}") for i, c in enumerate(id_cols)])
    got = _exceeding(texts, model, (model.strength,))
    size, ratio = F.log1p(F.col("n_words")) / 6, 10 * F.col("x0") / F.greatest(F.col("n_words"), F.lit(1))
    c = [F.lit(float(x)) for x in model.curve]
    z = c[0] + c[1] * ratio + c[2] * size + c[3] * ratio * size
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), z))))
    return got.select(*[F.col(f"_own{i}").alias(c) for i, c in enumerate(id_cols)], F.round(p, 9).alias("score"))
