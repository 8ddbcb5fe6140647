"""Quality classifier: a factorisation machine on hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)), linear in the
document's distinct words. The model is fitted on a bounded sample of labelled rows; documents are
scored whole, on the executors, with a model of fixed size. The metadata is the document's declared number
of characters and how far it is from the text's own; a missing number is a value of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import labelled_texts
from .textvec import mix, per_doc_sum, slices, words_of

WORD_BITS, BINS, FACTORS = 13, 10, 8
#: Labelled documents used in fitting.
SAMPLE = 12_000
STATS = ("words", "bytes", "mean_word", "distinct", "repeat3", "adjacent", "upper", "digit", "symbol", "mark", "other", "newline", "long_word", "dup_line", "marked_words", "declared", "declared_off")
_CLASS = np.zeros((256, 6))
_CLASS[ord("A") : ord("Z") + 1, 0] = 1
_CLASS[ord("0") : ord("9") + 1, 1] = 1
for _c in b"#*$%&|<>":
    _CLASS[_c, 2] = 1
for _c in b"!?.,;:":
    _CLASS[_c, 3] = 1
for _c in b"{}[]()=_/\\\"'~^@+-`":
    _CLASS[_c, 4] = 1
_CLASS[10, 5] = 1


def describe(texts: list[bytes], declared: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words as (bucket, value, first place of each text) and the statistics of each text; ``declared``: characters, NaN where missing."""
    n = len(texts)
    w = words_of(texts)
    words = np.diff(w.first).astype(float)
    many = np.maximum(words, 1)
    size = np.array([len(t) for t in texts], dtype=float)
    raw = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])[:-1])).astype(np.int64)
    classes = np.stack([np.add.reduceat(_CLASS[:, k][raw], starts) for k in range(_CLASS.shape[1])], axis=1)
    key = w.doc.astype(np.uint64) << np.uint64(WORD_BITS) | w.hash >> np.uint64(64 - WORD_BITS)
    pair, times = np.unique(key, return_counts=True)
    doc, bucket = (pair >> np.uint64(WORD_BITS)).astype(np.int64), (pair & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)
    value = np.log1p(times)
    first = np.searchsorted(doc, np.arange(n + 1))
    norm = np.sqrt(np.maximum(per_doc_sum(value**2, first), 1e-9))
    value = value / norm[doc]

    def same(h: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Of each text, how many entries occur before within it."""
        full = mix(h ^ mix(owner.astype(np.uint64) + np.uint64(77)))
        _, at = np.unique(full, return_index=True)
        repeat = np.ones(len(h))
        repeat[at] = 0
        return np.bincount(owner, weights=repeat, minlength=n)

    h, d = w.hash, w.doc
    inside = d[2:] == d[:-2] if len(d) > 2 else np.zeros(0, dtype=bool)
    three = mix(h[:-2] * np.uint64(3) + mix(h[1:-1]) * np.uint64(5) + h[2:])[inside] if len(d) > 2 else np.zeros(0, dtype=np.uint64)
    next_same = (h[1:] == h[:-1]) & (d[1:] == d[:-1]) if len(h) > 1 else np.zeros(0, dtype=bool)
    declared = np.full(n, np.nan) if declared is None else declared
    known = np.nan_to_num(np.maximum(declared, 0), nan=0.0)
    points = np.add.reduceat((raw & 0xC0 != 0x80).astype(np.int64), starts) - 1.0  # code points, less the blank between texts
    symbol_end = _CLASS[:, 2][w.bytes_[w.start + w.length - 1]] if len(h) else np.zeros(0)
    dup = np.array([_dup_lines(t) for t in texts])
    stats = np.stack(
        [
            np.log1p(words), np.log1p(size), per_doc_sum(w.length.astype(float), w.first) / many,
            1 - same(h, d) / many, same(three, d[2:][inside] if len(d) > 2 else np.zeros(0, dtype=np.int64)) / many,
            np.bincount(d[1:], weights=next_same, minlength=n)[:n] / many if len(h) > 1 else np.zeros(n),
            *(classes[:, k] / np.maximum(size, 1) for k in range(6)),
            per_doc_sum((w.length > 20).astype(float), w.first) / many, dup, per_doc_sum(symbol_end, w.first) / many,
            np.where(np.isnan(declared), -1.0, np.log1p(known)), np.where(np.isnan(declared), -9.0, np.log1p(known) - np.log1p(points)),
        ],
        axis=1,
    )
    return bucket, value, first, stats


def _dup_lines(text: bytes) -> float:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return 1 - len(set(lines)) / len(lines) if lines else 0.0


@dataclass
class Machine:
    edges: np.ndarray  # (statistics, BINS - 1): where bins part
    bias: float
    w: np.ndarray
    v: np.ndarray  # (features, FACTORS)

    def inputs(self, bucket: np.ndarray, value: np.ndarray, first: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All features of each text in one row of (index, value): its words, then a bin of each statistic."""
        n, s = stats.shape
        bins = np.stack([np.searchsorted(self.edges[k], stats[:, k], side="right") for k in range(s)], axis=1)
        own = (1 << WORD_BITS) + np.arange(s) * BINS + bins
        doc = np.concatenate((np.repeat(np.arange(n), np.diff(first)), np.repeat(np.arange(n), s)))
        order = np.argsort(doc, kind="stable")
        index, x = np.concatenate((bucket, own.ravel()))[order], np.concatenate((value, np.full(n * s, 0.5)))[order]
        return index, x, np.searchsorted(doc[order], np.arange(n + 1))

    def raw(self, index: np.ndarray, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        vx = self.v[index] * x[:, None]
        total = np.add.reduceat(vx, first[:-1], axis=0)
        square = np.add.reduceat(vx**2, first[:-1], axis=0)
        return self.bias + np.add.reduceat(self.w[index] * x, first[:-1]) + 0.5 * (total**2 - square).sum(axis=1), total

    def score(self, texts: list[bytes], declared: np.ndarray | None = None) -> np.ndarray:
        z, _ = self.raw(*self.inputs(*describe(texts, declared)))
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(parts: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], y: np.ndarray, epochs: int = 14, seed: int = 3, rate: float = 0.02, shrink: float = 2e-4) -> Machine:
    """Adam on the logistic loss. With one label only, the score is that label's smoothed rate."""
    bucket, value, first, stats = parts
    n, rng = len(y), np.random.default_rng(seed)
    edges = np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T if n else np.zeros((len(STATS), BINS - 1))
    # the tails matter most: the outer bins part at the 2nd and 98th hundredth
    if n:
        edges[:, 0], edges[:, -1] = np.quantile(stats, 0.02, axis=0), np.quantile(stats, 0.98, axis=0)
        edges = np.sort(edges, axis=1)
    size = (1 << WORD_BITS) + len(STATS) * BINS
    m = Machine(edges, float(np.log((y.sum() + 1) / (n - y.sum() + 1))), np.zeros(size), rng.normal(0, 0.02, (size, FACTORS)))
    if not n or y.min() == y.max():
        return m
    index, x, at = m.inputs(bucket, value, first, stats)
    params = [m.w, m.v]
    one, two = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    bias_one = bias_two = 0.0
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(n)
        lr = rate * (1 - epoch / epochs * 0.8)
        for a in range(0, n, 256):
            own = order[a : a + 256]
            sizes = at[own + 1] - at[own]
            places = np.repeat(at[own] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
            f = np.concatenate(([0], np.cumsum(sizes)))
            i, xi = index[places], x[places]
            z, total = m.raw(i, xi, f)
            g = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y[own]) / len(own)
            gx = np.repeat(g, sizes) * xi
            grad_v = gx[:, None] * (np.repeat(total, sizes, axis=0) - m.v[i] * xi[:, None])
            grads = [np.bincount(i, weights=gx, minlength=size) + shrink * m.w, np.stack([np.bincount(i, weights=grad_v[:, k], minlength=size) for k in range(FACTORS)], axis=1) + shrink * m.v]
            step += 1
            for p, gr, o, t in zip(params, grads, one, two, strict=True):
                o += 0.1 * (gr - o)
                t += 0.001 * (gr**2 - t)
                p -= lr * (o / (1 - 0.9**step)) / (np.sqrt(t / (1 - 0.999**step)) + 1e-8)
            bias_one += 0.1 * (g.sum() - bias_one)
            bias_two += 0.001 * (g.sum() ** 2 - bias_two)
            m.bias -= lr * (bias_one / (1 - 0.9**step)) / (np.sqrt(bias_two / (1 - 0.999**step)) + 1e-8)
    return m


def _declared(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)


def _size(docs: DataFrame, size_col: str | None) -> Column:
    """The declared number of characters, null without such a column."""
    return (F.col(size_col) if size_col in docs.columns else F.lit(None)).cast("double").alias("_size")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, size_col: str | None = "n_chars") -> Machine:
    """Fit on at most ``sample`` labelled documents (one row an id); their features come to the driver."""
    ship(docs.sparkSession)
    rows = labelled_texts(docs.select(id_col, text_col, _size(docs, size_col)), labels, id_col, text_col, label_col, sample, ("_size",))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in slices(b.column(2)):
                bucket, value, first, stats = describe(texts, _declared(b.column(3).slice(at, len(texts))))
                cut = pa.array(first.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(texts)), b.column(1).slice(at, len(texts)), pa.ListArray.from_arrays(cut, pa.array(bucket.astype(np.int16))), pa.ListArray.from_arrays(cut, pa.array(value.astype(np.float32))), pa.array(list(stats))],
                    names=["k", "label", "bucket", "value", "stats"],
                )

    described = rows.select(F.xxhash64("_id").alias("k"), "label", "_text", "_size")
    got = described.mapInArrow(run, "k long, label int, bucket array<smallint>, value array<float>, stats array<double>").toArrow()
    got = got.sort_by("k").combine_chunks()
    if not got.num_rows:
        none = np.zeros(0, dtype=np.int64)
        return fit((none, none.astype(float), np.zeros(1, dtype=np.int64), np.zeros((0, len(STATS)))), np.zeros(0))
    sizes = np.array([len(x) for x in got.column("bucket").to_pylist()])
    flat = lambda c: np.concatenate([np.asarray(x) for x in got.column(c).to_pylist()])
    parts = flat("bucket").astype(np.int64), flat("value").astype(float), np.concatenate(([0], np.cumsum(sizes))), np.array(got.column("stats").to_pylist())
    return fit(parts, got.column("label").to_numpy().astype(float))


def score(docs: DataFrame, machine: Machine, id_cols: list[str], text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """``id_cols`` and score in (0, 1) for every row.

    Null and empty texts are scored as texts without words. Repeated rows score alike. No column but the
    text and the declared size is read, so names can't clash; an id column may not be called ``score``.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in id_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in slices(b.column(len(id_cols))):
                ids = [b.column(c).slice(at, len(texts)) for c in range(len(id_cols))]
                found = shared.value.score(texts, _declared(b.column(len(id_cols) + 1).slice(at, len(texts))))
                yield pa.RecordBatch.from_arrays([*ids, pa.array(np.round(found, 9))], names=[*id_cols, "score"])

    return docs.select(*id_cols, text_col, _size(docs, size_col)).mapInArrow(run, f"{types}, score double")
