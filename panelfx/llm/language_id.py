"""Language ID as multilingual mixture inference.

Each language has a hashed byte n-gram model, counted over all training rows. A text's words get a
likelihood under each language from their n-grams; expectation-maximisation estimates the proportions
in which the languages make up the text. The language set is selected among the nested sets of the
largest proportions by penalised likelihood (BIC, one parameter a language beyond the first).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .textvec import slices

ORDERS = (1, 2, 3, 4)
BUCKET_BITS = 16
#: The broadcast model has at most this many languages times 2**BUCKET_BITS floats.
MOST_LANGUAGES = 400
#: Languages whose counts a task holds at a time; bytes and words whose likelihoods are computed at a time.
MOST_HELD, BYTES_AT_ONCE, WORDS_AT_ONCE = 32, 1 << 20, 1 << 17
#: A language below this share of a text's mixture isn't tried in a set.
LEAST_SHARE = 0.01
UNDETERMINED = "und"
_TABLE = bytes(32 if (c < 65 or 90 < c < 97 or 122 < c < 128) else c for c in range(256))
_SALT = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)


@dataclass
class Model:
    languages: list[str]
    loglik: np.ndarray  # (2**BUCKET_BITS, languages), float32


def _clean(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts in lower case, ASCII other than letters blanked, so many blanks before each that no n-gram reaches into another; and where each ends."""
    low = [t.decode("utf-8", "replace").lower().encode("utf-8").translate(_TABLE) for t in texts]
    gap = b"\x20" * (max(ORDERS) - 1)
    return np.frombuffer(gap + gap.join(low) + gap, dtype=np.uint8), np.cumsum([len(t) + len(gap) for t in low])


def _grams(b: np.ndarray) -> Iterator[np.ndarray]:
    """For each order, the bucket of the n-gram that starts at each byte but the last three."""
    n = len(b) - max(ORDERS) + 1
    code = np.zeros(n, dtype=np.uint32)
    for order in ORDERS:
        code = code * np.uint32(257) + b[order - 1 : order - 1 + n].astype(np.uint32)
        yield (((code + np.uint32(order)) * np.uint32(_SALT[order - 1])) ^ (code >> np.uint32(15))) * np.uint32(0x9E3779B1) >> np.uint32(32 - BUCKET_BITS)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (language, text) to (language, bucket, n), which hold every bucket once for each time that the task passed the language on."""
    seen: dict[str, np.ndarray] = {}

    def passed(lang: str) -> pa.RecordBatch:
        n = seen.pop(lang)
        k = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k.astype(np.int32)), pa.array(n[k])], names=["lang", "bucket", "n"])

    for batch in batches:
        langs = batch.column(0).to_pylist()
        for at, texts in slices(batch.column(1)):
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(langs[at : at + len(texts)], texts, strict=True):
                by.setdefault(lang, []).append(text)
            for lang, own in by.items():
                if lang not in seen and len(seen) >= MOST_HELD:
                    yield passed(next(iter(seen)))
                n = seen.setdefault(lang, np.zeros(1 << BUCKET_BITS, dtype=np.int64))
                b, _ = _clean(own)
                for c in range(0, len(b) - max(ORDERS) + 1, BYTES_AT_ONCE):
                    part = b[c : c + BYTES_AT_ONCE + max(ORDERS) - 1]
                    m = len(part) - max(ORDERS) + 1
                    blank, run = part[:m] == 32, (part[:m] == 32) & (part[1 : m + 1] == 32)
                    for order, g in zip(ORDERS, _grams(part), strict=True):
                        n += np.bincount(g[~blank] if order == 1 else g[~run], minlength=1 << BUCKET_BITS)
    for lang in list(seen):
        yield passed(lang)


def train(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", smoothing: float = 0.5) -> Model:
    """Count all rows with a language. The result is bounded by languages times buckets; too many languages are an error before any text is read."""
    ship(rows.sparkSession)
    named = rows.where(F.col(lang_col).isNotNull())
    langs = sorted(r[0] for r in named.select(lang_col).distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: raise MOST_LANGUAGES if executors can hold the model")
    n = np.zeros((1 << BUCKET_BITS, max(len(langs), 1)))
    if langs:
        counts = named.select(lang_col, text_col).mapInArrow(_count, "lang string, bucket int, n long")
        found = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
        column = pc.index_in(found.column("lang"), value_set=pa.array(langs)).to_numpy()
        n[found.column("bucket").to_numpy(), column] = found.column("n").to_numpy()
    shared = n.sum(axis=1, keepdims=True)
    shared = (shared + 1) / (shared.sum() + len(shared))
    prior = smoothing * len(n) * 0.01
    p = (n + prior * shared) / (n.sum(axis=0, keepdims=True) + prior)
    return Model(langs, np.log(p).astype(np.float32))


def _sums(like: np.ndarray, doc: np.ndarray, out: np.ndarray, value) -> np.ndarray:
    """Add ``value(rows)`` of blocks of words into their documents' rows of ``out``."""
    for a in range(0, len(like), WORDS_AT_ONCE):
        own = doc[a : a + WORDS_AT_ONCE]
        starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        out[own[starts]] += np.add.reduceat(value(like[a : a + WORDS_AT_ONCE], own), starts, axis=0)
    return out


def _em(like: np.ndarray, doc: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihoods of documents; ``like``: (words, languages), ``doc``: each word's document, in order,
    ``allowed``: (documents, languages). A document stops when its own proportions do, whatever its neighbours' need."""
    pi = allowed / allowed.sum(axis=1, keepdims=True)
    n = np.maximum(np.bincount(doc, minlength=len(pi)), 1)[:, None]
    active = np.ones(len(pi), dtype=bool)
    rows, owner = like, doc
    for _ in range(rounds):

        def parts(block: np.ndarray, own: np.ndarray) -> np.ndarray:
            joint = block * pi[own]
            return joint / (joint.sum(axis=1, keepdims=True) + 1e-30)

        new = _sums(rows, owner, np.zeros_like(pi), parts) / n
        moved = np.abs(new - pi).max(axis=1)
        pi[active] = new[active]
        active &= moved >= 1e-3
        if not active.any():
            break
        left = active[owner]
        if left.sum() < 0.6 * len(left):
            rows, owner = rows[left], owner[left]
    total = _sums(like, doc, np.zeros(len(pi)), lambda block, own: np.log((block * pi[own]).sum(axis=1) + 1e-30))
    return pi, total


def _words(b: np.ndarray, ends: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Likelihoods of each word under each language, relative to the best (float32), and the number of its text.

    N-grams are scored by chunks of bytes, so that a very long text costs memory by its words only.
    """
    n = len(b) - max(ORDERS) + 1
    blank = b[:n] == 32
    run = blank & (b[1 : n + 1] == 32)  # blanks before blanks say nothing
    begin = np.flatnonzero(blank[:-1] & ~blank[1:])  # a word's n-grams start at the blank before it
    like = np.empty((len(begin), len(model.languages)), dtype=np.float32)
    done = 0
    while done < len(begin):
        a = begin[done]
        last = max(int(np.searchsorted(begin, a + BYTES_AT_ONCE)), done + 1)
        z = begin[last] if last < len(begin) else n
        part = b[a : z + max(ORDERS) - 1]
        log = np.zeros((z - a, len(model.languages)), dtype=np.float32)
        for order, g in zip(ORDERS, _grams(part), strict=True):
            own = model.loglik[g]
            own[blank[a:z] if order == 1 else run[a:z]] = 0
            log += own
        # n-grams of four overlapping orders count each letter about four times
        word = np.add.reduceat(log, begin[done:last] - a, axis=0) / len(ORDERS)
        like[done:last] = np.exp(word - word.max(axis=1, keepdims=True))
        done = last
    return like, np.searchsorted(ends, begin, side="right")


def infer(texts: list[bytes], model: Model, rounds: int = 20, penalty: float = 0.5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: whether it has a letter, the selected proportions, and the number of languages selected."""
    k = len(model.languages)
    props, chosen = np.zeros((len(texts), k)), np.zeros(len(texts), dtype=np.int64)
    letters = np.zeros(len(texts), dtype=bool)
    like, owner = _words(*_clean(texts), model) if k else (np.zeros((0, 1)), np.zeros(0))
    if not len(like):
        return letters, props, chosen
    has, doc = np.unique(owner, return_inverse=True)
    words = np.bincount(doc)
    pi, _ = _em(like, doc, np.ones((len(has), k)), rounds)
    order = np.argsort(-pi, axis=1, kind="stable")
    best, size = np.zeros_like(pi), np.ones(len(has), dtype=np.int64)
    best[np.arange(len(has)), order[:, 0]] = 1
    ranked = np.take_along_axis(pi, order, axis=1)
    open_ = np.flatnonzero(ranked[:, min(1, k - 1)] >= LEAST_SHARE) if k > 1 else np.zeros(0, dtype=np.int64)
    if len(open_):
        rows = np.isin(doc, open_)
        sub, sub_doc = like[rows], np.searchsorted(open_, doc[rows])
        score = _sums(sub, sub_doc, np.zeros((len(open_), k)), lambda block, own: np.log(block + 1e-30))
        top = score.max(axis=1)
        best[open_] = 0
        best[open_, score.argmax(axis=1)] = 1
        for s in range(2, k + 1):
            # a text tries the sets that its own proportions suggest
            stays = ranked[open_, s - 1] >= LEAST_SHARE
            if not stays.any():
                break
            rows = stays[sub_doc]
            sub, sub_doc, open_, top = sub[rows], (np.cumsum(stays) - 1)[sub_doc[rows]], open_[stays], top[stays]
            allowed = np.zeros((len(open_), k))
            np.put_along_axis(allowed, order[open_, :s], 1, axis=1)
            p, ll = _em(sub, sub_doc, allowed, rounds)
            ll -= penalty * (s - 1) * np.log(np.maximum(words[open_], 2))
            better = ll > top
            top = np.where(better, ll, top)
            best[open_[better]], size[open_[better]] = p[better], s
    props[has], chosen[has] = best, size
    letters[has] = True
    return letters, props, chosen


def detect(docs: DataFrame, model: Model, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """``id_cols`` (any columns to carry, the text too) and lang_pred, score, n_langs, mixture (language to proportion) for every row.

    A text that is null or has no letter is ``und`` with score 0 and an empty mixture; so is every
    text if the model has no language. Very long texts are inferred whole, with memory for a few numbers a word and
    language. A text's result doesn't depend on the rows that it is read with. Ties go to the language that sorts
    first. Other columns are ignored; ``id_cols`` may not be called as a result is.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in id_cols)
    carried = text_col in id_cols  # the text is sent to the workers once
    text_at = id_cols.index(text_col) if carried else len(id_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at, texts in slices(batch.column(text_at)):
                has, props, chosen = infer(texts, m)
                lang, score, mixture = [], [], []
                for i, t in enumerate(texts):
                    if has[i] and any(c.isalpha() for c in t.decode("utf-8", "replace")):
                        k = int(props[i].argmax())
                        lang.append(m.languages[k])
                        score.append(round(min(1.0, float(props[i, k])), 9))
                        mixture.append([(m.languages[j], float(props[i, j])) for j in np.flatnonzero(props[i] > 1e-6)])
                    else:
                        lang.append(UNDETERMINED)
                        score.append(0.0)
                        mixture.append([])
                        chosen[i] = 0
                ids = [batch.column(c).slice(at, len(texts)) for c in range(len(id_cols))]
                yield pa.RecordBatch.from_arrays(
                    [*ids, pa.array(lang, pa.string()), pa.array(score), pa.array(chosen.astype(np.int32)), pa.array(mixture, pa.map_(pa.string(), pa.float64()))],
                    names=[*id_cols, "lang_pred", "score", "n_langs", "mixture"],
                )

    sent = docs.select(*id_cols) if carried else docs.select(*id_cols, text_col)
    return sent.mapInArrow(run, f"{types}, lang_pred string, score double, n_langs int, mixture map<string,double>")
