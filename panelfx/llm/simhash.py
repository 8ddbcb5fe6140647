"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint has eight positional bytes. Two fingerprints at Hamming distance 3 or less differ in
at most three bytes, so they share at least five positional bytes: the guaranteed minimum. Of any five
positions three lie in one half, so the index posts every distinct fingerprint under the eight triples of
positions within a half, and each such pair meets in a list. Within a list the shared positional bytes are tallied
per pair, pairs with five or more are retained, and a bit count verifies them. A pair that meets in
several lists is reported by the first triple that it shares.

Lists of more than LONG fingerprints are split before any task holds them: their members are posted again under
each set of five positions that holds the triple. Short lists are compared pair by pair; long ones are searched breadth
first and yield a spanning forest, never all pairs, with bit-flip probing where even
one-against-the-rest comparison would be slow. A list of five positions has at most 2**24 members (three free bytes).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import drop_saved, save
from .components import connected_components

BITS, MAX_BITS_APART, BYTES = 64, 3, 8
SEED = 42
#: Positional bytes that a pair shares at least.
LEAST_SHARED = BYTES - MAX_BITS_APART
TRIPLES = [t for half in (range(4), range(4, 8)) for t in combinations(half, 3)]
FIVES = list(combinations(range(BYTES), LEAST_SHARED))
SETS = TRIPLES + FIVES
MASKS = np.array([sum(0xFF << (8 * p) for p in s) for s in SETS], dtype=np.uint64)
#: Lists up to SHORT are compared pair by pair; beyond PROBE, members are found by flipping bits; beyond LONG, a triple's list is split.
SHORT, PROBE, LONG = 32, 20_000, 4_096


def fingerprint(text: str | None, width: int = 3, seed: int = SEED) -> int:
    """SimHash of the text's shingles (repeats count); 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < width:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(g, seed) for g in grams], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(h), 1 << 15):
        part = h[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(id, fp)`` for every row; fp is the 64-bit fingerprint as a signed long."""
    return _with_fingerprint(docs.select(id_col, text_col), text_col, width, "fp").select(id_col, "fp")


def _with_fingerprint(docs: DataFrame, text_col: str, width: int, name: str) -> DataFrame:
    ship(docs.sparkSession)
    at, names = docs.columns.index(text_col), [*docs.columns, name]
    carried = [k for k, c in enumerate(docs.columns) if c != text_col or name != "fp"]
    types = ", ".join(f"`{docs.columns[k]}` {docs.dtypes[k][1]}" for k in carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), width) for t in b.column(at)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in carried), pa.array(fp)], names=[*(names[k] for k in carried), name])

    return docs.mapInArrow(run, f"{types}, `{name}` long")


def _owner_table() -> np.ndarray:
    """For each bit set of equal positions, the first triple in it, which reports the pair (-1: fewer than the guaranteed minimum)."""
    out = np.full(256, -1, dtype=np.int16)
    for m in range(256):
        if m.bit_count() >= LEAST_SHARED:
            out[m] = next(k for k, t in enumerate(TRIPLES) if all(m >> p & 1 for p in t))
    return out


def _tally(x: np.ndarray) -> np.ndarray:
    """Bit set of the positional bytes in which pairs with these XORs agree."""
    same = x.view(np.uint8).reshape(-1, 8) == 0
    return np.packbits(same, axis=1, bitorder="little")[:, 0]


def _shared(x: np.ndarray) -> np.ndarray:
    """How many positional bytes pairs with these XORs share."""
    return np.bitwise_count(_tally(x))


def _flips(free: int) -> np.ndarray:
    """Every change of one to three of the bits that ``free`` leaves open."""
    bits = [np.uint64(1 << i) for i in range(BITS) if free >> i & 1]
    return np.array([np.bitwise_or.reduce(c) for k in range(1, MAX_BITS_APART + 1) for c in combinations(bits, k)], dtype=np.uint64)


def _forest(fps: np.ndarray, mask: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among the distinct fingerprints of one long list."""
    fps = np.sort(fps)
    left = np.ones(len(fps), dtype=bool)
    flips = _flips(int(~mask & np.uint64(0xFFFFFFFFFFFFFFFF))) if len(fps) > PROBE else None
    child, parent = [], []
    for start in range(len(fps)):
        if not left[start]:
            continue
        left[start] = False
        front = np.array([start])
        while len(front):
            found = []
            for f in front:
                if flips is not None:
                    probe = fps[f] ^ flips
                    at = np.minimum(np.searchsorted(fps, probe), len(fps) - 1)
                    new = np.unique(at[(fps[at] == probe) & left[at] & (_shared(flips) >= LEAST_SHARED)])
                else:
                    rest = np.flatnonzero(left)
                    x = fps[rest] ^ fps[f]
                    rest, x = rest[(kept := _shared(x) >= LEAST_SHARED)], x[kept]
                    new = rest[np.bitwise_count(x) <= MAX_BITS_APART]
                if len(new):
                    left[new] = False
                    child.append(fps[new])
                    parent.append(np.full(len(new), fps[f], dtype=np.uint64))
                    found.append(new)
            front = np.concatenate(found) if found else np.empty(0, dtype=np.int64)
    none = np.empty(0, dtype=np.uint64)
    return (np.concatenate(child), np.concatenate(parent)) if child else (none, none)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(s, fp)`` sorted by list to links ``(u, v)``; a list is held whole."""
    owner = _owner_table()

    def solve(s: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        key = fp & MASKS[s]
        new = np.flatnonzero((s[1:] != s[:-1]) | (key[1:] != key[:-1])) + 1
        starts = np.concatenate(([0], new))
        sizes = np.diff(np.concatenate((starts, [len(fp)])))
        group, size_of = np.repeat(np.arange(len(starts)), sizes), np.repeat(sizes, sizes)
        us, vs = [], []
        brief = np.flatnonzero((size_of >= 2) & (size_of <= SHORT))
        for k in range(1, SHORT):
            i = brief[brief + k < len(fp)]
            i = i[group[i] == group[i + k]]
            if not len(i):
                break
            x = fp[i] ^ fp[i + k]
            shared = _tally(x)
            i, x, shared = i[(kept := np.bitwise_count(shared) >= LEAST_SHARED)], x[kept], shared[kept]
            # a triple's list reports the pairs that it owns, be it whole or split into lists of five
            ok = (np.bitwise_count(x) <= MAX_BITS_APART) & ((owner[shared] == s[i]) | (s[i] >= len(TRIPLES)))
            us.append(fp[i][ok])
            vs.append(fp[i + k][ok])
        for g in np.flatnonzero(sizes > SHORT):
            a = starts[g]
            c, p = _forest(fp[a : a + sizes[g]], MASKS[s[a]])
            us.append(c)
            vs.append(p)
        if us:
            u, v = np.concatenate(us), np.concatenate(vs)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0
    for b in batches:
        s, fp = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        held.append((s, fp))
        rows += len(s)
        if rows < 1 << 16:
            continue
        s, fp = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        key = fp & MASKS[s]
        ends = np.flatnonzero((s[1:] != s[:-1]) | (key[1:] != key[:-1])) + 1
        cut = ends[-1] if len(ends) else 0
        if cut:
            yield from solve(s[:cut], fp[:cut])
        held, rows = [(s[cut:], fp[cut:])], len(s) - cut
    if rows:
        yield from solve(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))


def _posts(fps: DataFrame, sets: range) -> DataFrame:
    """``(s, m, fp)``: each fingerprint under the bytes ``m`` that it has at the positions of each set."""
    each = [F.struct(F.lit(k).cast("short").alias("s"), F.col("fp").bitwiseAND(F.lit(int(MASKS[k].view(np.int64)))).alias("m")) for k in sets]
    return fps.select(*fps.columns, F.explode(F.array(*each)).alias("p")).select(*fps.columns, "p.s", "p.m")


def near_links(distinct_fps: DataFrame, long: int = LONG) -> DataFrame:
    """Links ``(u, v)`` between distinct fingerprints ``fp``: all components of distance 3 or less, not all pairs."""
    ship(distinct_fps.sparkSession)
    fps = distinct_fps.select("fp")
    posts = _posts(fps, range(len(TRIPLES)))
    # at most 8 / long of the fingerprints' number: lists to be split
    heavy = posts.groupBy("s", "m").count().where(F.col("count") > long).select(F.col("s").alias("hs"), F.col("m").alias("hm"), F.lit(True).alias("heavy"))
    marked = posts.join(save(heavy, "simhash-long"), (F.col("s") == F.col("hs")) & (F.col("m") == F.col("hm")), "left").select("s", "m", "fp", F.coalesce("heavy", F.lit(False)).alias("heavy"))
    within = F.array(*[F.array(*[F.lit(len(TRIPLES) + n).cast("short") for n, five in enumerate(FIVES) if set(t) <= set(five)]) for t in TRIPLES])
    mask = F.element_at(F.array(*[F.lit(int(m.view(np.int64))) for m in MASKS]), F.col("s") + 1)
    again = F.when(F.col("heavy"), F.element_at(within, F.col("s") + 1)).otherwise(F.array("s"))
    lists = marked.select(F.explode(again).alias("s"), "fp").withColumn("m", F.col("fp").bitwiseAND(mask))
    lists = lists.repartition("s", "m").sortWithinPartitions("s", "m", "fp").select("s", "fp")
    return lists.mapInArrow(_links, "u long, v long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(id, fp, component_id)`` for every row of ``docs``.

    A null or wordless text has fingerprint zero and is linked like any other. Repeated rows all
    appear. component_id is the least non-null id of the component (null if it has none). Extra
    columns are ignored; an empty table gives an empty result.
    """
    rows = save(fingerprints(docs, id_col, text_col, width), "simhash")
    by_fp = _components(rows, id_col)
    return rows.join(by_fp, "fp").select(id_col, "fp", F.col("rep").alias("component_id"))


def _components(rows: DataFrame, id_col: str) -> DataFrame:
    """``(fp, rep, rep_fp)`` for each fingerprint of ``rows(id, fp)``: its component's least id (nulls last) and the least fingerprint that has it."""
    nodes = save(rows.groupBy("fp").agg(F.min(id_col).alias("rep")), "simhash-fps")
    roots = connected_components(near_links(nodes.select("fp")))
    joined = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "fp")).alias("r"))
    out = save(joined.select("fp", "root").join(least, "root").select("fp", "r.rep", F.col("r.fp").alias("rep_fp")), "simhash-components")
    drop_saved(nodes, roots)
    return out


def hex_fingerprint(col: str = "fp"):
    return F.lower(F.lpad(F.hex(col), 16, "0"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """One row of each near-duplicate component, with all columns of ``docs``: that of the least id, nulls last; of rows that share it that of the
    least fingerprint, and of those the one whose text hashes least (equal texts: any).

    Every row is written once with its fingerprint and a number of its own; the numbers to keep are found from these two and
    the id alone, and joined once. Columns may have any names. An empty table gives an empty result.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    own, text = (names[docs.columns.index(c)] for c in (id_col, text_col))
    numbered = docs.toDF(*names).withColumn("_row", F.monotonically_increasing_id())
    marked = save(_with_fingerprint(numbered, text, width, "_fp"), "simhash-marked")
    rows = marked.select(F.col(own).alias("id"), F.col("_fp").alias("fp"), F.xxhash64(text).alias("h"), F.col("_row").alias("row"))
    least = rows.groupBy("fp", "id").agg(F.min(F.struct("h", "row")).alias("r"))
    reps = _components(rows.select("id", "fp"), "id").where("fp = rep_fp").select("rep", "rep_fp")
    kept = least.join(reps, (F.col("fp") == F.col("rep_fp")) & F.col("id").eqNullSafe(F.col("rep"))).select(F.col("r.row").alias("kept"))
    # a number for nearly every document: joined alike at every size, never broadcast
    kept = save(kept, "simhash-kept").hint("merge")
    return marked.join(kept, F.col("_row") == F.col("kept"), "left_semi").select(*names).toDF(*docs.columns)
