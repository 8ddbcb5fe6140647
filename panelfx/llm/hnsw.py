"""Embedding near-duplicates with hierarchical navigable small-world graphs, one a shard.

Distinct unit vectors are dealt into shards by hash; a shard's size is bounded by bytes. Each shard's graph is
built by insertion, whatever its size: levels are drawn geometrically, rows enter by level and then in blocks, each finds
its neighbours on every level by a beam search of the graph so far (and among its own block), the
diversity rule thins them, and links are mutual. Rows that no path reaches are tied to their nearest reached neighbour.

Every distinct vector then queries every shard: a descent through the upper levels and a beam on the lowest one. A
task gets a shard's index once and queries stream past it. Beams are widened for queries whose whole beam
lies above the threshold, and for the whole task until an audit passes: probes planted at cosines
from the threshold up to 1 from rows of the shard, and sampled queries' hits other than themselves, both against brute
force over the shard. Hits are verified by cosine in double precision. A task returns counts and a spanning
forest of its links, so exact copies or tight clusters never become all pairs; connected components join the forests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import drop_saved, save
from .components import connected_components

THRESHOLD = 0.95
#: Links of a vector on the lowest level and on the upper ones; neighbours considered in building; rows inserted at a time.
LINKS, UPPER_LINKS, CANDIDATES, BLOCK = 24, 12, 48, 256
#: Beams of queries and of the descent; nodes that a query expands at a time.
BEAM, DESCENT, EXPAND = 32, 4, 3
#: Bytes of a shard's vectors in single precision; there are SHARDS shards at least.
SHARD_BYTES, SHARDS = 64 << 20, 6
#: Queries compared at a time.
QUERIES = 2_048
#: Planted probes, sampled queries, and the recall that both must reach.
PROBES, AUDIT, AUDIT_RECALL = 256, 64, 0.99
COUNT, LINK, AUDITED = 0, 1, 2


class Layer:
    """One level: ``rows`` of the shard by place, and each place's neighbours by place (-1 where fewer)."""

    def __init__(self, rows: np.ndarray, links: int) -> None:
        self.rows = rows
        self.near = np.full((len(rows), links), -1, dtype=np.int32)

    def search(self, x: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` best places found for each query from its entry, and similarities (-1 and -2 where fewer); ``x`` by place."""
        m, n = len(q), len(self.rows) if size is None else size
        seen = np.zeros((m, n + 1), dtype=bool)  # the last stands for no neighbour
        ids = np.full((m, beam), -1, dtype=np.int64)
        sims = np.full((m, beam), -2.0, dtype=np.float32)
        done = np.ones((m, beam), dtype=bool)
        ids[:, 0], sims[:, 0], done[:, 0] = entry, np.einsum("md,md->m", x[entry], q), False
        seen[:, n] = seen[np.arange(m), entry] = True
        live = np.arange(m)
        many = min(EXPAND, beam)
        while len(live):
            open_sims = np.where(done[live], -3.0, sims[live])
            go = open_sims.max(axis=1) > -2
            live, open_sims = live[go], open_sims[go]
            if not len(live):
                break
            pick = np.argpartition(-open_sims, many - 1, axis=1)[:, :many] if many < beam else np.tile(np.arange(beam), (len(live), 1))
            chosen = np.take_along_axis(open_sims, pick, axis=1) > -2
            at = np.take_along_axis(ids[live], pick, axis=1)
            done[live[:, None], pick] = True
            cand = self.near[np.where(chosen, at, 0)]
            cand = np.where(chosen[:, :, None] & (cand >= 0), cand, n).reshape(len(live), -1)
            cand.sort(axis=1)
            fresh = ~seen[live[:, None], cand]
            fresh[:, 1:] &= cand[:, 1:] != cand[:, :-1]
            seen[live[:, None], cand] = True
            r, c = np.nonzero(fresh)
            s = np.full(cand.shape, -2.0, dtype=np.float32)
            s[r, c] = np.einsum("kd,kd->k", x[cand[r, c]], q[live[r]])
            all_s, all_i = np.concatenate((sims[live], s), axis=1), np.concatenate((ids[live], np.where(fresh, cand, -1)), axis=1)
            all_d = np.concatenate((done[live], ~fresh), axis=1)
            keep = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
            sims[live], ids[live], done[live] = (np.take_along_axis(z, keep, axis=1) for z in (all_s, all_i, all_d))
        return ids, sims

    def insert(self, x: np.ndarray, entry) -> None:
        """Link all places in order; ``entry(places, size)`` gives the places, of the first ``size``, where their searches begin."""
        n, at = len(self.rows), 0
        while at < n:
            own = np.arange(at, min(n, at + min(BLOCK, max(16, at))))
            q = x[own]
            among = q @ q.T
            np.fill_diagonal(among, -2.0)
            ids, sims = np.tile(own, (len(own), 1)), among
            if at:
                found, s = self.search(x, q, entry(own, at), CANDIDATES, at)
                ids, sims = np.concatenate((found, ids), axis=1), np.concatenate((s, sims), axis=1)
            order = np.argsort(-sims, axis=1, kind="stable")[:, :CANDIDATES]
            ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
            chosen = self._choose(x, own, np.where(sims > -2, ids, -1), self.near.shape[1] * 3 // 4)
            self.near[own, : chosen.shape[1]] = chosen
            r, c = np.nonzero(chosen >= 0)
            self._tie(x, chosen[r, c].astype(np.int64), own[r])
            at = own[-1] + 1

    def _choose(self, x: np.ndarray, own: np.ndarray, cand: np.ndarray, most: int) -> np.ndarray:
        """Of candidates, nearest first: those nearer to the place than to any chosen before, up to two thirds; then the nearest of the
        rest, which keeps tight clusters whole."""
        out = np.full((len(own), most), -1, dtype=np.int32)
        for a in range(0, len(own), 512):
            c = cand[a : a + 512]
            ok = c >= 0
            vec = x[np.maximum(c, 0)]
            to_self = np.einsum("mkd,md->mk", vec, x[own[a : a + 512]])
            among = vec @ vec.transpose(0, 2, 1)
            chosen = np.zeros_like(ok)
            rival = np.full(ok.shape, -2.0, dtype=np.float32)
            count = np.zeros(len(c), dtype=np.int64)
            for k in range(c.shape[1]):
                take = ok[:, k] & (to_self[:, k] > rival[:, k]) & (count < most * 2 // 3)
                chosen[:, k] = take
                count += take
                rival[take] = np.maximum(rival[take], among[take, k])
            more = ok & ~chosen
            more &= np.cumsum(more, axis=1) <= (most - count)[:, None]
            chosen |= more
            r, k = np.nonzero(chosen)
            out[a + r, (np.cumsum(chosen, axis=1) - 1)[r, k]] = c[r, k]
        return out

    def _tie(self, x: np.ndarray, heads: np.ndarray, tails: np.ndarray) -> None:
        """Add the links heads -> tails; places with too many choose anew among the old and the new ones."""
        new = ~(self.near[heads] == tails[:, None]).any(axis=1)
        heads, tails = heads[new], tails[new]
        order = np.argsort(heads, kind="stable")
        heads, tails = heads[order], tails[order]
        most = self.near.shape[1]
        nth = np.arange(len(heads)) - np.searchsorted(heads, heads, side="left")
        at = (self.near[heads] >= 0).sum(axis=1) + nth
        fits = at < most
        self.near[heads[fits], at[fits]] = tails[fits]
        heads, tails, nth = heads[~fits], tails[~fits], nth[~fits]
        if not len(heads):
            return
        full, row = np.unique(heads, return_inverse=True)
        place = np.arange(len(heads)) - np.searchsorted(heads, heads, side="left")
        extra = np.full((len(full), int(place.max()) + 1), -1, dtype=np.int32)
        extra[row, place] = tails
        cand = np.concatenate((self.near[full], extra), axis=1)
        for a in range(0, len(full), 512):
            own, c = full[a : a + 512], cand[a : a + 512]
            s = np.where(c >= 0, np.einsum("mkd,md->mk", x[np.maximum(c, 0)], x[own]), -2.0)
            c = np.take_along_axis(c, np.argsort(-s, axis=1, kind="stable")[:, : 2 * most], axis=1)
            self.near[own] = self._choose(x, own, c, most)

    def reach(self, x: np.ndarray) -> None:
        """Tie every place that no path from the first one reaches to its nearest place that one does."""
        seen = np.zeros(len(self.rows), dtype=bool)
        seen[:1] = True
        front = np.arange(min(1, len(seen)))
        while True:
            while len(front):
                nxt = np.unique(self.near[front])
                front = nxt[(nxt >= 0) & ~seen[np.maximum(nxt, 0)]]
                seen[front] = True
            lost = np.flatnonzero(~seen)
            if not len(lost):
                return
            reached, best, top = np.flatnonzero(seen), np.zeros(len(lost), dtype=np.int64), np.full(len(lost), -3.0)
            for a in range(0, len(reached), 4096):
                s = x[lost] @ x[reached[a : a + 4096]].T
                k = s.argmax(axis=1)
                better = s[np.arange(len(lost)), k] > top
                best[better], top[better] = reached[a + k[better]], s[np.arange(len(lost)), k][better]
            # all that hang on one place form a chain behind it, so that each needs one link only
            order = np.lexsort((-top, best))
            lost, best = lost[order], best[order]
            heads = np.where(np.concatenate(([True], best[1:] != best[:-1])), best, np.concatenate(([0], lost[:-1])))
            self.near = np.concatenate((self.near, np.full((len(seen), 1), -1, dtype=np.int32)), axis=1)
            self.near[heads, -1] = lost
            seen[lost] = True
            front = lost


class Graph:
    """A navigable small-world graph over the rows of ``x`` (unit vectors), lowest layer first."""

    def __init__(self, x: np.ndarray, layers: list[Layer]) -> None:
        self.x = np.ascontiguousarray(x, dtype=np.float32)
        self.layers = layers
        self.at = [self.x[layer.rows] for layer in layers]

    @classmethod
    def build(cls, x: np.ndarray, seed: int = 7) -> Graph:
        x = np.ascontiguousarray(x, dtype=np.float32)
        rng = np.random.default_rng(seed)
        level = np.minimum(np.floor(-np.log(np.maximum(rng.random(len(x)), 1e-12)) / np.log(UPPER_LINKS)), 8).astype(int)
        order = np.lexsort((rng.random(len(x)), -level))  # upper rows enter first: they are where searches begin
        graph = cls(x, [])
        for lev in range(int(level.max(initial=0)), -1, -1):
            rows = order[: int((level >= lev).sum())]
            layer, own = Layer(rows, LINKS if lev == 0 else UPPER_LINKS), x[rows]
            layer.insert(own, lambda places, size, own=own: graph.enter(own[places], 0, size))
            layer.reach(own)
            graph.layers.insert(0, layer)
            graph.at.insert(0, own)
        return graph

    def enter(self, q: np.ndarray, lowest: int, size: int | None = None) -> np.ndarray:
        """Where the descent through the layers above ``lowest`` ends (the best place below ``size``); upper rows come first, so places hold in the layer below."""
        at = np.zeros(len(q), dtype=np.int64)
        for k in range(len(self.layers) - 1, lowest - 1, -1):
            ids, sims = self.layers[k].search(self.at[k], q, at, DESCENT)
            if k == lowest and size is not None:
                ids, sims = np.where(ids < size, ids, 0), np.where(ids < size, sims, -2.0)
            at = np.maximum(ids[np.arange(len(q)), sims.argmax(axis=1)], 0)
        return at

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` best rows found for each query, and their similarities (-1 and -2 where fewer)."""
        ids, sims = self.layers[0].search(self.at[0], q, self.enter(q, 1), beam)
        return np.where(ids >= 0, self.layers[0].rows[np.maximum(ids, 0)], -1), sims

    def rows(self) -> list[list[list[int]]]:
        """Of each row of x, by layer: its place, then its neighbours' places."""
        out: list[list[list[int]]] = [[] for _ in range(len(self.x))]
        for layer in self.layers:
            for place, (m, own) in enumerate(zip(layer.rows.tolist(), layer.near, strict=True)):
                out[m].append([place, *own[own >= 0].tolist()])
        return out

    @classmethod
    def load(cls, x: np.ndarray, rows: list) -> Graph:
        layers = []
        height = np.array([len(r) for r in rows])
        for lev in range(int(height.max(initial=0))):
            members = np.flatnonzero(height > lev)
            own = [rows[m][lev] for m in members.tolist()]
            place = np.array([r[0] for r in own])
            layer = Layer(np.zeros(len(members), dtype=np.int64), max(1, max(len(r) - 1 for r in own)))
            layer.rows[place] = members
            for p, r in zip(place.tolist(), own, strict=True):
                layer.near[p, : len(r) - 1] = r[1:]
            layers.append(layer)
        return cls(x, layers)


def _hits(graph: Graph, q: np.ndarray, threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, row) of what the beams find at or above the threshold; full beams are widened."""
    qs, rows = [], []
    n = len(graph.x)
    step = max(16, min(512, (64 << 20) // max(n, 1)))
    for a in range(0, len(q), step):
        left, width = np.arange(a, min(a + step, len(q))), min(beam, n)
        while len(left):
            ids, sims = graph.search(q[left], width)
            hit = sims >= threshold
            full = hit.all(axis=1) & (width < n)
            r, c = np.nonzero(hit & ~full[:, None])
            qs.append(left[r])
            rows.append(ids[r, c])
            left, width = left[full], min(4 * width, n)
    none = np.empty(0, dtype=np.int64)
    return (np.concatenate(qs), np.concatenate(rows)) if qs else (none, none)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links (a, b) by least labels."""
    names, inverse = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = inverse[: len(a)], inverse[len(a) :]
    root = np.arange(len(names))
    while True:
        low = root.copy()
        np.minimum.at(low, u, root[v])
        np.minimum.at(low, v, root[u])
        low = low[low]
        # what a root has met, all its members take over
        best = np.arange(len(names))
        np.minimum.at(best, root, low)
        low = np.minimum(low, best[root])
        if (low == root).all():
            break
        root = low
    own = root != np.arange(len(names))
    return names[own], names[root[own]]


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that no square is lost."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def build_shard(shard: pd.DataFrame) -> pd.DataFrame:
    """One shard's vectors with their links, in the order of their ids."""
    shard = shard.sort_values("id", ignore_index=True)
    graph = Graph.build(_unit(np.stack(shard["v"].to_numpy()).astype(np.float64)))
    return shard.assign(place=np.arange(len(shard)), near=graph.rows())


class Shard:
    """A loaded shard and the beam that its audit asks for."""

    def __init__(self, ids: np.ndarray, many: np.ndarray, x: np.ndarray, near: list, threshold: float, beam: int) -> None:
        self.ids, self.many, self.x, self.threshold = ids, many, _unit(x), threshold
        self.graph = Graph.load(self.x, near)
        self.near, self.beam, self.audits = threshold - 1e-5, beam, []
        rng = np.random.default_rng(len(ids))
        own = self.x[np.unique(np.linspace(0, len(ids) - 1, min(PROBES, len(ids))).astype(int))]
        aside = rng.normal(size=own.shape)
        aside -= np.einsum("md,md->m", aside, own)[:, None] * own
        size = np.linalg.norm(aside, axis=1, keepdims=True)
        cos = (threshold + (1 - threshold) * rng.random(len(own)))[:, None]
        planted = np.where(size > 1e-9, cos * own + np.sqrt(1 - cos**2) * aside / np.maximum(size, 1e-9), own)
        self._audit(planted.astype(np.float32), np.full(len(own), -1))

    def _audit(self, q: np.ndarray, own: np.ndarray) -> None:
        """Widen the beam until the queries' hits, their own ids left out, are found; note how many there were and were found."""
        truth = (q @ self.graph.x.T >= self.near) & (own[:, None] != self.ids)
        while True:
            at, row = _hits(self.graph, q, self.near, self.beam)
            found = np.zeros_like(truth)
            found[at, row] = True
            got = (found & truth).sum()
            if got >= AUDIT_RECALL * truth.sum() or self.beam >= len(self.ids):
                break
            self.beam *= 2
        self.audits.append((int(truth.sum()), int(got)))

    def compare(self, ids: np.ndarray, vectors: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Rows (kind, id, links, other) of a block of queries: verified counts and a forest of the links."""
        qu = _unit(vectors)
        q32 = qu.astype(np.float32)
        if len(self.audits) < 2:
            sample = np.unique(np.linspace(0, len(ids) - 1, min(AUDIT, len(ids))).astype(int))
            self._audit(q32[sample], ids[sample])
        at, row = _hits(self.graph, q32, self.near, self.beam)
        at, row = np.divmod(np.unique(at * len(self.ids) + row), len(self.ids))
        ok = np.empty(len(at), dtype=bool)
        for a in range(0, len(at), 1 << 16):
            ok[a : a + (1 << 16)] = np.einsum("md,md->m", qu[at[a : a + (1 << 16)]], self.x[row[a : a + (1 << 16)]]) >= self.threshold
        ok &= ids[at] != self.ids[row]
        at, row = at[ok], row[ok]
        links = np.bincount(at, weights=self.many[row], minlength=len(ids)).astype(np.int64)
        u, v = _forest(ids[at], self.ids[row])
        found = links > 0
        return [(COUNT, ids[found], links[found], np.zeros(found.sum(), dtype=np.int64)), (LINK, u, np.zeros(len(u), dtype=np.int64), v)]


def _compare(batches: Iterator[pa.RecordBatch], threshold: float, beam: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard, the index before its queries: the index is held, queries pass in blocks."""
    shard: Shard | None = None
    key, index, queries, waiting = None, [], [], 0

    def rows(kind: int, ids: np.ndarray, links: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), kind, dtype=np.int32)), pa.array(ids), pa.array(links), pa.array(other)], names=["kind", "id", "links", "other"])

    def answer() -> Iterator[pa.RecordBatch]:
        nonlocal shard, queries, waiting
        if index and shard is None:
            t = pa.Table.from_batches(index).combine_chunks()
            col = lambda c: t.column(c).combine_chunks() if isinstance(t.column(c), pa.ChunkedArray) else t.column(c)
            shard = Shard(col("id").to_numpy(), col("n").to_numpy(), _matrix(col("v")), col("near").to_pylist(), threshold, beam)
            index.clear()
        if queries and shard is not None:
            t = pa.Table.from_batches(queries).combine_chunks()
            for part in shard.compare(t.column("id").to_numpy(), _matrix(t.column("v").combine_chunks())):
                if len(part[1]):
                    yield rows(*part)
        queries, waiting = [], 0

    def finish() -> Iterator[pa.RecordBatch]:
        nonlocal shard
        yield from answer()
        if shard is not None:
            truth, got = np.array(shard.audits).sum(axis=0)
            yield rows(AUDITED, np.array([truth]), np.array([got]), np.array([shard.beam]))
        shard = None
        index.clear()

    for b in batches:
        group = b.column("g").to_numpy()
        cuts = np.flatnonzero(np.diff(group)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(group)], strict=True):
            if lo == hi:
                continue
            if group[lo] != key:
                yield from finish()
                key = group[lo]
            part = b.slice(lo, hi - lo)
            first = int((part.column("is_query").to_numpy(zero_copy_only=False)).argmax()) if part.column("is_query").to_numpy(zero_copy_only=False).any() else len(part)
            if first:
                index.append(part.slice(0, first))
            for a in range(first, len(part), QUERIES):
                queries.append(part.slice(a, QUERIES))
                waiting += len(queries[-1])
                if waiting >= QUERIES:
                    yield from answer()
    yield from finish()


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, beam: int = BEAM) -> DataFrame:
    """``(id, n_links, component_id, kept, audit_recall)`` for every row of ``rows``.

    Null, empty and zero vectors, and those with null or non-finite components, link with nothing; finite
    ones do however large or small they are. Vectors of different lengths are never linked. Rows that repeat an id are
    separate vectors (they link if their vectors do) but share the component; a null id is never a component's name unless
    all are null, and a vector that links with nothing is its own component. Extra columns are ignored.
    ``audit_recall`` is the share of the audits' links that were found, over all tasks (null without any).
    """
    spark = rows.sparkSession
    ship(spark)
    v = F.col(vector_col).cast("array<double>")
    good = F.coalesce(F.size(v) > 0, F.lit(False)) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    base = rows.select(F.col(id_col).alias("id"), F.when(good, v).alias("v"))
    key = F.when(F.col("v").isNotNull(), F.xxhash64("v"))
    base = save(base.withColumn("h", key), "hnsw-rows")
    # exact copies share a node: its number is the vector's least id and its place among them
    nodes = base.where("v IS NOT NULL").groupBy("h", "v").agg(F.count("*").alias("n"), F.min("id").alias("rep"))
    nodes = save(nodes.select("v", "n", "rep", F.monotonically_increasing_id().alias("id"), F.size("v").alias("d"), "h"), "hnsw-nodes")
    size = nodes.agg(F.coalesce(F.sum(F.col("d") * 4), F.lit(0)).alias("b")).first()["b"]
    shards = max(SHARDS, -(-size // SHARD_BYTES))
    # few shards are shared by several tasks each; with many, a task has one
    turns = max(1, -(-2 * spark.sparkContext.defaultParallelism // shards))
    number = F.pmod(F.xxhash64("id", F.lit("shard")), F.lit(shards)).cast("int")
    turn = F.pmod(F.xxhash64("id", F.lit("turn")), F.lit(turns)).cast("int")
    sharded = nodes.select("id", "n", "v", "d", number.alias("s"))
    built = sharded.groupBy("d", "s").applyInPandas(build_shard, "id long, n long, v array<double>, d int, s int, place int, near array<array<int>>")
    built = save(built, "hnsw-index")
    index = built.select("id", "n", "v", "d", "s", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"), "place", "near", F.lit(False).alias("is_query"))
    queries = nodes.select("id", "n", "v", "d", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s"), turn.alias("turn"), F.lit(None).cast("int").alias("place"), F.lit(None).cast("array<array<int>>").alias("near"), F.lit(True).alias("is_query"))
    task = (F.col("s") * turns + F.col("turn")).cast("int")
    both = index.unionByName(queries).withColumn("task", task).withColumn("g", F.col("d").cast("long") * (shards * turns) + F.col("task"))
    dealt = both.repartitionById(shards * turns, "task").sortWithinPartitions("g", "is_query", "place").select("g", "is_query", "id", "n", "v", "near")
    found = save(dealt.mapInArrow(lambda b: _compare(b, threshold, beam), "kind int, id long, links long, other long"), "hnsw-found")
    links = found.where(F.col("kind") == COUNT).groupBy("id").agg(F.sum("links").alias("links"))
    roots = connected_components(found.where(F.col("kind") == LINK).select(F.col("id").alias("u"), F.col("other").alias("v")))
    audit = found.where(F.col("kind") == AUDITED).agg(F.try_divide(F.sum("links"), F.sum("id")).alias("recall")).first()["recall"]
    named = nodes.select("id", "n", "rep", "h", "v").join(links, "id", "left").join(roots, nodes["id"] == roots["node"], "left")
    named = named.select("h", "v", "n", "rep", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "id").alias("root"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = save(named.join(least, "root").select(F.col("h").alias("_h"), F.col("v").alias("_v"), (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id"), "hnsw-named")
    drop_saved(nodes, built, found, roots)
    joined = base.where("v IS NOT NULL").join(named, (F.col("h") == F.col("_h")) & (F.col("v") == F.col("_v")))
    linked = joined.select("id", "n_links", "component_id")
    alone = base.where("v IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), F.col("n_links").cast("long"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"), F.lit(audit).cast("double").alias("audit_recall"))
