"""Incremental, reversible line dedup: cuckoo filters by shard over exact tables of reference counts.

A line's key is its text without outer white space, in lower case. The index has, written and by shard of the key:

* ``postings``: a row for each document and key that it holds, which deletions need;
* ``refs``: the exact number of documents that hold a key, and the greatest id among them;
* ``filters``: a cuckoo filter a shard, of the keys that are held often enough to be dropped.

Inserting documents adds postings and counts; deleting them takes both back, and a key whose count crosses the threshold
enters or leaves its shard's filter. A scan probes the filters, and what they let through is looked up in the exact table,
so that no line goes for a false positive. Nothing is lost by insertion and later deletion: the lines come back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import drop_saved, save

#: A key of at least SHORTEST code points goes where LEAST documents hold it.
SHORTEST, LEAST = 20, 3
#: Distinct keys a shard is meant for, and the fewest shards.
KEYS_PER_SHARD, FEWEST_SHARDS = 65_536, 64
#: The white space that is stripped from a line.
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TO_LOWER = str.maketrans(UPPER, LOWER)
#: The second half of a key's 128-bit hash: XXH64 seeded with the hash of this salt.
SALT, SEED = "line", 42
SECOND_SEED = xxhash.xxh64_intdigest(SALT.encode(), SEED)

SLOTS, LOAD, KICKS = 4, 0.6, 400


def _mix(fp: np.ndarray) -> np.ndarray:
    h = fp.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


class Cuckoo:
    """A cuckoo filter of 16-bit fingerprints, four to a bucket. All operations take arrays of 128-bit keys, whole."""

    def __init__(self, table: np.ndarray) -> None:
        self.table = table
        self.mask = np.uint64(len(table) - 1)

    @classmethod
    def empty(cls, keys: int) -> Cuckoo:
        buckets = 1 << max(1, int(np.ceil(np.log2(max(1, keys) / (SLOTS * LOAD)))))
        return cls(np.zeros((buckets, SLOTS), dtype=np.uint16))

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> Cuckoo:
        """A filter of distinct keys, as large as it must be."""
        room = len(h1)
        while not (made := cls.empty(room)).insert(h1, h2):
            room *= 2
        return made

    @classmethod
    def load(cls, data: bytes) -> Cuckoo:
        return cls(np.frombuffer(data, dtype=np.uint16).reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _places(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fp = (h2.view(np.uint64) & np.uint64(0xFFFF)).astype(np.uint16)
        return np.maximum(fp, 1), (h1.view(np.uint64) >> np.uint64(24)) & self.mask

    def _other(self, bucket: np.ndarray, fp: np.ndarray) -> np.ndarray:
        return bucket ^ (_mix(fp) & self.mask)

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        fp, b = self._places(h1, h2)
        return (self.table[b] == fp[:, None]).any(axis=1) | (self.table[self._other(b, fp)] == fp[:, None]).any(axis=1)

    def insert(self, h1: np.ndarray, h2: np.ndarray) -> bool:
        """False when there is no room: the filter is void then and must be built anew."""
        fp, b = self._places(h1, h2)
        rng = np.random.default_rng(len(fp))
        for turn in range(KICKS):
            if not len(fp):
                return True
            order = np.argsort(b, kind="stable")
            fp, b = fp[order], b[order]
            new = np.flatnonzero(np.diff(b, prepend=b[0] + np.uint64(1)))
            rank = np.arange(len(b)) - np.repeat(new, np.diff(np.append(new, len(b))))
            taken = self.table[b] != 0
            free = SLOTS - taken.sum(axis=1)
            fits = rank < free
            at = np.argsort(taken, axis=1, kind="stable")[np.arange(len(b)), np.minimum(rank, SLOTS - 1)]
            self.table[b[fits], at[fits]] = fp[fits]
            # of those left, one a bucket puts out another (from the second turn on); all go to their other bucket
            out = ~fits & (rank == free) & (turn > 0)
            slot = rng.integers(0, SLOTS, size=len(b))
            victim = self.table[b[out], slot[out]]
            self.table[b[out], slot[out]] = fp[out]
            fp[out] = victim
            fp, b = fp[~fits], b[~fits]
            b = self._other(b, fp)
        return not len(fp)

    def remove(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """Take out keys that were inserted, each one fingerprint of its own."""
        fp, b = self._places(h1, h2)
        for f, one, two in zip(fp.tolist(), b.tolist(), self._other(b, fp).tolist(), strict=True):
            for bucket in (one, two):
                at = np.flatnonzero(self.table[bucket] == f)
                if len(at):
                    self.table[bucket, at[0]] = 0
                    break


def line_key(line: str) -> str:
    return line.strip(BLANK).translate(_TO_LOWER)


def line_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc, h1, h2)``: each long enough key of a document once."""
    lines = F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\n", -1)
    keys = F.filter(F.transform(lines, lambda s: F.translate(F.btrim(s, F.lit(BLANK)), UPPER, LOWER)), lambda k: F.length(k) >= SHORTEST)
    each = docs.select(F.col(id_col).alias("doc"), F.explode(F.array_distinct(keys)).alias("k"))
    return each.select("doc", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(SALT), "k").alias("h2"))


def _shard(shards: int) -> Column:
    return F.pmod(F.col("h1"), F.lit(shards)).cast("int")


@dataclass
class LineIndex:
    """All tables are saved ones; an operation returns a new index and leaves the old one's tables to their scope."""

    shards: int
    postings: DataFrame
    refs: DataFrame
    filters: DataFrame

    def repeated(self) -> DataFrame:
        return self.refs.where(F.col("n") >= LEAST)


def _counted(postings: DataFrame) -> DataFrame:
    return postings.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc").alias("last"))


def _filter_rows(keys: DataFrame) -> DataFrame:
    """``(shard, data)``: a filter of each shard's keys, built at once."""

    def build(table: pa.Table) -> pa.Table:
        made = Cuckoo.build(table.column("h1").to_numpy(), table.column("h2").to_numpy())
        return pa.table({"shard": table.column("shard").slice(0, 1), "data": pa.array([made.dump()], type=pa.binary())})

    return keys.select("shard", "h1", "h2").groupBy("shard").applyInArrow(build, "shard int, data binary")


def create(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
    """An index of all lines of ``docs``. A row is a document; rows that share an id are separate ones of the same rank."""
    ship(docs.sparkSession)
    postings = save(line_keys(docs, id_col, text_col), "lines-postings")
    counted = save(_counted(postings), "lines-counted")
    shards = max(FEWEST_SHARDS, -(-counted.count() // KEYS_PER_SHARD))
    refs = counted.withColumn("shard", _shard(shards))
    return LineIndex(shards, postings, refs, save(_filter_rows(refs.where(F.col("n") >= LEAST)), "lines-filters"))


def _crossed(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(shard, h1, h2, enters)``: keys on another side of the threshold than before."""
    o = old.where(F.col("n") >= LEAST).select("shard", "h1", "h2", F.lit(True).alias("was"))
    n = new.where(F.col("n") >= LEAST).select("shard", "h1", "h2", F.lit(True).alias("now"))
    return o.join(n, ["shard", "h1", "h2"], "full").where("was IS NULL OR now IS NULL").select("shard", "h1", "h2", F.col("now").isNotNull().alias("enters"))


def _moved(index: LineIndex, postings: DataFrame, refs: DataFrame, touched: DataFrame) -> LineIndex:
    """The index with new tables; the filters take only the keys of ``touched(h1, h2)`` that crossed the threshold."""
    if refs.count() > 4 * KEYS_PER_SHARD * index.shards:  # outgrown: more shards, all filters anew from the exact table
        shards = -(-refs.count() // KEYS_PER_SHARD)
        refs = refs.withColumn("shard", _shard(shards))
        return LineIndex(shards, postings, refs, save(_filter_rows(refs.where(F.col("n") >= LEAST)), "lines-filters"))
    near = ["h1", "h2"]
    changes = _crossed(index.refs.join(touched, near, "left_semi"), refs.join(touched, near, "left_semi"))

    def update(held: pa.Table, change: pa.Table) -> pa.Table:
        shard = held.column("shard") if len(held) else change.column("shard").slice(0, 1)
        made = Cuckoo.load(held.column("data")[0].as_py()) if len(held) else Cuckoo.empty(len(change))
        enters = change.column("enters").to_numpy(zero_copy_only=False).astype(bool)
        h1, h2 = change.column("h1").to_numpy(), change.column("h2").to_numpy()
        made.remove(h1[~enters], h2[~enters])
        ok = made.insert(h1[enters], h2[enters])
        return pa.table({"shard": shard, "data": pa.array([made.dump() if ok else None], type=pa.binary())})

    filters = save(index.filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInArrow(update, "shard int, data binary"), "lines-filters")
    full = filters.where("data IS NULL").select("shard")  # no room: built anew from the exact table
    anew = _filter_rows(refs.where(F.col("n") >= LEAST).join(full, "shard", "left_semi"))
    out = save(filters.where("data IS NOT NULL").unionByName(anew), "lines-filters")
    drop_saved(filters)
    return LineIndex(index.shards, postings, refs, out)


def insert(index: LineIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
    """The index with the lines of more documents. Inserting a document twice counts it twice."""
    fresh = save(line_keys(docs, id_col, text_col), "lines-fresh")
    delta = _counted(fresh).withColumn("shard", _shard(index.shards))
    refs = index.refs.unionByName(delta).groupBy("h1", "h2", "shard").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    refs = save(refs.select("h1", "h2", "n", "last", "shard"), "lines-refs")
    postings = save(index.postings.unionByName(fresh), "lines-postings")
    out = _moved(index, postings, refs, fresh.select("h1", "h2").distinct())
    drop_saved(fresh)
    return out


def delete(index: LineIndex, ids: DataFrame) -> LineIndex:
    """The index without all rows of the documents named in the first column of ``ids`` (a null deletes those without an id)."""
    gone = ids.select(F.col(ids.columns[0]).alias("gone")).distinct()
    same = F.col("doc").eqNullSafe(F.col("gone"))
    near = ["h1", "h2"]
    touched = save(index.postings.join(gone, same, "left_semi").select(*near).distinct(), "lines-touched")
    postings = save(index.postings.join(gone, same, "left_anti"), "lines-postings")
    counted = _counted(postings.join(touched, near, "left_semi")).withColumn("shard", _shard(index.shards))
    refs = save(index.refs.join(touched, near, "left_anti").select("h1", "h2", "n", "last", "shard").unionByName(counted.select("h1", "h2", "n", "last", "shard")), "lines-refs")
    out = _moved(index, postings, refs, touched)
    drop_saved(touched)
    return out


def _verdicts(rows: pa.Table, held: pa.Table) -> pa.Table:
    """Of one cell's postings, those to drop. ``rows`` are postings and, marked ``exact``, the shard's repeated keys with their last document."""
    names = ["doc", "h1", "h2"]
    exact = rows.column("exact")
    known, posts = rows.filter(exact), rows.filter(pc.invert(exact))
    none = posts.slice(0, 0).select(names)
    if not len(held) or not len(known) or not len(posts):
        return none
    posts = posts.filter(pa.array(Cuckoo.load(held.column("data")[0].as_py()).contains(posts.column("h1").to_numpy(), posts.column("h2").to_numpy())))
    key = lambda t: np.rec.fromarrays([t.column("h1").to_numpy(), t.column("h2").to_numpy()], names="a,b")
    mine = key(known)
    order = np.argsort(mine, order=("a", "b"))
    mine, want = mine[order], key(posts)
    if not len(posts):
        return none
    at = np.minimum(np.searchsorted(mine, want), len(mine) - 1)
    found = mine[at] == want
    last = known.column("doc").take(pa.array(order[at]))
    doc = posts.column("doc")
    kept = pc.or_(pc.fill_null(pc.equal(doc, last), False), pc.and_(pc.is_null(doc), pc.is_null(last)))
    return posts.filter(pc.and_(pa.array(found), pc.invert(kept))).select(names)


def drops(index: LineIndex, postings: DataFrame) -> DataFrame:
    """``(doc, h1, h2)``: the postings whose lines go. Shards with many postings are cut into cells by document, each with the shard's filter and exact keys."""
    posts = postings.withColumn("shard", _shard(index.shards))
    per = posts.groupBy("shard").count()
    usual = F.lit(2.0) * per.agg(F.avg("count").alias("m")).first()["m"]
    busy = save(per.where(F.col("count") > usual).select("shard", F.ceil(F.col("count") / usual).cast("int").alias("cells")), "lines-busy")
    cells = F.coalesce("cells", F.lit(1))
    kind = postings.schema["doc"].dataType.simpleString()
    cell = F.pmod(F.xxhash64("doc", "h2"), cells).cast("int")
    rows = posts.join(busy, "shard", "left").select("shard", cell.alias("cell"), F.lit(False).alias("exact"), "doc", "h1", "h2")
    each = F.explode(F.sequence(F.lit(0), cells - 1)).alias("cell")
    known = index.repeated().join(busy, "shard", "left").select("shard", each, F.lit(True).alias("exact"), F.col("last").alias("doc"), "h1", "h2")
    held = index.filters.join(busy, "shard", "left").select("shard", each, "data")
    both = rows.unionByName(known).groupBy("shard", "cell").cogroup(held.groupBy("shard", "cell"))
    return both.applyInArrow(_verdicts, f"doc {kind}, h1 long, h2 long")


def _cut(text: str, gone: list) -> tuple[int, int, str]:
    lines = text.split("\n")
    if not gone:
        return len(lines), 0, text
    marks = {(d["h1"], d["h2"]) for d in gone}
    kept = []
    for line in lines:
        k = line_key(line)
        if len(k) >= SHORTEST:
            b = k.encode("utf-8", "surrogatepass")
            a, c = xxhash.xxh64_intdigest(b, SEED), xxhash.xxh64_intdigest(b, SECOND_SEED)
            if (a - (a >> 63 << 64), c - (c >> 63 << 64)) in marks:
                continue
        kept.append(line)
    return len(lines), len(lines) - len(kept), "\n".join(kept)


def dedup_lines(docs: DataFrame, index: LineIndex, id_col: str = "doc_id", text_col: str = "text", postings: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text``: lines that the index holds often go, but where the document's id is the last that holds them.

    A null or empty text is one empty line. Null ids rank lowest. Rows that share an id have the same rank; each counts as a document
    of its own. Columns may have any names but those three. ``postings`` may be given where those of ``docs`` are at hand.
    An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    names = [f"_c{i}" for i in range(len(docs.columns))]
    posts = postings if postings is not None else save(line_keys(docs, id_col, text_col), "lines-postings")
    by_doc = drops(index, posts).groupBy("doc").agg(F.collect_list(F.struct("h1", "h2")).alias("gone"))
    at, own = names[docs.columns.index(text_col)], names[docs.columns.index(id_col)]
    joined = docs.toDF(*names).join(by_doc, F.col(own).eqNullSafe(F.col("doc")), "left").select(*names, "gone")
    types = ", ".join(f"`{n}` {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [_cut(t.as_py() or "", g.as_py()) for t, g in zip(b.column(at), b.column("gone"), strict=True)]
            new = [pa.array([g[0] for g in got], type=pa.int64()), pa.array([g[1] for g in got], type=pa.int64()), pa.array([g[2] for g in got], type=pa.string())]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *new], names=[*names, "n_lines", "n_dropped", "kept_text"])

    return joined.mapInArrow(run, f"{types}, n_lines long, n_dropped long, kept_text string").toDF(*docs.columns, "n_lines", "n_dropped", "kept_text")
