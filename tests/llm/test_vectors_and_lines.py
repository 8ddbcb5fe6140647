import hashlib
import math

import numpy as np
import pytest
from panelfx.llm import line_dedup, vector_codes, whitening
from pyspark.sql import functions as F


def naive_codes(rows, entries=256, rounds=4):
    kept = sorted((r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])), key=lambda r: r[0])
    x = np.array([[math.floor(1024 * c) for c in r[1]] for r in kept], dtype=np.int64)
    d = x.shape[1] // 4
    parts = [x[:, k * d : (k + 1) * d] for k in range(4)]
    books = [p[:entries].copy() for p in parts]

    def assign(p, b):
        dist = ((p[:, None, :] - b[None]) ** 2).sum(axis=2)
        return dist.argmin(axis=1), dist.min(axis=1)

    for _ in range(rounds):
        for k in range(4):
            at, _ = assign(parts[k], books[k])
            for e in range(len(books[k])):
                if (at == e).any():
                    books[k][e] = [int(s) // int((at == e).sum()) for s in parts[k][at == e].sum(axis=0)]
    got = [assign(parts[k], books[k]) for k in range(4)]
    code = ["".join(f"{got[k][0][i]:02x}" for k in range(4)) for i in range(len(kept))]
    error = sum(g[1] for g in got)
    sums = {}
    for r, e in zip(kept, error, strict=True):
        sums[r[2]] = sums.get(r[2], 0) + int(e)
    sha = hashlib.sha256(",".join(str(int(c)) for b in books for c in b.ravel()).encode()).hexdigest()
    return {r[0]: (c, int(e), sums[r[2]], sha) for r, c, e in zip(kept, code, error, strict=True)}


def test_codes_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 12))
    rows = [(i, [float(c) for c in np.round(centres[i % 40] + rng.normal(size=12) * 0.3, 2)], None if i % 7 == 0 else i % 3) for i in range(700)]
    rows += [(1000 + i, rows[0][1], 5) for i in range(50)]  # copies: ties and a hot vector
    rows += [(2000, None, 1), (2001, [float("nan")] * 12, 1), (2002, [None] + [0.0] * 11, 1), (2003, [float("inf")] * 12, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("code", F.lit("x")).withColumn("id", F.lit(0)).repartition(5)
    single = [(r[0], None if r[1] is None else [None if c is None else float(np.float32(c)) for c in r[1]], r[2]) for r in rows]
    got = {r["vec_id"]: (r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in vector_codes.vector_codes(df).collect()}
    assert got == naive_codes(single)


def test_bounds_are_conservative_and_skip_work():
    rng = np.random.default_rng(1)
    centres = rng.integers(-500, 500, size=(256, 16))
    x = centres[rng.integers(0, 256, size=4000)] + rng.integers(-40, 40, size=(4000, 16))
    at, dist, exact = vector_codes.Codebook(centres).nearest(x)
    all_ = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert (at == all_.argmin(axis=1)).all() and (dist == all_.min(axis=1)).all()
    assert exact < 0.2 * all_.size
    # far from the origin, where rounding is at its worst, and with equal entries
    big = np.concatenate([centres[:128], centres[:128]]) + (1 << 21)
    at, dist, _ = vector_codes.Codebook(big).nearest(x + (1 << 21))
    all_ = ((x[:, None, :] + (1 << 21) - big[None]) ** 2).sum(axis=2)
    assert (at == all_.argmin(axis=1)).all() and (at < 128).all() and (dist == all_.min(axis=1)).all()


def test_codes_corners(spark):
    schema = "vec_id long, embedding array<double>, label string"
    assert vector_codes.vector_codes(spark.createDataFrame([], schema)).count() == 0
    one = vector_codes.vector_codes(spark.createDataFrame([(4, [0.5] * 8, "a")], schema)).first()
    assert (one["code"], one["error"], one["label_error"]) == ("00000000", 0, 0)
    mixed = spark.createDataFrame([(1, [0.1] * 8, None), (2, [0.2] * 4, None), (None, [0.3] * 8, "b"), (5, [1e300, -1e300] * 4, "b")], schema)
    got = {r["vec_id"]: r for r in vector_codes.vector_codes(mixed).collect()}
    assert got[2]["code"] is None and got[1]["code"] == "00000000" and got[None]["code"] == "02020202" and got[5]["error"] == 0
    short = vector_codes.vector_codes(spark.createDataFrame([(1, [], "a"), (2, [], "a")], schema))
    assert {r["code"] for r in short.collect()} == {"00000000"}
    assert vector_codes.vector_codes(mixed.drop("label"), label_col=None).count() == 4


@pytest.mark.parametrize(("n", "d", "flat"), [(400, 24, False), (900, 64, True), (300, 150, False), (30, 40, False)])
def test_whitening_against_dense(spark, n, d, flat):
    rng = np.random.default_rng(n)
    data = rng.normal(size=(n, d)) * (1.0 if flat else 1 / np.sqrt(np.arange(1, d + 1)))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(data)] + [(n + i, [float(c) for c in data[0]]) for i in range(20)] + [(5000, None), (5001, [float("nan")] * d)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("x", F.lit(1)).repartition(4)
    got = whitening.whiten(df).toPandas()
    x = np.floor(256 * np.array([r[1] for r in rows[:-2]])).astype(np.int64)
    distinct = np.unique(x, axis=0)
    sums, m = distinct.sum(axis=0), len(distinct)
    c = distinct - sums / m
    values, axes = np.linalg.eigh(c.T @ c / m)
    values, axes = values[::-1][:4], axes[:, ::-1][:, :4]
    assert len(got) == 4 * len(x) and (got.n == m).all() and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    wide = got.pivot(index="vec_id", columns="component", values="whitened")
    want = (x - sums / m) @ (axes / np.sqrt(values))
    signs = np.sign((wide.to_numpy() * want).sum(axis=0))
    assert np.abs(wide.to_numpy() * signs - want).max() < 1e-8
    far = got[got.component == 1].set_index("vec_id").deviation
    assert far[3] == sum((m * int(a) - int(s)) ** 2 for a, s in zip(x[3], sums, strict=True))
    share = got.groupby("component").explained.first().to_numpy()
    assert np.abs(share / (values / (c * c).sum() * m) - 1).max() < 1e-9


def test_whitening_corners(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(5)] + [(None, [9.0, 18.0, 0.0]), (7, [1.0])], schema)
    got = whitening.whiten(line).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 6 and all(abs(r["explained"] - 1) < 1e-9 for r in got)
    huge = whitening.whiten(spark.createDataFrame([(1, [1e9, 0.0]), (2, [-1e9, 0.0]), (3, [0.0, 0.0])], schema)).collect()
    assert {r["vec_id"]: r["deviation"] is None for r in huge} == {1: True, 2: True, 3: False}


def naive_lines(rows):
    held = {}
    for i, (doc, text) in enumerate(rows):
        for k in {line_dedup.line_key(s) for s in (text or "").split("\n")}:
            if len(k) >= 20:
                held.setdefault(k, {})[i] = doc
    out = []
    for doc, text in rows:
        lines, kept = (text or "").split("\n"), []
        for s in lines:
            h = held.get(line_dedup.line_key(s), {})
            ids = [x for x in h.values() if x is not None]
            if len(h) < 3 or doc == max(ids, default=None):
                kept.append(s)
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def _rows(n, seed):
    rng = np.random.default_rng(seed)
    pool = [f"This is the common Line number {i} É of all" for i in range(30)] + ["short line", "", "   ", "exactly twenty chars", "nineteen characters"]
    out = []
    for i in range(n):
        lines = [pool[j] for j in rng.integers(0, len(pool), size=rng.integers(0, 6))] + [f"a line that only document {seed} {i} has"] * int(rng.integers(0, 3))
        if i % 3 == 0:
            lines.append("\t A LICENSE line that a third of all documents hold \x0b")
        out.append((None if i % 41 == 40 else i + 1000 * seed, None if i % 29 == 28 else "\n".join(s.upper() if rng.random() < 0.3 else s for s in lines)))
    return out


SCHEMA = "doc_id long, text string"


def _deduped(docs, index):
    return sorted([(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in line_dedup.dedup_lines(docs, index).collect()], key=repr)


def test_lines_insert_delete_and_come_back(spark):
    a, b = _rows(200, 1), _rows(150, 2)
    da, db = (spark.createDataFrame(r, SCHEMA).withColumn("doc", F.lit("clash")).withColumn("gone", F.lit(1)).withColumn("_c0", F.lit(2)).repartition(3) for r in (a, b))
    first = line_dedup.create(da)
    alone = _deduped(da, first)
    assert alone == naive_lines(a)
    both = line_dedup.insert(first, db)
    assert _deduped(da.unionByName(db), both) == naive_lines(a + b)
    back = line_dedup.delete(both, spark.createDataFrame([(r[0],) for r in b if r[0] is not None], "doc_id long"))
    named = [r for r in b if r[0] is None]
    back = line_dedup.delete(back, spark.createDataFrame([(None,)], "x long"))
    assert _deduped(da.where("doc_id IS NOT NULL"), back) == naive_lines([r for r in a if r[0] is not None])
    assert named and back.postings.where("doc IS NULL").count() == 0
    # the filters hold what filters built afresh would hold: every repeated key, and as many fingerprints
    fresh = line_dedup.create(da.where("doc_id IS NOT NULL"))
    keys = back.repeated().toPandas()
    held = {r["shard"]: line_dedup.Cuckoo.load(r["data"]) for r in back.filters.collect()}
    assert all(held[s].contains(np.array([h1]), np.array([h2]))[0] for s, h1, h2 in zip(keys["shard"], keys.h1, keys.h2, strict=True))
    assert sum((c.table != 0).sum() for c in held.values()) == len(keys) == fresh.repeated().count()


def test_lines_repeated_rows_and_corners(spark):
    text = "the very same line in all of these rows"
    rows = [(5, text), (5, text), (5, text + "\n" + text), (2, text), (9, "other")]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert _deduped(docs, line_dedup.create(docs)) == naive_lines(rows)
    none = spark.createDataFrame([], SCHEMA)
    assert line_dedup.dedup_lines(none, line_dedup.create(none)).count() == 0
    blank = [(1, None), (2, ""), (3, "\n\n"), (4, "x" * 300_000), (None, None)]
    docs = spark.createDataFrame(blank, SCHEMA)
    assert _deduped(docs, line_dedup.create(docs)) == naive_lines(blank)


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    h = rng.integers(-(1 << 63), (1 << 63) - 1, size=(60_000, 2))
    made = line_dedup.Cuckoo.build(h[:50_000, 0], h[:50_000, 1])
    assert made.contains(h[:50_000, 0], h[:50_000, 1]).all() and (made.table != 0).sum() == 50_000
    assert made.contains(h[50_000:, 0], h[50_000:, 1]).mean() < 0.002
    made.remove(h[:20_000, 0], h[:20_000, 1])
    assert (made.table != 0).sum() == 30_000 and made.contains(h[20_000:50_000, 0], h[20_000:50_000, 1]).all()
    assert made.contains(h[:20_000, 0], h[:20_000, 1]).mean() < 0.002
    assert not line_dedup.Cuckoo.empty(100).insert(h[:5_000, 0], h[:5_000, 1])
