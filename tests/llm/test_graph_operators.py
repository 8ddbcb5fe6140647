"""Components, URL filters and embedding near-duplicates."""

import random

import numpy as np
import pytest

from panelfx.llm import hnsw, url_filters
from panelfx.llm.components import connected_components


def closure(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        if u is not None and v is not None and u != v:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("kind", ["random", "path", "star", "empty"])
def test_components(spark, kind):
    r = random.Random(4)
    edges = {
        "random": [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(None, 3), (5, None), (7, 7), (1, 2), (2, 1), (1, 2)],
        "path": [(i, i + 1) for i in range(90)],
        "star": [(500, i) for i in range(400)] + [(500, 900)],
        "empty": [],
    }[kind]
    got = {x["node"]: x["root"] for x in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == closure(edges)


RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8")]
PAGES = [
    (1, "http://A.Example.COM/en/1?q=/x", ""),
    (2, "https://example.com/en/77", '<link rel="canonical" href="https://shop.com/en/9">'),
    (3, "https://shop.com/en/9", ""),
    (4, "https://shop.org/p", "<LINK href='https://shop.com/en/9#top' REL=canonical>"),
    (5, "https://shop.org/q", '<meta http-equiv="refresh" content="0; url=/p">'),
    (6, "https://free.org/z", '<link rel="stylesheet" href="https://shop.com/en/9">'),
    (7, None, None),
    (8, "no scheme/en/", None),
    (9, "https://x.example.net/de/81", None),
    (10, "https://x.net/de/8", ""),
    (10, "https://x.net/de/8", ""),
    (11, "https://notcom/en/", ""),
    (None, "https://shop.org/q#part", None),
    (12, "https://example.com#x/en/", ""),
]


def test_url_filters(spark):
    pages = spark.createDataFrame([(*p, "clash", 1) for p in PAGES], "page_id long, url string, html string, rule string, verdict int")
    got = url_filters.judge(pages, url_filters.rules_frame(spark, RULES)).collect()
    assert len(got) == len(PAGES)
    by = {(r["page_id"], r["url"]): r for r in got}
    row = lambda i: next(r for k, r in by.items() if k[0] == i)
    assert (row(1)["host"], row(1)["path"], row(1)["rule"], row(1)["verdict"]) == ("a.example.com", "/en/1", "com/en/", "block")
    assert (row(2)["verdict"], row(2)["via"]) == ("allow", "rule")  # an explicit allow isn't overruled by its component
    assert row(3)["verdict"] == "block"
    assert (row(4)["verdict"], row(4)["via"], row(4)["rule"]) == ("block", "alias", None)
    assert (row(5)["verdict"], row(None)["verdict"]) == ("block", "block")  # through two edges; a fragment is the same page
    assert row(6)["verdict"] == "allow" and row(6)["via"] is None
    assert (row(7)["host"], row(7)["path"], row(7)["verdict"]) == ("", "", "allow")
    assert (row(8)["host"], row(8)["path"], row(8)["verdict"]) == ("", "", "allow")
    assert row(9)["rule"] == "example.net/de/8" and row(10)["rule"] == "net/de/"
    assert row(11)["verdict"] == "allow" and (row(12)["host"], row(12)["path"]) == ("example.com", "")
    more = spark.createDataFrame([("https://free.org/z", "https://shop.org/q"), (None, "https://free.org/z")], "u string, v string")
    again = url_filters.judge(pages, url_filters.rules_frame(spark, RULES), more).where("page_id = 6").first()
    assert again["verdict"] == "block"
    assert url_filters.judge(pages.where("false"), url_filters.rules_frame(spark, RULES)).count() == 0


def vectors(n=900, d=24, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d))
    for i in range(0, n // 3, 3):  # tight groups
        x[i + 1] = x[i] + r.normal(size=d) * 0.08
        x[i + 2] = x[i + 1] * 3 + r.normal(size=d) * 0.2
    x[-60:] = x[-61] + r.normal(size=(60, d)) * 0.05
    x[-90:-60] = x[-91]
    return x


def test_hnsw_against_brute_force(spark):
    x = vectors()
    rows = [(i, [float(v) for v in a], 1) for i, a in enumerate(x)]
    rows += [(1001, None, 1), (1002, [], 1), (1003, [0.0] * 24, 1), (1004, [float("nan")] + [1.0] * 23, 1), (1005, [None] + [1.0] * 23, None), (1006, [1.0, 2.0], 1), (1007, [2.0, 4.0], 1), (None, [1.0, 2.0], 1), (1006, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = hnsw.near_duplicates(df.withColumn("v", df.label)).collect()
    assert len(got) == len(rows)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    links = {r["vec_id"]: r["n_links"] for r in got if r["vec_id"] is not None and r["vec_id"] < 1000}
    want = near.sum(axis=1)
    assert all(links[i] <= want[i] for i in links)
    assert sum(links.values()) >= 0.98 * want.sum()
    comp = closure([(i, j) for i, j in np.argwhere(near)])
    assert np.mean([r["component_id"] == comp.get(r["vec_id"], r["vec_id"]) for r in got if r["vec_id"] is not None and r["vec_id"] < 1000]) > 0.98
    odd = {r["vec_id"]: r for r in got if r["vec_id"] is None or r["vec_id"] > 1000}
    assert all(odd[i]["n_links"] == 0 and odd[i]["component_id"] == i and odd[i]["kept"] for i in range(1001, 1006))
    assert odd[1006]["n_links"] == odd[1007]["n_links"] == odd[None]["n_links"] == 3
    assert odd[1007]["component_id"] == odd[None]["component_id"] == 1006
    assert hnsw.near_duplicates(df.where("false")).count() == 0


def test_beams_widen_to_the_whole_cluster():
    r = np.random.default_rng(1)
    x = np.concatenate((r.normal(size=16) + r.normal(size=(400, 16)) * 0.02, r.normal(size=(600, 16))))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    built = hnsw.Graph.build(x)
    g = hnsw.Graph.load(x, built.rows())
    for a, b in zip(built.layers, g.layers, strict=True):
        assert (a.rows == b.rows).all() and all(set(p) - {-1} == set(q) - {-1} for p, q in zip(a.near, b.near, strict=True))
    q, row = hnsw._hits(g, x[:5].astype(np.float32), 0.95, 16)
    assert len(q) >= 0.99 * (x[:5] @ x.T >= 0.95).sum()


@pytest.mark.parametrize("kind", ["random", "copies", "islands"])
def test_every_row_is_found(kind):
    """Graphs of any size are built alike, and each row finds itself."""
    r = np.random.default_rng(2)
    x = {"random": lambda: r.normal(size=(5000, 64)), "copies": lambda: np.repeat(r.normal(size=(60, 32)), 40, axis=0) + r.normal(size=(2400, 32)) * 1e-3, "islands": lambda: np.eye(24)[r.integers(0, 24, 3000)] + r.normal(size=(3000, 24)) * 1e-4}[kind]()
    x = hnsw._unit(x).astype(np.float32)
    g = hnsw.Graph.build(x)
    first = g.layers[0]
    seen = np.zeros(len(x), dtype=bool)
    front = np.array([0])
    while len(front):
        seen[front] = True
        front = np.unique(first.near[front])
        front = front[(front >= 0)]
        front = front[~seen[front]]
    assert seen.all()
    ids, sims = g.search(x[::7], 64)
    assert (sims.max(axis=1) > 0.9999).mean() > 0.99


def test_sparse_links_and_audit(spark):
    """Few links among many vectors: the audit has evidence without them, and nearly all are found."""
    r = np.random.default_rng(6)
    x = r.normal(size=(6000, 128))
    for k in range(0, 300, 2):
        x[k + 1] = x[k] / np.linalg.norm(x[k]) + r.normal(size=128) * 0.02
    df = spark.createDataFrame([(k, [float(c) for c in a]) for k, a in enumerate(x)], "vec_id long, embedding array<double>")
    got = {g["vec_id"]: g for g in hnsw.near_duplicates(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    assert near.sum() > 200
    assert sum(g["n_links"] for g in got.values()) >= 0.99 * near.sum()
    assert got[0]["audit_recall"] >= 0.99


def test_extreme_sizes_link(spark):
    rows = [(1, [1e300, 2e300]), (2, [1e-300, 2e-300]), (3, [5e-324, 0.0]), (4, [1.0, 0.0]), (5, [-0.0, 1.0]), (6, [0.0, 1.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (1, 5), 6: (1, 5)}
