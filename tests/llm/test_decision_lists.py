"""Sequential covering against a version that tries every threshold of every statistic on its own."""

from __future__ import annotations

import math

import numpy as np
import pytest

from panelfx.llm import quality_rules as q

NAMES = ("a", "b", "c")


def table(n, seed, noise=0.0):
    """Bad rows in two regions: a high, and b low where c is high. Coarse values, so that there are ties."""
    r = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        a, b, c = (float(v) for v in r.integers(0, 20, 3) / 2)
        bad = a > 7.75 or (b < 2.25 and c > 5.25)
        rows.append({"a": a, "b": b, "c": c, "label": int(not bad) if r.random() >= noise else int(bad)})
    return rows


def holds(row, conditions):
    return all(row[f] <= c if op == "<=" else row[f] > c for f, op, c in conditions)


def naive(rows, least, purity):
    """The same covering with nothing shared: each candidate counts its rows anew."""
    cuts = {}
    for f in NAMES:
        v, ranked = sorted({r[f] for r in rows}), sorted(r[f] for r in rows)
        cuts[f] = sorted({(x + y) / 2 for x, y in zip(v, v[1:])} | {ranked[int(p * (len(rows) - 1))] for p in (0.005, 0.01, 0.02, 0.05, 0.1, 0.9, 0.95, 0.98, 0.99, 0.995)})
    parts = [(r, i % 3 == 0) for i, r in enumerate(rows)]
    bad = lambda rs: sum(r["label"] == 0 for r in rs)
    found = []
    while len(found) < q.MOST_RULES:
        grow, prune = [r for r, p in parts if not p], [r for r, p in parts if p]
        if bad(grow) < least:
            break
        conditions = []
        while len(conditions) < q.MOST_CONDITIONS:
            inside = [r for r in grow if holds(r, conditions)]
            if not inside or not bad(inside):
                break
            before = math.log2(bad(inside) / len(inside))
            tried = []
            for k, f in enumerate(NAMES):
                for c in cuts[f]:
                    for o, op in enumerate(("<=", ">")):
                        got = [r for r in inside if holds(r, [(f, op, c)])]
                        if bad(got) >= least:
                            tried.append((-bad(got) * (math.log2(bad(got) / len(got)) - before), k, c, o, op, f))
            # the greatest gain; ties to the earlier statistic and the lower threshold
            top = min((t[0] for t in tried), default=0.0)
            if top >= -1e-9:
                break
            _, _, c, _, op, f = min((t for t in tried if t[0] <= top + 1e-12), key=lambda t: t[1:4])
            conditions.append((f, op, c))
        if not conditions:
            break

        def worth(cs):
            got = [r for r in prune if holds(r, cs)]
            return (2 * bad(got) - len(got)) / len(got) if got else -1.0

        while len(conditions) > 1 and worth(conditions[:-1]) >= worth(conditions):
            conditions = conditions[:-1]
        both = [r for r, _ in parts if holds(r, conditions)]
        if bad(both) < least or bad(both) < purity * len(both):
            break
        found.append((conditions, len(both), bad(both)))
        parts = [(r, p) for r, p in parts if not holds(r, conditions)]
    return found


@pytest.mark.parametrize(("n", "seed", "noise", "purity"), [(300, 1, 0.0, 0.9), (300, 2, 0.03, 0.9), (240, 3, 0.1, 0.7), (90, 4, 0.0, 0.9), (12, 5, 0.0, 0.9)])
def test_learns_as_the_naive_covering(n, seed, noise, purity):
    rows = table(n, seed, noise)
    got = q.learn([dict(r) for r in rows], features=NAMES, purity=purity)
    want = naive(rows, 5, purity)
    assert [(r.conditions, r.covered, r.right) for r in got.rules] == want
    assert got.default and not any(r.keep for r in got.rules)
    if n == 300:
        assert want  # there was something to learn


def test_rules_judge_rows_that_they_have_not_seen():
    rules = q.learn(table(600, 7), features=NAMES)
    fresh = table(2000, 8)
    judged = [next((r.keep for r in rules.rules if r.matches(row)), rules.default) == bool(row["label"]) for row in fresh]
    assert np.mean(judged) > 0.97


@pytest.mark.parametrize("label", [0, 1])
def test_one_label_alone(label):
    rows = [r | {"label": label} for r in table(60, 9)]
    assert q.learn(rows, features=NAMES).rules == [] and q.learn([], features=NAMES).rules == []


def test_list_as_expression_is_the_list_by_rows(spark):
    rows = table(400, 11, 0.02)
    rules = q.learn([dict(r) for r in rows], features=NAMES)
    got = spark.createDataFrame(rows).withColumn("kept", rules.column()).collect()
    assert len(got) == 400
    for r in got:
        assert r["kept"] == next((k.keep for k in rules.rules if k.matches(r.asDict())), rules.default)
