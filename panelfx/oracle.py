"""DuckDB SQL for the registered queries, composed of named steps."""

from __future__ import annotations

RULES = {
    "block": "u % 5 = 0 AND t >= 21",
    "staggered": "u % 4 = 0 AND t >= 12 + 3 * (u % 3)",
    "switching": "u % 5 = 1 AND t BETWEEN 15 AND 20",
}
LT, LU, B = 0.1, 0.05, 200


def cells(rule: str = "block", period: str = "quarter") -> str:
    return f"""
raw AS (SELECT c_nationkey AS unit, date_trunc('{period}', o_orderdate) AS time, avg(o_totalprice) / 1000 AS y
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
idx AS (SELECT unit, time, dense_rank() OVER (ORDER BY unit) - 1 AS u, dense_rank() OVER (ORDER BY time) - 1 AS t, y FROM raw),
cells AS (SELECT *, CASE WHEN {RULES[rule]} THEN 1 ELSE 0 END AS d FROM idx),
valid AS (SELECT u, t, y FROM cells WHERE d = 0 AND y IS NOT NULL),
treated AS (SELECT u, t, y FROM cells WHERE d = 1 AND y IS NOT NULL),
units AS (SELECT u, max(d) = 1 AS treated, min(CASE WHEN d = 1 THEN t END) AS first_t FROM cells GROUP BY u),
shape AS (SELECT count(DISTINCT t) AS n_t, count(DISTINCT t) - min(CASE WHEN d = 1 THEN t END) AS t_post FROM cells)"""


def pairs() -> str:
    return """
pairs AS (SELECT a.u AS i, b.u AS j, sum((a.y - b.y) * (a.y - b.y)) AS sum_sq, count(*) AS n
          FROM valid a JOIN valid b ON a.t = b.t AND a.u <> b.u GROUP BY 1, 2)"""


def zero(lu: float = 0.0) -> str:
    """The two-step estimator at norm penalty 0, by target."""
    w = "1.0" if lu == 0 else f"coalesce((SELECT exp(-{lu} * sqrt(p.sum_sq / p.n)) FROM pairs p WHERE p.i = x.u AND p.j = v.u), 0.0)"
    return (
        pairs()
        + f""",
sums AS (SELECT p.t, v.u, sum(exp(-{LT} * abs(p.t - v.t))) AS sw, sum(exp(-{LT} * abs(p.t - v.t)) * v.y) AS swy
         FROM (SELECT DISTINCT t FROM treated) p CROSS JOIN valid v GROUP BY 1, 2),
near AS (SELECT x.u, x.t, {w} AS w, v.y - s.swy / s.sw AS r
         FROM treated x JOIN valid v ON v.t = x.t JOIN sums s ON s.t = x.t AND s.u = v.u),
tau AS (SELECT x.u, x.t, x.y, coalesce(s.swy / s.sw, 0) AS alpha, coalesce(n.b, 0) AS beta, x.y - coalesce(s.swy / s.sw, 0) - coalesce(n.b, 0) AS tau
        FROM treated x LEFT JOIN sums s ON s.t = x.t AND s.u = x.u
        LEFT JOIN (SELECT u, t, CASE WHEN sum(w) > 0 THEN sum(w * r) / sum(w) END AS b FROM near GROUP BY 1, 2) n ON n.u = x.u AND n.t = x.t)"""
    )


DESIGN = """
design AS (SELECT i.u, n_regionkey AS stratum, n_nationkey AS psu, c.w, 20.0 AS fpc
           FROM (SELECT DISTINCT unit, u FROM cells) i
           JOIN (SELECT c_nationkey, count(DISTINCT c_custkey)::DOUBLE AS w FROM customer GROUP BY 1) c ON c.c_nationkey = i.unit
           JOIN nation ON n_nationkey = i.unit)"""


def rnd(b: str, k: str, seed: int = 42) -> str:
    x = f"(({b})::BIGINT * 7919 + ({k})::BIGINT * 104729 + {seed * 613 + 1}) % 2147483647"
    for c in (48271, 69621, 16807):
        x = f"(SELECT ((x0 * x0) % 2147483647 + x0 * {c} + {c}) % 2147483647 FROM (SELECT {x} AS x0))"
    return x


DRAWS = f"""
ranked AS (SELECT u, treated, row_number() OVER (PARTITION BY treated ORDER BY u) - 1 AS i, count(*) OVER (PARTITION BY treated) AS n FROM units),
slots AS (SELECT treated, n, i + CASE WHEN treated THEN (SELECT count(*) FROM units WHERE NOT treated) ELSE 0 END AS k FROM ranked),
x0 AS (SELECT b, k, treated, n, (b * 7919 + k * 104729 + {42 * 613 + 1}) % 2147483647 AS x FROM range({B}) r(b) CROSS JOIN slots),
x1 AS (SELECT b, k, treated, n, ((x * x) % 2147483647 + x * 48271 + 48271) % 2147483647 AS x FROM x0),
x2 AS (SELECT b, k, treated, n, ((x * x) % 2147483647 + x * 69621 + 69621) % 2147483647 AS x FROM x1),
x3 AS (SELECT b, k, treated, n, ((x * x) % 2147483647 + x * 16807 + 16807) % 2147483647 AS x FROM x2),
draws AS (SELECT x3.b, x3.k, ranked.u FROM x3 JOIN ranked ON ranked.treated = x3.treated AND ranked.i = x3.x % x3.n)"""

BOOT_BODY = """
mult AS (SELECT b, u, count(*) AS m FROM draws GROUP BY 1, 2),
rest AS (SELECT v.u, v.t, v.y - s.swy / s.sw AS r FROM valid v JOIN sums s ON s.u = v.u AND s.t = v.t),
bb AS (SELECT m.b, r.t, sum(m.m * r.r) / sum(m.m) AS beta FROM mult m JOIN rest r ON r.u = m.u GROUP BY 1, 2),
bt AS (SELECT m.b, m.m, t.u, t.y - t.alpha - coalesce(bb.beta, 0) AS tau FROM mult m JOIN tau t ON t.u = m.u LEFT JOIN bb ON bb.b = m.b AND bb.t = t.t),
boot AS (SELECT b, sum(m * tau) / sum(m) AS att FROM bt GROUP BY b)"""


def rao(b: int, design: str = "design", lonely: str = "skip") -> str:
    base = "w"
    extra = ""
    if lonely == "centered":
        extra = f"""
mean AS (SELECT avg(s) AS mean_psu FROM (SELECT sum(w) AS s FROM {design} GROUP BY stratum, psu)),
g0 AS (SELECT b, h, (b * 7919 + {44 * 613 + 1} + h) % 2147483647 AS x FROM range({b}) r(b) CROSS JOIN strata),
g1 AS (SELECT b, h, ((x * x) % 2147483647 + x * 48271 + 48271) % 2147483647 AS x FROM g0),
g2 AS (SELECT b, h, ((x * x) % 2147483647 + x * 69621 + 69621) % 2147483647 AS x FROM g1),
sign AS (SELECT b, h, CASE WHEN ((x * x) % 2147483647 + x * 16807 + 16807) % 2147483647 % 2 = 0 THEN 1.0 ELSE -1.0 END AS sg FROM g2),"""
        base = "CASE WHEN s.n = 1 THEN greatest(0, w + (SELECT sg FROM sign WHERE sign.b = q.b AND sign.h = s.h) * (w - (SELECT mean_psu FROM mean))) ELSE w END"
    return f"""
h0 AS (SELECT stratum, n, fpc, n / fpc AS f, CASE WHEN fpc IS NULL THEN n - 1 ELSE greatest(1, round((1 - n / fpc) * (n - 1))::INT) END AS m,
                  ((row_number() OVER (ORDER BY stratum) - 1) * 7919 + {43 * 613 + 1}) % 2147483647 AS h
           FROM (SELECT stratum, count(DISTINCT psu) AS n, max(fpc) AS fpc FROM {design} GROUP BY 1)),
h1 AS (SELECT * REPLACE (((h * h) % 2147483647 + h * 48271 + 48271) % 2147483647 AS h) FROM h0),
h2 AS (SELECT * REPLACE (((h * h) % 2147483647 + h * 69621 + 69621) % 2147483647 AS h) FROM h1),
strata AS (SELECT * REPLACE (((h * h) % 2147483647 + h * 16807 + 16807) % 2147483647 AS h) FROM h2),
psus AS (SELECT stratum, psu, row_number() OVER (PARTITION BY stratum ORDER BY psu) - 1 AS i FROM (SELECT DISTINCT stratum, psu FROM {design})),
y0 AS (SELECT b, s.stratum, s.n, (b * 7919 + k * 104729 + {42 * 613 + 1} + s.h) % 2147483647 AS x
       FROM range({b}) r(b) CROSS JOIN (SELECT *, unnest(range(m)) AS k FROM strata WHERE n > 1 AND coalesce(f, 0) < 1) s),
y1 AS (SELECT b, stratum, n, ((x * x) % 2147483647 + x * 48271 + 48271) % 2147483647 AS x FROM y0),
y2 AS (SELECT b, stratum, n, ((x * x) % 2147483647 + x * 69621 + 69621) % 2147483647 AS x FROM y1),
y3 AS (SELECT b, stratum, ((x * x) % 2147483647 + x * 16807 + 16807) % 2147483647 % n AS i FROM y2),
taken AS (SELECT y3.b, p.stratum, p.psu, count(*) AS r FROM y3 JOIN psus p ON p.stratum = y3.stratum AND p.i = y3.i GROUP BY 1, 2, 3),{extra}
rw AS (SELECT q.b, d.u, CASE WHEN s.n = 1 OR coalesce(s.f, 0) >= 1 THEN {base} ELSE d.w * s.n / s.m * coalesce(t.r, 0) END AS w
       FROM range({b}) q(b) CROSS JOIN {design} d JOIN strata s ON s.stratum = d.stratum
       LEFT JOIN taken t ON t.b = q.b AND t.stratum = d.stratum AND t.psu = d.psu)"""


CV = """
grid AS (SELECT row_number() OVER (ORDER BY lam_time, lam_unit) - 1 AS g_id, lam_time, lam_unit
         FROM (VALUES (0.0::DOUBLE), (0.1), (0.5)) a(lam_time) CROSS JOIN (VALUES (0.0::DOUBLE), (0.05)) b(lam_unit)),
per AS (SELECT l.lam_time, p.t, v.u, sum(exp(-l.lam_time * abs(p.t - v.t))) AS sw, sum(exp(-l.lam_time * abs(p.t - v.t)) * v.y) AS swy
       FROM (SELECT DISTINCT lam_time FROM grid) l CROSS JOIN (SELECT DISTINCT t FROM valid) p CROSS JOIN valid v GROUP BY 1, 2, 3),
cell AS (SELECT a.lam_time, a.t, a.u, v.y, v.y - a.swy / a.sw AS r, CASE WHEN a.sw - 1 > 1e-12 THEN (a.swy - v.y) / (a.sw - 1) ELSE 0 END AS alpha
         FROM per a JOIN valid v ON v.u = a.u AND v.t = a.t),
twin AS (SELECT a.lam_time, a.u, a.t, a.y, a.alpha, b.r,
                CASE WHEN p.n > 1 THEN sqrt(greatest(p.sum_sq - (a.y - b.y) * (a.y - b.y), 0) / (p.n - 1)) END AS dist
         FROM cell a JOIN cell b ON a.lam_time = b.lam_time AND a.t = b.t AND a.u <> b.u LEFT JOIN pairs p ON p.i = a.u AND p.j = b.u),
wt AS (SELECT g.g_id, g.lam_time, g.lam_unit, x.u, x.t, x.y, x.alpha, x.r,
              CASE WHEN g.lam_unit = 0 THEN 1.0 WHEN x.dist IS NULL THEN 0.0 ELSE exp(-g.lam_unit * x.dist) END AS w
       FROM twin x JOIN grid g ON g.lam_time = x.lam_time),
loo AS (SELECT g_id, lam_time, lam_unit, y - alpha - CASE WHEN sum(w) > 0 THEN sum(w * r) / sum(w) ELSE 0 END AS tau
        FROM wt GROUP BY g_id, lam_time, lam_unit, u, t, y, alpha),
scores AS (SELECT g_id, lam_time, lam_unit, sum(tau * tau) AS q, count(tau) AS n_valid, count(*) AS n_attempted FROM loo GROUP BY 1, 2, 3),
best AS (SELECT * FROM scores ORDER BY round(q, 9), lam_time, lam_unit, g_id LIMIT 1)"""

JOINT = f"""
jt AS (SELECT DISTINCT t AS s, exp(-{LT} * abs(t - (n_t - t_post / 2.0))) AS delta_time FROM cells CROSS JOIN shape),
path AS (SELECT t, avg(y) AS m FROM cells JOIN units USING (u) CROSS JOIN shape WHERE units.treated AND t < n_t - t_post AND y IS NOT NULL GROUP BY t),
rm AS (SELECT u, sqrt(avg((y - m) * (y - m))) AS rmse FROM cells JOIN path USING (t) GROUP BY u),
ju AS (SELECT units.u AS j, rmse, CASE WHEN rmse IS NULL THEN 0.0 ELSE exp(-{LU} * rmse) END AS delta_unit FROM units LEFT JOIN rm USING (u))"""

JOINT_GRID = """
gr AS (SELECT lam_time, lam_unit FROM (VALUES (0.0::DOUBLE), (0.1), (0.5)) a(lam_time) CROSS JOIN (VALUES (0.0::DOUBLE), (0.05)) b(lam_unit)),
jr AS (SELECT lam_time, lam_unit, units.treated AS tr, t < n_t - t_post AS pre, exp(-lam_time * abs(t - (n_t - t_post / 2.0))) AS dt,
              coalesce(exp(-lam_unit * rmse), 0) AS du, y
       FROM cells JOIN units USING (u) LEFT JOIN rm USING (u) CROSS JOIN shape CROSS JOIN gr),
ja AS (SELECT lam_time, lam_unit, avg(y) FILTER (tr AND NOT pre) - sum(dt * y) FILTER (tr AND pre) / sum(dt) FILTER (tr AND pre)
              - sum(du * y) FILTER (NOT tr AND NOT pre) / sum(du) FILTER (NOT tr AND NOT pre) + sum(dt * du * y) FILTER (NOT tr AND pre) / sum(dt * du) FILTER (NOT tr AND pre) AS att
       FROM jr GROUP BY 1, 2)"""

#: The joint estimator's own effects, by sums over its weighted cells.
JOINT_TAU = """
jw AS (SELECT c.u, c.t, c.y, units.treated AS tr, c.t < n_t - t_post AS pre, delta_time AS dt, delta_unit AS du
       FROM cells c JOIN units USING (u) JOIN jt ON jt.s = c.t JOIN ju ON ju.j = c.u CROSS JOIN shape),
jtau AS (SELECT x.u, x.t, x.y, x.y - (SELECT sum(p.dt * p.y) / sum(p.dt) FROM jw p WHERE p.u = x.u AND p.pre) - (SELECT sum(p.du * p.y) / sum(p.du) FROM jw p WHERE p.t = x.t AND NOT p.tr)
                + (SELECT sum(p.dt * p.du * p.y) / sum(p.dt * p.du) FROM jw p WHERE p.pre AND NOT p.tr) AS tau
         FROM treated x)"""

#: Leave-one-out misses of the joint fit by its effects and leverages: a, b are time and unit weights, capitals their sums.
CV_JOINT = """
grid AS (SELECT row_number() OVER (ORDER BY lam_time, lam_unit) - 1 AS g_id, lam_time, lam_unit
         FROM (VALUES (0.0::DOUBLE), (0.1), (0.5)) a(lam_time) CROSS JOIN (VALUES (0.0::DOUBLE), (0.05)) b(lam_unit)),
k AS (SELECT g_id, lam_time, lam_unit, cells.u, t, y, units.treated AS tr, t < n_t - t_post AS pre, exp(-lam_time * abs(t - (n_t - t_post / 2.0))) AS a, coalesce(exp(-lam_unit * rmse), 0) AS b
      FROM cells JOIN units USING (u) LEFT JOIN rm USING (u) CROSS JOIN shape CROSS JOIN grid WHERE NOT units.treated OR t < n_t - t_post),
ku AS (SELECT g_id, u, any_value(tr) AS tr, any_value(b) AS b, sum(a * y) / sum(a) AS m FROM k GROUP BY 1, 2),
kt AS (SELECT g_id, t, any_value(pre) AS pre, any_value(a) AS a, sum(b * y) / sum(b) AS n FROM k GROUP BY 1, 2),
su AS (SELECT g_id, sum(b) AS sb, sum(b) FILTER (tr) AS sbt FROM ku GROUP BY 1),
st AS (SELECT g_id, sum(a) AS sa, sum(a) FILTER (pre) AS sa0 FROM kt GROUP BY 1),
km AS (SELECT g_id, sum(a * b * y) FILTER (NOT tr) / sum(a * b) FILTER (NOT tr) AS mc, sum(a * b * y) FILTER (NOT tr AND pre) / sum(a * b) FILTER (NOT tr AND pre) AS mc0,
              sum(a * b * y) FILTER (tr) / sum(a * b) FILTER (tr) AS mt0 FROM k GROUP BY 1),
ke AS (SELECT k.g_id, k.lam_time, k.lam_unit,
              k.y - (ku.m - CASE WHEN k.tr THEN mc0 ELSE mc END) - kt.n + CASE WHEN k.pre THEN sbt / sb * (mt0 - mc0) ELSE 0 END AS e,
              k.a * k.b * CASE WHEN k.tr THEN 1 / (k.b * sa0) - 1 / (sa0 * sb) + 1 / (k.a * sb)
                               WHEN k.pre THEN 1 / (k.b * sa) - 1 / (sa * (sb - sbt)) + 1 / (k.a * sb) + sbt / (sb * sa0 * (sb - sbt))
                               ELSE 1 / (k.b * sa) + 1 / (k.a * (sb - sbt)) - 1 / (sa * (sb - sbt)) END AS h
       FROM k JOIN ku ON ku.g_id = k.g_id AND ku.u = k.u JOIN kt ON kt.g_id = k.g_id AND kt.t = k.t JOIN su ON su.g_id = k.g_id JOIN st ON st.g_id = k.g_id JOIN km ON km.g_id = k.g_id),
jscores AS (SELECT g_id, lam_time, lam_unit, sum((e / (1 - h)) ** 2) AS q, count(*) AS n_valid, count(*) AS n_attempted FROM ke GROUP BY 1, 2, 3)"""

PARAMS = f"""
fits AS (SELECT t AS ft, count(*) AS k FROM treated GROUP BY 1),
alphas AS (SELECT s.u, sum(s.swy / s.sw * k) / sum(k) AS alpha FROM sums s JOIN fits ON ft = s.t GROUP BY 1),
bper AS (SELECT ft, k, v.t, avg(v.y - s.swy / s.sw) AS b FROM fits JOIN sums s ON s.t = ft JOIN valid v ON v.u = s.u GROUP BY 1, 2, 3),
betas AS (SELECT t, sum(b * k) / sum(k) AS beta FROM bper GROUP BY 1),
pred AS (SELECT c.u, c.t, c.y, c.d, alpha, beta, CAST(NULL AS DOUBLE) AS mu,
                CASE WHEN c.d = 1 AND tau IS NOT NULL THEN c.y - tau ELSE coalesce(alpha, 0) + coalesce(beta, 0) END AS y0,
                CASE WHEN c.d = 1 THEN tau END AS te
         FROM cells c LEFT JOIN alphas USING (u) LEFT JOIN betas USING (t) LEFT JOIN (SELECT u, t, tau FROM tau) x USING (u, t)),
gaps AS (SELECT c.t - first_t AS h, count(c.y) AS n, avg(c.y - alpha - beta) AS gap, CASE WHEN count(c.y) >= 2 THEN stddev_samp(c.y - alpha - beta) / sqrt(count(c.y)) END AS se
         FROM cells c JOIN units ON units.u = c.u AND units.treated JOIN alphas ON alphas.u = c.u JOIN betas ON betas.t = c.t
         WHERE c.t - first_t BETWEEN -5 AND -1 AND c.y IS NOT NULL GROUP BY 1)"""

ES = """
hz AS (SELECT tau.t - first_t AS h, count(tau) AS n, avg(tau) AS att, stddev_samp(tau) AS sd FROM tau JOIN units USING (u) GROUP BY 1),
es AS (SELECT s.h, coalesce(n, 0) AS n, att, CASE WHEN n >= 2 THEN sd / sqrt(n) END AS se
       FROM (SELECT unnest(range(min(h), max(h) + 1)) AS h FROM hz) s LEFT JOIN hz ON hz.h = s.h)"""

Z95 = 1.959963984540054
MHT = """
ps AS (SELECT h, att, se, att / se AS z,
              CASE WHEN abs(att / se) < 3 THEN 2 * (0.5 - exp(-z2 / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 90), lambda k:
                  CASE WHEN z2 = 0 THEN 0 ELSE exp((2 * k + 1) * ln(sqrt(z2)) - ((k + 1) * ln(2) + lgamma(k + 1.5) - 0.5 * ln(pi()))) END)))
              ELSE 2 * exp(-z2 / 2) / sqrt(2 * pi()) / list_reduce(list_prepend(sqrt(z2)::DOUBLE, list_transform(range(0, 60), lambda k: (60 - k)::DOUBLE)), lambda acc, k: sqrt(z2) + k / acc) END AS p
       FROM (SELECT *, (att / se) * (att / se) AS z2 FROM es WHERE n >= 2 AND se > 0)),
rk AS (SELECT *, count(*) OVER () AS k, row_number() OVER (ORDER BY p, h) AS i FROM ps)"""

OUT = """
q0 AS (SELECT y, row_number() OVER (ORDER BY y) AS r, count(*) OVER () AS n FROM cells WHERE y IS NOT NULL),
q AS (SELECT avg(y) FILTER (CASE WHEN n * 0.25 = floor(n * 0.25) THEN r BETWEEN n * 0.25 AND n * 0.25 + 1 ELSE r = ceil(n * 0.25) END) AS q1,
             avg(y) FILTER (CASE WHEN n * 0.75 = floor(n * 0.75) THEN r BETWEEN n * 0.75 AND n * 0.75 + 1 ELSE r = ceil(n * 0.75) END) AS q3 FROM q0)"""

DIMS = """
dm AS (SELECT count(DISTINCT u) AS n_units, count(DISTINCT t) AS n_periods, count(y) AS n_obs, min(t) AS t_min, max(t) AS t_max FROM cells),
dims AS (SELECT *, 1 - n_obs / (n_units * n_periods) AS miss FROM dm)"""
DIMS_OUT = "n_units, n_periods, n_obs, t_min, t_max, round(miss, 6) + 0.0 AS miss, CASE WHEN miss > 0.3 THEN 'error' WHEN miss > 0.1 THEN 'warn' WHEN miss >= 1e-10 THEN 'note' ELSE 'balanced' END AS tier, miss < 1e-10 AS balanced"
SWITCH = """
lagged AS (SELECT *, lag(d) OVER (PARTITION BY u ORDER BY t) AS b FROM cells),
sw AS (SELECT u, max(d) AS ever, min(CASE WHEN d = 1 THEN t END) AS first_t, coalesce(sum((d <> b)::INT), 0) AS n_switch, coalesce(sum((d = 0 AND b = 1)::INT), 0) AS n_back FROM lagged GROUP BY u)"""
PATTERN = SWITCH + """,
sa AS (SELECT max(n_switch) AS max_switch, count(DISTINCT first_t) AS n_cohorts, sum(ever) AS n_treated_units, min(first_t) AS t1, max(n_back) = 0 AS absorbing FROM sw),
pp AS (SELECT count(*) FILTER (t < (SELECT t1 FROM sa)) AS n_pre, sum(any_d) AS n_post FROM (SELECT t, max(d) AS any_d FROM cells GROUP BY t))"""
FEAS = """
fu AS (SELECT u, max(d) AS ever, count(*) FILTER (d = 0 AND y IS NOT NULL) AS n_control, min(CASE WHEN d = 1 THEN t END) AS first_t, min(t) AS t0 FROM cells GROUP BY u),
fe AS (SELECT sum(ever) AS n_treated, sum(1 - ever) AS n_never, sum(n_control) AS n_control_cells, min(first_t - t0) FILTER (ever = 1) AS min_pre, min(n_control) FILTER (ever = 1) AS min_own_control, (SELECT var_samp(y) FROM cells) AS var_y FROM fu),
fo AS (SELECT *, coalesce(var_y > 0 AND n_treated >= 1 AND n_never >= 2 AND n_control_cells >= 1 AND min_pre >= 2 AND min_own_control >= 1, false) AS feasible FROM fe)"""
MVP = """
mvp AS (SELECT min(coalesce(n, 0)) AS min_valid_pairs FROM units LEFT JOIN (SELECT i AS u, max(n) AS n FROM pairs GROUP BY 1) p USING (u) WHERE treated)"""
DIST = """
own AS (SELECT u, count(*) AS own FROM valid GROUP BY u),
dist AS (SELECT a.u AS i, b.u AS j, CASE WHEN a.u = b.u THEN coalesce(own, 0) ELSE coalesce(p.n, 0) END AS n, CASE WHEN a.u = b.u THEN 0 ELSE sqrt(p.sum_sq / p.n) END AS dist
         FROM units a CROSS JOIN units b LEFT JOIN pairs p ON p.i = a.u AND p.j = b.u LEFT JOIN own ON own.u = a.u)"""


def r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)


def sql(steps: list[str], select: str) -> str:
    return "WITH " + ",".join(steps) + "\n" + select


C, S, W = cells(), cells("staggered"), cells("switching")
M = cells("block", "month")
FIRST = "first AS (SELECT * FROM treated ORDER BY t, u LIMIT 1)"

def grid(times: str, norms: str) -> str:
    return sql([C], f"SELECT row_number() OVER (ORDER BY i, j, k) - 1 AS g_id, lam_time, lam_unit, lam_norm, (SELECT count(*) FROM valid) AS n_fits FROM (SELECT unnest({times}::DOUBLE[]) AS lam_time, unnest(range(10)[1:len({times})]) AS i) CROSS JOIN (SELECT unnest({times}::DOUBLE[]) AS lam_unit, unnest(range(10)[1:len({times})]) AS j) CROSS JOIN (SELECT unnest({norms}::DOUBLE[]) AS lam_norm, unnest(range(10)[1:len({norms})]) AS k)")


MOMENTS = [
    "b1 AS (SELECT count(att) AS n, avg(att) AS mean, stddev_samp(att) AS sd FROM boot)",
    "b2 AS (SELECT any_value(n) AS n, any_value(mean) AS mean, avg(((att - mean) / sd) ** 3) AS skew, avg(((att - mean) / sd) ** 4) AS kurt FROM boot CROSS JOIN b1)",
]
Z90 = 1.6448536269514722

ORACLE_SQL: dict[str, str] = {
    "weight_matrix_sparse": sql(
        [C, pairs(), FIRST, f"wm AS (SELECT x.u, x.t, j.u AS j, s.s, exp(-1.0 * abs(x.t - s.s)) * CASE WHEN x.u = j.u THEN 1 ELSE coalesce(exp(-{LU} * sqrt(p.sum_sq / p.n)), 0) END AS w FROM first x CROSS JOIN units j CROSS JOIN (SELECT DISTINCT t AS s FROM cells) s LEFT JOIN pairs p ON p.i = x.u AND p.j = j.u)"],
        f"SELECT u, t, j, s, {r('w')} FROM wm WHERE w >= 1e-6 * (SELECT max(w) FROM wm)",
    ),
    "sparse_support": sql(
        [
            C, pairs(), "aim AS (SELECT u, t FROM cells WHERE d = 1 AND y IS NOT NULL)",
            f"wm AS (SELECT x.u, x.t, c.u AS j, c.u = x.u AS own, exp(-1.0 * abs(x.t - c.t)) AS theta, exp(-1.0 * abs(x.t - c.t)) * CASE WHEN x.u = c.u THEN 1 ELSE exp(-{LU} * sqrt(p.sum_sq / p.n)) END AS w FROM aim x CROSS JOIN cells c LEFT JOIN pairs p ON p.i = x.u AND p.j = c.u WHERE c.d = 0 AND c.y IS NOT NULL AND (c.u = x.u OR p.n > 0))",
            "unit AS (SELECT u, t, j, own, max(w) AS best, max(theta) AS near FROM wm GROUP BY ALL)",
            "top AS (SELECT u, t, max(best) FILTER (WHERE NOT own) AS top, max(near) FILTER (WHERE own) AS nearest FROM unit GROUP BY u, t)",
            "cut AS (SELECT u, t, w, theta >= 1e-6 * least(near, nearest) AND (own OR best >= 1e-6 * top) AS kept FROM wm JOIN unit USING (u, t, j, own) JOIN top USING (u, t))",
        ],
        "SELECT u, t, count(*) FILTER (WHERE kept) AS n_cells, round(sum(w) FILTER (WHERE kept), 6) + 0.0 AS kept, round(coalesce(sum(w) FILTER (WHERE NOT kept), 0), 6) + 0.0 AS left_out FROM cut GROUP BY u, t",
    ),
    "first_target": sql([C, FIRST], f"SELECT u, t, {r('y')} FROM first"),
    "grid_default": grid("[0, 0.1, 0.5, 1, 2, 5]", "[0, 0.01, 0.1, 1, 10]"),
    "grid_fine": grid("[0, 0.1, 0.3, 0.5, 1, 2, 5]", "[0, 0.01, 0.0316, 0.1, 0.316, 1, 10]"),
    "boot_variance_population": sql([C, zero(), DRAWS, BOOT_BODY], "SELECT count(*) AS n, round(var_pop(att), 6) + 0.0 AS variance, round(stddev_pop(att), 6) + 0.0 AS se FROM boot"),
    "boot_flags": sql([C, zero(), DRAWS, BOOT_BODY, *MOMENTS], "SELECT abs(skew) > 2 AS skewed, abs(kurt - 3) > 7 AS heavy, exp(-n / 6 * (skew ** 2 + (kurt - 3) ** 2 / 4) / 2) < 0.01 AS not_normal, abs(mean - 0.5) / 5.0 > 0.3 AS biased FROM b2"),
    "es_window": sql([S, zero(), ES], f"SELECT h, n, {r('att', 'se')}, round(att - {Z90} * se, 6) + 0.0 AS low, round(att + {Z90} * se, 6) + 0.0 AS high FROM es WHERE h BETWEEN 0 AND 5"),
    "priority_dims": sql(["raw AS (SELECT o_orderpriority AS unit, date_trunc('quarter', o_orderdate) AS time, avg(o_totalprice) AS y FROM orders GROUP BY 1, 2)", "cells AS (SELECT dense_rank() OVER (ORDER BY unit) - 1 AS u, dense_rank() OVER (ORDER BY time) - 1 AS t, y FROM raw)", DIMS], f"SELECT {DIMS_OUT} FROM dims"),
    "flagship_att": sql([C, zero()], f"SELECT {r('att')}, n_cells FROM (SELECT avg(tau) AS att, count(tau) AS n_cells FROM tau)"),
    "panel_index": sql([C], f"SELECT u, t, {r('y')}, d FROM cells"),
    "panel_dims": sql([C, DIMS], f"SELECT {DIMS_OUT} FROM dims"),
    "panel_dims_month": sql([M, DIMS], f"SELECT {DIMS_OUT} FROM dims"),
    "duplicates": sql([C], "SELECT u % 5 AS unit, t AS time, count(*) AS n FROM cells GROUP BY 1, 2 HAVING count(*) > 1"),
    "time_gaps": sql([M, "st AS (SELECT u, t - lag(t) OVER (PARTITION BY u ORDER BY t) AS step FROM cells)"], "SELECT u, count(*) AS n_cells, count(*) FILTER (step > 1) AS n_gaps, coalesce(min(step) > 0, true) AS rising FROM st GROUP BY u"),
    "empty_lines": sql([C], "SELECT 'u' AS axis, u AS idx FROM cells GROUP BY u HAVING count(CASE WHEN u <> 3 AND t <> 4 THEN y END) = 0 UNION ALL SELECT 't', t FROM cells GROUP BY t HAVING count(CASE WHEN u <> 3 AND t <> 4 THEN y END) = 0"),
    "treatment_values": sql([C], "SELECT n0, n1, n_other, n0 > 0 AND n1 > 0 AND n_other = 0 AS binary FROM (SELECT count(*) FILTER (d = 0) AS n0, count(*) FILTER (d = 1) AS n1, count(*) FILTER (d NOT IN (0, 1)) AS n_other FROM cells)"),
    "switch_count": sql([W, SWITCH], "SELECT * FROM sw"),
    **{
        f"pattern_{k}": sql([cells(k), PATTERN], "SELECT CASE WHEN max_switch >= 2 THEN 'switching_treatment' WHEN n_cohorts > 1 THEN 'staggered_adoption' WHEN n_treated_units > 1 THEN 'multiple_treated_simultaneous' ELSE 'single_treated_unit' END AS pattern, n_cohorts, n_treated_units, n_pre, n_post, absorbing FROM sa CROSS JOIN pp")
        for k in RULES
    },
    "cohorts": sql([S], "SELECT first_t, count(*) AS n_units, sum(n_d) AS n_cells FROM (SELECT u, min(CASE WHEN d = 1 THEN t END) AS first_t, sum(d) AS n_d FROM cells GROUP BY u) WHERE first_t IS NOT NULL GROUP BY 1"),
    "simultaneous": sql([C, "per AS (SELECT u, min(CASE WHEN d = 1 THEN t END) AS t1, sum(d) AS n_d, count(*) AS n FROM cells GROUP BY u HAVING sum(d) > 0)"], "SELECT min(t1) = max(t1) AND min(n_d) = max(n_d) AND max(n_d) = max(n_t) - min(t1) AND min(n) = max(n_t) AS simultaneous, min(t1) AS t1, max(n_t) - min(t1) AS t_post FROM per CROSS JOIN shape"),
    "outliers": sql([C, OUT], f"SELECT {r('q1', 'q3', 'low', 'high')}, (SELECT count(*) FROM cells WHERE y < low OR y > high) AS n_outliers FROM (SELECT *, q1 - 10 * (q3 - q1) AS low, q3 + 10 * (q3 - q1) AS high FROM q)"),
    "balance": sql(
        [C, "cov AS (SELECT c_nationkey AS unit, date_trunc('quarter', o_orderdate) AS time, avg(l_quantity::DOUBLE) AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)",
         "pre AS (SELECT treated, x FROM cells JOIN units USING (u) LEFT JOIN cov USING (unit, time) WHERE t < (SELECT min(t) FROM cells WHERE d = 1))",
         "ba AS (SELECT avg(x) FILTER (treated) AS mean_treated, avg(x) FILTER (NOT treated) AS mean_control, sqrt((var_samp(x) FILTER (treated) + var_samp(x) FILTER (NOT treated)) / 2) AS pooled FROM pre)",
         "bd AS (SELECT mean_treated, mean_control, CASE WHEN pooled >= 1e-10 THEN (mean_treated - mean_control) / pooled END AS std_diff FROM ba)"],
        f"SELECT {r('mean_treated', 'mean_control', 'std_diff')}, CASE WHEN abs(std_diff) < 0.1 THEN 'negligible' WHEN abs(std_diff) < 0.25 THEN 'small' WHEN abs(std_diff) < 0.5 THEN 'moderate' ELSE 'large' END AS band FROM bd",
    ),
    "feasibility": sql([C, FEAS], f"SELECT n_treated, n_never, n_control_cells, min_pre, min_own_control, {r('var_y')}, feasible FROM fo"),
    "min_valid_pairs": sql([C, pairs(), MVP], "SELECT min_valid_pairs FROM mvp"),
    "weight_check": sql([C, DESIGN], "SELECT count(*) AS n_units, count(*) FILTER (lo <= 0 OR hi - lo > 1e-12 * (abs(hi) + 1)) AS n_bad FROM (SELECT u, min(w) AS lo, max(w) AS hi FROM cells JOIN design USING (u) GROUP BY u)"),
    "design_check": sql([C, DESIGN], "SELECT stratum, count(DISTINCT psu) AS n_psu, max(fpc)::DOUBLE AS fpc, 0 AS n_shared, max(fpc) >= count(DISTINCT psu) AS ok FROM design GROUP BY stratum"),
    "report": sql(
        [C, DIMS, pairs(), MVP, FEAS],
        "SELECT 'missing_share' AS \"check\", miss <= 0.3 AS ok, round(miss, 6) + 0.0 AS value FROM dims UNION ALL SELECT 'periods', n_periods >= 2, n_periods FROM dims UNION ALL SELECT 'units', n_units >= 3, n_units FROM dims "
        "UNION ALL SELECT 'binary_treatment', count(DISTINCT d) = 2, sum(d) FROM cells UNION ALL SELECT 'feasible', feasible, n_control_cells FROM fo UNION ALL SELECT 'shared_periods', min_valid_pairs >= 2, min_valid_pairs FROM mvp "
        "UNION ALL SELECT 'no_empty_lines', true, 0 UNION ALL SELECT 'unique_cells', count(*) = count(DISTINCT (u, t)), count(*) - count(DISTINCT (u, t)) FROM cells",
    ),
    "summary_stats": sql([C, OUT, "sm AS (SELECT count(y) AS n_obs, count(DISTINCT u) AS n_units, count(DISTINCT t) AS n_periods, sum(d) AS n_treated, avg(d) AS treated_share, avg(y) AS mean, stddev_samp(y) AS sd, min(y) AS min, max(y) AS max FROM cells)"], f"SELECT n_obs, n_units, n_periods, n_treated, {r('treated_share', 'mean', 'sd', 'min', 'max')}, round(q1, 6) + 0.0 AS p25, round(q3, 6) + 0.0 AS p75 FROM sm CROSS JOIN q"),
    "events_dims": sql(["raw AS (SELECT user_id % 20 AS unit, date_trunc('day', ts) AS time, avg(value) AS y FROM events GROUP BY 1, 2)", "cells AS (SELECT dense_rank() OVER (ORDER BY unit) - 1 AS u, dense_rank() OVER (ORDER BY time) - 1 AS t, y FROM raw)", DIMS], f"SELECT {DIMS_OUT} FROM dims"),
    "unit_distance": sql([S, pairs(), DIST], f"SELECT i, j, n, {r('dist')} FROM dist"),
    "unit_distance_without": sql(
        [S],
        f"SELECT x.u, x.t, p.j, p.n, {r('dist')} FROM (SELECT u, t FROM cells WHERE d = 0 AND u < 3 AND t < 4) x JOIN (SELECT x.u, x.t, b.u AS j, count(*) FILTER (a.t <> x.t) AS n, "
        "sqrt(sum((a.y - b.y) * (a.y - b.y)) FILTER (a.t <> x.t) / count(*) FILTER (a.t <> x.t)) AS dist FROM (SELECT u, t FROM cells WHERE d = 0 AND u < 3 AND t < 4) x JOIN valid a ON a.u = x.u JOIN valid b ON b.t = a.t AND b.u <> a.u GROUP BY 1, 2, 3) p ON p.u = x.u AND p.t = x.t",
    ),
    "distance_summary": sql([C, pairs(), DIST, "dd AS (SELECT dist FROM dist WHERE i < j AND dist IS NOT NULL)", "ds AS (SELECT count(*) AS n_pairs, avg(dist) AS mean, stddev_samp(dist) AS sd, min(dist) AS min, max(dist) AS max, quantile_disc(dist, 0.25) AS p25, quantile_disc(dist, 0.5) AS p50, quantile_disc(dist, 0.75) AS p75 FROM dd)"], f"SELECT n_pairs, {r('mean', 'sd', 'min', 'max', 'p25', 'p50', 'p75')}, round(exp(-0.1 * p50), 6) + 0.0 AS weight_p50, round(exp(-0.1 * p75), 6) + 0.0 AS weight_p75 FROM ds"),
    "twostep_theta": sql([C], f"SELECT a.t, b.s, round(exp(-{LT} * abs(a.t - b.s)), 6) + 0.0 AS theta FROM (SELECT DISTINCT t FROM treated) a CROSS JOIN (SELECT DISTINCT t AS s FROM cells) b"),
    "twostep_omega": sql([S, pairs()], f"SELECT x.u, x.t, j.u AS j, round(CASE WHEN x.u = j.u THEN 1 ELSE coalesce(exp(-{LU} * sqrt(p.sum_sq / p.n)), 0) END, 6) + 0.0 AS omega FROM treated x CROSS JOIN units j LEFT JOIN pairs p ON p.i = x.u AND p.j = j.u"),
    "weight_matrix": sql([C, pairs(), FIRST], f"SELECT x.u, x.t, j.u AS j, s.s, round(exp(-{LT} * abs(x.t - s.s)) * CASE WHEN x.u = j.u THEN 1 ELSE coalesce(exp(-{LU} * sqrt(p.sum_sq / p.n)), 0) END, 6) + 0.0 AS w FROM first x CROSS JOIN units j CROSS JOIN (SELECT DISTINCT t AS s FROM cells) s LEFT JOIN pairs p ON p.i = x.u AND p.j = j.u"),
    "joint_delta_time": sql([C, JOINT], f"SELECT s, {r('delta_time')} FROM jt"),
    "joint_delta_unit": sql([C, JOINT], f"SELECT j, {r('rmse', 'delta_unit')} FROM ju"),
    "joint_delta": sql([C, JOINT], "SELECT u, t, round(delta_time * delta_unit * (1 - d), 6) + 0.0 AS delta FROM cells JOIN jt ON s = t JOIN ju ON j = u"),
    "weight_stats": sql(
        [C, JOINT, "w AS (SELECT j AS k, delta_unit AS w, delta_unit / sum(delta_unit) OVER () AS p, row_number() OVER (ORDER BY delta_unit DESC, j) AS rn FROM ju)", "run AS (SELECT *, sum(p) OVER (ORDER BY rn) AS run FROM w)",
         "ws AS (SELECT count(w) AS n, min(w) AS min, max(w) AS max, avg(w) AS mean, stddev_samp(w) AS sd, first(k ORDER BY w, k) AS argmin, first(k ORDER BY w DESC, k) AS argmax, quantile_cont(w, 0.1) AS p10, quantile_cont(w, 0.25) AS p25, quantile_cont(w, 0.5) AS p50, quantile_cont(w, 0.75) AS p75, quantile_cont(w, 0.9) AS p90, -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) AS entropy, 1 / sum(p * p) AS ess, min(rn) FILTER (run >= 0.5 - 1e-12) / count(*) AS concentration FROM run)"],
        f"SELECT n, argmin, argmax, {r('min', 'max', 'mean', 'sd', 'p10', 'p25', 'p50', 'p75', 'p90', 'entropy', 'ess', 'concentration')} FROM ws",
    ),
    "did_block": sql([C, "m AS (SELECT avg(y) FILTER (treated AND t >= n_t - t_post) AS treated_post, avg(y) FILTER (treated AND t < n_t - t_post) AS treated_pre, avg(y) FILTER (NOT treated AND t >= n_t - t_post) AS control_post, avg(y) FILTER (NOT treated AND t < n_t - t_post) AS control_pre FROM cells JOIN units USING (u) CROSS JOIN shape)"], f"SELECT {r('treated_post', 'treated_pre', 'control_post', 'control_pre')}, round(treated_post - treated_pre - control_post + control_pre, 6) + 0.0 AS did FROM m"),
    "joint_inf": sql([C, JOINT, JOINT_GRID], f"SELECT lam_time, lam_unit, {r('att')} FROM ja WHERE lam_time = {LT} AND lam_unit = {LU}"),
    "joint_inf_grid": sql([C, JOINT, JOINT_GRID], f"SELECT lam_time, lam_unit, {r('att')} FROM ja"),
    "joint_tau": sql([C, JOINT, JOINT_TAU], f"SELECT u, t, {r('y', 'tau')} FROM jtau"),
    "joint_weighted_att": sql([C, JOINT, JOINT_TAU, DESIGN], "SELECT round(sum(w * tau) / sum(w), 6) + 0.0 AS att, sum(w) AS sum_w FROM jtau JOIN design USING (u)"),
    "joint_rao_wu_att": sql([C, JOINT, JOINT_TAU, DESIGN, rao(B)], "SELECT b, round(sum(w * tau) / sum(w), 6) + 0.0 AS att FROM rw JOIN jtau USING (u) WHERE w > 0 GROUP BY b"),
    "predict_joint": sql([C, JOINT, JOINT_TAU], "SELECT u, t, round(y - tau, 6) + 0.0 AS y0, round(tau, 6) + 0.0 AS te FROM jtau"),
    "cv_joint_grid": sql([C, JOINT, CV_JOINT], f"SELECT g_id, lam_time, lam_unit, {r('q')}, n_valid, n_attempted FROM jscores"),
    "cv_joint_select": sql([C, JOINT, CV_JOINT], f"SELECT g_id, lam_time, lam_unit, {r('q')}, n_valid, n_attempted FROM jscores ORDER BY jscores.q LIMIT 1"),
    "mht_cells": sql(
        [C, zero(), "es AS (SELECT u * 100 + t AS h, 2 AS n, tau AS att, 5.0::DOUBLE AS se FROM tau)", MHT],
        f"SELECT h // 100 AS u, h % 100 AS t, {r('tau')}, {r('se', 'z', 'p')}, round(least(p * k, 1), 6) + 0.0 AS bonferroni, round(max(least(p * (k - i + 1), 1)) OVER (ORDER BY i), 6) + 0.0 AS holm, round(min(least(p * k / i, 1)) OVER (ORDER BY i DESC), 6) + 0.0 AS bh FROM (SELECT *, att AS tau FROM rk)",
    ),
    "twostep_inf": sql(
        [C, pairs(), f"bm AS (SELECT p.t, c.u, sum(exp(-{LT} * abs(p.t - c.t)) * c.y) / sum(exp(-{LT} * abs(p.t - c.t))) AS m FROM (SELECT DISTINCT t FROM treated) p CROSS JOIN cells c CROSS JOIN shape WHERE c.t < n_t - t_post GROUP BY 1, 2)",
         f"cg AS (SELECT x.u, x.t, sum(exp(-{LU} * sqrt(p.sum_sq / p.n)) * (c.y - bm.m)) / sum(exp(-{LU} * sqrt(p.sum_sq / p.n))) AS gain FROM treated x JOIN units n ON NOT n.treated JOIN pairs p ON p.i = x.u AND p.j = n.u JOIN cells c ON c.u = n.u AND c.t = x.t JOIN bm ON bm.t = x.t AND bm.u = n.u GROUP BY 1, 2)"],
        f"SELECT x.u, x.t, {r('y')}, round(x.y - bm.m - gain, 6) + 0.0 AS tau FROM treated x JOIN bm ON bm.t = x.t AND bm.u = x.u JOIN cg ON cg.u = x.u AND cg.t = x.t",
    ),
    "twostep_zero": sql([C, zero(LU)], f"SELECT u, t, {r('y', 'alpha', 'beta', 'tau')} FROM tau"),
    "twostep_zero_staggered": sql([S, zero()], f"SELECT u, t, {r('y', 'alpha', 'beta', 'tau')} FROM tau"),
    "twostep_zero_switching": sql([W, zero(LU)], "SELECT round(avg(tau), 6) + 0.0 AS att, count(tau) AS n_cells FROM tau"),
    "weighted_att": sql([C, zero(), DESIGN], "SELECT round(sum(w * tau) / sum(w), 6) + 0.0 AS att, sum(w) AS sum_w FROM tau JOIN design USING (u)"),
    "cv_zero_grid": sql([C, pairs(), CV], f"SELECT g_id, lam_time, lam_unit, {r('q')}, n_valid, n_attempted FROM scores"),
    "cv_select": sql([C, pairs(), CV], f"SELECT g_id, lam_time, lam_unit, {r('q')}, n_valid, n_attempted FROM best"),
    "cv_summary": sql([C, pairs(), CV], f"SELECT g_id, lam_time, lam_unit, {r('q')}, n_valid, n_attempted, round(sqrt(q / n_valid), 6) + 0.0 AS rmse, round(1 - n_valid / n_attempted, 6) + 0.0 AS fail_rate, 'ok' AS tier FROM scores"),
    "cv_sensitivity": sql(
        [C, pairs(), CV, "sn AS (SELECT count(q) AS n, min(q) AS q_min, max(q) AS q_max, avg(q) AS q_mean, stddev_samp(q) / avg(q) AS cv, (max(q) - min(q)) / min(q) * 100 AS range_pct, min(lam_time) AS tl, max(lam_time) AS th, min(lam_unit) AS ul, max(lam_unit) AS uh FROM scores)"],
        f"SELECT n, {r('q_min', 'q_max', 'q_mean', 'cv', 'range_pct')}, CASE WHEN cv < 0.1 THEN 'low' WHEN cv < 0.3 THEN 'moderate' ELSE 'high' END AS label, best.lam_time IN (tl, th) OR best.lam_unit IN (ul, uh) AS on_edge FROM sn CROSS JOIN best",
    ),
    "cv_top": sql([C, pairs(), CV], f"SELECT g_id, lam_time, lam_unit, {r('q')}, n_valid, n_attempted FROM (SELECT * FROM scores ORDER BY q, g_id LIMIT 3)"),
    "boot_draws": sql([C, DRAWS], "SELECT b, k, u FROM draws"),
    "boot_zero_att": sql([C, zero(), DRAWS, BOOT_BODY], f"SELECT b, {r('att')} FROM boot"),
    "boot_variance": sql([C, zero(), DRAWS, BOOT_BODY], "SELECT count(*) AS n, round(var_samp(att), 6) + 0.0 AS variance, round(stddev_samp(att), 6) + 0.0 AS se FROM boot"),
    "boot_percentile_ci": sql([C, zero(), DRAWS, BOOT_BODY], "SELECT round(quantile_cont(att, 0.025), 6) + 0.0 AS low, round(quantile_cont(att, 0.975), 6) + 0.0 AS high FROM boot"),
    "boot_moments": sql(
        [C, zero(), DRAWS, BOOT_BODY, "b1 AS (SELECT count(att) AS n, avg(att) AS mean, stddev_samp(att) AS sd FROM boot)",
         "b2 AS (SELECT any_value(n) AS n, any_value(mean) AS mean, any_value(sd) AS sd, " + ", ".join(f"quantile_cont(att, {p / 100}) AS p{p}" for p in (1, 5, 25, 50, 75, 95, 99)) + ", avg(((att - mean) / sd) ** 3) AS skew, avg(((att - mean) / sd) ** 4) AS kurt FROM boot CROSS JOIN b1)",
         "b3 AS (SELECT *, p75 - p25 AS iqr, n / 6 * (skew ** 2 + (kurt - 3) ** 2 / 4) AS jb FROM b2)"],
        f"SELECT n, {r('mean', 'sd', 'p1', 'p5', 'p25', 'p50', 'p75', 'p95', 'p99', 'skew', 'kurt', 'iqr', 'jb')}, round(exp(-jb / 2), 6) + 0.0 AS jb_p FROM b3",
    ),
    "boot_weighted_att": sql([C, zero(), DRAWS, BOOT_BODY, DESIGN], "SELECT bt.b, round(sum(m * w * tau) / sum(m * w), 6) + 0.0 AS att FROM bt JOIN design USING (u) GROUP BY bt.b"),
    "design_strata": sql([C, DESIGN, rao(1)], "SELECT stratum, n, fpc::DOUBLE AS fpc, round(f, 6) + 0.0 AS f, m FROM strata"),
    "rao_wu_weights": sql([C, DESIGN, rao(B)], f"SELECT b, u, {r('w')} FROM rw"),
    "rao_wu_att": sql([C, zero(), DESIGN, rao(B)], "SELECT b, round(sum(w * tau) / sum(w), 6) + 0.0 AS att FROM rw JOIN tau USING (u) WHERE w > 0 GROUP BY b"),
    "rao_wu_centered": sql([C, DESIGN, "few AS (SELECT * FROM design WHERE stratum > 0 OR psu = 0)", rao(B, "few", "centered")], f"SELECT b, u, {r('w')} FROM rw"),
    "kish_deff": sql([C, DESIGN], "SELECT count(*) AS n, round(greatest(1, count(*) * sum(w * w) / (sum(w) * sum(w))), 6) + 0.0 AS deff FROM design WHERE w > 0"),
    "high_fpc": sql([C, DESIGN], "SELECT count(*) FILTER (f > 0.5) AS n_high, round(max(f), 6) + 0.0 AS max_f FROM (SELECT stratum, count(DISTINCT psu) / (stratum * 2.0 + 6) AS f FROM design GROUP BY stratum)"),
    "predict_all": sql([C, zero(), PARAMS], "SELECT u, t, round(y, 6) + 0.0 AS y, d, round(alpha, 6) + 0.0 AS alpha, round(beta, 6) + 0.0 AS beta, mu, round(y0, 6) + 0.0 AS y0, round(y0 + te, 6) + 0.0 AS y1, round(te, 6) + 0.0 AS te, round(y0 + coalesce(te, 0), 6) + 0.0 AS fitted, round(y - (y0 + coalesce(te, 0)), 6) + 0.0 AS residuals FROM pred"),
    "predict_y0": sql([C, zero(), PARAMS], f"SELECT u, t, {r('y0')} FROM pred"),
    "predict_te": sql([C, zero(), PARAMS], f"SELECT u, t, {r('te')} FROM pred"),
    "fit_alpha": sql([C, zero(), PARAMS], f"SELECT u, {r('alpha')} FROM alphas"),
    "fit_beta": sql([C, zero(), PARAMS], f"SELECT t, {r('beta')} FROM betas"),
    "es_horizon": sql([S, zero(), ES], f"SELECT h, n, {r('att', 'se')}, round(att - {Z95} * se, 6) + 0.0 AS low, round(att + {Z95} * se, 6) + 0.0 AS high FROM es"),
    "es_placebo": sql([C, zero(), PARAMS], f"SELECT h, n, {r('gap', 'se')} FROM gaps"),
    "pretrend_wald": sql([C, zero(), PARAMS], "SELECT round(coalesce(sum((gap / se) ** 2), 0), 6) + 0.0 AS wald, count(*) AS df FROM gaps WHERE se > 0"),
    "mht": sql(
        [S, zero(), ES, MHT],
        f"SELECT h, {r('att', 'se', 'z', 'p')}, round(least(p * k, 1), 6) + 0.0 AS bonferroni, round(max(least(p * (k - i + 1), 1)) OVER (ORDER BY i), 6) + 0.0 AS holm, round(min(least(p * k / i, 1)) OVER (ORDER BY i DESC), 6) + 0.0 AS bh FROM rk",
    ),
}
