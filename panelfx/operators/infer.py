"""Standard errors, intervals and p-values of an estimate."""

from __future__ import annotations

import math

from ..functions.dist import normal_cdf, normal_quantile, t_cdf, t_quantile


def intervals(att: float, se: float | None, n_treated_units: int, level: float = 95.0, ci: str = "percentile", percentile: tuple[float, float] | None = None) -> dict:
    """t, p and all three intervals, and which is primary.

    The t interval has N1 - 1 degrees of freedom (of treated units) and is the normal one below two
    units. Without a positive standard error everything is None. A percentile interval that isn't
    given falls back to t, which is said in ``ci_method``.
    """
    out = dict.fromkeys(("t", "p", "df", "t_low", "t_high", "z_low", "z_high", "low", "high"))
    out |= {"att": att, "se": se, "ci_method": ci}
    if percentile is None and ci == "percentile":
        out["ci_method"] = "percentile->t"
    if not se or not se > 0 or not math.isfinite(att):
        return out | {"se": None}
    df, tail = max(1, n_treated_units - 1), (1 + level / 100) / 2
    use_t = n_treated_units >= 2
    t = att / se
    q = t_quantile(tail, df) if use_t else normal_quantile(tail)
    p = 2 * (1 - (t_cdf(abs(t), df) if use_t else normal_cdf(abs(t))))
    z = normal_quantile(tail)
    out |= {"t": t, "p": p, "df": df, "t_low": att - q * se, "t_high": att + q * se, "z_low": att - z * se, "z_high": att + z * se}
    if ci == "normal":
        out |= {"p": 2 * (1 - normal_cdf(abs(t))), "low": out["z_low"], "high": out["z_high"]}
    elif ci == "percentile" and percentile:
        out |= {"low": percentile[0], "high": percentile[1]}
    else:
        out |= {"low": out["t_low"], "high": out["t_high"]}
    return out
