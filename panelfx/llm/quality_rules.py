"""Quality rules as a learned decision list, on native expressions only.

Statistics of a text are Spark expressions within its row: nothing is exploded or shuffled. From
labelled statistics, sequential covering learns an ordered list: a rule grows by the threshold
condition of most FOIL gain until it is pure or long, is pruned on held-out rows while that doesn't
lower its worth, and the rows it covers are taken out. The list is emitted as nested conditions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, labelled_texts

SYMBOLS = "#*$%&|<>"
#: Labelled rows used in learning, and the thresholds tried for each statistic.
SAMPLE, CUTS = 20_000, 24
MOST_RULES, MOST_CONDITIONS = 12, 3
FEATURES = ("n_words", "mean_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "digit_ratio", "mark_ratio", "distinct_ratio", "ascii_odd_ratio")


def _drop(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def base_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (and arrays dropped).

    A null text counts as empty. Windows of three words are compared by 64-bit hashes; a word that is in
    any window that occurs twice counts once.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.withColumn("_t", text).withColumn("_w", F.filter(F.split("_t", SPACE + "+"), lambda x: x != ""))
    n = F.size("_w")
    # a window's hash and place; equal hashes are neighbours once sorted
    two = F.transform("_w", lambda x, i: F.xxhash64(x, F.get(F.col("_w"), i + 1), F.get(F.col("_w"), i + 2)))
    windows = F.when(n >= 3, F.slice(two, F.lit(1), n - 2)).otherwise(F.array().cast("array<bigint>"))
    d = d.withColumn("_h", windows).withColumn("_some", F.size(F.array_distinct("_h")) < F.size("_h"))
    placed = F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    d = d.withColumn("_p", F.when(F.col("_some"), placed))
    again = F.filter("_p", lambda x, i: (x["h"] == F.get(F.col("_p"), i + 1)["h"]) | (x["h"] == F.get(F.col("_p"), i - 1)["h"]))
    d = d.withColumn("_r", F.sort_array(F.transform(again, lambda x: x["i"])))
    covered = F.aggregate(
        F.transform("_r", lambda x, i: F.least(F.lit(3), F.coalesce(x - F.get(F.col("_r"), i - 1), F.lit(3)))),
        F.lit(0).cast("long"),
        lambda acc, x: acc + x,
    )
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumn("_l", lines)
    out = {
        "n_words": n.cast("long"),
        "word_chars": F.length(F.translate("_t", " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": _drop(F.col("_t"), SYMBOLS).cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
    }
    return d.withColumns({"_nl": F.size("_l"), "_nd": F.size(F.array_distinct("_w"))} | {f"_{k}": v for k, v in out.items()}).drop("_h", "_p", "_r", "_l", "_w", "_some")


def stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the base counts and the ratios that rules may test."""
    kept = docs.columns
    d = base_stats(docs, text_col)
    t, chars = F.col("_t"), F.greatest(F.col("_word_chars"), F.lit(1)).cast("double")
    words = F.greatest(F.col("_n_words"), F.lit(1)).cast("double")
    upper = F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}", ""))
    digits = _drop(t, "0123456789")
    ratios = {
        "mean_word": F.col("_word_chars") / words,
        "symbol_ratio": F.col("_n_symbols") / words,
        "dup_line_ratio": F.col("_n_dup_lines") / F.greatest(F.col("_nl"), F.lit(1)).cast("double"),
        "repeat_ratio": F.col("_n_repeat_words") / words,
        "upper_ratio": upper / chars,
        "digit_ratio": digits / chars,
        "mark_ratio": _drop(t, "!?.,;:") / words,
        "distinct_ratio": F.col("_nd") / words,
        "ascii_odd_ratio": _drop(t, "{}[]()=_/\\\"'~^@+|") / words,
    }
    counts = {k: F.col(f"_{k}") for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    return d.select(*kept, *[v.alias(k) for k, v in counts.items()], *[v.alias(k) for k, v in ratios.items()])


@dataclass
class Rule:
    """All conditions (statistic, ``<=`` or ``>``, threshold) together give the verdict."""

    conditions: list[tuple[str, str, float]]
    keep: bool
    covered: int = 0
    right: int = 0

    def matches(self, row: dict) -> bool:
        return all(row[f] <= c if op == "<=" else row[f] > c for f, op, c in self.conditions)

    def column(self) -> Column:
        out = F.lit(True)
        for f, op, c in self.conditions:
            out = out & (F.col(f) <= c if op == "<=" else F.col(f) > c)
        return out

    def __str__(self) -> str:
        return " and ".join(f"{f} {op} {c:.6g}" for f, op, c in self.conditions) + f" -> {'keep' if self.keep else 'drop'} ({self.right}/{self.covered})"


@dataclass
class DecisionList:
    rules: list[Rule] = field(default_factory=list)
    default: bool = True

    def column(self) -> Column:
        """The ordered list as one conditional expression: true to keep."""
        out = None
        for r in self.rules:
            out = F.when(r.column(), F.lit(r.keep)) if out is None else out.when(r.column(), F.lit(r.keep))
        return F.lit(self.default) if out is None else out.otherwise(F.lit(self.default))


def learn(rows: list[dict], label: str = "label", features: tuple[str, ...] = FEATURES, target: int = 0, least: int = 5, purity: float = 0.9) -> DecisionList:
    """Sequential covering of the rows labelled ``target`` (0: to be dropped); everything else is kept.

    Of every three rows the third prunes. Rules end where the pruned rule is right in less than
    ``purity`` of the rows it covers, or covers fewer than ``least``. Ties go to the earlier statistic and
    lower threshold. No rows, or rows of one label, give an empty list.
    """
    cuts = {}
    for f in features:
        v = sorted({r[f] for r in rows})
        step = max(1, len(v) // CUTS)
        mids = [(a + b) / 2 for a, b in zip(v, v[1:], strict=False)]
        by_rank = sorted(r[f] for r in rows)
        tails = [by_rank[int(q * (len(by_rank) - 1))] for q in (0.005, 0.01, 0.02, 0.05, 0.1, 0.9, 0.95, 0.98, 0.99, 0.995)] if rows else []
        cuts[f] = sorted(set(mids[::step]) | set(tails))
    grow, prune = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if not i % 3]
    found: list[Rule] = []
    while len(found) < MOST_RULES:
        p0, n0 = _count(grow, label, target)
        if p0 < least:
            break
        rule, inside = Rule([], target != 0), grow
        while len(rule.conditions) < MOST_CONDITIONS:
            p, n = _count(inside, label, target)
            if not n or not p:
                break
            best, gain = None, 1e-9
            for f in features:
                for c, (pl, nl) in _below(inside, f, cuts[f], label, target):
                    for op, pp, nn in (("<=", pl, nl), (">", p - pl, n - nl)):
                        if pp >= least and (g := pp * (math.log2(pp / (pp + nn)) - math.log2(p / (p + n)))) > gain:
                            best, gain = (f, op, c), g
            if best is None:
                break
            rule.conditions.append(best)
            inside = [r for r in inside if rule.matches(r)]
        if not rule.conditions:
            break
        while len(rule.conditions) > 1:
            shorter = Rule(rule.conditions[:-1], rule.keep)
            if _worth(shorter, prune, label, target) < _worth(rule, prune, label, target):
                break
            rule = shorter
        both = [r for r in rows if rule.matches(r)]
        p, n = _count(both, label, target)
        if p < least or p < purity * (p + n):
            break
        rule.covered, rule.right = p + n, p
        found.append(rule)
        rows = [r for r in rows if not rule.matches(r)]
        grow, prune = [r for r in grow if not rule.matches(r)], [r for r in prune if not rule.matches(r)]
    return DecisionList(found, default=target == 0)


def _count(rows: list[dict], label: str, target: int) -> tuple[int, int]:
    p = sum(r[label] == target for r in rows)
    return p, len(rows) - p


def _below(rows: list[dict], f: str, cuts: list[float], label: str, target: int):
    """For each threshold, how many rows of the target and of the others are at or below it."""
    ordered = sorted((r[f], r[label] == target) for r in rows)
    i = p = n = 0
    for c in cuts:
        while i < len(ordered) and ordered[i][0] <= c:
            p, n, i = p + ordered[i][1], n + (not ordered[i][1]), i + 1
        yield c, (p, n)


def _worth(rule: Rule, rows: list[dict], label: str, target: int) -> float:
    p, n = _count([r for r in rows if rule.matches(r)], label, target)
    return (p - n) / (p + n) if p + n else -1.0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> DecisionList:
    """Learn from the statistics of a bounded sample of labelled documents (``sample`` at most, one row an id)."""
    rows = labelled_texts(docs, labels, id_col, text_col, label_col, sample)
    got = stats(rows, "_text").select("_id", "label", *FEATURES).collect()
    return learn(sorted((r.asDict() for r in got), key=lambda r: r["_id"]))


def apply(docs: DataFrame, rules: DecisionList, id_col: str = "doc_id", text_col: str = "text", least_words: int = 50, most_repeat: int = 50) -> DataFrame:
    """The id, all statistics, base_failed and kept for every row.

    Null and empty texts have no words and so fail the base. Repeated rows are judged alike, texts of any
    length whole, and columns of ``docs`` that share a statistic's name don't clash: only id and text are read.
    """
    named = docs.select(F.col(id_col).alias("_key"), F.col(text_col).alias("_text"))
    d = stats(named, "_text")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat * F.col("n_words"))
    d = d.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & rules.column())
    return d.withColumnRenamed("_key", id_col).drop("_text")
