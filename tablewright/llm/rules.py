"""Quality rules as a learned decision list: sequential covering.

Rules that recognise bad documents are learned one after the other from labelled statistics.
A rule is a conjunction of thresholds; it is *grown* condition by condition for the greatest
gain of information on one part of the sample, *pruned* from its end as long as that does not
hurt on the other part (Cohen's RIPPER, 1995, without its optimisation rounds), and what it
covers leaves the sample. Learning ends when a pruned rule is no longer right more often than
``LEAST_PRECISION``. The list is emitted as one ordered Spark expression, so that applying it is
a projection and reading it is easy.

At scale: statistics are computed in one pass over the texts and written once; labels meet them
by a join of numbers. At most ``SAMPLE`` labelled rows, taken by a hash of the id, come to the
driver to be learned from, however many rows or partitions there are. Nothing else is bounded.

Defined results: null text has no words, and fails the base rule like any text of fewer than
50 words. Without labels of both kinds the list is empty and keeps what passes the base rule.
Repeated rows are judged one by one and learned from once; an id with two different labels is
learned from with both. Of conditions of equal gain the first by name, then the lower threshold, is
taken. An empty table has no verdicts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import discarding_stages, staged
from .batches import held_out, sampled_rows
from .statistics import ratios, with_counts

#: Labelled rows learned from at most.
SAMPLE = 20_000
#: Thresholds tried for one statistic: this many quantiles of the rows left.
QUANTILES = 64
MOST_RULES = 12
MOST_CONDITIONS = 4
LEAST_PRECISION = 0.8
LEAST_COVERED = 5


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        v = values[self.name]
        return v >= self.threshold if self.above else v <= self.threshold

    def column(self, columns: dict[str, Column]) -> Column:
        c = columns[self.name]
        return c >= F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        found = np.ones(len(next(iter(values.values()))), bool)
        for c in self.conditions:
            found &= c.holds(values)
        return found

    def column(self, columns: dict[str, Column]) -> Column:
        found = F.lit(True)
        for c in self.conditions:
            found &= c.column(columns)
        return found

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def _gain(hit: np.ndarray, bad: np.ndarray) -> float:
    """FOIL's gain of narrowing the rows to ``hit``."""
    p0, n0, p1, n1 = bad.sum(), (~bad).sum(), (hit & bad).sum(), (hit & ~bad).sum()
    return float(p1 * (np.log2(p1 / (p1 + n1)) - np.log2(p0 / (p0 + n0)))) if p1 else 0.0


def grow(values: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    rule: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < MOST_CONDITIONS and (inside & ~bad).any() and (inside & bad).any():
        best, best_gain = None, 1e-9
        for name in sorted(values):
            here = values[name][inside]
            cuts = np.unique(here)
            if len(cuts) > QUANTILES:
                # between the values of bad rows and good ones alike
                cuts = np.unique(np.concatenate([np.quantile(here[kind], np.linspace(0, 1, QUANTILES)) for kind in (bad[inside], ~bad[inside])]))
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                middle = float((low + high) / 2)
                for above in (True, False):
                    c = Condition(name, above, middle)
                    hit = here >= middle if above else here <= middle
                    gain = _gain(hit, bad[inside])
                    if gain > best_gain:
                        best, best_gain = c, gain
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(values)
    return rule


def _worth(rule: list[Condition], values: dict[str, np.ndarray], bad: np.ndarray) -> float:
    hit = Rule(tuple(rule)).holds(values)
    p, n = (hit & bad).sum(), (hit & ~bad).sum()
    return float((p - n) / (p + n)) if p + n else -1.0


def prune(rule: list[Condition], values: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    while len(rule) > 1 and _worth(rule[:-1], values, bad) >= _worth(rule, values, bad):
        rule = rule[:-1]
    return rule


def learn(values: dict[str, np.ndarray], bad: np.ndarray, seed: int = 7) -> list[Rule]:
    """The decision list for ``bad`` rows; what no rule covers is good."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    shuffled = np.random.default_rng(seed).random(len(bad)) < 2 / 3
    while len(rules) < MOST_RULES and (left & bad).sum() >= LEAST_COVERED and (left & ~bad).any():
        growing, pruning = left & shuffled, left & ~shuffled
        rule = grow({k: v[growing] for k, v in values.items()}, bad[growing])
        rule = prune(rule, {k: v[pruning] for k, v in values.items()}, bad[pruning])
        found = Rule(tuple(rule))
        hit = found.holds(values) & left
        if not rule or (hit & bad).sum() < max(LEAST_COVERED, LEAST_PRECISION * hit.sum()):
            break
        rules.append(found)
        left &= ~hit
    return rules


def verdict(rules: list[Rule], columns: dict[str, Column]) -> Column:
    """The list as an ordered expression: true for rows that are kept."""
    if not rules:
        return F.lit(True)
    found = F.when(rules[0].column(columns), F.lit(False))
    for rule in rules[1:]:
        found = found.when(rule.column(columns), F.lit(False))
    return found.otherwise(F.lit(True))


def base_failed(prefix: str = "") -> Column:
    """Too short, or mostly repeated: known without learning."""
    n, repeated = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (n < 50) | (100 * repeated > 50 * n)


def labelled_sample(stats: DataFrame, labels: DataFrame, *, id_col: str, label_col: str, most: int = SAMPLE):
    """Statistics and labels of at most ``most`` rows outside fold 0: ({name: values}, label)."""
    columns = ratios()
    marked = labels.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{label_col}`").alias("__label")).filter("__label is not null")
    rows = stats.filter(~held_out(id_col)).join(marked, id_col)
    rows = rows.select(F.xxhash64(id_col).alias("__order"), "__label", *[c.alias(n) for n, c in columns.items()])
    found = sampled_rows(rows, "__order", most)
    values = {n: np.array([r[n] for r in found], float) for n in columns}
    return values, np.array([r["__label"] for r in found], float)


def judge(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> tuple[DataFrame, list[Rule]]:
    """(id, counts, base_failed, kept, rule) for every row, and the rules in order.

    ``rule`` is the number of the rule that dropped the row, from 1; null if none did.
    """
    bare = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("__text"))
    with discarding_stages(docs.sparkSession):
        stats = staged(with_counts(bare, "__text").drop("__text"), "statistics", keep=True)
        values, label = labelled_sample(stats.filter(~base_failed()), labels, id_col=id_col, label_col=label_col)
    rules = learn(values, label == 0)
    columns = ratios()
    kept = ~base_failed() & verdict(rules, columns)
    number = F.coalesce(*[F.when(r.column(columns), F.lit(k)) for k, r in enumerate(rules, 1)], F.lit(None).cast("int"))
    return stats.select("*", base_failed().alias("base_failed"), kept.alias("kept"), number.alias("rule")), rules
