"""Quality rules as a learned decision list.

Sequential covering over labelled statistics: grow a conjunction of thresholds by information gain until it covers no
document of the better class, prune its last conditions while precision on held-back rows doesn't fall, keep it while it
is precise there, drop what it covers, and go on. The list comes out as ordered Spark ``when`` expressions.

Defined results: rows without a usable label teach nothing; with no rows of either class the list is empty and everything
is kept; ties between thresholds go to the first feature by name, then the smaller threshold. Null text has counts of 0.
Repeated rows each get a row; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from factloom.llm import text_stats

#: Labelled rows that the list learns from, at most (a uniform sample by hash of the doc_id beyond that; 13 numbers a row).
TRAIN_ROWS = 20_000
MAX_RULES = 24
MAX_CONDITIONS = 5
#: A rule stays if it is at least this precise on the held-back rows it covers, and covers at least so many rows in all.
PRECISION = 0.97
LEAST_COVER = 4
CUTS = 64


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.cut if self.above else x[self.feature] < self.cut

    def column(self, columns: dict[str, Column]) -> Column:
        return columns[self.feature] >= self.cut if self.above else columns[self.feature] < self.cut


def _covers(rule: list[Condition], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, bool)
    for c in rule:
        hit &= c.holds(x)
    return hit


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    rule: list[Condition] = []
    hit = np.ones(len(bad), bool)
    while len(rule) < MAX_CONDITIONS and (hit & ~bad).any():
        p0, n0 = (hit & bad).sum(), (hit & ~bad).sum()
        base, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
        for name in sorted(x):
            values, labels = x[name][hit], bad[hit]
            cuts = np.unique(np.quantile(values, np.linspace(0, 1, CUTS + 1)[1:-1]))
            cuts = np.unique(np.concatenate([cuts, np.quantile(values[labels], np.linspace(0, 1, 17))]))
            order = np.argsort(values, kind="stable")
            below = np.searchsorted(values[order], cuts)
            pos, neg = np.concatenate([[0], np.cumsum(labels[order])]), np.concatenate([[0], np.cumsum(~labels[order])])
            for above, p, n in ((True, p0 - pos[below], n0 - neg[below]), (False, pos[below], neg[below])):
                gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / np.maximum(p + n, 1)) - base), -np.inf)
                i = int(np.argmax(gain))
                if gain[i] > best[0] + 1e-9:
                    best = (gain[i], Condition(name, above, float(cuts[i])))
        if best[1] is None:
            break
        rule.append(best[1])
        hit &= best[1].holds(x)
    return rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray) -> list[list[Condition]]:
    """The ordered rules for documents of the worse class; every third row is held back for pruning."""
    rules: list[list[Condition]] = []
    left = np.ones(len(bad), bool)
    held = np.arange(len(bad)) % 3 == 2
    part = lambda mask: {k: v[mask] for k, v in x.items()}
    while len(rules) < MAX_RULES and (left & ~held & bad).any() and (left & ~held & ~bad).any():
        grow, prune = left & ~held, left & held
        rule = _grow(part(grow), bad[grow])

        def worth(r: list[Condition]) -> float:
            hit = _covers(r, part(prune), int(prune.sum()))
            p, n = (hit & bad[prune]).sum(), (hit & ~bad[prune]).sum()
            return (p + 1) / (p + n + 2)

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        hit = _covers(rule, x, len(bad)) & left
        wrong = (hit & ~bad).sum()
        if not rule or hit.sum() < LEAST_COVER or 1 - wrong / hit.sum() < PRECISION:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def as_columns(rules: list[list[Condition]], columns: dict[str, Column]) -> tuple[Column, Column]:
    """(number of the first rule that holds, from 1, or null; verdict: kept) as ordered conditional expressions."""
    number = F.lit(None).cast("int")
    for i in range(len(rules), 0, -1):
        holds = F.lit(True)
        for c in rules[i - 1]:
            holds = holds & c.column(columns)
        number = F.when(holds, F.lit(i)).otherwise(number)
    return number, number.isNull()


def base_failed() -> Column:
    """The fixed rules: too few words, or too many words in repeated windows."""
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def sampled(labelled: DataFrame, rows: int) -> DataFrame:
    """At most about that many rows, chosen by a hash of doc_id."""
    n = labelled.count()
    return labelled if n <= rows else labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * rows / n))


def fit(stats: DataFrame, labels: DataFrame) -> list[list[Condition]]:
    """Learn from stats (doc_id, COUNTS) and labels (doc_id, quality); what the fixed rules reject teaches nothing."""
    usable = labels.where("quality in (0, 1)").select("doc_id", (F.col("quality") == 0).alias("bad"))
    columns = text_stats.shares()
    rows = sampled(stats.join(usable, "doc_id").where(~base_failed()), TRAIN_ROWS).select("doc_id", "bad", *(c.alias(k) for k, c in columns.items())).toPandas()
    rows = rows.sort_values(["doc_id", *columns], kind="stable")
    return learn({k: rows[k].to_numpy(float) for k in columns}, rows["bad"].to_numpy(bool))


def apply_rules(stats: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """doc_id, COUNTS, base_failed, rule and kept."""
    number, fine = as_columns(rules, text_stats.shares())
    return stats.withColumn("base_failed", base_failed()).withColumn("rule", number).withColumn("kept", ~F.col("base_failed") & fine)
