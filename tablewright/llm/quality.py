"""A quality classifier from positive and unlabelled text.

Trusted positives are documents labelled good; everything else is unlabelled. A logistic model
over statistics of the text is fitted by minimising the non-negative unbiased risk (Kiryo et
al., "Positive-Unlabeled Learning with Non-Negative Risk Estimator", 2017)

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))

where the share of good documents among the unlabelled, the prior, is estimated from the same two
samples: it cannot exceed the ratio of the shares of unlabelled and positive rows above any
score of a first model, and the least ratio that enough rows support is taken (best bin
estimation; Garg et al., 2021). No negative label is used anywhere.

At scale: statistics come from one pass over the texts and are written once. At most
``POSITIVES`` and ``UNLABELLED`` rows of numbers, picked by a hash of the id, come to the driver
for fitting, however many rows or partitions there are. Scoring is a projection: the fitted model is a Spark expression.

Defined results: null text is empty, and text without a word scores 0. Without any positives
every text with words scores the prior 0.5. Rows of fold 0 are scored like others, but their
labels are never read. Repeated rows are scored one by one and fitted on once; an id is
positive if any of its labels is. Equal statistics score alike. An empty table has no scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import discarding_stages, staged
from .batches import held_out, sampled_rows
from .statistics import ratios, with_counts

#: Rows fitted on at most.
POSITIVES = 10_000
UNLABELLED = 20_000
STEPS = 600
RATE = 0.05
DECAY = 5e-3
#: Where a positive is predicted.
THRESHOLD = 0.3
#: Values this many deviations from the mean say no more than that.
CLIP = 4.0


@dataclass(frozen=True)
class Model:
    names: list[str]
    means: np.ndarray
    scales: np.ndarray
    weights: np.ndarray  # of the clipped deviations, and of one
    prior: float

    def column(self, columns: dict[str, Column]) -> Column:
        """The score as a Spark expression."""
        total = F.lit(float(self.weights[-1]))
        for i, name in enumerate(self.names):
            z = (columns[name] - F.lit(float(self.means[i]))) / F.lit(float(self.scales[i]))
            z = F.least(F.greatest(z, F.lit(-CLIP)), F.lit(CLIP))
            total = total + z * F.lit(float(self.weights[i]))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _features(x: np.ndarray, means: np.ndarray, scales: np.ndarray) -> np.ndarray:
    z = np.clip((x - means) / scales, -CLIP, CLIP)
    return np.hstack([z, np.ones((len(z), 1))])


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


def _descend(gradient, size: int) -> np.ndarray:
    """Adam from zero."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for step in range(1, STEPS + 1):
        g = gradient(w) + DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def _push(x: np.ndarray, w: np.ndarray, positive: bool) -> np.ndarray:
    """Gradient of the mean logistic loss of calling all rows positive (or negative)."""
    p = _sigmoid(x @ w)
    return ((p - 1) if positive else p) @ x / len(x)


def _loss(x: np.ndarray, w: np.ndarray, positive: bool) -> float:
    v = x @ w
    return float(np.logaddexp(0, -v if positive else v).mean())


def estimate_prior(positives: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, from features of both; halves of the rows fit
    the first model, the others estimate."""
    p0, p1, u0, u1 = positives[::2], positives[1::2], unlabelled[::2], unlabelled[1::2]
    if not (len(p1) and len(u1)):
        return 0.5
    w = _descend(lambda w: (_push(p0, w, True) + _push(u0, w, False)) / 2, positives.shape[1])
    sp, su = np.sort(p1 @ w), np.sort(u1 @ w)
    cuts = np.unique(np.concatenate([sp, su]))
    above_p = 1 - np.searchsorted(sp, cuts) / len(sp)
    above_u = 1 - np.searchsorted(su, cuts) / len(su)
    slack = np.sqrt(np.log(40.0) / 2) * (1 / np.sqrt(len(sp)) + 1 / np.sqrt(len(su)))
    enough = above_p > 0
    bounds = (above_u[enough] + slack) / above_p[enough]
    best = int(bounds.argmin())
    return float(np.clip(above_u[enough][best] / above_p[enough][best], 0.01, 0.99))


def fit(names: list[str], positives: np.ndarray, unlabelled: np.ndarray) -> Model:
    """The model of least non-negative risk."""
    both = np.vstack([positives, unlabelled]) if len(positives) else unlabelled
    if not len(positives) or not len(unlabelled):
        k = len(names)
        return Model(names, np.zeros(k), np.ones(k), np.zeros(k + 1), 0.5)
    means = both.mean(axis=0)
    scales = np.maximum(both.std(axis=0), 1e-6)
    p, u = _features(positives, means, scales), _features(unlabelled, means, scales)
    prior = estimate_prior(p, u)

    def gradient(w: np.ndarray) -> np.ndarray:
        negative = _loss(u, w, False) - prior * _loss(p, w, False)
        rest = _push(u, w, False) - prior * _push(p, w, False)
        # where the estimated negative risk is below zero, it is driven back up
        return prior * _push(p, w, True) + rest if negative >= 0 else -rest

    return Model(names, means, scales, _descend(gradient, p.shape[1]), prior)


def sample(stats: DataFrame, labels: DataFrame, *, id_col: str, label_col: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Numbers of trusted positives and of unlabelled rows, all outside fold 0."""
    columns, order = ratios(), F.xxhash64(id_col)
    usable = stats.filter(~held_out(id_col) & F.col(id_col).isNotNull() & (F.col("n_words") > 0))
    good = labels.filter(F.col(f"`{label_col}`") == 1).select(F.col(f"`{id_col}`").alias(id_col)).distinct()

    def rows(df: DataFrame, most: int) -> np.ndarray:
        picked = sampled_rows(df.select(order.alias("__order"), *[c.alias(n) for n, c in columns.items()]), "__order", most)
        return np.array([[r[n] for n in columns] for r in picked], float).reshape(-1, len(columns))

    positives = rows(usable.join(good, id_col, "left_semi"), POSITIVES)
    unlabelled = rows(usable, UNLABELLED)
    return list(columns), positives, unlabelled


def score(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> tuple[DataFrame, Model]:
    """(id, held_out, score, predicted) for every row, and the model."""
    bare = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("__text"))
    with discarding_stages(docs.sparkSession):
        stats = staged(with_counts(bare, "__text").drop("__text"), "statistics", keep=True)
        model = fit(*sample(stats, labels, id_col=id_col, label_col=label_col))
    value = F.when(F.col("n_words") > 0, model.column(ratios())).otherwise(F.lit(0.0))
    found = stats.select(id_col, held_out(id_col).alias("held_out"), value.alias("score"))
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")), model
