"""Labelled rows for the classifiers trained here, and calibration."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 11


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int | tuple[int, int]) -> tuple[list[str], np.ndarray, float]:
    """Texts and labels of a bounded sample, at most per_class rows of label 0 and of 1 (or a bound for each), and the share of 1 among all labelled rows.

    Rows are taken in the order of a hash of doc_id, so a sample doesn't depend on the partitioning.  Rows without text or
    label, or with another label, don't count; a document that is labelled twice the same way counts once, one labelled both ways not at
    all.  An id that stands with several texts, or many times, gives its least text, so no more rows than asked for reach the driver.
    """
    known = labels.where(labels[label].isin(0, 1) & labels["doc_id"].isNotNull()).groupBy("doc_id").agg(F.min(label).alias("_wl_y"), F.max(label).alias("_wl_z")).where("_wl_y = _wl_z").select("doc_id", "_wl_y")
    counts = {r[0]: r[1] for r in known.groupBy("_wl_y").count().collect()}
    order: Column = F.xxhash64(F.lit(SEED), "doc_id")
    # by a hash below a bound, a little more than is wanted; then exactly the first per_class
    most = per_class if isinstance(per_class, tuple) else (per_class, per_class)
    take = F.lit(False)
    for y, n in counts.items():
        bound = min(1.0, (most[y] + 6 * math.sqrt(most[y]) + 10) / n)
        take = take | ((F.col("_wl_y") == y) & (F.pmod(order, F.lit(1 << 30)) < int(bound * (1 << 30)) + 1))
    chosen = known.where(take)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "_wl_y").agg(F.min("text").alias("text")).select("text", "_wl_y", F.pmod(order, F.lit(1 << 30)).alias("o"), "doc_id").collect()
    texts, ys = [], []
    for y in (0, 1):
        mine = sorted((r.o, r.doc_id, r.text) for r in rows if r[1] == y)[: most[y]]
        texts += [t for _, _, t in mine]
        ys += [y] * len(mine)
    whole = sum(counts.values())
    return texts, np.array(ys, np.int64), counts.get(1, 0) / whole if whole else 0.5


def platt(score: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """a, b such that 1 / (1 + exp(-(a * score + b))) is the chance of label 1 where its share is prior; Newton's method on
    the smoothed targets of Platt (1999), so that separable scores stay finite."""
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    if not n1 or not n0:
        return 1.0, 0.0
    scale = float(np.std(score)) or 1.0
    x = score / scale
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    weight = np.where(y == 1, prior / n1, (1 - prior) / n0) * len(y)
    a, b = 0.0, math.log(prior / (1 - prior))

    def loss(a: float, b: float) -> float:
        z = a * x + b
        return float((weight * (np.logaddexp(0, z) - target * z)).sum()) + 1e-6 * a * a

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = weight * (p - target)
        h = weight * p * (1 - p)
        grad = np.array([(g * x).sum() + 2e-6 * a, g.sum()])
        hess = np.array([[(h * x * x).sum() + 2e-6, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(hess, grad)
        rate = 1.0
        while rate > 1e-6 and loss(a - rate * step[0], b - rate * step[1]) > loss(a, b):
            rate /= 2
        a, b = a - rate * step[0], b - rate * step[1]
        if abs(rate * step).max() < 1e-9:
            break
    return float(a / scale), float(b)


def logistic(x: np.ndarray, y: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias of the chance of label 1, where its share is prior, over several inputs: Newton's method on smoothed targets, as platt(), with a small ridge on inputs scaled to equal spread."""
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    middle, spread = x.mean(axis=0), np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    z = np.c_[(x - middle) / spread, np.ones(len(x))]
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    weight = np.where(y == 1, prior / n1, (1 - prior) / n0) * len(y)
    ridge = np.full(z.shape[1], 1e-2)
    w = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (weight * (p - target)) + ridge * w)
        w -= step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return w[:-1] / spread, float(w[-1] - (w[:-1] * middle / spread).sum())


def auc(score: np.ndarray, y: np.ndarray) -> float:
    """Chance that a row of label 1 scores above one of label 0, ties counting half."""
    values, where, count = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[where]
    n1 = int(y.sum())
    return float((rank[y == 1].sum() - n1 * (n1 + 1) / 2) / max(1, n1 * (len(y) - n1)))
