"""Linear classifiers of every fold and penalty, fitted side by side.

A fit per fold and parameter reads the table once per step and model. Here one scan per Newton step serves all models:
a task adds up the loss, gradient and Hessian of every model over its rows, with rows of a model's own fold left out. The
sums are small (models x features squared) and are added in two shuffled rounds, so the driver only reads one row per model.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.operators.folds import MAX_GROUPS, _known, _linear_scores
from tabforge.plans.bounded import BoundExceeded, settled, ship

ship(__name__)
MAX_SUMS = 1 << 22  # numbers a task holds: models x (features + 2) squared
ROWS = 1024  # rows whose squares are multiplied at a time
SLOTS = 64  # partial sums of a model after the first round


def _losses(kind: str, sign: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, first and second derivative by the score ``z`` where the class has the sign 1 or -1."""
    m = sign * z
    if kind == "logistic":
        p = np.exp(-np.logaddexp(0.0, m))
        return np.logaddexp(0.0, -m), -sign * p, p * (1 - p)
    e = 1 - m if kind == "squared" else np.maximum(0.0, 1 - m)
    return e * e, -2 * sign * e, np.where(e != 0, 2.0, 0.0) if kind == "squared_hinge" else np.full_like(e, 2.0)


def _sums(data: DataFrame, kind: str, held: np.ndarray, positive: np.ndarray, points: np.ndarray) -> dict[int, np.ndarray]:
    """{model: loss, gradient and Hessian in a row} over the rows outside of the model's fold."""
    models, q = points.shape

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((models, 1 + q + q * q))
        for b in batches:
            fold, label = (b.column(i).to_numpy() for i in range(2))
            every = b.column(2).flatten().to_numpy().reshape(-1, q)
            for k in range(0, len(every), ROWS):
                x, f, y = every[k:k + ROWS], fold[k:k + ROWS, None], label[k:k + ROWS, None]
                loss, slope, bend = (np.where(f != held, v, 0.0) for v in _losses(kind, np.where(y == positive, 1.0, -1.0), x @ points.T))
                total[:, 0] += loss.sum(0)
                total[:, 1:q + 1] += slope.T @ x
                total[:, q + 1:] += bend.T @ (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)
        slot = TaskContext.get().partitionId() % SLOTS
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(models, dtype=np.int32)), pa.array(np.full(models, slot, np.int32)),
                                          pa.array(total.tolist(), pa.list_(pa.float64()))], ["m", "slot", "s"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"m": rows["m"].iloc[:1], "slot": rows["slot"].iloc[:1], "s": [np.sum(np.stack(rows["s"].to_list()), 0)]})
    shape = "m int, slot int, s array<double>"
    parts = data.mapInArrow(scan, shape).groupBy("m", "slot").applyInPandas(add, shape)
    whole = parts.groupBy("m").applyInPandas(add, shape)
    return {r["m"]: np.array(r["s"]) for r in whole.collect()}  # one row per model, at most MAX_SUMS numbers


def linear_models(df: DataFrame, cols: list[str], y: str, fold: str, kind: str, cs: list[float], max_steps: int = 60) -> tuple[DataFrame, list[tuple]]:
    """The rows that take part, and a model (params, fold, class, weights, intercept) per penalty, fold and class.

    Minimises |w|^2 / 2 + C * sum of losses over the rows outside of the fold; the intercept is free. ``kind``: ``logistic``,
    ``squared_hinge`` (linear SVM) or ``squared``. Two classes have one model each, the first class scoring 0; more have one
    against the rest for each class. A class that has no rows outside of a fold is never predicted there. Rows with a NULL
    class, fold or feature take no part; a constant feature has weight 0. Steps are halved until the loss falls.
    """
    if kind not in ("logistic", "squared_hinge", "squared") or min(cs) <= 0:
        raise ValueError("kind is logistic, squared_hinge or squared, C is above 0")
    data = _known(df, cols, y, fold, lambda c: c)
    groups = data.groupBy("_f", "_y").count().limit(MAX_GROUPS + 1).collect()
    if len(groups) > MAX_GROUPS:
        raise BoundExceeded(f"more than {MAX_GROUPS} pairs of a fold and a class")
    folds, classes = sorted({r["_f"] for r in groups}), sorted({r["_y"] for r in groups})
    if not groups:
        return data, []
    moments = data.agg(*[a(F.col("_x")[i]).alias(f"{n}{i}") for i in range(len(cols)) for n, a in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean, sd = (np.array([moments[f"{n}{i}"] for i in range(len(cols))]) for n in "ms")
    flat = sd <= 1e-12 * np.abs(mean)
    sd = np.where(flat, 1.0, sd)
    place = {v: F.array_position(F.array(*[F.lit(x) for x in of]), F.col(v)).cast("int") - 1 for v, of in (("_f", folds), ("_y", classes))}
    scaled = F.zip_with("_x", F.array(*[F.struct(F.lit(float(a)).alias("m"), F.lit(0.0 if off else 1 / float(b)).alias("s")) for a, b, off in zip(mean, sd, flat)]),
                        lambda v, by: (v - by["m"]) * by["s"])
    rows = settled(data.select(place["_f"].alias("f"), place["_y"].alias("y"), F.concat(scaled, F.array(F.lit(1.0))).alias("x")))
    there = {f: [c for c in classes if any(r["_y"] == c and r["_f"] != f for r in groups)] for f in folds}
    # One class, or the first of two, scores 0: nothing is fitted for it.
    fixed = [(f"C={c}", f, k, np.zeros(len(cols)), 0.0) for f in folds for c in cs for k in there[f][:1] if len(there[f]) <= 2]
    tasks = [(f, c, k) for f in folds for c in cs for k in (there[f][1:] if len(there[f]) == 2 else there[f] if len(there[f]) > 2 else [])]
    q = len(cols) + 1
    if len(tasks) * (q + 1) ** 2 > MAX_SUMS:
        raise BoundExceeded(f"more than {MAX_SUMS} sums for {len(tasks)} models of {q} weights")
    held = np.array([folds.index(f) for f, _, _ in tasks], dtype=np.int64)
    positive = np.array([classes.index(k) for _, _, k in tasks], dtype=np.int64)
    ridge = np.append(1 / sd ** 2, 0.0)  # weights belong to scaled features, the penalty to the given ones
    at, base, step = (np.zeros((len(tasks), q)) for _ in range(3))
    best, drop, still = np.full(len(tasks), np.inf), np.zeros(len(tasks)), list(range(len(tasks)))
    for _ in range(max_steps):
        if not still:
            break
        found = _sums(rows, kind, held[still], positive[still], at[still])
        for j, t in enumerate(list(still)):
            c, s = tasks[t][1], found[j]
            value = c * s[0] + 0.5 * (ridge * at[t] ** 2).sum()
            if value > best[t] - 1e-4 * drop[t] + 1e-10 * (1 + abs(value)):
                step[t], drop[t] = step[t] / 2, drop[t] / 2
            else:
                best[t], base[t] = value, at[t]
                slope = c * s[1:q + 1] + ridge * at[t]
                step[t] = -np.linalg.lstsq(c * s[q + 1:].reshape(q, q) + np.diag(ridge), slope, rcond=None)[0]
                drop[t] = -slope @ step[t]
                if drop[t] <= 1e-12 * (1 + abs(value)):
                    base[t] += step[t]  # the last step squares what is left of the error
                    still.remove(t)
                    continue
            at[t] = base[t] + step[t]
    if still:
        raise ValueError(f"{len(still)} models have not settled after {max_steps} steps")
    weights = np.where(flat, 0.0, base[:, :-1] / sd)
    fitted = [(f"C={c}", f, k, weights[t], base[t, -1] - weights[t] @ mean) for t, (f, c, k) in enumerate(tasks)]
    return data, fixed + fitted


def linear_folds(df: DataFrame, cols: list[str], y: str, fold: str, kind: str, cs: list[float]) -> DataFrame:
    """(params, fold, score): accuracy on every fold of the ``linear_models`` that never saw it, for every C. One scan per
    Newton step for all folds and penalties, and one for all scores; no rows give no scores."""
    return _linear_scores(*linear_models(df, cols, y, fold, kind, cs))
