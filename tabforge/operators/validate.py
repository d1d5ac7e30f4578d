"""Splits, folds, metrics, model comparison.

Splits are exact and reproducible: rows are ordered by md5(seed ‖ key) (ties by
key) and numbered with the distributed ``exact_row_number``; no
``randomSplit`` (inexact, layout-dependent) and no single-task window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.plans.bounded import settled
from tabforge.functions.columns import stable_sigmoid
from tabforge.plans.ranking import exact_row_number


def _hash_order(key: str, seed) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}#"), F.col(key).cast("string")))


# M1 / M2 -------------------------------------------------------------------
#: Rows of the last bracket that are read back to find the boundary row.
BRACKET_ROWS = 10_000


def _first_k(df: DataFrame, key: str, seed, k: int, n: int) -> Column:
    """Predicate: the row is among the k first of n by (md5(seed ‖ key), key).

    Hashes are uniform, so the k-th lies close to k/n of their range: scans count a bracket around it, which shrinks to
    about the square root of its rows each time, until its few rows are read back. The split is then a plain filter on
    the table: nothing is sorted, shuffled or written. A NULL key raises, as rows without one cannot be told apart.
    """
    h = _hash_order(key, seed)
    if k <= 0:
        return F.lit(False)
    if k >= n:
        return F.lit(True)
    u = F.conv(F.substring(h, 1, 15), 16, 10).cast("long")  # 60 bits
    low, high, below, inside = 0, 1 << 60, 0, n
    while inside > BRACKET_ROWS and high - low > 1:
        near = min(high - 1, low + int((high - low) * ((k - below) / inside)))
        # At most half of the range, so that it shrinks whatever the rows.
        margin = min(int((high - low) * (4.0 * math.sqrt(inside) + 10.0) / inside), (high - low) // 4)
        a, b = max(low, near - margin), min(high, near + margin + 1)
        before, within = df.where((u >= low) & (u < high)).agg(F.count_if(u < a), F.count_if((u >= a) & (u < b))).first()
        if k - below <= before:  # outside the bracket: far rarer than one time in ten thousand
            high, inside = a, before
        elif k - below <= before + within:
            low, high, below, inside = a, b, below + before, within
        else:
            low, below, inside = b, below + before + within, inside - before - within
    if inside > BRACKET_ROWS:
        raise ValueError(f"{key} is not unique: many rows share one value")
    rows = df.where((u >= low) & (u < high)).select(h.alias("_h"), F.col(key)).orderBy("_h", key).collect()
    bh, bk = rows[k - below - 1]["_h"], rows[k - below - 1][key]
    return (h < F.lit(bh)) | ((h == F.lit(bh)) & (F.col(key) <= F.lit(bk)))


def _counted(df: DataFrame, key: str) -> int:
    n, known = df.agg(F.count(F.lit(1)), F.count(key)).first()
    if known < n:
        raise ValueError(f"{key} is NULL in {n - known} rows")
    return n


def split(df: DataFrame, key: str, train_frac: float, seed: int = 0, name: str = "part") -> DataFrame:
    """Tag rows 'train'/'test': test size = ceil((1 − train_frac)·n) (sklearn rule), the rest train. A NULL key raises."""
    n = _counted(df, key)
    n_test = math.ceil((1.0 - train_frac) * n)
    return df.withColumn(name, F.when(_first_k(df, key, seed, n - n_test, n), "train").otherwise("test"))


def sample_exact(df: DataFrame, key: str, frac: float, seed: int = 0) -> DataFrame:
    """Exactly round(frac·n) rows, chosen by hash order. A NULL key raises."""
    n = _counted(df, key)
    return df.where(_first_k(df, key, seed, int(round(frac * n)), n))


# M3 ------------------------------------------------------------------------
def stratified_folds(df: DataFrame, y: str, key: str, k: int, shuffle_seed: int | None = None,
                     name: str = "fold") -> DataFrame:
    """fold = (position within its class − 1) mod k; class sizes per fold differ by ≤ 1.

    Unshuffled: position by key; shuffled: by md5(seed ‖ key). ``key`` must be
    unique; a NULL key raises. Only the narrow (key, class, order) projection is numbered and
    checkpointed; the fold joins back to the full rows on the key.
    """
    _counted(df, key)
    narrow = df.select(key, y)
    order = [key]
    if shuffle_seed is not None:
        narrow = narrow.withColumn("_h", _hash_order(key, shuffle_seed))
        order = ["_h", key]
    r = exact_row_number(narrow, order, partition_by=[y], name="_rn")
    folds = r.select(key, ((F.col("_rn") - 1) % k).cast("int").alias(name))
    return df.join(folds, on=key, how="inner")


# M8–M11 --------------------------------------------------------------------
def accuracy(df: DataFrame, y: str, p: str, by: list[str] = ()) -> DataFrame:
    """Share of rows with prediction == label, and the error rate."""
    hit = F.avg((F.col(y) == F.col(p)).cast("double"))
    g = df.groupBy(*by) if by else df
    return g.agg(hit.alias("accuracy"), (1 - hit).alias("error"), F.count(F.lit(1)).alias("n"))


def correct_count(df: DataFrame, y: str, score: str) -> Column:
    """Count (not rate) of rows where (1e-15 + sigmoid(score) > 0.5) equals the label."""
    pred = (F.lit(1e-15) + 1.0 / (1.0 + F.exp(-F.col(score)))) > 0.5
    return F.sum((pred.cast("int") == F.col(y).cast("int")).cast("int"))


def cross_entropy(df: DataFrame, y: str, score: str, form: str = "literal") -> Column:
    """Mean binary cross-entropy of stable-sigmoid(score).

    ``literal`` follows the formula as written (±inf/NaN possible when p hits 0 or 1);
    ``softplus`` = mean(max(s,0) + log1p(exp(−|s|)) − y·s), which never overflows.
    """
    s = F.col(score).cast("double")
    yy = F.col(y).cast("double")
    if form == "softplus":
        return F.avg(F.greatest(s, F.lit(0.0)) + F.log1p(F.exp(-F.abs(s))) - yy * s)
    p = stable_sigmoid(s)
    return -F.avg(yy * F.ln(p) + (1 - yy) * F.ln(1 - p))


def auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """ROC AUC by the rank-sum rule with average ranks for ties.

    Per distinct score: (positives, negatives). AUC = Σ pos·(neg_below + neg/2) / (P·N),
    where neg_below is a prefix sum over distinct scores in order (one window when
    the distinct-score table is provably small, else the distributed blocked prefix). Rows without a label or a score
    don't count; NULL if only one class is left.
    """
    from tabforge.operators.sequence import ordered_prefix
    g = df.where(F.col(y).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).alias("_s")).agg(
        F.sum(F.col(y).cast("long")).alias("_pos"), F.sum((1 - F.col(y)).cast("long")).alias("_neg"))
    r = ordered_prefix(g, ["_s"], "_neg", "sum", "_cum")
    contrib = F.col("_pos") * ((F.col("_cum") - F.col("_neg")) + F.col("_neg") / 2.0)
    return r.agg(F.try_divide(F.sum(contrib), (F.sum("_pos") * F.sum("_neg")).cast("double")).alias("auc"))


# M13 / M14 / M15 -------------------------------------------------------------
def filter_models(scores: DataFrame, score: str = "score", margin: float = 0.8) -> DataFrame:
    return scores.where(F.col(score) >= margin)


def submission(df: DataFrame, key: str, pred: str, key_name: str | None = None,
               label_name: str | None = None) -> DataFrame:
    return df.select(F.col(key).alias(key_name or key), F.col(pred).cast("int").alias(label_name or pred))


def agreement(a: DataFrame, b: DataFrame, key: str, pa: str, pb: str) -> DataFrame:
    """Confusion counts between two prediction tables joined on key, with the agreement rate."""
    j = a.select(key, F.col(pa).alias("p1")).join(b.select(key, F.col(pb).alias("p2")), on=key, how="inner")
    c = settled(j.groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("n")))
    same = F.col("p1") == F.col("p2")
    tot = c.agg(F.try_divide(F.sum(F.when(same, F.col("n")).otherwise(0)), F.sum(F.when(same.isNotNull(), F.col("n")))).alias("agreement"))
    return c.withColumn("agreement", F.lit(tot.first()[0]))  # one scalar from a global aggregate
