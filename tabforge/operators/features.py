"""Automated feature synthesis and pruning.

DFS works on a graph of feature definitions. The parents' own aggregates come from one narrow copy of the base rows:
one groupBy per parent for all numeric primitives, one table of joint counts per pair of columns for modes and
distinct counts. A feature of a parent is the same for all its rows, so features stacked on it never go back to the base
rows: they are aggregates of the parents' tables weighted by the joint counts of the two parents, which both
directions and all depths share. At the end each parent's table, one row per value, is joined to the base rows once:
broadcast when its checked size allows, otherwise by a sort-merge join whose hot partitions are split at run time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.operators.profile import numeric_columns
from tabforge.plans.bounded import checked_broadcast, settled
from tabforge.operators.summarize import corr_matrix

NUMERIC_PRIMITIVES = ["sum", "mean", "max", "min", "std", "skew"]
CATEGORICAL_PRIMITIVES = ["num_unique", "mode"]
BOOLEAN_PRIMITIVES = ["percent_true"]


def _flat(lo: Column, hi: Column) -> Column:
    """No spread beyond the rounding of equal sums added in another order."""
    return hi - lo <= 1e-12 * F.greatest(F.abs(lo), F.abs(hi))


def sample_skew(c: Column) -> Column:
    """Bias-corrected skewness (pandas form): g1·√(n(n−1))/(n−2); null for n < 3, 0 without spread."""
    n = F.count(c).cast("double")
    return F.when(n >= 3, F.when(_flat(F.min(c), F.max(c)), 0.0).otherwise(F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2)))


def sample_kurtosis(c: Column) -> Column:
    """Bias-corrected excess kurtosis (pandas form); null for n < 4."""
    n = F.count(c).cast("double")
    g2 = F.kurtosis(c)
    return F.when(n >= 4, ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3)))


def _prim(name: str, c: str) -> Column:
    x = F.col(c)
    return {
        "sum": lambda: F.sum(x), "mean": lambda: F.avg(x), "max": lambda: F.max(x), "min": lambda: F.min(x),
        "std": lambda: F.stddev_samp(x), "skew": lambda: sample_skew(x), "count": lambda: F.count(x),
        "percent_true": lambda: F.avg(x.cast("double")),
    }[name]()


def feature_name(parent: str, prim: str, child: str) -> str:
    return f"{parent}__{prim}__{child}"


def normalize(df: DataFrame, parents: list[str]) -> dict[str, DataFrame]:
    """One parent entity per column: its distinct values with their row counts."""
    return {p: df.groupBy(p).agg(F.count(F.lit(1)).alias("n")) for p in parents}


@dataclass(frozen=True)
class Feature:
    """An aggregate over the rows of a parent value: of a base column (``child`` is its name) or of another feature."""

    parent: str
    primitive: str
    child: Feature | str
    depth: int

    @property
    def name(self) -> str:
        return feature_name(self.parent, self.primitive, self.child if isinstance(self.child, str) else self.child.name)

    @property
    def categorical(self) -> bool:
        return self.primitive == "mode"


def define_features(parents: list[str], numeric: list[str], categorical: list[str] = (), boolean: list[str] = (),
                    numeric_primitives=NUMERIC_PRIMITIVES, categorical_primitives=CATEGORICAL_PRIMITIVES,
                    boolean_primitives=BOOLEAN_PRIMITIVES, depth: int = 1, deep_primitives=None) -> list[Feature]:
    """All features up to ``depth`` in one fixed order: by depth, parent, child, primitive.

    Depth 1 aggregates base columns. Depth d aggregates, for every parent, the features of depth d - 1 of every other
    parent: numeric ones with ``deep_primitives`` (default: the numeric ones), modes with the categorical primitives.
    """
    deep = numeric_primitives if deep_primitives is None else deep_primitives
    levels = [[f for p in parents for f in [
        Feature(p, "count", "rows", 1),
        *(Feature(p, x, c, 1) for cols, prims in ((numeric, numeric_primitives), (categorical, categorical_primitives), (boolean, boolean_primitives))
          for c in cols if c != p for x in prims)]]]
    for d in range(2, depth + 1):
        levels.append([Feature(p, x, f, d) for p in parents for f in levels[-1] if f.parent != p
                       for x in (categorical_primitives if f.categorical else deep)])
    return [f for level in levels for f in level]


def _values(counts: DataFrame, by: str, c: str, n: str, names: dict[str, str]) -> DataFrame:
    """``num_unique`` and ``mode`` (most rows, ties to the smallest) of a column from its counts per ``by``."""
    aggs = {"num_unique": F.count(F.lit(1)), "mode": F.min_by(c, F.struct(-F.col(n), F.col(c)))}
    return counts.groupBy(by).agg(*[aggs[x].alias(name) for x, name in names.items()])


def _weighted(rows: DataFrame, by: str, wanted: dict[str, dict[str, str]]) -> DataFrame:
    """Numeric primitives of columns whose values stand for ``_n`` base rows each: ``wanted`` is {column: {primitive: name}}.

    Moments are taken about the group's mean, from a second pass over ``rows``.
    """
    cols = list(wanted)
    n = {c: F.when(F.col(f"`{c}`").isNotNull(), F.col("_n")) for c in cols}
    first = settled(rows.groupBy(by).agg(*[e for i, c in enumerate(cols) for e in (
        F.sum(n[c]).alias(f"_n{i}"), F.sum(n[c] * F.col(f"`{c}`")).alias(f"_s{i}"), F.min(f"`{c}`").alias(f"_lo{i}"), F.max(f"`{c}`").alias(f"_hi{i}"))]))
    moments = {"std", "skew"} & {x for names in wanted.values() for x in names}
    if moments:
        gap = {i: F.col(f"`{c}`") - F.col(f"_s{i}") / F.col(f"_n{i}") for i, c in enumerate(cols)}
        near = rows.join(checked_broadcast(first, 200_000), by)
        first = first.join(near.groupBy(by).agg(*[F.sum(F.col("_n") * F.pow(gap[i], F.lit(k))).alias(f"_c{k}{i}")
                                                  for i in range(len(cols)) for k in ((2, 3) if "skew" in moments else (2,))]), by, "left")
    out = []
    for i, c in enumerate(cols):
        count, flat = F.col(f"_n{i}").cast("double"), F.col(f"_lo{i}") == F.col(f"_hi{i}")
        forms = {
            "sum": lambda: F.col(f"_s{i}"), "mean": lambda: F.col(f"_s{i}") / count, "count": lambda: F.coalesce(F.col(f"_n{i}"), F.lit(0)),
            "min": lambda: F.col(f"_lo{i}"), "max": lambda: F.col(f"_hi{i}"),
            "std": lambda: F.when(count > 1, F.when(flat, 0.0).otherwise(F.sqrt(F.col(f"_c2{i}") / (count - 1)))),
            "skew": lambda: F.when(count >= 3, F.when(_flat(F.col(f"_lo{i}"), F.col(f"_hi{i}")), 0.0).otherwise(
                (F.col(f"_c3{i}") / count) / F.pow(F.col(f"_c2{i}") / count, F.lit(1.5)) * F.sqrt(count * (count - 1)) / (count - 2))),
        }
        out += [forms[x]().alias(name) for x, name in wanted[c].items()]
    return first.select(by, *out)


def dfs(df: DataFrame, key: str, parents: list[str], numeric: list[str] | None = None,
        categorical: list[str] = (), boolean: list[str] = (), numeric_primitives=NUMERIC_PRIMITIVES,
        categorical_primitives=CATEGORICAL_PRIMITIVES, boolean_primitives=BOOLEAN_PRIMITIVES,
        depth: int = 1, deep_primitives=None, max_parent_rows: int = 200_000, combinations: bool = False) -> DataFrame:
    """Deep feature synthesis; returns the columns of ``df`` and all features of ``define_features`` in its order.

    Rows whose parent value is NULL have NULL features of that parent; NULL children are left out of aggregates.
    ``max_parent_rows`` bounds what is broadcast and never changes the result. With ``combinations``, the result is one
    row per combination of parent values: the parents and their features, which no other column of ``df`` changes.
    """
    numeric = [c for c in (numeric if numeric is not None else numeric_columns(df)) if c != key]
    features = define_features(parents, numeric, categorical, boolean, numeric_primitives, categorical_primitives,
                               boolean_primitives, depth, deep_primitives)
    narrow = settled(df.select(*dict.fromkeys([*parents, *numeric, *categorical, *boolean])))
    counted: dict[frozenset, DataFrame] = {}

    def joint(a: str, b: str) -> DataFrame:
        if frozenset((a, b)) not in counted:
            counted[frozenset((a, b))] = settled(narrow.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("_n")))
        return counted[frozenset((a, b))]

    def spine(p: str, parts: list[DataFrame], names: list[str]) -> DataFrame:
        """Tables by parent value side by side; what a value has no rows for is NULL, a distinct count 0."""
        out = parts[0]
        for part in parts[1:]:
            out = out.join(part, p, "left")
        zero = [f.name for f in features if f.primitive == "num_unique"]
        return settled(out.select(p, *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) if c in zero else F.col(f"`{c}`") for c in names]))

    level: dict[str, DataFrame] = {}
    tables: dict[str, list[DataFrame]] = {p: [] for p in parents}
    for p in parents:
        own = [f for f in features if f.depth == 1 and f.parent == p]
        values = {c: {f.primitive: f.name for f in own if f.child == c and f.primitive in CATEGORICAL_PRIMITIVES} for c in categorical if c != p}
        aggs = [(F.count(F.lit(1)) if f.child == "rows" else _prim(f.primitive, f.child)).alias(f.name)
                for f in own if f.primitive not in CATEGORICAL_PRIMITIVES]
        parts = [narrow.where(F.col(p).isNotNull()).groupBy(p).agg(*aggs)]
        parts += [_values(joint(p, c), p, c, "_n", names) for c, names in values.items() if names]
        level[p] = spine(p, parts, [f.name for f in own])
        tables[p].append(level[p])
    for d in range(2, depth + 1):
        below, level = level, {}
        for p in parents:
            own = [f for f in features if f.depth == d and f.parent == p]
            parts = [tables[p][0].select(p)]
            for q in parents:
                stacked = [f for f in own if f.child.parent == q]
                if not stacked:
                    continue
                rows = settled(joint(p, q).join(checked_broadcast(below[q], max_parent_rows), q))
                wanted: dict[str, dict[str, str]] = {}
                for f in stacked:
                    wanted.setdefault((f.child.categorical, f.child.name), {})[f.primitive] = f.name
                plain = {c: names for (cat, c), names in wanted.items() if not cat}
                if plain:
                    parts.append(_weighted(rows, p, plain))
                for (cat, c), names in wanted.items():
                    if cat:
                        counts = (rows.where(F.col(f"`{c}`").isNotNull()).groupBy(p, F.col(f"`{c}`").alias("_v")).agg(F.sum("_n").alias("_k")))
                        parts.append(_values(counts, p, "_v", "_k", names))
            level[p] = spine(p, parts, [f.name for f in own])
            tables[p].append(level[p])
    out = narrow.select(*parents).distinct() if combinations else df
    kept = parents if combinations else df.columns
    for p in parents:
        g = tables[p][0]
        for t in tables[p][1:]:
            g = g.join(t, p)
        out = out.join(checked_broadcast(g, max_parent_rows), on=p, how="left")
    return out.select(*[F.col(f"`{c}`") for c in [*kept, *(f.name for f in features)]])


def collinear_pairs(df: DataFrame, cols: list[str], threshold: float, strict: bool = False) -> DataFrame:
    """(a, b, r) where a is earlier than b and |r| ≥ threshold (> when strict); NaN never counts."""
    cond = (F.col("abs_r") > threshold) if strict else (F.col("abs_r") >= threshold)
    return corr_matrix(df, cols).where(cond & ~F.isnan("r") & F.col("r").isNotNull())


def drop_collinear(df: DataFrame, cols: list[str], threshold: float, strict: bool = False) -> tuple[DataFrame, list[str]]:
    """Drop every column correlated with any earlier column (earlier ones count even if dropped)."""
    dropped = sorted({r["b"] for r in collinear_pairs(df, cols, threshold, strict).select("b").collect()})
    return df.drop(*dropped), dropped


def nonnegative_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per column whether every value is ≥ 0 (a null fails), one aggregate."""
    row = df.agg(*[F.bool_and(F.coalesce(F.col(c) >= 0, F.lit(False))).alias(f"_c{i}") for i, c in enumerate(cols)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_c{i}").alias("nonnegative"))
                                         for i, c in enumerate(cols)])))


def select_from_model(df: DataFrame, cols: list[str], y: str, model: str = "linear_svm", C: float = 0.01,
                      threshold: str | float = "mean", seed: int = 0, step_size: float = 0.01, num_trees: int = 50) -> DataFrame:
    """Keep features whose |weight| (linear SVM) or importance (boosted trees / forest) exceeds
    the mean (or a given threshold). Returns (feature, weight, keep). The SVM's loss is averaged over rows, so
    ``C`` becomes regParam = 1 / (C * rows); ``step_size`` is the boosting rate."""
    from pyspark.ml.classification import GBTClassifier, LinearSVC, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    data = VectorAssembler(inputCols=cols, outputCol="_x", handleInvalid="keep").transform(
        df.select(*cols, F.col(y).cast("double").alias("_y")))
    if model == "linear_svm":
        m = LinearSVC(featuresCol="_x", labelCol="_y", regParam=1.0 / (C * max(1, data.count()))).fit(data)
        w = [abs(float(v)) for v in m.coefficients]
    elif model == "boosted_trees":
        m = GBTClassifier(featuresCol="_x", labelCol="_y", stepSize=step_size, maxIter=num_trees, seed=seed).fit(data)
        w = [float(v) for v in m.featureImportances.toArray()]
    elif model == "forest":
        m = RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=num_trees, seed=seed).fit(data)
        w = [float(v) for v in m.featureImportances.toArray()]
    else:
        raise ValueError(f"unknown model {model!r}: linear_svm, boosted_trees or forest")
    thr = sum(w) / len(w) if threshold == "mean" else float(threshold)
    spark = df.sparkSession
    return spark.createDataFrame([(c, wi, wi > thr) for c, wi in zip(cols, w)], "feature string, weight double, keep boolean")


def final_matrix(df: DataFrame, key: str, original: list[str], selected: list[str], label: str | None = None,
                 cast: str = "int") -> DataFrame:
    """Key (+ label) + original columns ∪ selected features, cast to ``cast``."""
    cols = list(dict.fromkeys([*original, *selected]))
    extra = [label] if label else []
    return df.select(key, *extra, *[F.col(c).try_cast(cast).alias(c) for c in cols])
