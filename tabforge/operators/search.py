"""Search over whole pipelines (M7) and boosting with early stopping.

A search space is typed: each step names how its stage is built and the kind of values of its parameters. Candidates
(some transformers and a model, all with drawn parameters) are drawn from a seed, scored by cross-validation on a
fold column, and the best one is fitted again on all rows. Only drawn parameters and fold scores live on the driver.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import feature as MF
from pyspark.ml.classification import GBTClassificationModel, NaiveBayes
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame

from tabforge.operators import models as L


# Parameter kinds -------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Choice:
    values: tuple

    def draw(self, rng: random.Random):
        return rng.choice(self.values)


@dataclass(frozen=True)
class Whole:
    low: int
    high: int

    def draw(self, rng: random.Random) -> int:
        return rng.randint(self.low, self.high)


@dataclass(frozen=True)
class Real:
    low: float
    high: float
    log: bool = False

    def draw(self, rng: random.Random) -> float:
        if self.log:
            return math.exp(rng.uniform(math.log(self.low), math.log(self.high)))
        return rng.uniform(self.low, self.high)


@dataclass(frozen=True)
class Step:
    """``build(width, **parameters)`` gives a stage and the width of its output for an input of ``width`` features."""

    name: str
    build: Callable
    params: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Space:
    transformers: list[Step]
    models: list[Step]
    max_transformers: int = 2


@dataclass(frozen=True)
class Candidate:
    steps: tuple  # (Step, parameters), the last one the model

    def __str__(self) -> str:
        return " > ".join(f"{s.name}({', '.join(f'{k}={v}' for k, v in sorted(p.items()))})" for s, p in self.steps)

    def pipeline(self, cols: list[str], label: str = "label") -> Pipeline:
        stages, at, width = [VectorAssembler(inputCols=cols, outputCol="_v0", handleInvalid="keep")], "_v0", len(cols)
        for k, (step, params) in enumerate(self.steps[:-1], start=1):
            stage, width = step.build(width, **params)
            for p, v in (("inputCol", at), ("featuresCol", at), ("labelCol", label), ("outputCol", f"_v{k}")):
                if stage.hasParam(p):
                    stage._set(**{p: v})
            stages.append(stage)
            at = f"_v{k}"
        model, _ = self.steps[-1][0].build(width, **self.steps[-1][1])
        return Pipeline(stages=[*stages, model._set(featuresCol=at, labelCol=label)])


def _same(make):
    return lambda width, **p: (make(**p), width)


def _pca(width, share):
    k = max(1, min(width, math.ceil(share * width)))
    return MF.PCA(k=k), k


def _percentile(width, percentile):
    s = MF.UnivariateFeatureSelector(selectionMode="percentile").setFeatureType("continuous").setLabelType("categorical")
    return s.setSelectionThreshold(percentile / 100.0), max(1, int(width * percentile / 100.0))


def default_space(max_transformers: int = 2) -> Space:
    """Scalers, row norms, degree-2 terms, projections and selections times the classifiers, with wide parameter ranges."""
    transformers = [
        Step("standard", _same(lambda: MF.StandardScaler(withMean=True))), Step("minmax", _same(MF.MinMaxScaler)),
        Step("maxabs", _same(MF.MaxAbsScaler)), Step("robust", _same(lambda: MF.RobustScaler(withCentering=True))),
        Step("normalize", _same(MF.Normalizer), {"p": Choice((1.0, 2.0, float("inf")))}),
        Step("binarize", _same(MF.Binarizer), {"threshold": Real(0.0, 1.0)}),
        Step("poly", lambda width: (MF.PolynomialExpansion(degree=2), width * (width + 3) // 2)),
        Step("pca", _pca, {"share": Real(0.3, 1.0)}), Step("percentile", _percentile, {"percentile": Whole(20, 99)}),
    ]
    depth = Whole(1, 10)
    models = [
        Step("logreg", _same(lambda **p: L.logreg(maxIter=100, **p)), {"regParam": Real(1e-4, 10.0, log=True), "elasticNetParam": Choice((0.0, 1.0))}),
        Step("tree", _same(lambda **p: L.tree(seed=0, **p)), {"maxDepth": depth, "minInstancesPerNode": Whole(1, 20), "impurity": Choice(("gini", "entropy"))}),
        Step("forest", _same(lambda **p: L.forest(seed=0, **p)), {"numTrees": Choice((20, 50, 100)), "maxDepth": depth,
                                                                    "subsamplingRate": Real(0.5, 1.0), "featureSubsetStrategy": Choice(("sqrt", "log2", "all"))}),
        Step("forest_no_bootstrap", _same(lambda **p: L.forest_no_bootstrap(seed=0, **p)), {"numTrees": Choice((20, 50, 100)), "maxDepth": depth}),
        Step("boosted_trees", _same(lambda **p: L.boosted_trees(seed=0, **p)), {"maxIter": Choice((20, 50, 100)), "maxDepth": Whole(1, 5),
                                                                                  "stepSize": Choice((0.001, 0.01, 0.1, 0.5, 1.0))}),
        Step("linear_svm", _same(lambda **p: L.linear_svm(maxIter=100, **p)), {"regParam": Real(1e-4, 10.0, log=True)}),
        Step("gaussian_nb", _same(lambda: NaiveBayes(modelType="gaussian"))),
    ]
    return Space(transformers, models, max_transformers)


def draw(space: Space, n: int, seed: int = 0) -> list[Candidate]:
    """``n`` seeded candidates, different ones as long as 20 draws in a row find one."""
    rng, out, seen = random.Random(seed), [], set()
    while len(out) < n:
        for _ in range(20):
            chosen = [rng.choice(space.transformers) for _ in range(rng.randint(0, space.max_transformers))] if space.transformers else []
            chosen.append(rng.choice(space.models))
            c = Candidate(tuple((s, {k: kind.draw(rng) for k, kind in s.params.items()}) for s in chosen))
            if str(c) not in seen:
                break
        seen.add(str(c))
        out.append(c)
    return out


def search(df: DataFrame, space: Space, cols: list[str], y: str, fold: str, n: int = 100, seed: int = 0, patience: int | None = None,
           parallelism: int = 4) -> tuple[DataFrame, PipelineModel | None, Candidate | None]:
    """Scores of the candidates in the order they were drawn, the best one fitted on all rows, and its description.

    Scores are fold accuracies (mean and population std). The search ends after ``n`` candidates or ``patience`` in a
    row without a better mean. A candidate that cannot be fitted to the data has a NULL score and its reason, and counts as
    one without improvement. Table: step, pipeline, params (JSON), mean, std, best_so_far, failure.
    """
    rows, best, chosen, stale = [], None, None, 0
    for k, c in enumerate(draw(space, n, seed)):
        params = json.dumps({s.name: p for s, p in c.steps}, sort_keys=True, default=str)
        try:
            scores = [r["score"] for r in L.cross_validate(df, {"c": c.pipeline(cols)}, cols, y, fold, parallelism).collect()]
            mean = sum(scores) / len(scores)
            std = math.sqrt(sum((s - mean) ** 2 for s in scores) / len(scores))
            failure = None
        except Exception as e:  # noqa: BLE001  what a stage refuses differs by stage
            mean = std = None
            failure = f"{type(e).__name__}: {str(e).splitlines()[0][:200]}"
        if mean is not None and (best is None or mean > best):
            best, chosen, stale = mean, c, 0
        else:
            stale += 1
        rows.append((k, str(c), params, mean, std, best, failure))
        if patience is not None and stale >= patience:
            break
    table = df.sparkSession.createDataFrame(rows, "step int, pipeline string, params string, mean double, std double, best_so_far double, failure string")
    return table, chosen and chosen.pipeline(cols).fit(L.with_label(df, y)), chosen


# Boosting with a validation metric ----------------------------------------------------------------
def truncate_boosting(model: GBTClassificationModel, rounds: int) -> GBTClassificationModel:
    """The model after its first ``rounds`` trees."""
    java, sc = model._java_obj, model._sc if hasattr(model, "_sc") else None
    from pyspark.sql import SparkSession
    sc = sc or SparkSession.active().sparkContext
    jvm = sc._jvm
    trees, weights = java.trees(), java.treeWeights()
    some = sc._gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, rounds)
    heavy = sc._gateway.new_array(jvm.double, rounds)
    for k in range(rounds):
        some[k], heavy[k] = trees[k], float(weights[k])
    made = jvm.org.apache.spark.ml.classification.GBTClassificationModel(f"{java.uid()}_{rounds}", some, heavy, java.numFeatures())
    out = GBTClassificationModel(made)
    out._set(featuresCol=model.getFeaturesCol(), labelCol=model.getLabelCol(), predictionCol=model.getPredictionCol())
    return out


def boost_with_early_stop(train: DataFrame, valid: DataFrame, cols: list[str], y: str, patience: int | None = None,
                          **params) -> tuple[DataFrame, PipelineModel, int]:
    """Table (iteration, train_loss, valid_loss, best), the model truncated at the best iteration, and that iteration.

    The loss after each iteration is twice the mean of log(1 + exp(-2 y F)) with y = -1 or 1. The best iteration is the
    first with the least validation loss among those up to ``patience`` iterations behind the best so far.
    """
    pipe = L.assembled(L.boosted_trees(**params), cols)
    fitted = pipe.fit(L.with_label(train, y))
    model = fitted.stages[-1]

    def losses(df):
        return model.evaluateEachIteration(fitted.stages[0].transform(L.with_label(df, y)))
    on_train, on_valid = losses(train), losses(valid)
    best = 0
    for k, v in enumerate(on_valid):
        if v < on_valid[best]:
            best = k
        elif patience is not None and k - best >= patience:
            break
    rows = [(k + 1, float(a), float(b), k == best) for k, (a, b) in enumerate(zip(on_train, on_valid))]
    table = train.sparkSession.createDataFrame(rows, "iteration int, train_loss double, valid_loss double, best boolean")
    return table, PipelineModel([fitted.stages[0], truncate_boosting(model, best + 1)]), best + 1
