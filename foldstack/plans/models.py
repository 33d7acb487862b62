"""Model registry: name to a function building an unfitted pipeline.

Estimators learn from ``features`` and ``y`` (see ``index_labels``) and fitted pipelines add
``proba`` and ``prediction``. ``full`` settings follow the fixed values below; ``quick`` settings
shrink the same models for tests and smoke runs.

``rwkv_ts`` and ``cnn_transformer`` keep the names callers know, but here each is a fixed
sequence transform feeding a multilayer perceptron: recurrent and attention networks have no
distributed counterpart in Spark ML.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from math import isqrt

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier

from foldstack.operators.splits import SEED
from foldstack.plans.boosting import BoostedClasses, Boosting
from foldstack.plans.forest import ForestClasses, Growing
from foldstack.plans.stages import CONVOLVED, FLAT, MIXED, ClassOutput, WindowVector

# Model names in stacking order and their full-size settings.
BASE_MODELS = ("logreg", "rf", "xgb", "rwkv_ts", "cnn_transformer")
STACKER = "stack"
# Models that learn a small table in one long task a fold, and those that cut it into many.
LONG_TASKS, FORESTS = ("xgb",), ("rf", "stack")
FULL = {
    "logreg": {"max_iter": 1000},
    "rf": {"trees": 1000, "depth": None, "leaf": 1, "bins": 256},
    "xgb": {"rounds": 500, "depth": 6, "step": 0.05, "rows": 0.8, "columns": 0.8, "bins": 256},
    "rwkv_ts": {"hidden": 128, "max_iter": 100},
    "cnn_transformer": {"hidden": 128, "max_iter": 100},
    "stack": {"trees": 1000, "depth": None, "leaf": 1, "bins": 256},
}
QUICK = {
    "logreg": {"max_iter": 50},
    "rf": {"trees": 20, "depth": 6, "leaf": 1, "bins": 64},
    "xgb": {"rounds": 2, "depth": 2, "step": 0.3, "rows": 0.8, "columns": 0.8, "bins": 32},
    "rwkv_ts": {"hidden": 16, "max_iter": 20},
    "cnn_transformer": {"hidden": 16, "max_iter": 20},
    "stack": {"trees": 20, "depth": 6, "leaf": 1, "bins": 64},
}
# Gradients of many partitions are combined in more steps before they reach the driver.
DEEP_AGGREGATION_ROWS = 100_000_000
SIZES = {"full": FULL, "quick": QUICK}
SCRATCH = ("_vector", "_raw", "_probability", "_index")


@dataclass(frozen=True)
class FitContext:
    """What a model must know about its training rows before it is built."""

    labels: list[str]
    n_rows: int
    n_features: int
    seed: int = SEED
    input_col: str = "features"
    settings: dict = field(default_factory=dict)


def _wrap(context: FitContext, kind: str, classifier) -> Pipeline:
    return Pipeline(
        stages=[
            WindowVector(
                inputCol=context.input_col, outputCol="_vector", kind=kind, size=context.n_features
            ),
            classifier,
            ClassOutput(
                labels=context.labels,
                probabilityCol="_probability",
                dropCols=list(SCRATCH),
            ),
        ]
    )


_COLUMNS = {
    "featuresCol": "_vector",
    "labelCol": "y",
    "probabilityCol": "_probability",
    "rawPredictionCol": "_raw",
    "predictionCol": "_index",
}


def logreg(context: FitContext) -> Pipeline:
    """Multinomial logistic regression with unit L2 penalty on the summed loss."""
    return _wrap(
        context,
        FLAT,
        LogisticRegression(
            family="multinomial",
            maxIter=context.settings["max_iter"],
            regParam=1.0 / max(context.n_rows, 1),
            elasticNetParam=0.0,
            standardization=False,
            aggregationDepth=3 if context.n_rows > DEEP_AGGREGATION_ROWS else 2,
            **_COLUMNS,
        ),
    )


def forest(context: FitContext) -> Pipeline:
    """Random forest under a keyed bootstrap, classes balanced in each tree, over the root of the columns per node."""
    s = context.settings
    settings = Growing(s["trees"], max(1, isqrt(context.n_features)), s["depth"], s["leaf"], context.seed)
    return _wrap(context, FLAT, ForestClasses(len(context.labels), s["bins"], settings))


def boosted(context: FitContext) -> Pipeline:
    """Gradient-boosted trees over all classes with row and column sampling and an L2 penalty."""
    s = context.settings
    settings = Boosting(s["rounds"], s["depth"], s["step"], s["rows"], s["columns"], seed=context.seed)
    return _wrap(context, FLAT, BoostedClasses(len(context.labels), s["bins"], settings))


def _perceptron(context: FitContext, kind: str, width: int) -> Pipeline:
    layers = [width, context.settings["hidden"], len(context.labels)]
    return _wrap(
        context,
        kind,
        MultilayerPerceptronClassifier(
            layers=layers, maxIter=context.settings["max_iter"], seed=context.seed, **_COLUMNS
        ),
    )


def _channels(n_features: int) -> int:
    return 4 if n_features % 4 == 0 else n_features


def shifted_sequence(context: FitContext) -> Pipeline:
    """Instance norm, time mixing and the last step, into a perceptron."""
    return _perceptron(context, MIXED, _channels(context.n_features))


def convolved_sequence(context: FitContext) -> Pipeline:
    """Multi-scale causal convolution and mean pooling, into a perceptron."""
    return _perceptron(context, CONVOLVED, 3 * _channels(context.n_features))


REGISTRY: dict[str, Callable[[FitContext], Pipeline]] = {
    "logreg": logreg,
    "rf": forest,
    "xgb": boosted,
    "rwkv_ts": shifted_sequence,
    "cnn_transformer": convolved_sequence,
    "stack": forest,
}


def list_models() -> list[str]:
    return list(REGISTRY)


def check_name(name: str) -> None:
    if name not in REGISTRY:
        raise ValueError(f"unknown model {name!r}; choose from {', '.join(REGISTRY)}")


def settings_for(name: str, size: str = "full", **overrides) -> dict:
    check_name(name)
    return {**SIZES[size][name], **overrides}


def get_model(name: str, context: FitContext) -> Pipeline:
    """Unfitted pipeline; unknown names list the choices."""
    check_name(name)
    settings = context.settings or settings_for(name)
    return REGISTRY[name](FitContext(**{**context.__dict__, "settings": settings}))
