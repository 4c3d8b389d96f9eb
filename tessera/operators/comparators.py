"""Models on raw features to compare with, by Spark ML: they fit and predict like the estimators, on standardised features with balanced class weights.

``kind`` is linear_svm, logistic_l2, logistic_l1, logistic_elasticnet, random_forest or gradient_boosting. Several classes are handled by the model itself where it can, else
one against the rest. A kernel machine isn't among them, as Spark ML has none.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import prepare

LINEAR = {"linear_svm", "logistic_l2", "logistic_l1", "logistic_elasticnet"}
KINDS = (*sorted(LINEAR), "random_forest", "gradient_boosting")
_INPUT, _INDEX, _WEIGHT, _PREDICTION, _MARGINS = "__features", "__label", "__weight", "__prediction", "__margins"


@dataclass
class Comparator:
    kind: str = "logistic_l2"
    C: float = 1.0
    l1_ratio: float = 0.5
    n_trees: int = 100
    max_depth: int = 5
    learning_rate: float = 0.1
    max_iter: int = 200
    class_weight: str | dict | None = "balanced"
    seed: int = 0
    classes_: list = field(default_factory=list, init=False)

    def _model(self, rows: float):
        cols = {"featuresCol": _INPUT, "labelCol": _INDEX, "weightCol": _WEIGHT}
        # Spark divides the loss by the sum of weights, so 1 / (C n) is the penalty of C in a sum over n rows.
        reg = 1 / (self.C * max(rows, 1.0))
        if self.kind == "linear_svm":
            return LinearSVC(regParam=reg, maxIter=self.max_iter, **cols)
        if self.kind in LINEAR:
            ratio = {"logistic_l2": 0.0, "logistic_l1": 1.0, "logistic_elasticnet": self.l1_ratio}[self.kind]
            return LogisticRegression(regParam=reg, elasticNetParam=ratio, maxIter=self.max_iter, **cols)
        if self.kind == "random_forest":
            return RandomForestClassifier(numTrees=self.n_trees, maxDepth=self.max_depth, seed=self.seed, **cols)
        return GBTClassifier(maxIter=self.n_trees, maxDepth=self.max_depth, stepSize=self.learning_rate, seed=self.seed, **cols)

    def fit(self, df: DataFrame, label: str = "y", features: Sequence[str] | None = None, weight: str | None = None, exclude=()) -> Comparator:
        if self.kind not in KINDS:
            raise ValueError(f"kind must be one of {KINDS}")
        if self.C <= 0:
            raise ValueError("C must be positive")
        self.features_ = prepare.feature_names(df, features, label, [*exclude, *([weight] if weight else [])])
        self.n_features_in_ = len(self.features_)
        prepare.require_clean(df, self.features_)
        of_class = prepare.class_weights(df, label, self.class_weight)
        self.classes_ = sorted(of_class)
        if len(self.classes_) < 2:
            raise ValueError("at least two classes are needed")
        s = F.col(weight).cast("double") if weight else F.lit(1.0)
        index = F.array_position(F.array(*map(F.lit, self.classes_)), F.col(label)) - 1
        data = df.select(*self.features_, index.cast("double").alias(_INDEX), (s * prepare.lookup(F.col(label), of_class)).alias(_WEIGHT))
        # The names are set before the fit, as models of one class against the rest keep what they were fitted with.
        model = self._model(data.agg(F.sum(_WEIGHT)).first()[0] or 0.0).setPredictionCol(_PREDICTION).setRawPredictionCol(_MARGINS)
        if len(self.classes_) > 2 and self.kind in ("linear_svm", "gradient_boosting"):
            model = OneVsRest(classifier=model, featuresCol=_INPUT, labelCol=_INDEX, weightCol=_WEIGHT, predictionCol=_PREDICTION, rawPredictionCol=_MARGINS)
        steps = [VectorAssembler(inputCols=self.features_, outputCol="__raw"), StandardScaler(inputCol="__raw", outputCol=_INPUT, withMean=True), model]
        self.model_ = Pipeline(stages=steps).fit(data)
        return self

    def _scored(self, df: DataFrame) -> DataFrame:
        prepare.feature_names(df, self.features_)
        return self.model_.transform(df)

    def predict(self, df: DataFrame, to: str = "prediction") -> DataFrame:
        classes = F.array(*map(F.lit, self.classes_))
        return self._scored(df).select(*[c for c in df.columns if c != to], F.get(classes, F.col(_PREDICTION).cast("int")).alias(to))

    def decision_function(self, df: DataFrame, to: str = "margin") -> DataFrame:
        """The score of the second of two classes, or an array with one for each of several."""
        scores = vector_to_array(_MARGINS)
        return self._scored(df).select(*[c for c in df.columns if c != to], (F.get(scores, F.lit(1)) if len(self.classes_) == 2 else scores).alias(to))
