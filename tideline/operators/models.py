"""Models trained here: hashed text vectors, topics, classifiers. Spark ML throughout, so training is distributed."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, PCA, HashingTF, Normalizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.text import tokens


def embedded(df: DataFrame, text: str, name: str = "embedding", size: int = 64) -> DataFrame:
    """Hashed word counts of unit length: the offline stand-in for a hosted sentence embedder, same column contract."""
    tf = HashingTF(numFeatures=size, inputCol="_w", outputCol="_tf")
    out = Normalizer(inputCol="_tf", outputCol="_n", p=2.0).transform(tf.transform(df.withColumn("_w", tokens(F.coalesce(F.col(text), F.lit(""))))))
    return out.withColumn(name, vector_to_array("_n").cast("array<float>")).drop("_w", "_tf", "_n")


def topics(df: DataFrame, vector: str, k: int, components: int = 16, seed: int = 42) -> DataFrame:
    """Vectors scaled, reduced and clustered into ``topic``."""
    v = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    stages = [StandardScaler(inputCol="_v", outputCol="_s", withMean=True), PCA(k=components, inputCol="_s", outputCol="_p"), KMeans(k=k, seed=seed, featuresCol="_p", predictionCol="topic")]
    return Pipeline(stages=stages).fit(v).transform(v).drop("_v", "_s", "_p")


def tfidf(df: DataFrame, text: str, size: int = 1 << 16) -> DataFrame:
    w = HashingTF(numFeatures=size, inputCol="_w", outputCol="_tf").transform(df.withColumn("_w", tokens(F.col(text))))
    return IDF(inputCol="_tf", outputCol="tfidf").fit(w).transform(w).drop("_w", "_tf")


def classifier(kind: str = "gbt", seed: int = 42):
    """``gbt``, ``tree`` or ``logistic`` on ``features`` and ``label``."""
    return {"gbt": lambda: GBTClassifier(maxIter=20, maxDepth=4, seed=seed), "tree": lambda: DecisionTreeClassifier(maxDepth=4, seed=seed), "logistic": lambda: LogisticRegression(maxIter=50, regParam=0.01)}[kind]()


def assembled(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    d = df.select("*", *[F.col(c).cast("double").alias(f"_x_{c}") for c in columns]).withColumn("label", F.col(label).cast("double"))
    return VectorAssembler(inputCols=[f"_x_{c}" for c in columns], outputCol="features", handleInvalid="keep").transform(d)


def scored(train: DataFrame, test: DataFrame, columns: list[str], label: str, kind: str = "gbt") -> DataFrame:
    """Probability of the positive class for every row of ``test``."""
    m = classifier(kind).fit(assembled(train, columns, label))
    return m.transform(assembled(test, columns, label)).withColumn("probability", F.round(vector_to_array("probability")[1], 6)).drop("features", "rawPrediction", *[f"_x_{c}" for c in columns])


def tuned(train: DataFrame, columns: list[str], label: str, folds: int = 3, seed: int = 42) -> tuple[object, float]:
    """Best logistic model of a small grid by cross-validation, and its area under the curve."""
    lr = LogisticRegression(maxIter=50)
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.001, 0.01, 0.1]).build()
    cv = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(), numFolds=folds, seed=seed).fit(assembled(train, columns, label))
    return cv.bestModel, max(cv.avgMetrics)


def greedy_features(train: DataFrame, columns: list[str], label: str, most: int = 3) -> list[str]:
    """Forward selection by cross-validated area under the curve; the loop is over features, each step trains distributed."""
    chosen: list[str] = []
    best = 0.0
    while len(chosen) < most:
        tries = [(tuned(train, [*chosen, c], label)[1], c) for c in columns if c not in chosen]
        if not tries or max(tries)[0] <= best:
            break
        best, name = max(tries)
        chosen.append(name)
    return chosen
