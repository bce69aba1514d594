"""Three-class models of the forward return: fitting, scoring, importances and attributions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, OneVsRestModel, RandomForestClassifier
from pyspark.ml.feature import StringIndexerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantframe.session import stored_bytes

CLASSES = ("-1", "0", "1")  # model class index 0, 1, 2
SELL, HOLD, BUY = 0, 1, 2


def train_classifier(
    labelled: DataFrame,
    features: Sequence[str],
    target: str = "target",
    class_weight: Mapping[int, float] | None = None,
    kind: str = "forest",
    **params,
) -> PipelineModel:
    """Fit on rows with -1/0/1 in ``target``.

    ``kind`` is 'forest' (default), 'boosted' (gradient-boosted trees, one class against the rest) or 'logistic', whose
    attributions are exact.  The class index is fixed, so a fold that misses a class still yields three probabilities.
    """
    weight = F.lit(1.0)
    for value, w in (class_weight or {}).items():
        weight = F.when(F.col(target) == int(value), F.lit(float(w))).otherwise(weight)
    rows = labelled.select(*features, F.col(target).cast("string").alias("_target"), weight.alias("_weight"))
    index = StringIndexerModel.from_labels(list(CLASSES), inputCol="_target", outputCol="_label")
    assemble = VectorAssembler(inputCols=list(features), outputCol="_features")
    common = {"featuresCol": "_features", "labelCol": "_label", "weightCol": "_weight"}
    if kind == "forest":
        learner = RandomForestClassifier(**common, **{"numTrees": 20, "maxDepth": 4, "seed": 1, **params})
    elif kind == "logistic":
        learner = LogisticRegression(
            **common, **{"family": "multinomial", "regParam": 0.05, "maxIter": 20, "tol": 1e-4, **params}
        )
    elif kind == "boosted":
        trees = GBTClassifier(**{"maxIter": 20, "maxDepth": 4, "stepSize": 0.1, "seed": 1, **params})
        learner = OneVsRest(classifier=trees, **common)
        return _one_against_the_rest(assemble, learner, index.transform(rows))
    else:
        raise ValueError("kind is 'forest', 'boosted' or 'logistic'")
    fitted = Pipeline(stages=[assemble, learner]).fit(index.transform(rows))
    return fitted


#: Stored bytes of rows up to which the classes are fitted side by side.
SIDE_BY_SIDE = 1 << 28


def _one_against_the_rest(assemble: VectorAssembler, learner: OneVsRest, rows: DataFrame) -> PipelineModel:
    """As ``learner`` fits, but without a copy of all vectors, and a class at a time if the rows are many: each fit keeps its own."""
    vectors, trees = assemble.transform(rows), learner.getClassifier()

    def fit(k: int):
        own = vectors.withColumn("_one", (F.col("_label") == k).cast("double"))
        return trees.copy({trees.labelCol: "_one", trees.featuresCol: "_features", trees.weightCol: "_weight"}).fit(own)

    with ThreadPool(len(CLASSES) if stored_bytes(rows) <= SIDE_BY_SIDE else 1) as pool:
        fitted = pool.map(fit, range(len(CLASSES)))
    return PipelineModel([assemble, learner._copyValues(OneVsRestModel(models=fitted))])


def class_probabilities(scored: DataFrame) -> Column:
    """Probability of each class, as an array, from the columns that a model adds.

    Boosted margins against the rest become probabilities of their own, which are scaled to add up to one.
    """
    if "probability" in scored.columns:
        return vector_to_array(F.col("probability"))
    each = F.transform(vector_to_array(F.col("rawPrediction")), lambda margin: 1 / (1 + F.exp(-2 * margin)))
    total = F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
    return F.transform(each, lambda x: x / total)


def score_probabilities(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add prob_buy and prob_sell."""
    scored = model.transform(df)
    scored = scored.withColumn("_p", class_probabilities(scored))
    return scored.withColumns({"prob_sell": F.col("_p")[SELL], "prob_buy": F.col("_p")[BUY]}).drop(*MODEL_COLUMNS)


#: What a model adds beside its answer.
MODEL_COLUMNS = ("_features", "rawPrediction", "probability", "prediction", "_p")


def predicted_class(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add ``y_pred``, the most probable class."""
    return (
        model.transform(df)
        .withColumn("y_pred", (F.col("prediction") - 1).cast("int"))
        .drop(*MODEL_COLUMNS)
    )


def feature_names(model: PipelineModel) -> list[str]:
    return list(model.stages[0].getInputCols())


def feature_importance(model: PipelineModel) -> list[tuple[str, float]]:
    """(feature, importance), largest first, ties by name."""
    learner = model.stages[-1]
    if isinstance(learner, OneVsRestModel):
        values = sum(m.featureImportances.toArray() for m in learner.models) / len(learner.models)
    elif hasattr(learner, "featureImportances"):
        values = learner.featureImportances.toArray()
    else:
        values = abs(learner.coefficientMatrix.toArray()).max(axis=0)
    return sorted(zip(feature_names(model), map(float, values)), key=lambda x: (-x[1], x[0]))


def top_features(labelled: DataFrame, features: Sequence[str], n: int = 15, **params) -> list[str]:
    """The ``n`` features with the largest impurity gain."""
    return [name for name, _ in feature_importance(train_classifier(labelled, features, **params))[:n]]


def linear_contributions(weights: Mapping[str, float], means: Mapping[str, Column | float]) -> dict[str, Column]:
    """Exact attributions of a linear margin: weight times distance from the mean."""
    return {
        name: F.lit(float(w)) * (F.col(name) - (F.lit(m) if isinstance(m, float) else m))
        for (name, w), m in zip(weights.items(), (means[n] for n in weights))
    }


def top_drivers(contributions: Mapping[str, Column], n: int = 3) -> Column:
    """Names of the ``n`` largest absolute contributions, ties in mapping order."""
    ranked = F.array_sort(
        F.array(
            *[
                F.struct((-F.abs(c)).alias("size"), F.lit(i).alias("place"), F.lit(name).alias("name"))
                for i, (name, c) in enumerate(contributions.items())
            ]
        )
    )
    return F.transform(F.slice(ranked, 1, n), lambda r: r["name"])


def occlusion(model: PipelineModel, df: DataFrame, keys: Sequence[str], classes: Sequence[int] = (SELL,)) -> DataFrame:
    """(keys, class_index, feature, contribution): drop in a class's probability when a feature is set to its mean.

    The rows and their replaced feature vectors are scored once for all ``classes``; each row's variants stay together, so
    the row's own score meets them without a join.
    """
    names = feature_names(model)
    means = df.agg(F.struct(*[F.avg(n).alias(n) for n in names])).scalar()
    values = F.array(*[F.col(n).cast("double") for n in names])
    variants = F.array(
        F.struct(F.lit("").alias("feature"), values.alias("v")),
        *[
            F.struct(
                F.lit(n).alias("feature"),
                F.array(*[means[m] if m == n else F.col(m).cast("double") for m in names]).alias("v"),
            )
            for n in names
        ],
    )
    spread = df.select(*keys, F.explode(variants).alias("_x")).select(
        *keys, "_x.feature", array_to_vector(F.col("_x.v")).alias("_features")
    )
    scored = model.stages[-1].transform(spread)
    p = class_probabilities(scored)
    scored = scored.select(*keys, F.struct("feature", *[p[c].alias(f"p{c}") for c in classes]).alias("_s"))
    rows = scored.groupBy(*keys).agg(F.collect_list("_s").alias("_s"))  # one entry per feature, and the row itself
    own = F.filter("_s", lambda s: s["feature"] == "")[0]
    parts = F.flatten(
        F.transform(
            F.filter("_s", lambda s: s["feature"] != ""),
            lambda s: F.array(
                *[
                    F.struct(F.lit(c).alias("class_index"), s["feature"].alias("feature"), (own[f"p{c}"] - s[f"p{c}"]).alias("contribution"))
                    for c in classes
                ]
            ),
        )
    )
    return rows.select(*keys, F.explode(parts).alias("_c")).select(*keys, "_c.*")


def attribution_mean_abs(contributions: DataFrame) -> DataFrame:
    """Mean absolute contribution per feature, largest first."""
    impact = contributions.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_impact"))
    return impact.orderBy(F.col("mean_impact").desc(), "feature")


def tail_sample(df: DataFrame, n: int = 1000, order: Sequence[str] = ("date", "ticker")) -> DataFrame:
    """The last ``n`` rows in the given order."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)
