"""Text embedding and sentiment as Spark ML stages; both are replaceable by any frame function."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantframe.operators.news import default_sentiment

DIMENSIONS = 256
WORD = r"[^\p{L}\p{N}]+"


def embed_text(df: DataFrame, text: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """Unit vector of hashed word counts in ``embedding``; nothing is fitted, so it also streams."""
    words = RegexTokenizer(inputCol=text, outputCol="_words", pattern=WORD).transform(df.fillna("", [text]))
    counts = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dimensions).transform(words)
    unit = Normalizer(inputCol="_tf", outputCol="_unit").transform(counts)
    vector = vector_to_array(F.col("_unit"), "float32")
    return unit.withColumn("embedding", vector).drop("_words", "_tf", "_unit")


def train_sentiment(labelled: DataFrame, features: int = 1 << 14, iterations: int = 20) -> PipelineModel:
    """Classifier of texts with a 0/1 ``label``."""
    stages = [
        RegexTokenizer(inputCol="text", outputCol="_words", pattern=WORD),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_idf"),
        LogisticRegression(featuresCol="_idf", labelCol="label", maxIter=iterations, regParam=0.01),
    ]
    return Pipeline(stages=stages).fit(labelled)


def score_sentiment(model: PipelineModel, news: DataFrame, names: tuple[str, str] = ("negative", "positive")) -> DataFrame:
    """Label and probability of each whole text; blank texts count as a failed scorer."""
    scored = model.transform(news)
    p = vector_to_array(F.col("probability"))
    failed = F.col("text").isNull() | (F.trim("text") == "")
    label = F.when(~failed, F.when(F.col("prediction") == 1, names[1]).otherwise(names[0]))
    return scored.withColumns(default_sentiment(label, F.array_max(p))).drop(
        "_words", "_tf", "_idf", "rawPrediction", "probability", "prediction"
    )
