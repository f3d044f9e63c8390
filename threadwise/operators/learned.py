"""A learned text classifier on weak labels: TF-IDF and class-weighted logistic regression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import (
    CountVectorizer,
    ElementwiseProduct,
    IDF,
    IndexToString,
    Normalizer,
    StringIndexer,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadwise.config import Settings
from threadwise.operators.retrieval import with_terms
from threadwise.operators.sampling import class_weights
from threadwise.session import reliable


def _with_terms(df: DataFrame, text: str, stop: Sequence[str]) -> DataFrame:
    rows = df.withColumn("_raw", F.coalesce(F.col(text), F.lit("")))
    return with_terms(rows, "_raw", "_terms", stop).drop("_raw")


def train_text_classifier(
    train: DataFrame,
    text: str,
    label: str,
    taxonomy: Sequence[str],
    stop: Sequence[str] = (),
    max_iter: int = 1000,
    settings: Settings = Settings(),
) -> PipelineModel:
    """Fit on (text, label) with balanced class weights n / (K * count) over labels present."""
    # every fit below passes over the training rows, so they are written once
    rows = reliable(_with_terms(train, text, stop).select(label, "_terms"))
    counted = class_weights(rows, label, taxonomy).where("n > 0").select(label, "n").collect()
    present, total = [r[0] for r in counted], sum(r[1] for r in counted)
    weights = class_weights(rows.where(F.col(label).isin(present)), label, present)
    rows = rows.join(F.broadcast(weights.select(label, "weight")), label)  # one row per label
    counts = CountVectorizer(
        inputCol="_terms", outputCol="_tf", vocabSize=settings.max_features, minDF=settings.min_df
    ).fit(rows)
    counted = counts.transform(rows)
    idf = IDF(inputCol="_tf", outputCol="_idf").fit(counted)
    # the library's idf has no final + 1, which a smoothed idf needs
    scale = ElementwiseProduct(
        inputCol="_tf", outputCol="_tfidf", scalingVec=Vectors.dense(idf.idf.toArray() + 1.0)
    )
    unit = Normalizer(inputCol="_tfidf", outputCol="features", p=2.0)
    index = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(rows)
    fitted = LogisticRegression(
        featuresCol="features", labelCol="_y", weightCol="weight", predictionCol="_yhat",
        maxIter=max_iter, regParam=1.0 / max(total, 1), standardization=False,
        family="multinomial",
    ).fit(index.transform(unit.transform(scale.transform(counted))))
    name = IndexToString(inputCol="_yhat", outputCol="prediction", labels=index.labels)
    return PipelineModel([counts, scale, unit, fitted, name])


def predict_text(model: PipelineModel, df: DataFrame, text: str, stop: Sequence[str] = ()) -> DataFrame:
    """Add ``prediction``."""
    made = ["_terms", "_tf", "_tfidf", "features", "rawPrediction", "probability", "_yhat"]
    return model.transform(_with_terms(df, text, stop)).drop(*made)


def predict_from_coefficients(model: PipelineModel, df: DataFrame, key: str, text: str, stop: Sequence[str] = ()) -> DataFrame:
    """(key, prediction) by joins with a table of the model's coefficients, of max_features x labels numbers at most:
    counts times idf per term, unit length, one linear score per label, the greatest wins."""
    counts, scale, _, fitted, name = model.stages
    spark, labels = df.sparkSession, name.getLabels()
    by_term = fitted.coefficientMatrix.toArray().T
    idf = scale.getScalingVec().toArray()
    table = spark.createDataFrame(
        [(t, float(w), row.tolist()) for t, w, row in zip(counts.vocabulary, idf, by_term)], "term string, idf double, weights array<double>"
    )
    terms = _with_terms(df, text, stop).select(key, F.explode("_terms").alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    rows = terms.join(F.broadcast(table), "term").withColumn("w", F.col("tf") * F.col("idf"))
    sums = [F.sum(F.col("w") * F.col("weights")[k]).alias(f"s{k}") for k in range(len(labels))]
    scored = df.select(key).join(rows.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"), *sums), key, "left")
    score = lambda k: F.coalesce(F.col(f"s{k}") / F.col("size"), F.lit(0.0)) + F.lit(float(fitted.interceptVector[k]))
    best = F.array_max(F.array(*[F.struct(score(k).alias("score"), F.lit(-k).alias("at"), F.lit(label).alias("label")) for k, label in enumerate(labels)]))
    return scored.select(key, best["label"].alias("prediction"))
