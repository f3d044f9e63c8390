"""Evaluation aggregates. Every metric starts from one small ``groupBy`` over (truth, prediction)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _cells(df: DataFrame, y: str, yhat: str, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by, F.col(y).alias("y"), F.col(yhat).alias("yhat")).agg(
        F.count(F.lit(1)).alias("n")
    )


def per_class(
    df: DataFrame, y: str, yhat: str, labels: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Precision, recall, F1 and support for each label of a fixed list; 0/0 is 0."""
    cells = _cells(df, y, yhat, by)
    hit = F.col("y").eqNullSafe(F.col("yhat"))
    sides = F.array(
        F.struct(
            F.col("y").alias("label"),
            F.col("n").alias("support"),
            F.lit(0).cast("long").alias("predicted"),
            F.when(hit, F.col("n")).otherwise(0).alias("tp"),
        ),
        F.struct(
            F.col("yhat").alias("label"),
            F.lit(0).cast("long").alias("support"),
            F.col("n").alias("predicted"),
            F.lit(0).cast("long").alias("tp"),
        ),
        # a zero row per label keeps labels which neither side ever names
        *[
            F.struct(
                F.lit(label).alias("label"),
                F.lit(0).cast("long").alias("support"),
                F.lit(0).cast("long").alias("predicted"),
                F.lit(0).cast("long").alias("tp"),
            )
            for label in labels
        ],
    )
    sums = (
        cells.select(*by, F.inline(sides))
        .where(F.col("label").isin(list(labels)))
        .groupBy(*by, "label")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])
    )
    p, r = _ratio(F.col("tp"), F.col("predicted")), _ratio(F.col("tp"), F.col("support"))
    return sums.withColumns({"precision": p, "recall": r}).select(
        *by,
        "label",
        "precision",
        "recall",
        _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"),
        "support",
    )


def classification_metrics(
    df: DataFrame, y: str, yhat: str, labels: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """``per_class`` rows plus 'macro avg', 'weighted avg' and 'accuracy' rows."""
    rows = per_class(df, y, yhat, labels, by)
    macro = rows.groupBy(*by).agg(
        F.lit("macro avg").alias("label"),
        *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")],
        F.sum("support").alias("support"),
    )
    weighted = rows.groupBy(*by).agg(
        F.lit("weighted avg").alias("label"),
        *[
            _ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c)
            for c in ("precision", "recall", "f1")
        ],
        F.sum("support").alias("support"),
    )
    right = F.sum(F.when(F.col(y).eqNullSafe(F.col(yhat)), 1).otherwise(0))
    share = _ratio(right, F.count(F.lit(1)))
    accuracy = df.groupBy(*by).agg(
        F.lit("accuracy").alias("label"),
        *[share.alias(c) for c in ("precision", "recall", "f1")],
        F.count(F.lit(1)).alias("support"),
    )
    return rows.unionByName(macro).unionByName(weighted).unionByName(accuracy)


def confusion(df: DataFrame, y: str, yhat: str, labels: Sequence[str]) -> DataFrame:
    """One row per true label, one column per predicted label, zero filled."""
    truth = df.sparkSession.createDataFrame([(t,) for t in labels], "label string")
    counts = (
        df.where(F.col(y).isin(list(labels)))
        .groupBy(F.col(y).alias("label"))
        .pivot(yhat, list(labels))
        .agg(F.count(F.lit(1)))
    )
    return truth.join(counts, "label", "left").fillna(0, list(labels))


def metrics_by_subset(
    df: DataFrame, y: str, yhat: str, labels: Sequence[str], flag: str, by: Sequence[str] = ()
) -> DataFrame:
    """The same metrics on all rows and on rows whose flag is false, in one pass."""
    names = F.when(F.col(flag), F.array(F.lit("all"))).otherwise(
        F.array(F.lit("all"), F.lit("clean"))
    )
    return classification_metrics(
        df.withColumn("subset", F.explode(names)), y, yhat, labels, ["subset", *by]
    )


def lift(metrics: DataFrame, best: str, model: str = "model", label: str = "macro avg") -> DataFrame:
    """F1 of the best model less that of every other model."""
    rows = metrics.where(F.col("label") == label).select(model, "f1")
    top = rows.where(F.col(model) == best).select("f1").scalar()
    return rows.where(F.col(model) != best).select(
        F.lit(best).alias("best"),
        F.col(model).alias("baseline"),
        F.col("f1").alias("baseline_f1"),
        (top - F.col("f1")).alias("lift"),
    )


def compare_models(
    preds: DataFrame, y: str, yhat: str, labels: Sequence[str], model: str = "model"
) -> DataFrame:
    """Accuracy and macro F1 per model from a long (model, truth, prediction) table."""
    rows = classification_metrics(preds, y, yhat, labels, [model])
    return (
        rows.where(F.col("label").isin("accuracy", "macro avg"))
        .groupBy(model)
        .agg(
            F.max(F.when(F.col("label") == "accuracy", F.col("f1"))).alias("accuracy"),
            F.max(F.when(F.col("label") == "macro avg", F.col("f1"))).alias("macro_f1"),
        )
    )


def agreement(df: DataFrame, dims: dict[str, tuple[str, str]]) -> DataFrame:
    """Share of equal ratings, Cohen's kappa and both means per dimension.

    ``dims`` maps a name to the two raters' columns. Kappa is null when chance agreement is 1.
    """
    pairs = ", ".join(f"'{d}', CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)" for d, (a, b) in dims.items())
    long = df.selectExpr(f"stack({len(dims)}, {pairs}) AS (dimension, a, b)")
    cells = long.groupBy("dimension", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    marginal = F.array(
        F.struct(F.col("a").alias("v"), F.col("n").alias("na"), F.lit(0).cast("long").alias("nb")),
        F.struct(F.col("b").alias("v"), F.lit(0).cast("long").alias("na"), F.col("n").alias("nb")),
    )
    chance = (
        cells.select("dimension", F.inline(marginal))
        .groupBy("dimension", "v")
        .agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
        .groupBy("dimension")
        .agg(F.sum(F.col("na") * F.col("nb")).alias("met"))
    )
    seen = cells.groupBy("dimension").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("equal"),
        (F.sum(F.col("a") * F.col("n")) / F.sum("n")).alias("mean_a"),
        (F.sum(F.col("b") * F.col("n")) / F.sum("n")).alias("mean_b"),
    )
    po, pe = F.col("equal") / F.col("n"), F.col("met") / (F.col("n") * F.col("n"))
    certain = F.col("met") == F.col("n") * F.col("n")
    return seen.join(chance, "dimension").select(
        "dimension",
        "n",
        po.alias("agreement"),
        F.when(~certain, (po - pe) / F.when(~certain, 1 - pe)).alias("kappa"),
        "mean_a",
        "mean_b",
    )


def check_expectations(
    preds: DataFrame, expectations: Sequence[tuple[str, str, str]]
) -> DataFrame:
    """Rows tested and passed per expectation (name, rows it applies to, check), both as SQL.

    All checks are one aggregation over one scan of the predictions.
    """
    aggs = []
    for name, where, check in expectations:
        applies = F.coalesce(F.expr(where), F.lit(False))
        passed = applies & F.coalesce(F.expr(check), F.lit(False))
        aggs += [
            F.struct(
                F.lit(name).alias("expectation"),
                F.coalesce(F.sum(applies.cast("long")), F.lit(0)).alias("n"),
                F.coalesce(F.sum(passed.cast("long")), F.lit(0)).alias("n_passed"),
            )
        ]
    rows = preds.agg(F.array(*aggs).alias("r")).select(F.inline("r"))
    return rows.withColumn("ok", F.col("n") == F.col("n_passed"))
