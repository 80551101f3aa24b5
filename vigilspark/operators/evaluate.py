"""Training and evaluation of risk models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage


def train_risk_model(df: DataFrame, features: Sequence[str], label: str = "label", c: float = 1.0) -> dict:
    """Class-balanced, L2-regularized logistic regression on standardized features.

    Returns weights and intercept for the unscaled features. The whole fit runs on Spark;
    only the moments the coefficients (one number per feature) and the two classes' counts come to the driver.
    """
    classes = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n")).limit(3).collect()
    if len(classes) > 2:
        raise ValueError(f"{label}: more than two classes")
    total = sum(r["n"] for r in classes)
    weight = F.lit(None)
    for r in classes:
        weight = F.when(F.col(label) == r[label], F.lit(total / (len(classes) * r["n"]))).otherwise(weight)
    moments = df.agg(
        *[F.avg(f).alias(f"m_{i}") for i, f in enumerate(features)],
        *[F.stddev_pop(f).alias(f"s_{i}") for i, f in enumerate(features)],
        F.count("*").alias("n"),
    ).first()
    mean = [moments[f"m_{i}"] for i in range(len(features))]
    scale = [moments[f"s_{i}"] or 1.0 for i in range(len(features))]
    scaled = df.where(F.col(label).isNotNull()).select(
        F.col(label).cast("double").alias("label"), weight.cast("double").alias("class_weight"),
        *[((F.col(f) - m) / s).alias(f"z_{i}") for i, (f, m, s) in enumerate(zip(features, mean, scale))],
    )
    rows = VectorAssembler(inputCols=[f"z_{i}" for i in range(len(features))], outputCol="features").transform(scaled)
    model = LogisticRegression(
        weightCol="class_weight", regParam=1.0 / (c * moments["n"]), elasticNetParam=0.0, standardization=False,
        maxIter=1000, tol=1e-9,
    ).fit(rows.select("features", "label", "class_weight"))
    raw = [float(w) / s for w, s in zip(model.coefficients, scale)]
    return {
        "weights": {f: round(w, 4) for f, w in zip(features, raw)},
        "intercept": float(model.intercept) - sum(w * m for w, m in zip(raw, mean)),
    }


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def binary_metrics(df: DataFrame, truth: str = "label", predicted: str = "prediction") -> DataFrame:
    """Confusion counts, accuracy, precision, recall and F1 in one pass."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    n = df.agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & ~p).alias("tn"), F.count_if(~t & p).alias("fp"),
        F.count_if(t & ~p).alias("fn"),
    )
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return n.withColumns({
        "accuracy": _ratio(tp + tn, tp + tn + fp + fn), "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn),
    }).withColumn(
        "f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    )


def ranked(df: DataFrame, score: str, label: str, tie: str) -> DataFrame:
    """Rows by falling score with their rank and the positives up to and including them.

    A total order over everything, without one task seeing everything: rows are range
    partitioned (ties by key, so equal scores spread too), ranked inside their range, and
    shifted by the totals of the ranges before (one row per range).
    """
    ranges = df.select(F.col(score).alias("score"), F.col(label).cast("int").alias("label"), F.col(tie).alias("tie"))
    ranges = ranges.repartitionByRange(F.col("score").desc(), F.col("tie")).withColumn("part", F.spark_partition_id())
    ranges = stage(ranges, "ranked")
    totals = ranges.groupBy("part").agg(F.count("*").alias("n"), F.sum("label").alias("p"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select(
        "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum("p").over(earlier), F.lit(0)).alias("p0")
    )
    inside = Window.partitionBy("part").orderBy(F.col("score").desc(), "tie")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    return ranges.withColumn("r", F.row_number().over(inside)).withColumn("s", F.sum("label").over(upto)).join(shift, "part").select(
        "score", "label", "tie", (F.col("r") + F.col("n0")).alias("rank"), (F.col("s") + F.col("p0")).alias("positives"),
    )


def roc_auc(df: DataFrame, score: str = "score", label: str = "label", tie: str = "id") -> DataFrame:
    """Area under the step curve, one step a row; 0.5 with a single class."""
    rows = ranked(df, score, label, tie)
    return rows.agg(
        F.sum(F.when(F.col("label") == 0, F.col("positives")).otherwise(0)).alias("under"),
        F.sum("label").alias("p"), F.count_if(F.col("label") == 0).alias("n"),
    ).select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("under") / (F.col("p") * F.col("n"))).otherwise(0.5).alias("roc_auc"))


def average_precision(df: DataFrame, score: str = "score", label: str = "label", tie: str = "id") -> DataFrame:
    """Mean precision at the positives; 0 without positives."""
    rows = ranked(df, score, label, tie)
    return rows.agg(
        F.sum(F.when(F.col("label") == 1, F.col("positives") / F.col("rank"))).alias("s"), F.sum("label").alias("p")
    ).select(F.when(F.col("p") > 0, F.col("s") / F.col("p")).otherwise(0.0).alias("average_precision"))


def multiclass_metrics(df: DataFrame, classes: Sequence[str], truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """One row per class with its confusion row, precision, recall, F1 and support,
    plus the accuracy and the macro averages."""
    counts = df.groupBy(truth, predicted).agg(F.count("*").alias("n"))
    names = counts.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in classes])).alias("class"))
    confusion = (
        counts.withColumnRenamed(truth, "class").groupBy("class").pivot(predicted, list(classes)).agg(F.sum("n"))
    )
    columns = [F.coalesce(F.col(c), F.lit(0)).alias(f"as_{c}") for c in classes]
    hit = F.when(F.col(truth) == F.col(predicted), F.col("n"))
    by_truth = counts.groupBy(F.col(truth).alias("class")).agg(
        F.sum("n").alias("support"), F.coalesce(F.sum(hit), F.lit(0)).alias("tp")
    )
    by_guess = counts.groupBy(F.col(predicted).alias("class")).agg(F.sum("n").alias("guessed"))
    full = names.join(confusion, "class", "left").select("class", *columns).join(by_truth, "class", "left").join(by_guess, "class", "left").na.fill(0)
    w = Window.partitionBy()
    return (
        full.withColumns({"precision": _ratio(F.col("tp"), F.col("guessed")), "recall": _ratio(F.col("tp"), F.col("support"))})
        .withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
        .withColumns({
            "accuracy": _ratio(F.sum("tp").over(w), F.sum("support").over(w)),
            "macro_precision": F.avg("precision").over(w), "macro_recall": F.avg("recall").over(w), "macro_f1": F.avg("f1").over(w),
        })
        .drop("tp", "guessed")
    )


def stratified_split(df: DataFrame, label: str, key: str, ratio: float = 0.75, seed: int = 42, pieces: int = 256) -> DataFrame:
    """Exact ``round(ratio * n)`` of each class for training, chosen by hash order.

    The shuffled order is cut into pieces by the hash, so a class that holds most rows is
    ranked in many tasks; a piece is shifted by the sizes of the pieces before it.
    """
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    mixed = df.withColumn("_h", h).withColumn(
        "_piece", F.floor(F.conv(F.substring("_h", 1, 4), 16, 10).cast("int") * F.lit(pieces) / 65536).cast("int")
    )
    sizes = mixed.groupBy(label, "_piece").agg(F.count("*").alias("n"))
    by_class = Window.partitionBy(label)
    shift = sizes.select(
        label, "_piece",
        F.coalesce(F.sum("n").over(by_class.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.rint(F.sum("n").over(by_class) * ratio).alias("_train"),
    )
    rank = F.row_number().over(Window.partitionBy(label, "_piece").orderBy("_h", key))
    return mixed.withColumn("_rank", rank).join(shift, [label, "_piece"]).withColumn(
        "split", F.when(F.col("_rank") + F.col("_before") <= F.col("_train"), "train").otherwise("test")
    ).drop("_h", "_piece", "_rank", "_before", "_train")


def class_imbalance(df: DataFrame, label: str = "label") -> DataFrame:
    """Counts per class, ratio of largest to smallest, flag above 2."""
    w = Window.partitionBy()
    return df.groupBy(F.col(label).alias("class")).agg(F.count("*").alias("n")).withColumn(
        "ratio", F.max("n").over(w) / F.min("n").over(w)
    ).withColumn("imbalanced", F.col("ratio") > 2)
