"""Classification metrics from counts, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.operators.ranges import running_sums


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def confusion_matrix(df: DataFrame, true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """n and its share of the true class, for every pair of labels that occur in either column."""
    counts = df.groupBy(F.col(true).alias("true_label"), F.col(pred).alias("pred_label")).agg(F.count(F.lit(1)).alias("n"))
    labels = counts.select(F.explode(F.array("true_label", "pred_label")).alias("label")).distinct()
    grid = labels.select(F.col("label").alias("true_label")).crossJoin(labels.select(F.col("label").alias("pred_label")))  # labels squared
    full = grid.join(counts, ["true_label", "pred_label"], "left").fillna(0, ["n"])
    return full.withColumn("row_share", F.round(_ratio(F.col("n"), F.sum("n").over(Window.partitionBy("true_label"))), 6))


def class_metrics(matrix: DataFrame) -> DataFrame:
    """Per class: tp, fp, fn, tn, support, precision, recall, f1 (0 for a division by zero)."""
    rows = matrix.groupBy(F.col("true_label").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(0)).alias("tp"))
    cols = matrix.groupBy(F.col("pred_label").alias("label")).agg(F.sum("n").alias("predicted"))
    total = matrix.agg(F.sum("n").alias("total"))
    d = rows.join(cols, "label").crossJoin(F.broadcast(total))  # one row
    d = d.select("label", "support", "tp", (F.col("predicted") - F.col("tp")).alias("fp"), (F.col("support") - F.col("tp")).alias("fn"), (F.col("total") - F.col("predicted") - F.col("support") + F.col("tp")).alias("tn"))
    d = d.withColumns({"precision": _ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": _ratio(F.col("tp"), F.col("support"))})
    return d.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def classification_metrics(matrix: DataFrame) -> DataFrame:
    """One row: accuracy, error_rate, macro and weighted precision, recall, f1."""
    c = class_metrics(matrix)
    total = F.sum("support")
    weighted = lambda x: F.round(_ratio(F.sum(F.col(x) * F.col("support")), total), 6)
    accuracy = _ratio(F.sum("tp"), total)
    return c.agg(F.round(accuracy, 6).alias("accuracy"), F.round(1 - accuracy, 6).alias("error_rate"), *(F.round(F.avg(x), 6).alias(f"{x}_macro") for x in ("precision", "recall", "f1")), *(weighted(x).alias(f"{x}_weighted") for x in ("precision", "recall", "f1")))


def misclassified(df: DataFrame, true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    return df.where(F.col(true) != F.col(pred)).withColumn("kind", F.when(F.col(pred) > F.col(true), "false_positive").otherwise("false_negative"))


def _counts(labels: range, true: str, pred: str) -> list[Column]:
    out = []
    for x in labels:
        t, p = F.col(true) == x, F.col(pred) == x
        out += [F.count_if(t & p).alias(f"tp{x}"), F.count_if(p & ~t).alias(f"fp{x}"), F.count_if(t & ~p).alias(f"fn{x}"), F.count_if(t & p & (F.col(true) > 0)).alias(f"mtp{x}"), F.count_if(p & ~t & (F.col(true) > 0)).alias(f"mfp{x}")]
    return out


def aspect_metrics(pairs: DataFrame, *keys: str, true: str = "label_id", pred: str = "pred_label_id", single: bool = False) -> DataFrame:
    """Detection (label > 0), polarity (labels 1-3 where the true one is over 0; null below two of these, or 0 with
    `single`) and combined macro F1 over the fixed labels 0-3, so that absent classes count as 0."""
    t, p = F.col(true) > 0, F.col(pred) > 0
    d = pairs.groupBy(*keys).agg(F.count_if(t).alias("n_human"), F.count_if(p).alias("n_pred"), F.count_if(t & p).alias("both"), *_counts(range(4), true, pred))
    precision, recall = _ratio(F.col("both"), F.col("n_pred")), _ratio(F.col("both"), F.col("n_human"))
    each = {x: (_ratio(F.col(f"mtp{x}"), F.col(f"mtp{x}") + F.col(f"mfp{x}")), _ratio(F.col(f"mtp{x}"), F.col(f"mtp{x}") + F.col(f"fn{x}"))) for x in (1, 2, 3)}
    mean = lambda cs: sum(cs, F.lit(0.0)) / len(cs)
    least = lambda c: F.when(F.col("n_human") >= 2, F.round(c, 6)).otherwise(F.lit(0.0) if single else F.lit(None))
    f1 = [_f1(_ratio(F.col(f"tp{x}"), F.col(f"tp{x}") + F.col(f"fp{x}")), _ratio(F.col(f"tp{x}"), F.col(f"tp{x}") + F.col(f"fn{x}"))) for x in range(4)]
    return d.select(
        *keys, "n_human", "n_pred", F.round(precision, 6).alias("detection_precision"), F.round(recall, 6).alias("detection_recall"), F.round(_f1(precision, recall), 6).alias("detection_f1"),
        least(mean([e[0] for e in each.values()])).alias("polarity_precision"), least(mean([e[1] for e in each.values()])).alias("polarity_recall"), least(mean([_f1(*e) for e in each.values()])).alias("polarity_f1"), F.round(mean(f1), 6).alias("combined_f1"),
    )


def macro_over_aspects(metrics: DataFrame) -> DataFrame:
    return metrics.agg(*(F.round(F.avg(c), 6).alias(f"macro_{c}") for c in ("detection_f1", "polarity_f1", "combined_f1")))


def comparison_table(metrics: DataFrame, aspects: list[str]) -> DataFrame:
    """metrics: model, aspect, detection_f1, polarity_f1; one wide row per model."""
    wide = metrics.groupBy("model").pivot("aspect", aspects).agg(F.round(F.max("detection_f1"), 6).alias("detection"), F.round(F.max("polarity_f1"), 6).alias("polarity"))
    return wide.join(metrics.groupBy("model").agg(F.round(F.avg("detection_f1"), 6).alias("macro_detection"), F.round(F.avg("polarity_f1"), 6).alias("macro_polarity")), "model")


def compare_models(metrics: DataFrame, first: str, second: str) -> DataFrame:
    """metrics: (model, metric, value); difference and improvement in percent of the first over the second."""
    wide = metrics.groupBy("metric").pivot("model", [first, second]).agg(F.first("value"))
    return wide.select("metric", F.col(first).alias("first"), F.col(second).alias("second"), F.round(F.col(first) - F.col(second), 6).alias("difference"), F.round(F.try_divide((F.col(first) - F.col(second)) * 100, F.col(second)), 6).alias("improvement"))


def winner_per_metric(metrics: DataFrame) -> DataFrame:
    """The model with the largest value, of equal ones the first by name."""
    best = metrics.groupBy("metric").agg(F.min(F.struct((-F.col("value")).alias("less"), "model")).alias("b"))
    return best.select("metric", F.col("b.model").alias("winner"), (-F.col("b.less")).alias("value"))


def _points(df: DataFrame, keys: tuple[str, ...], true: str, score: str) -> DataFrame:
    """(keys, score, p, n): counts by distinct score, which combine before any order is needed."""
    return df.groupBy(*keys, F.col(score).alias("score")).agg(F.sum(F.col(true).cast("long")).alias("p"), F.sum((1 - F.col(true)).cast("long")).alias("n"))


def _curve(df: DataFrame, keys: tuple[str, ...], true: str, score: str, ahead: dict[str, str] | None = None) -> DataFrame:
    """(keys, score, p, n, tps, fps, all_p, all_n): running sums from the largest score down, and their totals."""
    points = _points(df, keys, true, score)
    return running_sums(points, list(keys), [F.desc("score")], {"tps": "p", "fps": "n"}, totals={"all_p": "p", "all_n": "n"}, ahead=ahead, name="curve")


def roc_curve(df: DataFrame, *keys: str, true: str = "y_true", score: str = "y_score", corners: bool = False) -> DataFrame:
    """(keys, threshold, tps, fps, tpr, fpr) from the largest score down, with an infinite first threshold.

    Distinct scores are summed by ranges of the score, so a class may have any number of them. corners: without points between two others on a line, that is, only
    those behind which either count goes on by another step, and both ends.
    """
    curve = _curve(df, keys, true, score, {"next_p": "p", "next_n": "n"} if corners else None)
    start = curve.groupBy(*keys).agg(F.lit(float("inf")).alias("threshold"), F.lit(0).cast("long").alias("tps"), F.lit(0).cast("long").alias("fps"), F.first("all_p").alias("all_p"), F.first("all_n").alias("all_n"))
    if corners:
        curve = curve.where("next_p is null or next_p <> p or next_n <> n")
    both = curve.withColumnRenamed("score", "threshold").select(*keys, "threshold", "tps", "fps", "all_p", "all_n").union(start.select(*keys, "threshold", "tps", "fps", "all_p", "all_n"))
    return both.select(*keys, "threshold", "tps", "fps", _ratio(F.col("tps"), F.col("all_p")).alias("tpr"), _ratio(F.col("fps"), F.col("all_n")).alias("fpr"))


def roc_auc(df: DataFrame, *keys: str, true: str = "y_true", score: str = "y_score") -> DataFrame:
    """Area under the curve; null where only one outcome occurs."""
    part = F.col("n") / F.col("all_n") * (2 * F.col("tps") - F.col("p")) / F.col("all_p") / 2  # a trapezoid
    d = _curve(df, keys, true, score).groupBy(*keys).agg(F.sum(F.when((F.col("all_p") > 0) & (F.col("all_n") > 0), part)).alias("auc"), F.max("tps").alias("positives"), F.max("fps").alias("negatives"))
    return d.select(*keys, F.round("auc", 6).alias("auc"), "positives", "negatives")


def rank_auc(df: DataFrame, *keys: str, true: str = "y_true", score: str = "y_score") -> DataFrame:
    """The same area from ranks (average ranks for ties)."""
    both = F.col("p") + F.col("n")
    rank = F.col("all_p") + F.col("all_n") - F.col("tps") - F.col("fps") + both - (both - 1) / 2.0  # from the smallest score up
    d = _curve(df, keys, true, score).groupBy(*keys).agg(F.sum(rank * F.col("p")).alias("r"), F.sum("p").cast("double").alias("p"), F.sum("n").cast("double").alias("n"))
    return d.select(*keys, F.when((F.col("p") > 0) & (F.col("n") > 0), F.round((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / F.nullif(F.col("p") * F.col("n"), F.lit(0.0)), 6)).alias("auc"))


def average_precision(df: DataFrame, *keys: str, true: str = "y_true", score: str = "y_score") -> DataFrame:
    """Sum of precision times the step in recall, from the largest score down."""
    part = _ratio(F.col("p"), F.col("all_p")) * _ratio(F.col("tps"), F.col("tps") + F.col("fps"))
    return _curve(df, keys, true, score).groupBy(*keys).agg(F.round(F.sum(part), 6).alias("average_precision"))


def precision_recall_curve(df: DataFrame, *keys: str, true: str = "y_true", score: str = "y_score") -> DataFrame:
    curve = roc_curve(df, *keys, true=true, score=score).where(F.col("threshold") != float("inf"))
    return curve.select(*keys, "threshold", _ratio(F.col("tps"), F.col("tps") + F.col("fps")).alias("precision"), F.col("tpr").alias("recall"))
