"""Group fairness: rates, differences, verdicts, weights and thresholds per protected group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.operators.evaluation import roc_curve


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def encode_protected(df: DataFrame, column: str, mapping: dict, into: str = "protected_attr") -> DataFrame:
    """The mapping says which value is 0 and which 1; others are null."""
    return df.withColumn(into, F.try_element_at(F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv)), F.col(column)))


def group_rates(df: DataFrame, *keys: str, attr: str = "protected_attr", true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    t, p = F.col(true) == 1, F.col(pred) == 1
    d = df.groupBy(*keys, attr).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(~t & ~p).alias("tn"), F.count_if(t & ~p).alias("fn"), F.count(F.lit(1)).alias("n"))
    tp, fp, tn, fn, n = (F.col(c) for c in ("tp", "fp", "tn", "fn", "n"))
    return d.select(*keys, attr, "tp", "fp", "tn", "fn", "n", _ratio(tp, tp + fn).alias("tpr"), _ratio(fp, fp + tn).alias("fpr"), _ratio(tn, fp + tn).alias("tnr"), _ratio(fn, tp + fn).alias("fnr"), _ratio(tp + fp, n).alias("positive_rate"), _ratio(tp + tn, n).alias("accuracy"))


def fairness_metrics(df: DataFrame, *keys: str, attr: str = "protected_attr", true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """spd, eod, aod, di of group 0 against group 1 in one pass; an absent group's rates are 0."""
    rates = group_rates(df, *keys, attr=attr, true=true, pred=pred)
    of = lambda c, g: F.coalesce(F.max(F.when(F.col(attr) == g, F.col(c))), F.lit(0.0))
    d = rates.groupBy(*keys).agg(*(of(c, g).alias(f"{c}{g}") for c in ("positive_rate", "tpr", "fpr") for g in (0, 1)))
    pr0, pr1 = F.col("positive_rate0"), F.col("positive_rate1")
    tpr, fpr = F.col("tpr0") - F.col("tpr1"), F.col("fpr0") - F.col("fpr1")
    di = F.when(pr1 == 0, F.when(pr0 > 0, F.lit(float("inf"))).otherwise(1.0)).otherwise(F.try_divide(pr0, pr1))
    return d.select(*keys, F.round(pr0 - pr1, 6).alias("spd"), F.round(tpr, 6).alias("eod"), F.round((fpr + tpr) / 2, 6).alias("aod"), F.round(di, 6).alias("di"))


def verdicts(metrics: DataFrame) -> DataFrame:
    return metrics.withColumns({**{f"{c}_fair": F.abs(F.col(c)) < 0.1 for c in ("spd", "eod", "aod")}, "di_pass": F.col("di").between(0.8, 1.25)})


def reduction(before: Column, after: Column, goal: float = 0.0) -> Column:
    """Percent by which the distance to the goal became smaller; 0 if there was none."""
    was, now = F.abs(before - goal), F.abs(after - goal)
    return F.round(F.coalesce(F.try_divide((was - now) * 100, F.nullif(was, F.lit(0.0))), F.lit(0.0)), 6)


def compare_fairness(before: DataFrame, after: DataFrame) -> DataFrame:
    b = before.select(*(F.col(c).alias(f"{c}_before") for c in ("spd", "eod", "aod", "di")))
    a = after.select(*(F.col(c).alias(f"{c}_after") for c in ("spd", "eod", "aod", "di")))
    d = b.crossJoin(a)  # two single rows
    return d.withColumns({f"{c}_reduction": reduction(F.col(f"{c}_before"), F.col(f"{c}_after"), 1.0 if c == "di" else 0.0) for c in ("spd", "eod", "aod", "di")})


def fair_weights(df: DataFrame, label: str, attr: str) -> DataFrame:
    """n / (k n_g) for the groups g of label and attribute, divided by the rows' mean weight."""
    groups = df.groupBy(label, attr).agg(F.count(F.lit(1)).alias("n_g"))
    # the mean weight over all rows is sum(n_g * n / (k n_g)) / n = 1, whatever the groups are
    total = groups.agg(F.sum("n_g").alias("n"), F.count(F.lit(1)).alias("k"))
    weights = groups.crossJoin(F.broadcast(total)).select(label, attr, (F.col("n") / (F.col("k") * F.col("n_g"))).alias("weight"))  # a row per group
    return df.join(F.broadcast(weights), [label, attr])


def penalised_weights(df: DataFrame, strength: float, attr: str) -> DataFrame:
    return df.withColumn("weight", F.pow("weight", F.lit(1 + strength))).drop(attr)


def calibrate_thresholds(df: DataFrame, mode: str = "equal_opportunity", *, attr: str = "protected_attr", true: str = "y_true", score: str = "y_score", drop: bool = True) -> DataFrame:
    """(attr, threshold): of each group's ROC points the one nearest to the overall rates at 0.5; the highest of equal ones.

    equal_opportunity looks at the true positive rate, equalized_odds at both. A group without positives gets 0.5.
    """
    hit = F.col(score) >= 0.5
    goal = df.agg(_ratio(F.count_if(hit & (F.col(true) == 1)), F.count_if(F.col(true) == 1)).alias("goal_tpr"), _ratio(F.count_if(hit & (F.col(true) == 0)), F.count_if(F.col(true) == 0)).alias("goal_fpr"))
    curve = roc_curve(df, attr, true=true, score=score, corners=drop)
    positives = curve.groupBy(attr).agg(F.max("tps").alias("positives"))
    curve = curve.crossJoin(F.broadcast(goal)).join(positives, attr)  # one row
    by_tpr, by_fpr = F.col("tpr") - F.col("goal_tpr"), F.col("fpr") - F.col("goal_fpr")
    distance = F.abs(by_tpr) if mode == "equal_opportunity" else F.sqrt(by_tpr * by_tpr + by_fpr * by_fpr)
    best = curve.groupBy(attr).agg(F.min(F.struct(F.round(distance, 12).alias("d"), (-F.col("threshold")).alias("t"))).alias("b"), F.max("positives").alias("positives"))
    return best.select(attr, F.when(F.col("positives") > 0, -F.col("b.t")).otherwise(0.5).alias("threshold"))


def apply_thresholds(df: DataFrame, thresholds: DataFrame, attr: str = "protected_attr", score: str = "y_score") -> DataFrame:
    """y_fair: 1 at or over the group's threshold; a group without one: 0."""
    return df.join(F.broadcast(thresholds), attr, "left").withColumn("y_fair", F.coalesce((F.col(score) >= F.col("threshold")).cast("int"), F.lit(0)))  # a row per group


def quality_of(df: DataFrame, *keys: str, true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    t, p = F.col(true) == 1, F.col(pred) == 1
    d = df.groupBy(*keys).agg(F.count_if(t == p).alias("ok"), F.count(F.lit(1)).alias("n"), F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    return d.select(*keys, F.round(_ratio(F.col("ok"), F.col("n")), 6).alias("accuracy"), F.round(_ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6).alias("f1"))


def mitigation_table(df: DataFrame, base: str, method: str = "method") -> DataFrame:
    """Per method accuracy, f1 and the four metrics, and against `base`: EOD reduction, accuracy change, the 80 % rule."""
    d = quality_of(df, method).join(fairness_metrics(df, method), method)
    first = d.where(F.col(method) == base).select(F.col("eod").alias("base_eod"), F.col("accuracy").alias("base_accuracy"))
    d = d.crossJoin(F.broadcast(first))  # one row
    return d.select(method, "accuracy", "f1", "spd", "eod", "aod", "di", reduction(F.col("base_eod"), F.col("eod")).alias("eod_reduction"), F.round(F.col("accuracy") - F.col("base_accuracy"), 6).alias("accuracy_change"), (F.col("di") >= 0.8).alias("four_fifths"))


def group_balance(df: DataFrame, attr: str, label: str) -> DataFrame:
    d = df.groupBy(attr, label).agg(F.count(F.lit(1)).alias("n"))
    return d.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(attr)), 6))  # a row per label
