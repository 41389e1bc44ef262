"""Exact seeded samples of classes, without any class in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def quota_sample(df: DataFrame, keys: list[str], quotas: DataFrame, *, id_col: str = "id", seed: str = "42") -> DataFrame:
    """Of each class the first `quota` rows in the order of a seeded hash of the id; quotas: (*keys, quota).

    Rows are cut into 4096 stretches of the hash. Counts by class and stretch tell which stretches are taken whole; only the
    one in which the quota runs out is put in order.
    """
    order = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(seed)))
    hashed = df.withColumns({"sample_order": order, "stretch": F.substring(order, 1, 3)})
    counts = hashed.groupBy(*keys, "stretch").agg(F.count(F.lit(1)).alias("n"))
    before = (F.sum("n").over(Window.partitionBy(*keys).orderBy("stretch")) - F.col("n")).alias("before")  # 4096 rows a class at most
    room = counts.select(*keys, "stretch", "n", before).join(quotas, keys).select(*keys, "stretch", (F.col("before") + F.col("n") <= F.col("quota")).alias("whole"), (F.col("quota") - F.col("before")).alias("room")).where("room > 0")
    out = hashed.join(room, [*keys, "stretch"])
    whole = out.where("whole").select(*df.columns)
    w = Window.partitionBy(*keys, "stretch").orderBy("sample_order", id_col)
    cut = out.where("not whole").withColumn("place", F.row_number().over(w)).where("place <= room").select(*df.columns)
    return whole.unionByName(cut)


def balanced_quotas(df: DataFrame, domain: str | None, label: str, target: int) -> DataFrame:
    """For each domain (or for all) and label the same number: half the target, or the smaller class."""
    keys = [domain] if domain else []
    sizes = df.groupBy(*keys).agg(*(F.count_if(F.col(label) == x).alias(x) for x in ("negative", "positive")))
    each = F.least(F.lit(target // 2).cast("long"), F.col("negative"), F.col("positive")).alias("quota")
    return sizes.select(*keys, F.explode(F.array(F.lit("negative"), F.lit("positive"))).alias(label), each)


def share_quotas(df: DataFrame, label: str, percent: int) -> DataFrame:
    """percent of each class, rounded down."""
    return df.groupBy(label).agg((F.floor(F.count(F.lit(1)) * percent / 100)).cast("long").alias("quota"))
