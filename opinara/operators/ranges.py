"""Order over whole groups without a group in one task: rows are cut into ranges of the order, and ranges are added up.

A table of ranges is written once, as it has to be the same for the sums of the ranges and for their rows. What is gathered
of a group is a row for each of its ranges, of which there are as many as the shuffle has partitions at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.sources.files import once


def ranged(df: DataFrame, keys: list[str], by: list[Column], name: str) -> DataFrame:
    """The rows with `range_at`, which ascends in the order of keys and `by`; its upper bits number the ranges."""
    order = [*(F.col(k) for k in keys), *by]
    return once(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range_at", F.monotonically_increasing_id()), name)


def part(at: str = "range_at") -> Column:
    return F.shiftright(at, 33)


def running_sums(df: DataFrame, keys: list[str], by: list[Column], sums: dict[str, str], *, totals: dict[str, str] | None = None, ahead: dict[str, str] | None = None, name: str = "running") -> DataFrame:
    """The rows with running sums within the keys in the order of `by`, which has to tell all rows of a key apart.

    `sums` and `totals` name new columns and the columns that are summed, up to the row and over the key; `ahead` takes a column's value in the
    next row of the key, null in its last. A window holds one range's rows of a key. Null keys are a group.
    """
    totals, ahead = totals or {}, ahead or {}
    df = df.withColumns({f"range_key_{i}": F.struct(k) for i, k in enumerate(keys)})  # a struct is not null where its field is
    own = [f"range_key_{i}" for i in range(len(keys))]
    rows = ranged(df, own, by, name).withColumn("range_part", part())
    ranges = rows.groupBy(*own, "range_part").agg(*(F.sum(c).alias(f"range_sum_{n}") for n, c in (sums | totals).items()), *(F.min_by(c, "range_at").alias(f"range_next_{n}") for n, c in ahead.items()))
    whole = Window.partitionBy(*own)
    line = whole.orderBy("range_part")  # a row for each range
    before = {f"range_before_{n}": F.coalesce(F.sum(f"range_sum_{n}").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for n in sums}
    ranges = ranges.select(*own, "range_part", *(c.alias(n) for n, c in before.items()), *(F.sum(f"range_sum_{n}").over(whole).alias(f"range_all_{n}") for n in totals), *(F.lead(f"range_next_{n}").over(line).alias(f"range_next_{n}") for n in ahead))
    local = Window.partitionBy(*own, "range_part").orderBy("range_at")
    rows = rows.withColumns({**{f"range_local_{n}": F.sum(c).over(local) for n, c in sums.items()}, **{f"range_local_{n}": F.lead(c).over(local) for n, c in ahead.items()}, "range_last": F.lead("range_part").over(local).isNull()})
    joined = rows.join(ranges, [*own, "range_part"])
    new = {**{n: F.col(f"range_local_{n}") + F.col(f"range_before_{n}") for n in sums}, **{n: F.col(f"range_all_{n}") for n in totals}, **{n: F.when(F.col("range_last"), F.col(f"range_next_{n}")).otherwise(F.col(f"range_local_{n}")) for n in ahead}}
    return joined.select(*(c for c in df.columns if c not in own), *(c.alias(n) for n, c in new.items()))


def page(df: DataFrame, order: list[Column], skip: int, limit: int, name: str = "pages") -> DataFrame:
    """Rows `skip` to `skip + limit` in the order, which has to be total, sorted.

    Rows are dealt to ranges, which are counted and not sorted; only the ranges that the page lies in are read again and put in
    order. The driver learns a number for each range.
    """
    columns = df.columns
    rows = once(df.repartitionByRange(*order).withColumn("range_part", F.spark_partition_id()), name)
    counts = sorted((r.range_part, r.n) for r in rows.groupBy("range_part").agg(F.count(F.lit(1)).alias("n")).collect())
    before, first, parts = 0, 0, []
    for number, n in counts:
        if before + n > skip and before < skip + limit:
            first = before if not parts else first
            parts.append(number)
        before += n
    some = rows.where(F.col("range_part").between(parts[0], parts[-1])) if parts else rows.limit(0)
    return some.orderBy(*order).offset(max(0, skip - first)).limit(limit).select(*columns)
