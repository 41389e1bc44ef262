"""Filters, updates, aggregates, orders and trends over a table of reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.functions.text import derive_overall_sentiment, sanitize_search
from opinara.functions.vocab import POLARITIES
from opinara.operators import ranges


def list_reviews(df: DataFrame, *, user_id=None, product_name: str | None = None, sentiment: str | None = None, min_rating: int | None = None, max_rating: int | None = None, search: str | None = None) -> DataFrame:
    """All predicates given hold. Wildcards stay live in product_name; the search text is sanitised."""
    if user_id is not None:
        df = df.where(F.col("user_id") == user_id)
    if product_name:
        df = df.where(F.col("product_name").ilike(f"%{product_name}%"))
    if sentiment:
        df = df.where(F.col("sentiment_label") == sentiment)
    if min_rating is not None:
        df = df.where(F.col("rating") >= min_rating)
    if max_rating is not None:
        df = df.where(F.col("rating") <= max_rating)
    if search:
        df = df.where(F.ilike(F.col("review_text"), F.concat(F.lit("%"), sanitize_search(F.lit(search)), F.lit("%"))))
    return df


def get_review(df: DataFrame, review_id, user_id) -> DataFrame:
    return df.where((F.col("id") == review_id) & (F.col("user_id") == user_id)).limit(1)


def by_product(df: DataFrame, product: str, user_id=None) -> DataFrame:
    df = df.where(F.col("product_name") == product)
    return df if user_id is None else df.where(F.col("user_id") == user_id)


def absa_only(df: DataFrame) -> DataFrame:
    """Reviews with aspects by an aspect model; _ stands for any one character, as in SQL."""
    return df.where(F.col("aspects").isNotNull() & F.col("model_used").like("absa_%"))


def update_reviews(df: DataFrame, updates: DataFrame, now: Column, rescore=None) -> DataFrame:
    """Columns of `updates` that aren't null replace the review's; rows with a new text are scored anew by `rescore`."""
    changed = [c for c in updates.columns if c != "id"]
    new = updates.withColumnsRenamed({c: f"new_{c}" for c in changed}).withColumn("touched", F.lit(True))
    out = df.join(new, "id", "left")
    text = F.coalesce(F.col("new_review_text") != "", F.lit(False)) if "review_text" in changed else F.lit(False)
    out = out.withColumns({c: F.coalesce(f"new_{c}", c) for c in changed} | {"updated_at": F.when(F.col("touched"), now).otherwise(F.col("updated_at")), "rescore": text}).select(*df.columns, "rescore")
    if rescore is None:
        return out.drop("rescore")
    again = rescore(out.where("rescore").drop("rescore"))
    return out.where("not rescore").drop("rescore").unionByName(again)


def delete_product(df: DataFrame, user_id, product: str) -> tuple[DataFrame, DataFrame]:
    """What is left, and a row with the number deleted; nulls match nothing and stay."""
    hit = F.coalesce((F.col("user_id") == user_id) & (F.col("product_name") == product), F.lit(False))
    return df.where(~hit), df.agg(F.count_if(hit).alias("deleted"))


def delete_reviews(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Without the rows named by (id, user_id)."""
    return df.join(keys.select("id", "user_id"), ["id", "user_id"], "left_anti")


def _summary() -> dict[str, Column]:
    return {
        "total_reviews": F.count(F.lit(1)),
        "average_rating": F.round(F.coalesce(F.avg("rating"), F.lit(0.0)), 6),
        "average_score": F.round(F.coalesce(F.avg("sentiment_score"), F.lit(0.0)), 6),
        **{p: F.count_if(F.col("sentiment_label") == p) for p in POLARITIES},
        **{f"rating_{i}": F.count_if(F.col("rating") == i) for i in range(1, 6)},
        "first_date": F.min("review_date"),
        "last_date": F.max("review_date"),
    }


def product_analytics(df: DataFrame, product: str, user_id=None) -> DataFrame:
    """One row for a product, none if it has no reviews: one scan, one aggregate."""
    return product_analytics_all(by_product(df, product, user_id))


def product_analytics_all(df: DataFrame) -> DataFrame:
    return df.groupBy("product_name").agg(*(c.alias(n) for n, c in _summary().items()))


def sentiment_distribution(df: DataFrame, *keys: str) -> DataFrame:
    """Null and other labels count only in the total."""
    return df.groupBy(*keys).agg(*(F.count_if(F.col("sentiment_label") == p).alias(p) for p in POLARITIES), F.count(F.lit(1)).alias("total"))


def rating_distribution(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(*(F.count_if(F.col("rating") == i).alias(f"rating_{i}") for i in range(1, 6)), F.round(F.coalesce(F.avg("rating"), F.lit(0.0)), 6).alias("average_rating"), F.count(F.lit(1)).alias("total"))


def overall_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_reviews"), F.countDistinct("product_name").alias("n_products"), F.round(F.coalesce(F.avg("rating"), F.lit(0.0)), 6).alias("average_rating"), *(F.count_if(F.col("sentiment_label") == p).alias(p) for p in POLARITIES))


def top_products(df: DataFrame, by: str, k: int = 5) -> DataFrame:
    """by: average_rating or total; ties by name."""
    got = df.groupBy("product_name").agg(F.round(F.avg("rating"), 6).alias("average_rating"), F.count(F.lit(1)).alias("total"))
    return got.orderBy(F.desc(by), "product_name").limit(k)


def product_list(df: DataFrame, user_id, name: str | None = None) -> DataFrame:
    df = df.where(F.col("user_id") == user_id)
    if name:
        df = df.where(F.col("product_name").ilike(f"%{name}%"))
    return df.groupBy("product_name").agg(F.count(F.lit(1)).alias("total"), F.round(F.avg("rating"), 6).alias("average_rating"), F.max("created_at").alias("last_created"), *(F.count_if(F.col("sentiment_label") == p).alias(p) for p in POLARITIES))


def sort_products(products: DataFrame, by: str = "last_created", descending: bool = True) -> DataFrame:
    """by: product_name, average_rating, total or last_created, which anything else means, too; ties by name."""
    c = F.col(by if by in ("product_name", "average_rating", "total") else "last_created")
    return products.orderBy(c.desc_nulls_first() if descending else c.asc_nulls_last(), "product_name")


def _review_order(by: str, descending: bool) -> list[Column]:
    c = F.col(by if by in ("created_at", "rating", "sentiment_score", "review_date") else "created_at")
    return [c.desc_nulls_first() if descending else c.asc_nulls_last(), F.asc("id")]


def sort_reviews(df: DataFrame, by: str = "created_at", descending: bool = True) -> DataFrame:
    """Nulls first in descending order and last in ascending order; ties by id."""
    return df.orderBy(*_review_order(by, descending))


def page(df: DataFrame, skip: int, limit: int, by: str = "created_at", descending: bool = True) -> DataFrame:
    """A page of the reviews in the order of sort_reviews; page number skip // limit + 1.

    However far behind it lies, only the range of the order that holds the page is sorted.
    """
    return ranges.page(df, _review_order(by, descending), skip, limit).withColumn("page", F.lit(skip // limit + 1))


def top_reviews(df: DataFrame, k: int = 10, sentiment: str | None = None, min_rating: int | None = None) -> DataFrame:
    df = list_reviews(df, sentiment=sentiment, min_rating=min_rating)
    return df.orderBy(F.col("sentiment_score").desc_nulls_first(), F.desc("rating"), "id").limit(k)


def product_trend(df: DataFrame, product: str | None, now: Column, *, period: str = "day", days: int = 30) -> DataFrame:
    """Per period: reviews, average rating and score of those from `days` before `now` to now; empty periods have no row."""
    if product is not None:
        df = df.where(F.col("product_name") == product)
    day = F.col("review_date")
    df = df.where(day.between(now - F.make_interval(days=F.lit(days)), now))
    return df.groupBy("product_name", F.date_trunc(period, day).cast("date").alias("date")).agg(F.count(F.lit(1)).alias("total"), F.round(F.avg("rating"), 6).alias("average_rating"), F.round(F.avg("sentiment_score"), 6).alias("average_score")).orderBy("product_name", "date")


def aspect_counts(df: DataFrame, dimension: DataFrame, *keys: str) -> DataFrame:
    """For each aspect (and key): positive, negative, neutral, not_mentioned, total_reviews, mention_rate.

    A missing key or another value counts as not mentioned. Reviews are counted per map entry; nothing is multiplied
    by the number of aspects but the keys.
    """
    df = absa_only(df).select(*keys, "aspects")
    said = df.select(*keys, F.explode("aspects").alias("aspect", "polarity")).where(F.col("polarity").isin(POLARITIES))
    counts = said.groupBy(*keys, "aspect").agg(*(F.count_if(F.col("polarity") == p).alias(p) for p in POLARITIES))
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_reviews"))
    grid = totals.crossJoin(F.broadcast(dimension))  # the ten aspects
    out = grid.join(counts, [*keys, "aspect"], "left").fillna(0, POLARITIES)
    mentioned = F.col("positive") + F.col("negative") + F.col("neutral")
    return out.select(*keys, "aspect", "ord", *POLARITIES, (F.col("total_reviews") - mentioned).alias("not_mentioned"), "total_reviews", F.round(F.coalesce(F.try_divide(mentioned, "total_reviews"), F.lit(0.0)), 4).alias("mention_rate"))


def order_aspects(counts: DataFrame) -> DataFrame:
    return counts.orderBy(F.desc(F.col("total_reviews") - F.col("not_mentioned")), "ord")


def top_aspects(counts: DataFrame, k: int = 5) -> DataFrame:
    """Mentioned aspects by mentions, with the dominant polarity; neutral takes no part."""
    mentions = F.col("total_reviews") - F.col("not_mentioned")
    got = counts.where(mentions > 0).select("aspect", mentions.alias("mentions"), F.when(F.col("positive") >= F.col("negative"), "positive").otherwise("negative").alias("dominant"), "ord")
    return got.orderBy(F.desc("mentions"), "ord").limit(k).drop("ord")


def overall_sentiment(df: DataFrame) -> DataFrame:
    return df.withColumn("overall", derive_overall_sentiment(F.col("aspects")))


def platform_metrics(df: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row: users, reviews and jobs. As no table holds users and their flags, a user is one who wrote a review, and
    active with a review in the last day before the table's newest."""
    last = df.agg(F.max("created_at").alias("last"))
    users = df.groupBy("user_id").agg(F.max("created_at").alias("seen")).crossJoin(F.broadcast(last)).agg(F.count(F.lit(1)).alias("users"), F.count_if(F.col("seen") > F.col("last") - F.expr("INTERVAL 1 DAY")).alias("active_users"))
    jobs = jobs.agg(F.countDistinct("job_id").alias("jobs"), *(F.count_if(F.col("status") == s).alias(f"jobs_{s}") for s in ("pending", "in_progress", "completed", "failed", "cancelled")))
    one = df.agg(F.count(F.lit(1)).alias("reviews"), F.round(F.avg("rating"), 6).alias("average_rating"), F.round(F.avg("sentiment_score"), 6).alias("average_score"), *(F.count_if(F.col("sentiment_label") == p).alias(p) for p in POLARITIES))
    return one.crossJoin(users).crossJoin(jobs)  # three single rows


def positive_rate(positive: Column, total: Column) -> Column:
    """Whole percent, halves up; 0 without reviews."""
    return F.when(total > 0, F.floor(100.0 * positive / F.nullif(total, F.lit(0)) + 0.5)).otherwise(F.lit(0)).cast("long")


def health_label(rate: Column) -> Column:
    return F.when(rate >= 80, "Excellent").when(rate >= 60, "Good").when(rate >= 40, "Fair").otherwise("Poor")


def null_profile(df: DataFrame) -> DataFrame:
    """(column, nulls) of every column, in one scan."""
    counts = df.select(*(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
    return counts.select(F.explode(F.map_from_arrays(F.array(*(F.lit(c) for c in df.columns)), F.array(*(F.col(c) for c in df.columns)))).alias("column", "nulls"))


def sample_per_class(df: DataFrame, keys: list[str], n: Column | int, id_col: str = "id", seed: str = "42") -> DataFrame:
    """The first n rows of each class in the order of a seeded hash."""
    w = Window.partitionBy(*keys).orderBy(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(seed))), id_col)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def expand_aspects(df: DataFrame, dimension: DataFrame) -> DataFrame:
    """A row for each review and aspect, the polarity none where the map has no such key."""
    return df.crossJoin(F.broadcast(dimension)).withColumn("polarity", F.coalesce(F.try_element_at("aspects", F.col("aspect")), F.lit("none")))  # the ten aspects
