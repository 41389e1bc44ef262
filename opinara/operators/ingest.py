"""From raw reviews to stored ones: labels, keyword filters, validation, content hashes, deduplication."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.functions.text import content_hash, sanitize_html
from opinara.functions.vocab import DOMAINS, MARKUP_PATTERNS, NON_TECHNICAL, SQL_PATTERNS, URL_PATTERN
from opinara.operators import hash_log


def label_corpus(train: DataFrame, test: DataFrame) -> DataFrame:
    """Both splits with id (index_split), split and polarity_binary (two stars or fewer are negative)."""
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    return both.withColumns({"id": F.concat_ws("_", F.col("index").cast("string"), "split"), "polarity_binary": star_to_sentiment(F.col("starRating"), "text")})


def star_to_sentiment(stars: Column, rule: str) -> Column:
    """strict: 1-2 negative, 4-5 positive, anything else an error; text: 1-2 negative, else positive; number: 1-2 is 0, else 1."""
    if rule == "strict":
        return F.when(stars.isin(1, 2), "negative").when(stars.isin(4, 5), "positive").otherwise(F.raise_error(F.concat(F.lit("unexpected stars: "), F.coalesce(stars.cast("string"), F.lit("null")))))
    return F.when(stars.isin(1, 2), "negative").otherwise("positive") if rule == "text" else F.when(stars.isin(1, 2), 0).otherwise(1)


def _holds_any(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def _lower_text(title: Column, content: Column) -> Column:
    return F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(content, F.lit(""))))


def exclude_nontech(df: DataFrame, more: list[str] | None = None) -> DataFrame:
    """Without reviews that hold a word of other than technical products."""
    return df.where(~_holds_any(_lower_text(F.col("title"), F.col("content")), [*NON_TECHNICAL, *(more or [])]))


def assign_domain(title: Column, content: Column) -> Column:
    text, out = _lower_text(title, content), None
    for domain, words in DOMAINS.items():
        out = F.when(_holds_any(text, words), domain) if out is None else out.when(_holds_any(text, words), domain)
    return out.otherwise("other")


def _any_pattern(c: Column, patterns: list[str]) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | F.coalesce(c.rlike(f"(?i){p}"), F.lit(False))
    return found


def validate_reviews(df: DataFrame) -> DataFrame:
    """reject_reason: the first rule that the row breaks, or null. Rows that are fine have product and text sanitised."""
    product, text, title, rating = (F.col(c) for c in ("product_name", "review_text", "review_title", "rating"))
    size = lambda c: F.char_length(F.coalesce(c, F.lit("")))
    both = lambda ps: _any_pattern(product, ps) | _any_pattern(text, ps)
    reason = (
        F.when(~size(product).between(2, 500), "product_length").when(~size(text).between(10, 5000), "text_length").when(size(title) > 500, "title_length")
        .when(~F.coalesce(rating.between(1, 5), F.lit(False)), "rating").when(both(MARKUP_PATTERNS), "markup").when(both(SQL_PATTERNS), "sql")
    )
    out = df.withColumn("reject_reason", reason)
    fine = F.col("reject_reason").isNull()
    return out.withColumns({c: F.when(fine, sanitize_html(F.col(c))).otherwise(F.col(c)) for c in ("product_name", "review_text")})


def valid_url(url: Column, allowed: list[str] | None = None, strict_host: bool = False) -> Column:
    """An http(s) URL whose text holds an allowed domain; with strict_host its host has to be, or end in, one."""
    ok = F.coalesce(url.rlike(f"(?i){URL_PATTERN}"), F.lit(False))
    if not allowed:
        return ok
    if not strict_host:
        return ok & _holds_any(F.lower(url), allowed)
    host = F.lower(F.regexp_extract(url, r"^https?://([^/:?#]+)", 1))
    inside = F.lit(False)
    for d in allowed:
        inside = inside | (host == d) | host.endswith(f".{d}")
    return ok & inside


def with_hash(df: DataFrame) -> DataFrame:
    return df.withColumn("content_hash", content_hash(F.col("product_name"), F.col("review_text"), F.col("review_date")))


def new_reviews(batch: DataFrame, stored: DataFrame, order: str) -> DataFrame:
    """The first row, by `order`, of each hash that isn't stored.

    Which row is first is decided on hashes alone, with minima that combine before the shuffle; texts are joined to it.
    """
    fresh = batch.join(stored.select("content_hash").distinct(), "content_hash", "left_anti")
    first = fresh.groupBy("content_hash").agg(F.min(order).alias(order))
    return fresh.join(first, ["content_hash", order], "left_semi")


def ingest_reviews(batch: DataFrame, store: str, *, order: str, score: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, int]:
    """Hashes a batch, drops what the store (a Parquet folder) has or the batch repeats, scores the rest and appends it.

    Duplicates count over all users. Running a batch again stores nothing. What the store has is looked up in its log of hashes (see
    hash_log), so what is read for a batch grows with the batch and not with the store.
    """
    spark = batch.sparkSession
    hash_log.recover(spark, store)
    hashed = with_hash(batch).persist()  # hashed once
    fresh = None
    try:
        scraped = hashed.count()
        known = hash_log.found(hashed.select("content_hash").distinct(), store)
        fresh = new_reviews(hashed, known, order)
        fresh = (score(fresh) if score else fresh).persist()
        created = fresh.count()
        if created:
            run = hash_log.prepare(spark, store, fresh.select("content_hash"), created)
            fresh.write.mode("append").parquet(store)
            hash_log.commit(spark, store, run)
    finally:
        hashed.unpersist()
        if fresh is not None:
            fresh.unpersist()
    return {"scraped": scraped, "created": created, "duplicates": scraped - created}


def first_rows(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The first n rows of each key (n literal: Spark cuts each partition to n before it shuffles)."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).drop("place")
