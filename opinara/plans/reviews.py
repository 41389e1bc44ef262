"""Queries over reviews: filters, aggregates, orders, trends, aspects."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinara.operators import reviews as R
from opinara.plans.catalog import Catalog
from opinara.sources import adapters as A

C = Catalog()
NOW = "TIMESTAMP '2024-01-31 00:00:00'"
RV, RA = f"WITH {A.REVIEWS}", f"WITH {A.REVIEW_ASPECTS}"
COUNTS = "count(*) FILTER (WHERE sentiment_label = 'positive') AS positive, count(*) FILTER (WHERE sentiment_label = 'negative') AS negative, count(*) FILTER (WHERE sentiment_label = 'neutral') AS neutral"
STARS = ", ".join(f"count(*) FILTER (WHERE rating = {i}) AS rating_{i}" for i in range(1, 6))
SUMMARY = f"count(*) AS total_reviews, round(coalesce(avg(rating), 0), 6) AS average_rating, round(coalesce(avg(sentiment_score), 0), 6) AS average_score, {COUNTS}, {STARS}, min(review_date) AS first_date, max(review_date) AS last_date"


def _now():
    return F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'")


def rv(spark, sf):
    return A.reviews(spark, sf)


def with_text(spark, sf):
    """Reviews whose text is their product, label and model, for predicates on text."""
    return rv(spark, sf).withColumn("review_text", F.concat_ws(" ", "product_name", "sentiment_label", "model_used"))


TEXT = f"{RV}, texts AS (SELECT *, concat_ws(' ', product_name, sentiment_label, model_used) AS review_text FROM reviews)"


@C.query("flt1_list_reviews", f"{TEXT} SELECT id, product_name, rating, sentiment_label FROM texts WHERE product_name ILIKE '%PRODUCT_1%' AND sentiment_label = 'positive' AND rating >= 2 AND rating <= 4 AND review_text ILIKE '%positive abs%'")
def _(spark, sf):
    return R.list_reviews(with_text(spark, sf), product_name="PRODUCT_1", sentiment="positive", min_rating=2, max_rating=4, search="  positive  ab%s_").select("id", "product_name", "rating", "sentiment_label")


@C.query("flt2_get_review", f"{RV} SELECT id, user_id, product_name, rating FROM reviews WHERE id = 1234 AND user_id = (SELECT user_id FROM reviews WHERE id = 1234)")
def _(spark, sf):
    df = rv(spark, sf)
    owner = df.where("id = 1234").select("user_id")
    return df.join(owner, "user_id", "left_semi").where("id = 1234").limit(1).select("id", "user_id", "product_name", "rating")


@C.query("flt3_by_product", f"{RV} SELECT id, user_id, rating FROM reviews WHERE product_name = 'product-7'")
def _(spark, sf):
    return R.by_product(rv(spark, sf), "product-7").select("id", "user_id", "rating")


@C.query("flt4_absa_only", f"{RV} SELECT id, model_used FROM reviews WHERE model_used LIKE 'absa_%'")
def _(spark, sf):
    return R.absa_only(A.reviews_with_aspects(spark, sf)).select("id", "model_used")


@C.query("flt8_update_reviews", f"{TEXT} SELECT id, CASE WHEN id % 10 = 3 THEN 5 ELSE rating END AS rating, CASE WHEN id % 20 = 3 THEN 'new text ' || id ELSE review_text END AS review_text, CASE WHEN id % 10 = 3 THEN {NOW} ELSE created_at END AS updated_at, CASE WHEN id % 20 = 3 THEN 'rescored' ELSE model_used END AS model_used FROM texts")
def _(spark, sf):
    df = with_text(spark, sf).withColumn("updated_at", F.col("created_at")).select("id", "rating", "review_text", "updated_at", "model_used")
    updates = df.where("id % 10 = 3").select("id", F.lit(5).alias("rating"), F.when(F.col("id") % 20 == 3, F.concat(F.lit("new text "), "id")).alias("review_text"))
    return R.update_reviews(df, updates, _now(), lambda d: d.withColumn("model_used", F.lit("rescored")))


@C.query("flt9_delete_product", f"{RV} SELECT id, user_id, product_name FROM reviews WHERE NOT coalesce(user_id = 42 AND product_name = 'product-5', false)")
def _(spark, sf):
    return R.delete_product(rv(spark, sf), 42, "product-5")[0].select("id", "user_id", "product_name")


@C.query("flt10_delete_review", f"{RV} SELECT id, user_id FROM reviews WHERE id % 100 <> 7")
def _(spark, sf):
    df = rv(spark, sf)
    return R.delete_reviews(df, df.where("id % 100 = 7")).select("id", "user_id")


@C.query("flt11_list_jobs", f"WITH {A.JOB_UPDATES} SELECT event_id, job_id, status FROM job_updates WHERE status = 'failed'")
def _(spark, sf):
    return A.job_updates(spark, sf).where("status = 'failed'").select("event_id", "job_id", "status")


@C.query("flt15_null_profile", RV + " ".join(f"{'UNION ALL' if i else ''} SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM reviews" for i, c in enumerate(("id", "user_id", "product_name", "rating", "review_date", "sentiment_label", "sentiment_score", "model_used", "created_at"))))
def _(spark, sf):
    return R.null_profile(rv(spark, sf))


@C.query("agg1_product_analytics", f"{RV} SELECT product_name, {SUMMARY} FROM reviews WHERE product_name = 'product-7' GROUP BY product_name")
def _(spark, sf):
    return R.product_analytics(rv(spark, sf), "product-7")


@C.query("agg2_product_analytics_all", f"{RV} SELECT product_name, {SUMMARY} FROM reviews GROUP BY product_name")
def _(spark, sf):
    return R.product_analytics_all(rv(spark, sf))


@C.query("agg3_sentiment_distribution", f"{RV} SELECT product_name, {COUNTS}, count(*) AS total FROM reviews GROUP BY product_name")
def _(spark, sf):
    return R.sentiment_distribution(rv(spark, sf), "product_name")


@C.query("agg4_rating_distribution", f"{RV} SELECT product_name, {STARS}, round(avg(rating), 6) AS average_rating, count(*) AS total FROM reviews GROUP BY product_name")
def _(spark, sf):
    return R.rating_distribution(rv(spark, sf), "product_name")


@C.query("agg5_overall_summary", f"{RV} SELECT count(*) AS total_reviews, count(DISTINCT product_name) AS n_products, round(avg(rating), 6) AS average_rating, {COUNTS} FROM reviews")
def _(spark, sf):
    return R.overall_summary(rv(spark, sf))


@C.query("agg6_product_list", f"{RV} SELECT product_name, count(*) AS total, round(avg(rating), 6) AS average_rating, max(created_at) AS last_created, {COUNTS} FROM reviews WHERE user_id = 42 AND product_name ILIKE '%duct-_%' GROUP BY product_name")
def _(spark, sf):
    return R.product_list(rv(spark, sf), 42, "duct-_")


ASPECT_SQL = """SELECT {keys} a.aspect, a.ord, coalesce(positive, 0) AS positive, coalesce(negative, 0) AS negative, coalesce(neutral, 0) AS neutral,
  total_reviews - coalesce(positive, 0) - coalesce(negative, 0) - coalesce(neutral, 0) AS not_mentioned, total_reviews,
  round((coalesce(positive, 0) + coalesce(negative, 0) + coalesce(neutral, 0)) / total_reviews, 4) AS mention_rate
FROM aspects a CROSS JOIN (SELECT {keys} count(*) AS total_reviews FROM reviews WHERE model_used LIKE 'absa_%' {group}) t
LEFT JOIN (SELECT {keys} aspect, count(*) FILTER (WHERE polarity = 'positive') AS positive, count(*) FILTER (WHERE polarity = 'negative') AS negative, count(*) FILTER (WHERE polarity = 'neutral') AS neutral
  FROM review_aspects GROUP BY {keys} aspect) c USING ({keys} aspect)"""
ASPECTS_ALL = ASPECT_SQL.format(keys="", group="")


@C.query("agg7_aspect_analytics", f"{RA} {ASPECTS_ALL}")
def _(spark, sf):
    return R.order_aspects(R.aspect_counts(A.reviews_with_aspects(spark, sf), A.aspects(spark)))


@C.query("agg8_aspect_analytics_by_product", f"{RA} {ASPECT_SQL.format(keys='product_name,', group='GROUP BY product_name')}".replace("SELECT product_name, a.aspect", "SELECT t.product_name, a.aspect").replace("USING (product_name, aspect)", "ON c.product_name = t.product_name AND c.aspect = a.aspect"))
def _(spark, sf):
    return R.aspect_counts(A.reviews_with_aspects(spark, sf), A.aspects(spark), "product_name")


@C.query("agg9_derive_overall_sentiment", f"""{RA}, said AS (SELECT id, count(*) FILTER (WHERE polarity = 'positive') AS p, count(*) FILTER (WHERE polarity = 'negative') AS n, count(*) FILTER (WHERE polarity = 'neutral') AS u FROM review_aspects GROUP BY id)
SELECT r.id, CASE WHEN coalesce(p + n + u, 0) = 0 THEN 'neutral' WHEN n >= p AND n >= u THEN 'negative' WHEN p >= u THEN 'positive' ELSE 'neutral' END AS label,
  CASE WHEN coalesce(p + n + u, 0) = 0 THEN 0.0::DOUBLE ELSE greatest(p, n, u) / (p + n + u)::DOUBLE END AS score
FROM reviews r LEFT JOIN said s ON r.id = s.id WHERE model_used LIKE 'absa_%'""".replace("THEN 0.0::DOUBLE ELSE greatest(p, n, u) / (p + n + u)::DOUBLE END", "THEN 0.0::DOUBLE ELSE round_even(greatest(p, n, u) / (p + n + u)::DOUBLE, 4) END"))
def _(spark, sf):
    df = R.overall_sentiment(R.absa_only(A.reviews_with_aspects(spark, sf)))
    return df.select("id", "overall.label", "overall.score")


@C.query("agg10_platform_metrics", f"""{RV}, {A.JOB_UPDATES},
u AS (SELECT count(*) AS users, count(*) FILTER (WHERE seen > (SELECT max(created_at) FROM reviews) - INTERVAL 1 DAY) AS active_users FROM (SELECT user_id, max(created_at) AS seen FROM reviews GROUP BY user_id)),
j AS (SELECT count(DISTINCT job_id) AS jobs, {', '.join(f"count(*) FILTER (WHERE status = '{s}') AS jobs_{s}" for s in ('pending', 'in_progress', 'completed', 'failed', 'cancelled'))} FROM job_updates)
SELECT * FROM (SELECT count(*) AS reviews, round(avg(rating), 6) AS average_rating, round(avg(sentiment_score), 6) AS average_score, {COUNTS} FROM reviews), u, j""")
def _(spark, sf):
    return R.platform_metrics(rv(spark, sf), A.job_updates(spark, sf))


@C.query("agg11_count_before_paging", f"{RV} SELECT count(*) AS total FROM reviews WHERE rating >= 4 AND sentiment_label = 'positive'")
def _(spark, sf):
    return R.list_reviews(rv(spark, sf), min_rating=4, sentiment="positive").agg(F.count(F.lit(1)).alias("total"))


@C.query("agg21_health", f"""{RV}, rates AS (SELECT product_name, count(*) AS total, CAST(floor(100.0::DOUBLE * count(*) FILTER (WHERE sentiment_label = 'positive') / count(*) + 0.5) AS BIGINT) AS positive_rate,
  CAST(floor(100.0::DOUBLE * count(*) FILTER (WHERE sentiment_label = 'negative') / count(*) + 0.5) AS BIGINT) AS negative_rate FROM reviews GROUP BY product_name)
SELECT *, 100 - positive_rate AS card_negative_rate, CASE WHEN positive_rate >= 80 THEN 'Excellent' WHEN positive_rate >= 60 THEN 'Good' WHEN positive_rate >= 40 THEN 'Fair' ELSE 'Poor' END AS health FROM rates""")
def _(spark, sf):
    d = R.sentiment_distribution(rv(spark, sf), "product_name")
    d = d.select("product_name", "total", R.positive_rate(F.col("positive"), F.col("total")).alias("positive_rate"), R.positive_rate(F.col("negative"), F.col("total")).alias("negative_rate"))
    return d.withColumns({"card_negative_rate": 100 - F.col("positive_rate"), "health": R.health_label(F.col("positive_rate"))})


TREND = """SELECT product_name, CAST(date_trunc('{p}', review_date) AS DATE) AS date, count(*) AS total, round(avg(rating), 6) AS average_rating, round(avg(sentiment_score), 6) AS average_score
FROM reviews WHERE {w} review_date BETWEEN TIMESTAMP '2024-01-31 00:00:00' - INTERVAL {d} DAY AND TIMESTAMP '2024-01-31 00:00:00' GROUP BY ALL"""


@C.query("ts1_product_trend", f"{RV} {TREND.format(p='day', w='', d=30)}")
def _(spark, sf):
    return R.product_trend(rv(spark, sf), None, _now())


@C.query("ts1_product_trend_one", f"{RV} {TREND.format(p='day', w=chr(112) + 'roduct_name = ' + chr(39) + 'product-7' + chr(39) + ' AND', d=14)}")
def _(spark, sf):
    return R.product_trend(rv(spark, sf), "product-7", _now(), days=14)


@C.query("ts2_product_trend_week", f"{RV} {TREND.format(p='week', w='', d=60)}")
def _(spark, sf):
    return R.product_trend(rv(spark, sf), None, _now(), period="week", days=60)


@C.query("ts2_product_trend_month", f"{RV} {TREND.format(p='month', w='', d=90)}")
def _(spark, sf):
    return R.product_trend(rv(spark, sf), None, _now(), period="month", days=90)


@C.query("srt1_sort_reviews", f"{RV} SELECT id, sentiment_score FROM reviews WHERE product_name = 'product-7' ORDER BY sentiment_score DESC NULLS FIRST, id")
def _(spark, sf):
    return R.sort_reviews(R.by_product(rv(spark, sf), "product-7"), "sentiment_score").select("id", "sentiment_score")


@C.query("srt2_sort_products", f"{RV} SELECT product_name, total FROM (SELECT product_name, count(*) AS total FROM reviews WHERE user_id = 42 GROUP BY product_name) ORDER BY total DESC, product_name")
def _(spark, sf):
    return R.sort_products(R.product_list(rv(spark, sf), 42), "total").select("product_name", "total")


@C.query("srt3_page", f"{RV} SELECT id, review_date, 5 AS page FROM reviews ORDER BY review_date ASC NULLS LAST, id LIMIT 20 OFFSET 80")
def _(spark, sf):
    return R.page(rv(spark, sf).select("id", "review_date"), 80, 20, "review_date", descending=False).select("id", "review_date", "page")


@C.query("srt4_jobs_by_time", f"WITH {A.JOB_UPDATES} SELECT event_id, job_id, ts FROM job_updates ORDER BY ts DESC, event_id")
def _(spark, sf):
    return A.job_updates(spark, sf).orderBy(F.desc("ts"), "event_id").select("event_id", "job_id", "ts")


TOPS = "SELECT product_name, round(avg(rating), 6) AS average_rating, count(*) AS total FROM reviews GROUP BY product_name ORDER BY {} DESC, product_name LIMIT 5"


@C.query("top1_products_by_rating", f"{RV} {TOPS.format('average_rating')}")
def _(spark, sf):
    return R.top_products(rv(spark, sf), "average_rating")


@C.query("top2_products_by_count", f"{RV} {TOPS.format('total')}")
def _(spark, sf):
    return R.top_products(rv(spark, sf), "total")


@C.query("top3_top_reviews", f"{RV} SELECT id, sentiment_score, rating FROM reviews WHERE sentiment_label = 'positive' AND rating >= 3 ORDER BY sentiment_score DESC NULLS FIRST, rating DESC, id LIMIT 25")
def _(spark, sf):
    return R.top_reviews(rv(spark, sf), 25, "positive", 3).select("id", "sentiment_score", "rating")


@C.query("top4_top_aspects", f"{RA}, counted AS ({ASPECTS_ALL}) SELECT aspect, total_reviews - not_mentioned AS mentions, CASE WHEN positive >= negative THEN 'positive' ELSE 'negative' END AS dominant FROM counted WHERE total_reviews > not_mentioned ORDER BY mentions DESC, ord LIMIT 5")
def _(spark, sf):
    return R.top_aspects(R.aspect_counts(A.reviews_with_aspects(spark, sf), A.aspects(spark)))


@C.query("jn7_expand_aspects", f"{RA} SELECT r.id, a.aspect, coalesce(x.polarity, 'none') AS polarity FROM reviews r CROSS JOIN aspects a LEFT JOIN review_aspects x ON x.id = r.id AND x.aspect = a.aspect WHERE r.model_used LIKE 'absa_%'")
def _(spark, sf):
    return R.expand_aspects(R.absa_only(A.reviews_with_aspects(spark, sf)), A.aspects(spark)).select("id", "aspect", "polarity")


@C.query("win8_sample_per_rating", f"{RV} SELECT id, rating FROM (SELECT id, rating, row_number() OVER (PARTITION BY rating ORDER BY md5(id || '42'), id) AS n FROM reviews) WHERE n <= 2")
def _(spark, sf):
    return R.sample_per_class(rv(spark, sf), ["rating"], 2).select("id", "rating")


@C.query("dat1_durations", f"{RV} SELECT id, CAST(date_trunc('day', created_at) AS DATE) AS day, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS iso, date_diff('second', created_at, {NOW}) AS seconds_to_now FROM reviews")
def _(spark, sf):
    seconds = F.expr("timestampdiff(SECOND, date_trunc('SECOND', created_at), TIMESTAMP_NTZ '2024-01-31 00:00:00')")
    return rv(spark, sf).select("id", F.date_trunc("day", "created_at").cast("date").alias("day"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), seconds.alias("seconds_to_now"))
