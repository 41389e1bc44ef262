"""Review, annotation and prediction tables as views over the driver's tables; the same in SQL for DuckDB.

The texts of these views are shared by Spark (spark.sql over the path) and DuckDB where the dialects agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.functions.vocab import ASPECT_NAMES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_REVIEW_COLUMNS = """event_id AS id, user_id, concat('product-', CAST(event_id % 97 AS VARCHAR(20))) AS product_name,
  CAST(1 + (event_id * 7 + user_id) % 5 AS INT) AS rating, CASE WHEN event_id % 17 = 0 THEN NULL ELSE ts END AS review_date,
  CASE event_type WHEN 'purchase' THEN 'positive' WHEN 'click' THEN 'positive' WHEN 'error' THEN 'negative' WHEN 'view' THEN 'neutral' END AS sentiment_label,
  CASE WHEN event_id % 23 = 0 THEN NULL ELSE value / 500 END AS sentiment_score,
  CASE event_id % 4 WHEN 0 THEN 'absa_lr' WHEN 1 THEN 'absa_xlmr' WHEN 2 THEN 'lr' ELSE 'robert' END AS model_used, ts AS created_at"""
REVIEWS = f"reviews AS (SELECT {_REVIEW_COLUMNS} FROM events)"


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [c.strip() for c in _split(_REVIEW_COLUMNS)]
    return table(spark, sf_dir, "events").selectExpr(*columns)


def _split(columns: str) -> list[str]:
    """At the commas that are in no bracket."""
    out, depth = [""], 0
    for c in columns:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


ASPECT_VALUES = "aspects(aspect, ord) AS (VALUES " + ", ".join(f"('{a}', {i})" for i, a in enumerate(ASPECT_NAMES)) + ")"
#: Long form of the aspect map; aspects whose key is missing have no row.
REVIEW_ASPECTS = f"""{REVIEWS}, {ASPECT_VALUES}, review_aspects AS (
  SELECT id, user_id, product_name, aspect, ord, CASE WHEN k < 3 THEN 'positive' WHEN k < 5 THEN 'negative' WHEN k < 6 THEN 'neutral' ELSE 'none' END AS polarity
  FROM (SELECT *, (id * 31 + ord * 17) % 11 AS k FROM reviews, aspects WHERE model_used LIKE 'absa_%') WHERE k < 9)"""


def aspects(spark: SparkSession) -> DataFrame:
    """The dimension of aspects: ten rows."""
    return spark.createDataFrame([(a, i) for i, a in enumerate(ASPECT_NAMES)], "aspect string, ord int")


def reviews_with_aspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews with a map aspect -> polarity, null where the model gives none."""
    names = F.array(*(F.struct(F.lit(a).alias("aspect"), ((F.col("id") * 31 + i * 17) % 11).alias("k")) for i, a in enumerate(ASPECT_NAMES)))
    word = lambda k: F.when(k < 3, "positive").when(k < 5, "negative").when(k < 6, "neutral").otherwise("none")
    entries = F.transform(F.filter(names, lambda x: x["k"] < 9), lambda x: F.struct(x["aspect"], word(x["k"])))
    return reviews(spark, sf_dir).withColumn("aspects", F.when(F.col("model_used").like("absa_%"), F.map_from_entries(entries)))


#: Pairs of three annotators in long form.
ANNOTATIONS = f"""{ASPECT_VALUES}, raw_pairs AS (
  SELECT doc_id, aspect, ord, (doc_id * 13 + ord * 7) % 10 < 3 AS present, (doc_id + ord) % 3 AS p, (doc_id + ord) % 4 = 0 AS moved FROM documents, aspects
), annotations AS (
  SELECT doc_id, j, aspect, ord, CASE (p + CASE WHEN j = 1 AND moved THEN 1 ELSE 0 END) % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'neutral' END AS polarity
  FROM raw_pairs, (VALUES (0), (1), (2)) AS annotators(j)
  WHERE present AND doc_id % 11 <> 0 AND (j = 0 OR doc_id % 7 <> 0) AND (j < 2 OR doc_id % 3 <> 0))"""


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, a0, a1, a2): each annotator's pairs as an array of structs; empty if there are none."""
    names, last = ", ".join(f"'{a}'" for a in ASPECT_NAMES), len(ASPECT_NAMES) - 1

    def pairs(j: int) -> str:
        present = "(doc_id * 13 + i * 7) % 10 < 3 AND doc_id % 11 <> 0" + " AND doc_id % 7 <> 0" * (j > 0) + " AND doc_id % 3 <> 0" * (j > 1)
        polarity = "(doc_id + i" + " + if((doc_id + i) % 4 = 0, 1, 0)" * (j == 1) + ") % 3"
        return f"transform(filter(sequence(0, {last}), i -> {present}), i -> named_struct('aspect', element_at(array({names}), i + 1), 'polarity', element_at(array('positive', 'negative', 'neutral'), cast({polarity} + 1 as int)))) AS a{j}"

    return table(spark, sf_dir, "documents").selectExpr("doc_id", *(pairs(j) for j in range(3)))


_PREDICTION_COLUMNS = "doc_id, quality AS y_true, ((doc_id * 37 + quality * 41) % 101) / 100.0 AS y_score, CASE WHEN ((doc_id * 37 + quality * 41) % 101) >= 50 THEN 1 ELSE 0 END AS y_pred, doc_id % 2 AS protected_attr"
PREDICTIONS = f"predictions AS (SELECT {_PREDICTION_COLUMNS.replace('/ 100.0 AS', '/ 100.0::DOUBLE AS')} FROM labels)"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").selectExpr(*(c.strip().replace("/ 100.0", "/ 100.0D") for c in _split(_PREDICTION_COLUMNS)))


PAIR_PREDICTIONS = f"""{ASPECT_VALUES}, pairs AS (
  SELECT doc_id, aspect, ord, label_id, CASE WHEN (doc_id * 3 + ord) % 5 = 0 THEN (label_id + 1) % 4 ELSE label_id END AS pred_label_id
  FROM (SELECT doc_id, aspect, ord, (doc_id + ord) % 4 AS label_id FROM labels, aspects))"""


def pair_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "labels").select("doc_id").crossJoin(F.broadcast(aspects(spark)))  # ten rows
    label = (F.col("doc_id") + F.col("ord")) % 4
    return base.select("doc_id", "aspect", "ord", label.alias("label_id"), F.when((F.col("doc_id") * 3 + F.col("ord")) % 5 == 0, (label + 1) % 4).otherwise(label).alias("pred_label_id"))


CORPUS = """corpus AS (SELECT d.doc_id, d.source AS title, d.text AS content, d.lang, CASE l.quality WHEN 1 THEN 5 WHEN 0 THEN 1 ELSE 4 END AS starRating,
  CASE l.quality WHEN 0 THEN 'negative' ELSE 'positive' END AS polarity FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    star = F.when(F.col("quality") == 1, 5).when(F.col("quality") == 0, 1).otherwise(4)
    return docs.join(labels, "doc_id", "left").select("doc_id", F.col("source").alias("title"), F.col("text").alias("content"), "lang", star.alias("starRating"), F.when(F.col("quality") == 0, "negative").otherwise("positive").alias("polarity"))


_STATUS = "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'in_progress' END AS status"
JOB_UPDATES = f"job_updates AS (SELECT event_id, event_id % 500 AS job_id, {_STATUS}, ts FROM events)"


def job_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id", "event_id % 500 AS job_id", _STATUS, "ts")
