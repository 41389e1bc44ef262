"""Training and scoring with Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from os.path import commonprefix

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import CountVectorizer, HashingTF, IDF, Normalizer, UnivariateFeatureSelector, VectorSlicer
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from opinara.functions.text import derive_overall_sentiment, ngrams
from opinara.operators.features import words


#: Between the words or grams of a row that goes to an external model.
_BETWEEN = "\n"


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, weight): n / (k n_class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("k"))
    return counts.crossJoin(F.broadcast(total)).select(label, (F.col("all") / (F.col("k") * F.col("n"))).alias("weight"))  # one row


def with_grams(df: DataFrame, text: str) -> DataFrame:
    split = df.withColumn("_words", words(F.col(text)))  # a column of its own: grams name it several times
    return split.withColumn("grams", ngrams(F.col("_words"))).drop("_words")


def text_features(size: int = 1 << 14) -> list:
    """Stages from grams to hashed, scaled and normalised features; the vocabulary needs no table."""
    return [HashingTF(inputCol="grams", outputCol="counts", numFeatures=size), IDF(inputCol="counts", outputCol="idf", minDocFreq=2), Normalizer(inputCol="idf", outputCol="features")]


def _accuracy(model, df: DataFrame, label: str) -> dict[str, float]:
    m = model.transform(df).agg(F.avg((F.col("prediction") == F.col(label)).cast("int")).alias("accuracy"), F.count_if((F.col("prediction") == 1) & (F.col(label) == 1)).alias("tp"), F.count_if(F.col("prediction") != F.col(label)).alias("wrong")).first()
    return {"val_accuracy": float(m.accuracy or 0), "val_f1": 2 * m.tp / max(1, 2 * m.tp + m.wrong)}


def _at_once(spark: SparkSession, tasks: Sequence[Callable], parallel: int) -> list:
    """What the tasks return, in their order. Up to `parallel` run at a time: a fit is many small jobs, which leave cores to others."""
    with ThreadPoolExecutor(parallel) as pool:
        return list(pool.map(lambda t: t(), [inheritable_thread_target(spark)(t) for t in tasks]))


def grid_search(train: DataFrame, val: DataFrame, kind: str, settings: Sequence[dict], *, label: str = "label", features: list | None = None, iterations: int = 50, parallel: int = 4, rungs: Sequence[float] = ()) -> tuple[PipelineModel, DataFrame]:
    """The pipeline with the best validation accuracy (the first of equal ones) and a row for each setting.

    kind: logistic (setting C, as L2 strength 1 / (C n)), svm (C) or trees (maxIter, maxDepth, stepSize, subsamplingRate).
    `parallel` settings are fitted at a time, over one cached table. rungs: growing shares of the training rows, chosen by a hash of
    their features, on which settings are tried first; each stops the worse half, whose rows keep what they reached there, and
    its share as train_share. Without rungs every setting sees all rows.
    """
    prepared = Pipeline(stages=features or text_features()).fit(train)
    a, b = prepared.transform(train).select(label, "features").persist(), prepared.transform(val).select(label, "features").persist()

    def fit(s: dict, rows: DataFrame, n: int):
        if kind == "logistic":
            estimator = LogisticRegression(labelCol=label, regParam=1.0 / (s["C"] * n), standardization=False, maxIter=iterations)
        elif kind == "svm":
            estimator = LinearSVC(labelCol=label, regParam=1.0 / (s["C"] * n), standardization=False, maxIter=iterations)
        else:
            estimator = GBTClassifier(labelCol=label, seed=42, **s)
        model = estimator.fit(rows)
        return model, _accuracy(model, b, label)

    try:
        left, reached = list(range(len(settings))), {}
        for share in (*rungs, 1.0):
            rows = a if share == 1 else a.where(F.pmod(F.xxhash64("features"), F.lit(10_000)) < share * 10_000)
            n = max(1, rows.count())
            for i, r in zip(left, _at_once(train.sparkSession, [lambda s=settings[i]: fit(s, rows, n) for i in left], parallel), strict=True):
                reached[i] = (share, *r)
            ranked = sorted(left, key=lambda i: -reached[i][2]["val_accuracy"])  # stable: the first of equal ones
            left = sorted(ranked[: (len(ranked) + 1) // 2])
    finally:
        a.unpersist()
        b.unpersist()
    lines = [(kind, str(sorted(s.items())), m["val_accuracy"], m["val_f1"], share) for s, (share, _, m) in ((s, reached[i]) for i, s in enumerate(settings))]
    return PipelineModel(stages=[*prepared.stages, reached[ranked[0]][1]]), train.sparkSession.createDataFrame(lines, "model string, setting string, val_accuracy double, val_f1 double, train_share double")


def calibrated(model: PipelineModel, train: DataFrame, label: str = "label", folds: int = 3, key: str = "doc_id") -> PipelineModel:
    """A linear SVM's pipeline with probabilities: it scores rows without labels like any other model.

    A sigmoid of the margin is fitted on margins that the training rows get from SVMs of the same settings which have
    not seen them: one for each fold, on the other folds.
    """
    svm = model.stages[-1]
    rows = PipelineModel(stages=model.stages[:-1]).transform(train).select(label, "features", F.pmod(F.xxhash64(key), F.lit(folds)).alias("fold")).persist()
    again = LinearSVC(labelCol=label, regParam=svm.getRegParam(), standardization=False, maxIter=svm.getMaxIter())
    margins = [again.fit(rows.where(F.col("fold") != k)).transform(rows.where(F.col("fold") == k)).select(label, "rawPrediction") for k in range(folds)]
    margin = VectorSlicer(inputCol="rawPrediction", outputCol="margin", indices=[1])
    sigmoid = LogisticRegression(labelCol=label, featuresCol="margin", rawPredictionCol="sigmoid", probabilityCol="probability", predictionCol="likelier").fit(margin.transform(reduce(DataFrame.union, margins)))
    rows.unpersist()
    return PipelineModel(stages=[*model.stages, margin, sigmoid])


def score(model: PipelineModel, df: DataFrame, name: str, labels: Sequence[str] = ("negative", "positive")) -> DataFrame:
    """label, confidence, the probabilities and the model's name."""
    p = vector_to_array("probability")
    out = model.transform(df).withColumn("p", p)
    return out.withColumns({"predicted_label": F.element_at(F.array(*(F.lit(x) for x in labels)), (F.col("prediction") + 1).cast("int")), "confidence": F.array_max("p"), "prob_negative": F.col("p")[0], "prob_positive": F.col("p")[1], "model_used": F.lit(name)}).drop("p")


def save_model(model: PipelineModel, path: str) -> None:
    """Writes a fitted pipeline, in place of what is there."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def score_external(df: DataFrame, column: str, load: Callable[[], Callable[[np.ndarray], np.ndarray]], name: str, labels: Sequence[str] = ("negative", "positive"), *, batch_size: int = 256) -> DataFrame:
    """The columns of `score`, by a model from outside of Spark.

    `load` is called once in each Python worker and returns a function from a batch of the column's values to an array of
    shape (values, labels) of probabilities. Values are text, numbers or arrays of numbers; an array of words or grams comes as one text, a
    newline between them. Batches have `batch_size` rows and come by Arrow. Null values are not scored: their label and probabilities are null.
    """

    def make():
        model = load()
        return lambda values: np.asarray(model(values), dtype=np.float64)

    words_ = dict(df.dtypes)[column] == "array<string>"
    value = F.array_join(column, _BETWEEN, "") if words_ else F.col(column)
    known = F.col(column).isNotNull()
    default = {"string": F.lit("")}.get("string" if words_ else dict(df.dtypes)[column], F.col(column))
    out = df.withColumn("p", F.when(known, predict_batch_udf(make, return_type=ArrayType(DoubleType()), batch_size=batch_size)(F.coalesce(value, default))))
    best = F.array_position("p", F.array_max("p")).cast("int")
    label = F.when(F.col("p").isNotNull(), F.element_at(F.array(*(F.lit(x) for x in labels)), best))
    return out.withColumns({"predicted_label": label, "confidence": F.array_max("p"), "prob_negative": F.col("p")[0], "prob_positive": F.col("p")[1], "model_used": F.lit(name)}).drop("p")


def word_weights(df: DataFrame, label: str, grams: str = "grams", size: int = 1 << 14) -> DataFrame:
    """(gram, weight): the log odds of the label for the `size` grams in most documents, by document counts with one added to each."""
    rows = df.select(F.explode(F.array_distinct(grams)).alias("gram"), F.col(label).alias("y"))
    counts = rows.groupBy("gram").agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("n")).orderBy(F.desc(F.col("p") + F.col("n")), "gram").limit(size)
    total = df.agg(F.count_if(F.col(label) == 1).alias("all_p"), F.count_if(F.col(label) == 0).alias("all_n"))
    return counts.crossJoin(F.broadcast(total)).select("gram", F.log((F.col("p") + 1) / (F.col("all_p") + 2) / ((F.col("n") + 1) / (F.col("all_n") + 2))).alias("weight"))  # one row


class WordWeights:
    """A scorer for score_external: called, it loads a written table of word_weights, and scores rows of grams."""

    def __init__(self, path: str):
        self.path = path

    def __call__(self) -> Callable[[np.ndarray], np.ndarray]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.path) if ":/" in self.path else (fs.LocalFileSystem(), self.path)
        table = pq.read_table(path, filesystem=system).to_pydict()
        weights = dict(zip(table["gram"], table["weight"], strict=True))

        def predict(texts: np.ndarray) -> np.ndarray:
            margin = np.array([sum(weights.get(g, 0.0) for g in set(t.split(_BETWEEN))) for t in texts])
            positive = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
            return np.stack([1 - positive, positive], axis=1)

        return predict


def term_counts(df: DataFrame, size: int = 1 << 10) -> DataFrame:
    """The hashed counts of the grams, as `counts`."""
    return HashingTF(inputCol="grams", outputCol="counts", numFeatures=size).transform(df)


def aspect_baselines(docs: DataFrame, aspects: Sequence[str], *, kind: str = "logistic", label: str = "label_id", iterations: int = 20, held: int = 1 << 30) -> dict[str, PipelineModel]:
    """One four-class model of `counts` per aspect, rows weighted so that classes count alike.

    docs: a written table of counts (term_counts) and `pairs`, an array of (aspect, label). Terms are hashed and document frequencies are
    counted once for all aspects, whose models begin with the same stages. Each fit keeps its rows; as many run at a time as keep
    some `held` bytes, one to four.
    """
    spark = docs.sparkSession
    pairs = docs.select(F.explode("pairs").alias("p")).select("p.aspect", f"p.{label}").where(F.col(label).isNotNull())
    sizes: dict[str, dict[int, int]] = {}
    for r in pairs.groupBy("aspect", label).count().where(F.col("aspect").isin(list(aspects))).collect():  # a row per aspect and class
        sizes.setdefault(r.aspect, {})[r[label]] = r["count"]

    def fit(a: str) -> PipelineModel:
        n, k = sum(sizes.get(a, {}).values()), len(sizes.get(a, {}))
        weights = F.create_map(*(F.lit(x) for y, m in sizes.get(a, {}).items() for x in (y, n / (k * m))))
        rows = docs.select("counts", F.explode(F.filter("pairs", lambda p: (p["aspect"] == a) & p[label].isNotNull())).alias("p")).select("counts", F.col(f"p.{label}").alias(label))
        weighted = rows.withColumn("weight", F.element_at(weights, F.col(label)))
        one = LogisticRegression(labelCol=label, weightCol="weight", family="multinomial", maxIter=iterations) if kind == "logistic" else OneVsRest(classifier=LinearSVC(maxIter=iterations), labelCol=label, weightCol="weight")
        return Pipeline(stages=[*prepared.stages, one]).fit(weighted)

    prepared = Pipeline(stages=text_features()[1:]).fit(docs)
    size = docs.select("counts").first()
    row = 8 * (size.counts.size if size else 1)
    most = max((sum(x.values()) for x in sizes.values()), default=0)
    parallel = min(4, max(1, held // max(1, row * most)))
    return dict(zip(aspects, _at_once(spark, [lambda a=a: fit(a) for a in aspects], parallel), strict=True))


def score_aspects(models: dict[str, PipelineModel], df: DataFrame) -> DataFrame:
    """df with aspects and overall: a map aspect -> polarity, and the overall sentiment of what isn't none. All models score a row in one pass."""
    words_ = F.array(*(F.lit(x) for x in ("none", "positive", "negative", "neutral")))
    shared = len(commonprefix([[s.uid for s in m.stages] for m in models.values()]))  # stages that all begin with
    out = PipelineModel(stages=next(iter(models.values())).stages[:shared]).transform(df)
    for i, m in enumerate(models.values()):
        out = PipelineModel(stages=m.stages[shared:]).transform(out).select(*out.columns, F.element_at(words_, (F.col("prediction") + 1).cast("int")).alias(f"polarity_{i}"))
    aspects = F.create_map(*(x for i, a in enumerate(models) for x in (F.lit(a), F.col(f"polarity_{i}"))))
    out = out.select(*df.columns, aspects.alias("aspects"))
    return out.withColumn("overall", derive_overall_sentiment(F.col("aspects")))


def select_features(df: DataFrame, k: int, label: str = "label", vocabulary: int = 1 << 14) -> DataFrame:
    """The k gram counts that tell the label best, by the chi-squared test, as `selected`."""
    counted = CountVectorizer(inputCol="grams", outputCol="counts", vocabSize=vocabulary, minDF=2).fit(df).transform(df)
    selector = UnivariateFeatureSelector(featuresCol="counts", outputCol="selected", labelCol=label, selectionMode="numTopFeatures").setFeatureType("categorical").setLabelType("categorical").setSelectionThreshold(k)
    return selector.fit(counted).transform(counted)


def cluster_documents(df: DataFrame, vector: str, k: int, seed: int = 42) -> DataFrame:
    """topic_id of each row by k-means on its vector."""
    rows = df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    return KMeans(k=k, seed=seed, featuresCol="features", predictionCol="topic_id").fit(rows).transform(rows).drop("features")


def choose_clusters(df: DataFrame, vector: str, most: int = 32, *, seed: int = 42, parallel: int = 4) -> tuple[DataFrame, DataFrame]:
    """The rows with a topic_id, for which nobody says how many topics there are, and a row (k, method, silhouette) for each clustering tried.

    K-means and bisecting k-means are fitted with numbers of clusters that grow by half, up to `most`, then with those between the
    best one's neighbours, until none is left there; `parallel` fits run at a time, over one cached table. The largest
    silhouette wins (by squared distances to clusters' sums: two passes, no pairs), of equal ones the smaller k. So some 4 log2(most) + 8 fits
    are made, however many rows there are. A null vector has a null topic. With fewer than two different vectors all are topic 0.
    """
    known = df.where(F.col(vector).isNotNull()).withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    rest = df.where(F.col(vector).isNull()).withColumn("topic_id", F.lit(None).cast("int"))
    rows, tried = known.select("features").persist(), {}

    def fit(k: int, method: str) -> None:
        kind = BisectingKMeans(minDivisibleClusterSize=2.0) if method == "bisecting" else KMeans()
        model = kind.setK(k).setSeed(seed).setFeaturesCol("features").setPredictionCol("topic_id").fit(rows)
        apart = sum(n > 0 for n in model.summary.clusterSizes) > 1
        tried[k, method] = (ClusteringEvaluator(featuresCol="features", predictionCol="topic_id").evaluate(model.transform(rows)) if apart else -1.0, model)

    try:
        if rows.distinct().limit(2).count() < 2:
            return known.drop("features").withColumn("topic_id", F.lit(0)).unionByName(rest), df.sparkSession.createDataFrame([], "k int, method string, silhouette double")
        ks = [2]
        while ks[-1] < most:
            ks.append(min(most, max(ks[-1] + 1, ks[-1] * 3 // 2)))
        while ks:
            _at_once(df.sparkSession, [lambda k=k, m=m: fit(k, m) for k in ks for m in ("kmeans", "bisecting")], parallel)
            best = min(tried, key=lambda t: (-tried[t][0], *t))
            seen = sorted({k for k, _ in tried})
            at = seen.index(best[0])
            between = [k for k in range(seen[max(0, at - 1)] + 1, seen[min(at + 1, len(seen) - 1)]) if k not in seen]
            ks = between[:: -(-len(between) // (2 * parallel)) or 1]
    finally:
        rows.unpersist()
    out = tried[best][1].transform(known).drop("features").unionByName(rest)
    return out, df.sparkSession.createDataFrame([(*t, v[0]) for t, v in sorted(tried.items())], "k int, method string, silhouette double")
