"""Ingest, checkpoints, models and streams."""

import os
import random
from collections import deque
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from opinara.functions.vocab import ASPECT_NAMES
from opinara.operators import hash_log
from opinara.operators import ingest as I
from opinara.operators import models as M
from opinara.plans import registry
from opinara.sources import files as L
from opinara.sources import html as H
from opinara.streaming import jobs as J

SF = "/root/testdata/sf0.001"


def test_ingest_twice_stores_once(spark, tmp_path):
    rows = [(1, "A", "text one", None), (2, " a", "TEXT one ", None), (3, "A", "text two", datetime(2024, 1, 1)), (4, "A", "text two", datetime(2024, 1, 2))]
    df = spark.createDataFrame(rows, "n long, product_name string, review_text string, review_date timestamp")
    store = f"{tmp_path}/store"
    assert I.ingest_reviews(df, store, order="n", score=lambda d: d.withColumn("scored", F.lit(True))) == {"scraped": 4, "created": 3, "duplicates": 1}
    assert I.ingest_reviews(df, store, order="n", score=lambda d: d.withColumn("scored", F.lit(True))) == {"scraped": 4, "created": 0, "duplicates": 4}
    assert sorted(r.n for r in spark.read.parquet(store).collect()) == [1, 3, 4]


def test_checkpoint_keeps_the_last_record(spark, tmp_path):
    path = f"{tmp_path}/c"
    with pytest.raises(Exception):
        L.read_checkpoint(spark, path, "id string").collect()
    L.append_checkpoint(spark.createDataFrame([("a", "1", 1), ("b", "1", 1), ("a", "2", 2)], "id string, v string, seq long"), path)
    (tmp_path / "c" / "part-x.json").write_text('\n  \n{"id": "c"\nnull\n[]\n')
    done = L.read_checkpoint(spark, path, "id string, v string")
    assert {(r.id, r.v) for r in done.collect()} == {("a", "2"), ("b", "1")}
    todo = spark.createDataFrame([("a",), ("z",)], "id string")
    assert [r.id for r in L.unfinished(todo, done).collect()] == ["z"]


def test_texts(spark, tmp_path):
    (tmp_path / "t.txt").write_text(" one \n\n\ttwo\n")
    (tmp_path / "t.csv").write_text('text,n\n"a ""b"",\nc",1\n')
    (tmp_path / "no.csv").write_text("x\n1\n")
    assert sorted(r.text for r in L.read_texts(spark, f"{tmp_path}/t.txt").collect()) == ["one", "two"]
    assert [r.text for r in L.read_texts(spark, f"{tmp_path}/t.csv").collect()] == ['a "b",\nc']
    with pytest.raises(ValueError):
        L.read_texts(spark, f"{tmp_path}/no.csv")


def test_models_learn(spark):
    rows = [(i, "good fine nice " * (1 + i % 3) if i % 2 else "bad poor awful " * (1 + i % 3), float(i % 2)) for i in range(60)]
    df = M.with_grams(spark.createDataFrame(rows, "doc_id long, text string, label double"), "text").coalesce(1)
    for kind, settings in (("logistic", [{"C": 0.1}, {"C": 1.0}]), ("svm", [{"C": 1.0}]), ("trees", [{"maxIter": 2, "maxDepth": 2}])):
        model, grid = M.grid_search(df.where("doc_id < 40"), df.where("doc_id >= 40"), kind, settings, features=M.text_features(64), iterations=5)
        assert grid.count() == len(settings) and grid.agg(F.max("val_accuracy").alias("a")).first().a == 1.0
        if kind == "svm":
            out = M.score(M.calibrated(model, df.where("doc_id < 40")), df.drop("label"), "svm").join(df.select("doc_id", "label"), "doc_id")
            assert out.where((F.col("prob_positive") > 0.5) == (F.col("label") == 1)).count() == 60
        elif kind == "logistic":
            out = M.score(model, df, "lr")
            assert out.where(F.col("predicted_label") == F.when(F.col("label") == 1, "positive").otherwise("negative")).count() == 60
            assert out.where("abs(prob_negative + prob_positive - 1) > 1e-9 or confidence < 0.5").count() == 0


def test_settings_at_once_choose_as_one_by_one(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["good", "fine", "bad", "poor"] if rng.random() < 0.4 else (["good", "fine"] if i % 2 else ["bad", "poor"])) for _ in range(12)), float(i % 2)) for i in range(240)]
    df = M.with_grams(spark.createDataFrame(rows, "doc_id long, text string, label double"), "text")
    train, val = df.where("doc_id < 160"), df.where("doc_id >= 160")
    settings = [{"C": c} for c in (0.001, 0.1, 1.0, 5.0)]
    found = [M.grid_search(train, val, "logistic", settings, features=M.text_features(256), iterations=10, parallel=p) for p in (1, 4)]
    one, four = ([tuple(r) for r in g.collect()] for _, g in found)
    assert one == four and len(one) == 4 and all(r[4] == 1.0 for r in one)
    assert str(found[0][0].stages[-1].coefficients) == str(found[1][0].stages[-1].coefficients)
    # a rung stops the worse half, and what goes on sees all rows
    model, grid = M.grid_search(train, val, "logistic", settings, features=M.text_features(256), iterations=10, rungs=[0.5])
    shares = [r.train_share for r in grid.collect()]
    assert sorted(shares) == [0.5, 0.5, 1.0, 1.0]
    assert M.score(model, val, "lr").where(F.col("predicted_label") == F.when(F.col("label") == 1, "positive").otherwise("negative")).count() > 60


def test_settings_are_let_go_when_a_fit_fails(spark):
    df = M.with_grams(spark.createDataFrame([(0, "a b", 0.0), (1, "b c", 1.0)], "doc_id long, text string, label double"), "text")
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    with pytest.raises(KeyError):
        M.grid_search(df, df, "logistic", [{"D": 1.0}], features=M.text_features(16))
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


@pytest.mark.parametrize("k", [3, 7])
def test_the_number_of_clusters_is_found(spark, k):
    rng = np.random.default_rng(k)
    centres = rng.normal(0, 10, (k, 8))
    rows = [(i, [float(x) for x in centres[i % k] + rng.normal(0, 0.5, 8)]) for i in range(60 * k)]
    df = spark.createDataFrame([*rows, (-1, None)], "vec_id long, embedding array<float>").repartition(4)
    out, tried = M.choose_clusters(df, "embedding", 12)
    topics = {r.vec_id: r.topic_id for r in out.collect()}
    assert topics.pop(-1) is None and len(topics) == 60 * k
    assert len(set(topics.values())) == k and all(topics[i] == topics[i % k] for i in topics)
    best = max(tried.collect(), key=lambda r: r.silhouette)
    assert best.k == k and best.silhouette > 0.9


def test_vectors_without_difference_are_one_topic(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None)], "vec_id long, embedding array<double>")
    out, tried = M.choose_clusters(df, "embedding", 4)
    assert sorted((r.vec_id, r.topic_id) for r in out.collect()) == [(0, 0), (1, 0), (2, None)] and tried.count() == 0
    assert M.choose_clusters(df.limit(0), "embedding", 4)[0].count() == 0


def expected_admission(rows, seconds, limit):
    out, recent = {}, {}
    for user, ts, n in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        q = recent.setdefault(user, deque())
        while q and q[0] <= ts - timedelta(seconds=seconds):
            q.popleft()
        out[n] = len(q) < limit
        if out[n]:
            q.append(ts)
    return out


def test_admission(spark):
    e = spark.read.parquet(f"{SF}/events.parquet")
    want = expected_admission([(r.user_id, r.ts, r.event_id) for r in e.select("user_id", "ts", "event_id").collect()], 86400, 3)
    assert not all(want.values())
    got = {r.event_id: r.admitted for r in J.admitted(e, "user_id", "ts", "event_id", 86400, 3).collect()}
    assert got == want
    stream = J.read_stream(spark, f"{SF}/events.parquet", e.schema).withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.event_id: r.admitted for r in J.run_available(J.admitted_stream(stream, "user_id", "event_id", 86400, 3), "append").collect()}
    assert got == want


def test_a_hot_key_is_admitted_in_many_tasks(spark):
    t, rng = datetime(2024, 1, 1), random.Random(4)
    at, rows = t, []
    for n in range(3000):  # bursts, with gaps between
        at += timedelta(seconds=rng.choice([1, 2, 20, 59, 60, 61, 400]))
        rows.append((1 if n % 3 else n, at, n))
    rows += [(None, t, 5000), (None, t + timedelta(seconds=59), 5001), (2, t, 5002), (2, t, 5003), (2, t, 5004)]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp, event_id long")
    cut = J.pieces(df, "user_id", "ts", "event_id", 60)
    assert cut.where("user_id = 1").select("piece").distinct().count() > 100
    got = J.admitted(df, "user_id", "ts", "event_id", 60, 2)
    assert {r.event_id: r.admitted for r in got.collect()} == expected_admission([(-1 if u is None else u, at, n) for u, at, n in rows], 60, 2)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got.where("user_id = 1").groupBy(F.spark_partition_id()).count().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_state_of_keys_that_stay_away_goes(spark, tmp_path):
    t = datetime(2024, 1, 1)
    for day, users in enumerate(([1, 2, 3], [4], [4], [4])):
        spark.createDataFrame([(u, 10 * day + u, "pending", t + timedelta(days=day)) for u in users], "user_id long, event_id long, status string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/{day}")
    left = {}
    for name, make in (("admitted", lambda s: J.admitted_stream(s, "user_id", "event_id", 60, 2, delay="1 second")), ("status", lambda s: J.latest_status_stream(s.withColumnRenamed("user_id", "job_id"), delay="1 second", keep_hours=1))):
        stream = spark.readStream.schema("user_id long, event_id long, status string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        query = make(stream).writeStream.outputMode("append" if name == "admitted" else "update").format("noop").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        query.awaitTermination()
        left[name] = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert all(max(x) >= 3 and x[-1] <= 1 for x in left.values())


def test_external_models_are_loaded_once_in_each_worker(spark, tmp_path):
    def load():
        with open(f"{tmp_path}/loads-{os.getpid()}", "a") as f:
            f.write("x")
        return lambda texts: np.array([[0.25, 0.75] if "good" in t else [1.0, 0.0] for t in texts])

    df = spark.range(4000).selectExpr("id", "case when id % 7 = 0 then null when id % 2 = 0 then 'a good one' else 'bad' end as text").repartition(4)
    out = M.score_external(df, "text", load, "outside", batch_size=16)
    assert {(r.predicted_label, r.confidence, r.prob_positive, r.model_used) for r in out.collect()} == {("positive", 0.75, 0.75, "outside"), ("negative", 1.0, 0.0, "outside"), (None, None, None, "outside")}
    assert out.where("text is null and predicted_label is not null").count() == 0
    assert all(len(p.read_text()) <= 2 for p in tmp_path.glob("loads-*"))  # once for each of the two runs


def test_a_loaded_model_scores_as_the_saved_one(spark, tmp_path):
    rows = [(i, "good fine nice " * (1 + i % 3) if i % 2 else "bad poor awful " * (1 + i % 3), float(i % 2)) for i in range(60)]
    df = M.with_grams(spark.createDataFrame(rows, "doc_id long, text string, label double"), "text").coalesce(1)
    model, _ = M.grid_search(df, df, "svm", [{"C": 1.0}], features=M.text_features(64), iterations=5)
    model = M.calibrated(model, df)
    M.save_model(model, f"{tmp_path}/m")
    M.save_model(model, f"{tmp_path}/m")
    first, again = (sorted(map(str, M.score(m, df, "svm").collect())) for m in (model, M.load_model(f"{tmp_path}/m")))
    assert first == again
    M.word_weights(df, "label").write.parquet(f"{tmp_path}/w")
    out = M.score_external(df, "grams", M.WordWeights(f"{tmp_path}/w"), "w")
    assert out.where((F.col("predicted_label") == "positive") == (F.col("label") == 1)).count() == 60


def test_dedupe_stream_keeps_one_of_each(spark):
    e = spark.read.parquet(f"{SF}/events.parquet")
    assert registry.QUERIES["st2_dedupe_stream"](spark, SF).count() == e.select("user_id", "event_type").distinct().count()


def test_a_job_that_has_ended_stays_ended(spark):
    t = datetime(2024, 1, 1)
    rows = [(1, 7, "pending", t), (2, 7, "in_progress", t), (3, 7, "failed", t + timedelta(hours=1)), (4, 7, "in_progress", t + timedelta(hours=2)), (5, 8, "pending", t)]
    df = spark.createDataFrame(rows, "event_id long, job_id long, status string, ts timestamp")
    assert {(r.job_id, r.status, r.updates) for r in J.latest_status(df).collect()} == {(7, "failed", 3), (8, "pending", 1)}
    allowed = {r.event_id: r.allowed for r in J.job_transitions(df).collect()}
    assert allowed == {1: True, 2: True, 3: True, 4: False, 5: True}


def test_aspect_baselines_cover_every_aspect(spark):
    rows = registry.QUERIES["mdl4_aspect_baselines"](spark, "/root/testdata/sf0.001").collect()
    assert rows and all(sorted(e["key"] for e in r.aspects) == sorted(ASPECT_NAMES) for r in rows)


def test_aspect_baselines_read_each_document_once(spark):
    df = registry.QUERIES["mdl4_aspect_baselines"](spark, SF)
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert not [f for f in df.inputFiles() if f.startswith(f"file://{SF}")]


def test_aspect_baselines_equal_a_pipeline_of_each_aspect(spark, tmp_path):
    docs = M.with_grams(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), "text")
    names, label = ASPECT_NAMES[:2], lambda i: F.when(F.col("doc_id") % (5 + i) < 2, 0).otherwise(F.col("doc_id") % 4).cast("int")
    docs = docs.withColumn("pairs", F.array(*(F.struct(F.lit(a).alias("aspect"), label(i).alias("label_id")) for i, a in enumerate(names))))
    M.term_counts(docs).select("doc_id", "pairs", "counts").write.parquet(f"{tmp_path}/docs")
    rows = spark.read.parquet(f"{tmp_path}/docs")
    got = {r.doc_id: r.aspects for r in M.score_aspects(M.aspect_baselines(rows, names, iterations=5), rows).collect()}
    words = ["none", "positive", "negative", "neutral"]
    for i, a in enumerate(names):
        alone = docs.withColumn("label_id", label(i))
        alone = alone.join(M.balanced_weights(alone, "label_id"), "label_id")
        one = LogisticRegression(labelCol="label_id", weightCol="weight", family="multinomial", maxIter=5)
        wanted = {r.doc_id: words[int(r.prediction)] for r in Pipeline(stages=[*M.text_features(1 << 10), one]).fit(alone).transform(alone).collect()}
        assert len(wanted) == len(got) and {k: v[a] for k, v in got.items()} == wanted


def test_deeply_nested_pages_are_read(spark):
    deep = "<div>" * 3000 + "<p>a review that is long enough to be one</p>" + "</div>" * 3000
    page = f'<h1>Phone</h1><div class="review-item">{deep}</div>'
    pages = spark.createDataFrame([(1, "https://cel.ro/x", page), (2, "https://cel.ro/y", "<div>" * 5000), (3, "u", None)], "page_id long, url string, html string")
    rows = H.extract_reviews(pages, F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz")).collect()
    assert [(r.page_id, r.product_name, r.review_text) for r in rows] == [(1, "Phone", "a review that is long enough to be one")]


@pytest.fixture
def small_cells(monkeypatch):
    monkeypatch.setattr(hash_log, "CELL", 16)


def numbered(spark, lo, hi):
    return spark.range(lo, hi).selectExpr("id as n", "'A' as product_name", "concat('text ', id) as review_text", "cast(null as timestamp) as review_date")


def files_read(hashes, store):
    return sum(len(part.inputFiles()) for run in hash_log.runs(hashes.sparkSession, store) if (part := hash_log._read(hashes, run)) is not None)


def test_files_read_grow_with_the_batch_and_not_with_the_store(spark, tmp_path, small_cells):
    few, many = f"{tmp_path}/few", f"{tmp_path}/many"
    assert I.ingest_reviews(numbered(spark, 0, 400), few, order="n")["created"] == 400
    assert I.ingest_reviews(numbered(spark, 0, 12_000), many, order="n")["created"] == 12_000
    of = lambda n: I.with_hash(numbered(spark, 0, n)).select("content_hash").distinct()
    assert files_read(of(5), few) <= 5 and files_read(of(5), many) <= 5
    assert 5 < files_read(of(40), many) <= 40
    assert hash_log.found(of(40), many).count() == 40
    assert hash_log.found(I.with_hash(numbered(spark, 20_000, 20_040)).select("content_hash"), many).count() == 0


def test_runs_are_merged_and_nothing_is_stored_twice(spark, tmp_path, small_cells):
    store = f"{tmp_path}/store"
    for k in range(9):
        assert I.ingest_reviews(numbered(spark, 10 * k, 10 * k + 20), store, order="n") == {"scraped": 20, "created": 20 if k == 0 else 10, "duplicates": 0 if k == 0 else 10}
    assert [(r.first, r.last) for r in hash_log.runs(spark, store)] == [(1, 8), (9, 9)]
    assert sorted(r.n for r in spark.read.parquet(store).collect()) == list(range(100))


@pytest.mark.parametrize("stored", [True, False])
def test_a_batch_that_broke_off_is_taken_up_again(spark, tmp_path, monkeypatch, stored):
    store = f"{tmp_path}/store"
    I.ingest_reviews(numbered(spark, 0, 10), store, order="n")

    def lost(*_):
        raise RuntimeError("the driver is lost")

    with monkeypatch.context() as m:
        if stored:
            m.setattr(hash_log, "commit", lost)
            score = None
        else:
            true = hash_log.prepare
            m.setattr(hash_log, "prepare", lambda *a: (true(*a), lost()))
            score = None
        with pytest.raises(RuntimeError):
            I.ingest_reviews(numbered(spark, 5, 20), store, order="n", score=score)
    assert I.ingest_reviews(numbered(spark, 5, 20), store, order="n")["created"] == (0 if stored else 10)
    assert sorted(r.n for r in spark.read.parquet(store).collect()) == list(range(20))


def test_a_failing_scorer_leaves_nothing_cached(spark, tmp_path):
    def score(df):
        raise ValueError("no model")

    with pytest.raises(ValueError, match="no model"):
        I.ingest_reviews(numbered(spark, 0, 5), f"{tmp_path}/store", order="n", score=score)
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()
