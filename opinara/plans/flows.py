"""Queries that read and write files, extract pages, train models and run streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from opinara.functions.vocab import ASPECT_NAMES, FURNITURE_PARTS, FURNITURE_STARTS, MONTHS, MONTHS_RO
from opinara.operators import annotation as N
from opinara.operators import ingest as I
from opinara.operators import models as M
from opinara.plans.catalog import Catalog
from opinara.sources import adapters as A
from opinara.sources import files as L
from opinara.sources import html as H
from opinara.streaming import jobs as J

C = Catalog()
RV, JU = f"WITH {A.REVIEWS}", f"WITH {A.JOB_UPDATES}"
ORDER = "event_id"


# files


@C.query("src2_read_annotations", "SELECT CAST(doc_id AS VARCHAR) AS id, '[{\"aspect\":\"ECRAN\",\"polarity\":\"' || lang || '\"}]' || chr(10) || 'x' AS aspects_llm FROM documents")
def _(spark, sf):
    path = L.shared_path(spark, "annotations")
    d = A.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit('[{"aspect":"ECRAN","polarity":"'), "lang", F.lit('"}]\nx')).alias("aspects"))
    L.write_table(d, path, csv=True)
    return L.read_annotations(spark, path, "llm")


@C.query("src3_read_checkpoint", "SELECT CAST(doc_id AS VARCHAR) AS id, 'second ' || lang AS aspects FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT CAST(doc_id AS VARCHAR), 'first ' || lang FROM documents WHERE doc_id % 2 = 1")
def _(spark, sf):
    path = L.shared_path(spark, "checkpoint")
    d = A.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "lang")
    L.append_checkpoint(d.select("id", F.concat(F.lit("first "), "lang").alias("aspects"), F.lit(1).alias("seq")), path)
    L.append_checkpoint(d.where("id % 2 = 0").select("id", F.concat(F.lit("second "), "lang").alias("aspects"), F.lit(2).alias("seq")), path)
    d.where("id % 10 = 0").select(F.concat(F.lit('{"id": "'), "id").alias("value")).write.mode("append").text(path)  # broken lines
    return L.read_checkpoint(spark, path, "id string, aspects string")


@C.query("src4_read_texts", "SELECT trim(line) AS text FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> ''")
def _(spark, sf):
    path = L.shared_path(spark, "texts")
    A.table(spark, sf, "documents").select(F.concat(F.lit("  "), "text", F.lit(" \n\n")).alias("value")).write.text(path)
    return L.read_texts(spark, path)


@C.query("snk1_csv_round_trip", "SELECT doc_id, lang, text FROM documents")
def _(spark, sf):
    path = L.shared_path(spark, "csv")
    L.write_table(A.table(spark, sf, "documents").select("doc_id", "lang", "text"), path, csv=True)
    return L.read_table(spark, path, "doc_id long, lang string, text string")


@C.query("snk2_json_stats", "SELECT count(*) AS total, count(DISTINCT lang) AS languages FROM documents")
def _(spark, sf):
    path = L.shared_path(spark, "stats")
    L.write_stats(A.table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("total"), F.countDistinct("lang").alias("languages")), path)
    return spark.read.schema("total long, languages long").json(path)


@C.query("snk3_checkpoint_resume", "SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE doc_id % 3 <> 0")
def _(spark, sf):
    path = L.shared_path(spark, "resume")
    d = A.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"))
    L.append_checkpoint(d.where("id % 3 = 0").withColumn("seq", F.lit(1)), path)
    return L.unfinished(d, L.read_checkpoint(spark, path, "id string"))


# pages


@C.query("src5_extract_reviews")
def _(spark, sf):
    return H.extract_reviews(A.table(spark, sf, "pages"), F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'"), blocks=[("below_tag", "article")])


#: Eight documents a page, as the reviews of two shops and of a site of its own, with each shop's ways to say a rating and a date.
SHOPS = f"""WITH blocks AS (
  SELECT doc_id // 8 AS page_id, doc_id, row_number() OVER (PARTITION BY doc_id // 8 ORDER BY doc_id) - 1 AS pos, doc_id // 8 AS h, coalesce(source, '') AS title, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) AS body,
    CASE doc_id // 8 % 3 WHEN 0 THEN 'emag' WHEN 1 THEN 'cel' ELSE 'generic' END AS site FROM documents
), judged AS (SELECT *, CASE WHEN site = 'emag' AND body = '' THEN title ELSE body END AS t FROM blocks)
SELECT page_id, CAST(pos AS INT) AS pos, 'Product ' || page_id AS product_name, CASE WHEN site = 'emag' AND body <> '' THEN nullif(title, '') END AS review_title, sha256(t) AS review_text,
  CAST(CASE site WHEN 'cel' THEN least(5, greatest(1, h % 8)) WHEN 'generic' THEN 3 ELSE CASE doc_id % 4 WHEN 0 THEN least(5, greatest(1, h % 7)) WHEN 1 THEN least(5, 1 + h % 7) WHEN 2 THEN least(5, greatest(1, h % 60 // 10)) ELSE h % 10 END END AS INT) AS rating,
  CASE WHEN site = 'emag' THEN make_date(2018 + h % 7, 1 + h % 12, 1 + doc_id % 28) ELSE DATE '2024-01-31' END AS review_date, site AS source
FROM judged WHERE CASE site WHEN 'cel' THEN length(t) >= 10 WHEN 'generic' THEN length(t) BETWEEN 10 AND 1000
  ELSE length(t) >= 20 AND contains(t, ' ') AND NOT ({' OR '.join([*(f"starts_with(t, '{s}')" for s in FURNITURE_STARTS), *(f"contains(t, '{p}')" for p in FURNITURE_PARTS)])}) AND NOT regexp_matches(t, '^[0-9]+%') AND NOT regexp_matches(t, '^[0-9]+\\s*stele?\\(') END"""


def shop_pages(spark, sf):
    """(page_id, url, html): a page of eight documents at most, in the shops' own markup."""
    escaped = lambda c: reduce(lambda x, ab: F.replace(x, F.lit(ab[0]), F.lit(ab[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")), F.coalesce(F.col(c), F.lit("")))
    h, n = F.expr("doc_id DIV 8"), F.col("doc_id")
    month = F.element_at(F.array(*(F.when(h % 2 == 0, F.lit(a)).otherwise(F.lit(b)) for a, b in zip(MONTHS, MONTHS_RO, strict=True))), (h % 12 + 1).cast("int"))
    stars = F.when(n % 4 == 0, F.concat(F.lit('<div class="star-rating rated-'), h % 7, F.lit('"></div>'))).when(n % 4 == 1, F.expr("repeat('<i class=\"star-filled\"></i>', CAST(1 + doc_id DIV 8 % 7 AS INT))"))
    stars = stars.when(n % 4 == 2, F.concat(F.lit('<i data-rating="'), h % 60 / 10, F.lit('"></i>'))).otherwise(F.concat(F.lit("<p>Nota "), h % 10, F.lit(" din 5</p>")))
    emag = F.concat(F.lit('<div class="product-review-item"><h3 class="product-review-title">'), escaped("source"), F.lit("</h3><p>Publicat pe "), n % 28 + 1, F.lit(" "), month, F.lit(" "), h % 7 + 2018, F.lit("</p>"), stars, F.lit('<div class="js-review-body">'), escaped("text"), F.lit("</div></div>"))
    cel = F.concat(F.lit('<div class="review"><span class="star">'), h % 8, F.lit('</span><p class="review-text">'), escaped("text"), F.lit("</p></div>"))
    block = F.when(h % 3 == 0, emag).when(h % 3 == 1, cel).otherwise(F.concat(F.lit('<div class="comment">'), escaped("text"), F.lit("</div>")))
    pages = A.table(spark, sf, "documents").select(h.alias("page_id"), n, block.alias("block")).groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("doc_id", "block"))).alias("blocks"))  # eight ids a page
    k = F.col("page_id") % 3
    url = F.concat(F.when(k == 0, "https://www.emag.ro/p/").when(k == 1, "https://cel.ro/p/").otherwise("https://shop.example.org/p/"), "page_id")
    name = F.when(k == 0, '<h1 class="page-title">').when(k == 1, '<h1 class="product_title">').otherwise("<h1>")
    return pages.select("page_id", url.alias("url"), F.concat(F.lit("<html><body>"), name, F.lit("Product "), "page_id", F.lit("</h1>"), F.array_join("blocks.block", ""), F.lit("</body></html>")).alias("html"))


@C.query("src5_shop_reviews", SHOPS)
def _(spark, sf):
    out = H.extract_reviews(shop_pages(spark, sf), F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'"))
    return out.withColumns({"review_text": F.sha2("review_text", 256), "review_date": F.col("review_date").cast("date")})


@C.query("src6_detect_site", "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'emag' WHEN page_id % 5 = 1 THEN 'cel' WHEN page_id % 5 = 2 THEN 'emag' ELSE 'generic' END AS site FROM pages")
def _(spark, sf):
    p = A.table(spark, sf, "pages")
    m = F.col("page_id") % 5
    url = F.when(m == 0, F.concat(F.lit("https://www.eMAG.ro/"), "url")).when(m == 1, F.concat(F.lit("https://cel.ro/"), "url")).otherwise(F.col("url"))
    return p.select("page_id", H.detect_site(url, F.when(m == 2, "EMAG").when(m == 3, "other").when(m == 4, "")).alias("site"))


RATED = """WITH blocks AS (
  SELECT event_id, user_id % 4 AS kind, CASE event_type WHEN 'purchase' THEN 'emag' WHEN 'click' THEN 'emag' WHEN 'view' THEN 'cel' ELSE 'generic' END AS site,
    event_id % 9 - 1 AS rated, event_id % 8 AS filled, value, event_id % 10 AS said, CAST(nullif(regexp_extract(props, '([0-9]+)', 1), '') AS INT) AS near FROM events)
SELECT event_id, CAST(CASE site WHEN 'cel' THEN coalesce(least(5, greatest(1, near)), 3) WHEN 'generic' THEN 3
  ELSE CASE kind WHEN 0 THEN least(5, greatest(1, rated)) WHEN 1 THEN CASE WHEN filled > 0 THEN least(5, filled) ELSE said END WHEN 2 THEN least(5, greatest(1, trunc(value))) ELSE said END END AS INT) AS rating FROM blocks"""


@C.query("src7_parse_rating", RATED)
def _(spark, sf):
    kind, n = F.col("user_id") % 4, F.col("event_id")
    site = F.when(F.col("event_type").isin("purchase", "click"), "emag").when(F.col("event_type") == "view", "cel").otherwise("generic")
    blocks = A.table(spark, sf, "events").select(
        "event_id", site.alias("site"), F.when(kind == 0, F.concat(F.lit("rated-"), n % 9 - 1)).alias("rated_class"), F.when(kind == 1, n % 8).otherwise(0).alias("filled"),
        F.when(kind == 2, F.col("value").cast("string")).alias("data_rating"), F.concat("props", F.lit(" nota "), n % 10, F.lit(" din 5")).alias("block_text"), F.col("props").alias("rating_text"),
    )
    return blocks.select("event_id", H.parse_rating(F.col("site")).alias("rating"))


@C.query("src8_parse_review_date", "SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(ts AS DATE) END AS day FROM events")
def _(spark, sf):
    # each event's own day as a page would say it: short English or Romanian months, and a day that no month has
    month = F.element_at(F.array(*(F.when(F.col("user_id") % 2 == 0, F.lit(a)).otherwise(F.lit(b)) for a, b in zip(MONTHS, MONTHS_RO, strict=True))), F.month("ts"))
    day = F.when(F.col("event_type") == "error", F.lit("32")).otherwise(F.dayofmonth("ts").cast("string"))
    text = F.concat_ws(" ", "event_type", "props", F.lit("pe"), day, month, F.year("ts").cast("string"), F.lit("la"), F.date_format("ts", "HH:mm"))
    return A.table(spark, sf, "events").select("event_id", H.parse_review_date(text).alias("day"))


#: Documents as the blocks of three kinds of site; a third of the shop's bodies begin with its own words.
CANDIDATES = f"""WITH blocks AS (
  SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'emag' WHEN 1 THEN 'cel' ELSE 'generic' END AS site, source || ' is the title here' AS title, coalesce(text, '') AS body FROM documents
), judged AS (
  SELECT doc_id, site, CASE WHEN site <> 'emag' THEN body WHEN doc_id % 15 = 0 THEN title ELSE trim(body, ' ' || chr(9) || chr(10) || chr(13)) END AS t FROM blocks)
SELECT doc_id, sha256(t) AS review_text FROM judged WHERE CASE site WHEN 'cel' THEN length(t) >= 10 WHEN 'generic' THEN length(t) BETWEEN 10 AND 1000
  ELSE length(t) >= 20 AND contains(t, ' ') AND NOT ({' OR '.join([*(f"starts_with(t, '{s}')" for s in FURNITURE_STARTS), *(f"contains(t, '{p}')" for p in FURNITURE_PARTS)])}) AND NOT regexp_matches(t, '^[0-9]+%') AND NOT regexp_matches(t, '^[0-9]+\\s*stele?\\(') END"""


@C.query("src9_filter_candidates", CANDIDATES)
def _(spark, sf):
    n, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    site = F.when(n % 3 == 0, "emag").when(n % 3 == 1, "cel").otherwise("generic")
    body = F.when(n % 15 == 0, "review utilizator emag").when(n % 9 == 0, F.concat(F.lit("Review cumparator eMAG "), text)).otherwise(text)
    blocks = A.table(spark, sf, "documents").select("doc_id", site.alias("site"), F.concat("source", F.lit(" is the title here")).alias("title"), body.alias("body"))
    return H.filter_candidates(blocks).select("doc_id", F.sha2("review_text", 256).alias("review_text"))


@C.query("win2_per_page_cap", f"{RV} SELECT user_id, id FROM (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY id) AS k FROM reviews) WHERE k <= 20")
def _(spark, sf):
    return I.first_rows(A.reviews(spark, sf).select("user_id", "id"), ["user_id"], "id", 20)


# models: checked by tests


def labelled(spark, sf):
    d = A.table(spark, sf, "documents").join(A.table(spark, sf, "labels"), "doc_id").select("doc_id", "text", F.col("quality").cast("double").alias("label"))
    return M.with_grams(d, "text")


def halves(df):
    val = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    return df.where(~val), df.where(val)


SCORED = ["doc_id", "predicted_label", "confidence", "prob_negative", "prob_positive", "model_used"]


#: The strengths that a search tries.
STRENGTHS = [{"C": c} for c in (0.01, 0.1, 0.5, 1.0, 5.0, 10.0)]
#: Rounds, depth, step and share of rows: a few settings, as each is a sequence of trees.
TREES = [{"maxIter": 5, "maxDepth": 2, "stepSize": 0.1}, {"maxIter": 10, "maxDepth": 3, "stepSize": 0.3}, {"maxIter": 10, "maxDepth": 4, "stepSize": 0.3, "subsamplingRate": 0.8}]


@C.query("mdl1_logistic_regression")
def _(spark, sf):
    train, val = halves(labelled(spark, sf))
    model, _ = M.grid_search(train, val, "logistic", STRENGTHS)
    return M.score(model, val, "lr").select(SCORED)


@C.query("mdl2_linear_svm")
def _(spark, sf):
    train, val = halves(labelled(spark, sf))
    model, _ = M.grid_search(train, val, "svm", STRENGTHS)
    # documents without labels are scored, too
    return M.score(M.calibrated(model, train), M.with_grams(A.table(spark, sf, "documents").select("doc_id", "text"), "text"), "svm").select(SCORED)


@C.query("mdl3_boosted_trees")
def _(spark, sf):
    train, val = halves(labelled(spark, sf))
    model, _ = M.grid_search(train, val, "trees", TREES, features=M.text_features(256))
    return M.score(model, val, "xgboost").select(SCORED)


def pair_rows(spark, sf):
    """(doc_id, pairs, counts): a row for each document, written once."""
    pairs = N.to_sentence_pairs(A.annotations(spark, sf), "a0", A.aspects(spark))
    pairs = pairs.groupBy("doc_id").agg(F.collect_list(F.struct("aspect", "label_id")).alias("pairs"))  # ten aspects
    texts = A.table(spark, sf, "documents").select("doc_id", "text")
    rows = M.term_counts(M.with_grams(texts.join(pairs, "doc_id"), "text"))
    return L.once(rows.select("doc_id", "pairs", "counts"), "pairs")


@C.query("mdl4_aspect_baselines")
def _(spark, sf):
    rows = pair_rows(spark, sf)
    models = M.aspect_baselines(rows, ASPECT_NAMES)
    scored = M.score_aspects(models, rows).select("doc_id", F.map_entries("aspects").alias("aspects"), "overall.label", "overall.score")
    one = F.min(F.struct("aspects", "label", "score")).alias("one")  # of documents that share their id
    return scored.groupBy("doc_id").agg(one).select("doc_id", "one.*")


@C.query("mdl6_batch_scoring")
def _(spark, sf):
    train, _ = halves(labelled(spark, sf))
    model, _ = M.grid_search(train, train, "logistic", [{"C": 1.0}])
    M.save_model(model, path := L.shared_path(spark, "model"))
    return M.score(M.load_model(path), M.with_grams(A.table(spark, sf, "documents").select("doc_id", "text"), "text"), "lr").select(SCORED)


@C.query("mdl6_external_scorer")
def _(spark, sf):
    train, _ = halves(labelled(spark, sf))
    M.word_weights(train, "label").write.parquet(path := L.shared_path(spark, "weights"))
    docs = M.with_grams(A.table(spark, sf, "documents").select("doc_id", "text"), "text")
    return M.score_external(docs, "grams", M.WordWeights(path), "word-weights").select(SCORED)


@C.query("mdl7_grid_results")
def _(spark, sf):
    train, val = halves(labelled(spark, sf))
    return M.grid_search(train, val, "logistic", STRENGTHS)[1]


@C.query("fea6_chi_squared_features")
def _(spark, sf):
    from pyspark.ml.functions import vector_to_array

    out = M.select_features(labelled(spark, sf), 100)
    return out.select("doc_id", F.size(F.filter(vector_to_array("selected"), lambda x: x > 0)).alias("n_selected"))


@C.query("ann6_cluster_documents")
def _(spark, sf):
    return M.cluster_documents(A.table(spark, sf, "embeddings").where("embedding is not null"), "embedding", 10).select("vec_id", "topic_id")


@C.query("ann6_chosen_clusters")
def _(spark, sf):
    # no number of topics is given
    return M.choose_clusters(A.table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding", 16)[0].select("vec_id", "topic_id")


# streams and jobs


def review_stream(spark, sf):
    path = f"{sf}/events.parquet"
    schema = spark.read.parquet(path).schema
    return J.read_stream(spark, path, schema).withColumn("ts", F.col("ts").cast("timestamp"))


@C.query("st1_ingest_stream", "SELECT min(event_id) AS event_id FROM events GROUP BY 'product-' || (event_id % 97) || '|' || props || strftime(ts, '%Y-%m-%d')")
def _(spark, sf):
    store = L.shared_path(spark, "store")
    rows = review_stream(spark, sf).select("event_id", F.concat(F.lit("product-"), F.col("event_id") % 97).alias("product_name"), F.col("props").alias("review_text"), F.col("ts").alias("review_date"))
    J.ingest_stream(rows, store, order="event_id")
    return spark.read.parquet(store).select("event_id")


@C.query("st2_dedupe_stream", "SELECT DISTINCT sha256(user_id || '|' || event_type) AS content_hash FROM events")
def _(spark, sf):
    rows = review_stream(spark, sf).withColumn("content_hash", F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), "event_type"), 256))
    return J.run_available(J.dedupe_stream(rows, "content_hash", "ts", "60 days"), "append").select("content_hash")


LATEST = f"""{JU}, ended AS (SELECT job_id, min((ts, event_id)) AS e FROM job_updates WHERE status IN ('completed', 'failed', 'cancelled') GROUP BY job_id),
live AS (SELECT u.* FROM job_updates u LEFT JOIN ended e ON e.job_id = u.job_id WHERE e.e IS NULL OR (u.ts, u.event_id) <= e.e)
SELECT job_id, arg_max(status, (ts, event_id)) AS status, max(ts) AS ts, count(*) AS updates FROM live GROUP BY job_id"""


@C.query("st3_latest_job_status", LATEST)
def _(spark, sf):
    return J.latest_status(A.job_updates(spark, sf))


@C.query("st3_latest_job_status_stream", LATEST)
def _(spark, sf):
    rows = review_stream(spark, sf).selectExpr("event_id", "event_id % 500 AS job_id", A._STATUS, "ts")
    out = J.run_available(J.latest_status_stream(rows), "update", keys=["job_id"])
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


#: Event by event of every user: the admitted times of the last six hours, three at most.
ADMITTED = """WITH RECURSIVE numbered AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
judged(user_id, event_id, k, admitted, recent) AS (
  SELECT user_id, event_id, k, true, [us] FROM numbered WHERE k = 1
  UNION ALL
  SELECT n.user_id, n.event_id, n.k, len(list_filter(j.recent, lambda x: x > n.us - 21600000000)) < 3,
    CASE WHEN len(list_filter(j.recent, lambda x: x > n.us - 21600000000)) < 3 THEN list_append(list_filter(j.recent, lambda x: x > n.us - 21600000000), n.us) ELSE j.recent END
  FROM judged j JOIN numbered n ON n.user_id = j.user_id AND n.k = j.k + 1)
SELECT user_id, event_id, admitted FROM judged"""


@C.query("st4_rate_limit_stream", ADMITTED)
def _(spark, sf):
    return J.run_available(J.admitted_stream(review_stream(spark, sf), "user_id", ORDER, 21600, 3), "append")


@C.query("win7_request_rate", "SELECT event_id, count(*) OVER w AS recent, count(*) OVER w > 3 AS flagged FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW)")
def _(spark, sf):
    return J.request_rate(A.table(spark, sf, "events"), "user_id", "ts", 21600, 3).select("event_id", "recent", "flagged")


@C.query("win7_admitted", ADMITTED)
def _(spark, sf):
    return J.admitted(A.table(spark, sf, "events"), "user_id", "ts", ORDER, 21600, 3).select("user_id", "event_id", "admitted")


@C.query("st5_job_transitions", f"{JU}, p AS (SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS previous FROM job_updates) SELECT event_id, status, previous, CASE WHEN previous IS NULL THEN status = 'pending' WHEN previous = 'pending' THEN status IN ('in_progress', 'cancelled') WHEN previous = 'in_progress' THEN status IN ('completed', 'failed', 'cancelled') ELSE false END AS allowed FROM p")
def _(spark, sf):
    return J.job_transitions(A.job_updates(spark, sf)).select("event_id", "status", "previous", "allowed")


@C.query("st6_job_durations", f"{JU}, d AS (SELECT job_id, min(ts) AS created_at, min(ts) FILTER (WHERE status = 'in_progress') AS started_at, min(ts) FILTER (WHERE status IN ('completed', 'failed')) AS completed_at FROM job_updates GROUP BY job_id) SELECT *, CAST(trunc((epoch_us(completed_at) - epoch_us(started_at)) / 1000000.0) AS BIGINT) AS seconds, coalesce(completed_at, started_at, created_at) AS shown_at FROM d")
def _(spark, sf):
    return J.job_durations(A.job_updates(spark, sf))


@C.query("st7_windowed_metrics", f"{RV} SELECT product_name, CAST(created_at AS DATE) AS date, count(*) AS total, round(avg(rating), 6) AS average_rating, round(avg(sentiment_score), 6) AS average_score FROM reviews GROUP BY ALL")
def _(spark, sf):
    columns = [c.strip() for c in A._split(A._REVIEW_COLUMNS)]
    rows = review_stream(spark, sf).selectExpr(*columns)
    return J.run_available(J.windowed_metrics(rows, "created_at", "60 days"), "update", keys=["product_name", "date"])

