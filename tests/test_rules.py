"""Hand-made rows, one for each rule that is easily got wrong, and arithmetic with known results."""

import datetime

import pytest
from pyspark.sql import functions as F

from opinara.functions import text as X
from opinara.operators import annotation as N
from opinara.operators import evaluation as E
from opinara.operators import fairness as Y
from opinara.operators import features as T
from opinara.operators import ingest as I
from opinara.operators import reviews as R
from opinara.operators import sampling as S
from opinara.sources import adapters as A
from opinara.sources import html as H


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()) or [F.lit(1)])
    return row.select(column.alias("x")).first().x


def test_overall_sentiment(spark):
    cases = [({"A": "positive", "B": "negative"}, ("negative", 0.5)), ({"A": "neutral", "B": "positive"}, ("positive", 0.5)), ({"A": "none"}, ("neutral", 0.0)), ({}, ("neutral", 0.0)), ({"A": "neutral", "B": "neutral", "C": "positive"}, ("neutral", 0.6667))]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, aspects map<string,string>")
    got = {r.i: tuple(r.o) for r in df.select("i", X.derive_overall_sentiment(F.col("aspects")).alias("o")).collect()}
    assert got == {i: c[1] for i, c in enumerate(cases)}


def test_absa_wildcard(spark):
    df = spark.createDataFrame([("absaX1", {"a": "b"}), ("absa", {"a": "b"}), ("absa_lr", {"a": "b"}), ("absa_lr2", None)], "model_used string, aspects map<string,string>")
    assert sorted(r.model_used for r in R.absa_only(df).collect()) == ["absaX1", "absa_lr"]


def test_majority_vote(spark):
    e, p = ("ECRAN", "positive"), ("PRET", "negative")
    rows = [(1, [e], [e], [p]), (2, [e, e], [], []), (3, [], None, []), (4, [p, e], [e, p], None), (5, [("X", "positive")], [], [])]
    df = spark.createDataFrame(rows, "id int, a array<struct<aspect:string,polarity:string>>, b array<struct<aspect:string,polarity:string>>, c array<struct<aspect:string,polarity:string>>")
    got = {r.id: ([tuple(x) for x in r.final], r.disagreement) for r in N.majority_vote(df, ["a", "b", "c"]).collect()}
    general = [("GENERAL", "neutral")]
    assert got == {1: ([e], False), 2: ([e, e], True), 3: (general, True), 4: ([e, p], False), 5: (general, True)}
    swapped = {r.id: [tuple(x) for x in r.final] for r in N.majority_vote(df, ["c", "b", "a"]).collect()}
    assert swapped[1] == [e] and swapped[4] == [e, p]


def test_json_forms(spark):
    got = lambda f, j: f(F.lit(j).cast("string"))
    twice, lacking = '[{"aspect":"ECRAN","polarity":"positive"},{"aspect":"ECRAN","polarity":"negative"}]', '[{"aspect":"ECRAN","polarity":"positive"},{"aspect":"PRET"}]'
    assert one(spark, got(X.parse_aspect_map, twice)) == {"ECRAN": "negative"} and one(spark, got(X.parse_aspect_map, lacking)) == {}
    assert len(one(spark, got(X.parse_aspect_list, twice))) == 2 and len(one(spark, got(X.parse_aspect_list, lacking))) == 1
    for odd in (None, "", "x", "{}", "[]", "[null]"):
        assert one(spark, got(X.parse_aspect_list, odd)) == []
        assert [tuple(x) for x in one(spark, got(X.validate_annotation, odd))] == [("GENERAL", "neutral")]


def test_text_functions(spark):
    import hashlib

    plain = one(spark, X.content_hash(F.lit("  Tel "), F.lit("Bun\t "), F.lit(None).cast("date")))
    assert plain == hashlib.sha256(b"tel|bun").hexdigest()
    dated = one(spark, X.content_hash(F.lit("Tel"), F.lit("bun"), F.lit("2024-02-03").cast("date")))
    assert dated == hashlib.sha256(b"tel|bun|2024-02-03").hexdigest()
    assert one(spark, X.sanitize_html(F.lit(" <a href=\"x\">&'\n "))) == "&lt;a href=&quot;x&quot;&gt;&amp;&#x27;"
    assert one(spark, X.sanitize_search(F.lit("  50%_\\  off "))) == "50 off"
    assert one(spark, X.clean_text(F.lit("<b>Bună</b> https://x.ro/a a@b.ro ŞI ă 10€!"))) == "bună i ă 10 !"
    assert one(spark, X.clean_text(F.lit("é ă"), exact_nfc=True)) == "ă" and one(spark, X.clean_text(F.lit(None).cast("string"))) == ""
    assert one(spark, X.basic_clean(F.lit("See WWW.x.com <i>Da</i>  acum"))) == "See Da acum"
    assert one(spark, X.preprocess(F.lit("Este un telefon a foarte bun"), ["este", "un"])) == "telefon foarte bun"
    assert one(spark, X.ngrams(F.split(F.lit("a b c"), " "), 3)) == ["a", "b", "c", "a b", "b c", "a b c"]
    assert one(spark, X.ngrams(F.split(F.lit("a"), " "))) == ["a"]
    X.register(spark)
    assert spark.sql("select content_hash('Tel ', ' Bun', null) as x").first().x == plain


def test_stars(spark):
    with pytest.raises(Exception, match="unexpected stars"):
        one(spark, I.star_to_sentiment(F.lit(3), "strict"))
    assert one(spark, I.star_to_sentiment(F.lit(3), "text")) == "positive" and one(spark, I.star_to_sentiment(F.lit(2), "number")) == 0


def test_validation(spark):
    ok = "a review that is long enough"
    rows = [("ab", ok, 5), ("a", ok, 5), ("ab", "short", 5), ("ab", ok, 0), ("ab", ok, None), ("ab", ok + "<script>x</script>", 5), ("ab", ok + " onclick = 1", 1), ("ab", ok + " drop the table", 1), ("ab", ok + " <b>&", 2), (None, ok, 1)]
    df = spark.createDataFrame([(*r, None) for r in rows], "product_name string, review_text string, rating int, review_title string").coalesce(1)
    got = [(r.reject_reason, r.review_text) for r in I.validate_reviews(df).collect()]
    assert [g[0] for g in got] == [None, "product_length", "text_length", "rating", "rating", "markup", "markup", "sql", None, "product_length"]
    assert got[8][1].endswith("&lt;b&gt;&amp;")
    assert one(spark, I.valid_url(F.lit("http://x.com/emag.ro"), ["emag.ro"])) and not one(spark, I.valid_url(F.lit("http://x.com/emag.ro"), ["emag.ro"], strict_host=True))
    assert one(spark, I.valid_url(F.lit("https://www.emag.ro/p?q=1"), ["emag.ro"], strict_host=True)) and not one(spark, I.valid_url(F.lit("ftp://emag.ro")))


def test_page_fields(spark):
    emag = lambda **v: one(spark, H.parse_rating(F.lit("emag")), **({"rated_class": None, "filled": 0, "data_rating": None, "block_text": "", "rating_text": None} | v))
    assert emag() == 5 and emag(rated_class="rated-9") == 5 and emag(rated_class="rated-x", filled=2) == 2 and emag(data_rating="4.7") == 4 and emag(block_text="9/5") == 9
    assert one(spark, H.parse_review_date(F.lit("30 Feb 2025"))) is None
    assert one(spark, H.parse_review_date(F.lit("la 3 mai 2024"))) == datetime.date(2024, 5, 3)
    assert one(spark, H.parse_review_date(F.lit("30 Feb 2025 sau 1 iunie 2025"))) == datetime.date(2025, 6, 1)


def test_pages_of_shops(spark):
    emag = """<h1 class="page-title"> Telefon X </h1><div class="product-review-item"><h3>Bun</h3><div class="star-rating rated-4"></div><div class="js-review-body">Un telefon foarte bun pentru pret</div><span>18 Dec 2023</span></div>
      <div class="product-review-item"><h3>Titlu care este destul de lung</h3><div class="js-review-body">Review cumparator eMAG</div></div><div class="product-review-item"><div class="js-review-body">scurt</div></div>"""
    cel = """<h1>Y</h1><div class="review"><p>Merge bine de tot</p><span class="stars">nota 2 din 5</span></div>"""
    other = """<h1>Z<script>no</script></h1><ul><li class="User-Comment">a comment that is long enough</li><li class="x">no</li></ul>"""
    pages = spark.createDataFrame([(1, "https://www.emag.ro/x", emag), (2, "http://cel.ro/y", cel), (3, "http://z.com", other), (4, "http://z.com", ""), (5, None, None)], "page_id long, url string, html string")
    now = F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'")
    got = sorted((r.page_id, r.pos, r.product_name, r.review_title, r.review_text, r.rating, str(r.review_date)[:10], r.source) for r in H.extract_reviews(pages, now).collect())
    assert got == [
        (1, 0, "Telefon X", "Bun", "Un telefon foarte bun pentru pret", 4, "2023-12-18", "emag"), (1, 1, "Telefon X", None, "Titlu care este destul de lung", 5, "2024-01-31", "emag"),
        (2, 0, "Y", None, "Merge bine de tot", 2, "2024-01-31", "cel"), (3, 0, "Z", None, "a comment that is long enough", 3, "2024-01-31", "generic"),
    ]


def matrix(spark, rows):
    return spark.createDataFrame([(t, p, n) for t, row in enumerate(rows) for p, n in enumerate(row)], "true_label int, pred_label int, n long")


@pytest.mark.parametrize("rows, accuracy, f1", [([[1473, 27], [23, 1477]], 0.983333, 0.983333), ([[1385, 115], [155, 1345]], 0.91, 0.909984)])
def test_known_matrices(spark, rows, accuracy, f1):
    r = E.classification_metrics(matrix(spark, rows)).first()
    assert (r.accuracy, r.f1_macro) == (accuracy, f1) and abs(r.error_rate - (1 - accuracy)) < 2e-6


def test_known_comparison(spark):
    df = spark.createDataFrame([("a", "accuracy", 0.9833333333333333), ("b", "accuracy", 0.91)], "model string, metric string, value double")
    r = E.compare_models(df, "a", "b").first()
    assert (r.difference, r.improvement) == (0.073333, 8.058608)
    assert E.winner_per_metric(df).first().winner == "a"


def test_a_class_without_rows_counts_as_zero(spark):
    df = spark.createDataFrame([(0, 0), (0, 2), (2, 2)], "y_true int, y_pred int")
    assert {(r.true_label, r.pred_label): r.n for r in E.confusion_matrix(df).collect()} == {(0, 0): 1, (0, 2): 1, (2, 0): 0, (2, 2): 1}
    none = E.class_metrics(matrix(spark, [[0, 0], [0, 0]])).collect()
    assert all(r.precision == r.recall == r.f1 == 0 for r in none)


def test_kappa(spark):
    dim = A.aspects(spark)
    pair = "array<struct<aspect:string,polarity:string>>"
    same = spark.createDataFrame([(i, [("ECRAN", p)], [("ECRAN", p)]) for i, p in enumerate(["positive", "negative", "neutral", "positive"])] + [(9, [], [])], f"doc_id int, a {pair}, b {pair}")
    got = {r.aspect: r for r in N.agreement(N.rating_cells(same, "a", "b", dim)).collect()}
    assert got["ECRAN"].detection_kappa == 1.0 and got["ECRAN"].polarity_kappa == 1.0 and got["ECRAN"].polarity_n == 4
    assert got["PRET"].detection_kappa is None and got["PRET"].polarity_kappa is None and got["PRET"].polarity_n == 0
    assert N.exact_match_rate(N.rating_cells(same, "a", "b", dim)).first().exact_match == 1.0


def test_fairness(spark):
    rows = [(1, 1, 0), (0, 1, 0), (1, 0, 0), (0, 0, 0), (1, 0, 1), (0, 0, 1)]
    df = spark.createDataFrame(rows, "y_true int, y_pred int, protected_attr int")
    r = Y.fairness_metrics(df).first()
    assert (r.spd, r.eod, r.aod, r.di) == (0.5, 0.5, 0.5, float("inf"))
    swapped = Y.fairness_metrics(df.withColumn("protected_attr", 1 - F.col("protected_attr"))).first()
    assert (swapped.spd, swapped.eod, swapped.aod, swapped.di) == (-0.5, -0.5, -0.5, 0.0)
    nothing = Y.fairness_metrics(df.withColumn("y_pred", F.lit(0))).first()
    assert (nothing.spd, nothing.di) == (0.0, 1.0)
    assert abs(Y.fair_weights(df, "y_true", "protected_attr").agg(F.avg("weight").alias("m")).first().m - 1) < 1e-9
    scored = spark.createDataFrame([(1, 0.9, 0), (0, 0.2, 0), (0, 0.4, 1), (0, 0.6, 1)], "y_true int, y_score double, protected_attr int")
    thresholds = {t.protected_attr: t.threshold for t in Y.calibrate_thresholds(scored).collect()}
    assert thresholds == {0: 0.9, 1: 0.5}
    unknown = scored.withColumn("protected_attr", F.col("protected_attr") + 5)
    assert {r.y_fair for r in Y.apply_thresholds(unknown, Y.calibrate_thresholds(scored)).collect()} == {0}


def test_null_order_and_pages(spark):
    df = spark.createDataFrame([(1, 0.5), (2, None), (3, 0.9)], "id int, sentiment_score double")
    assert [r.id for r in R.sort_reviews(df, "sentiment_score").collect()] == [2, 3, 1]
    assert [r.id for r in R.sort_reviews(df, "sentiment_score", descending=False).collect()] == [1, 3, 2]
    got = R.page(df, 1, 1, "sentiment_score").collect()
    assert [(r.id, r.page) for r in got] == [(3, 2)]


def test_products_without_reviews_and_deletes(spark):
    df = spark.createDataFrame([(1, 7, "a", None), (2, None, "a", 0.5), (3, 7, None, 0.1)], "id int, user_id int, product_name string, sentiment_score double").withColumns({"rating": F.lit(4), "sentiment_label": F.lit(None).cast("string"), "review_date": F.lit(None).cast("timestamp")})
    assert R.product_analytics(df, "zzz").count() == 0
    r = R.product_analytics(df.where("id = 1"), "a").first()
    assert r.average_score == 0.0 and r.total_reviews == 1 and r.positive == 0
    left, n = R.delete_product(df, 7, "a")
    assert sorted(x.id for x in left.collect()) == [2, 3] and n.first().deleted == 1


def test_samples_are_exact_disjoint_and_repeat(spark):
    df = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 10 == 0, "negative").otherwise("positive").alias("label"))
    quotas = S.balanced_quotas(df, None, "label", 300)
    a, b = (sorted(r.id for r in S.quota_sample(df, ["label"], quotas).collect()) for _ in range(2))
    assert a == b and len(a) == 300 and sum(x % 10 == 0 for x in a) == 150
    capped = S.quota_sample(df.where("id < 100"), ["label"], S.balanced_quotas(df.where("id < 100"), None, "label", 300))
    assert capped.groupBy("label").count().agg(F.min("count").alias("a"), F.max("count").alias("b")).first() == (10, 10)


def test_terms_of_documents_are_counted_without_a_second_shuffle(spark):
    rows = [(1, "a b a"), (1, "b"), (2, None), (3, ""), (4, "x " * 5000 + "y"), (None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("term", F.lit("other"))
    tokens = T.words(F.col("text"))
    got, plain = T.document_terms(df, tokens, "doc_id"), T.terms(df, tokens, "doc_id")
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.term)
    assert sorted(got.collect(), key=key) == sorted(plain.collect(), key=key) and got.count() == 5
    plan = T.document_terms(df, tokens, "doc_id")._jdf.queryExecution().executedPlan().toString()  # not run, so it stands there once
    assert plan.count("Exchange") == 1 and "hashpartitioning(doc_id#" in plan and "Scan ExistingRDD[doc_id" in plan
