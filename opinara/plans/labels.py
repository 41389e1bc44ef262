"""Queries over annotations, predictions and groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinara.functions.vocab import ASPECTS, ASPECT_NAMES, TOPIC_ASPECTS
from opinara.operators import annotation as N
from opinara.operators import evaluation as E
from opinara.operators import fairness as Y
from opinara.operators import sampling as S
from opinara.plans.catalog import Catalog
from opinara.sources import adapters as A

C = Catalog()
AN, PR, PP, CO = f"WITH {A.ANNOTATIONS}", f"WITH {A.PREDICTIONS}", f"WITH {A.PAIR_PREDICTIONS}", f"WITH {A.CORPUS}"
SIDES = ["a0", "a1", "a2"]


def an(spark, sf):
    return A.annotations(spark, sf)


def voted(spark, sf):
    return N.majority_vote(an(spark, sf), SIDES)


def cells(spark, sf):
    return N.rating_cells(an(spark, sf), "a0", "a1", A.aspects(spark))


VOTED = f"""{AN}, votes AS (SELECT doc_id, aspect, ord, polarity, count(DISTINCT j) AS n FROM annotations GROUP BY ALL),
agreed AS (SELECT doc_id, aspect, ord, polarity FROM votes WHERE n >= 2),
final AS (
  SELECT doc_id, aspect, polarity, false AS fallback FROM agreed
  UNION ALL SELECT doc_id, aspect, polarity, true FROM annotations WHERE j = 0 AND doc_id NOT IN (SELECT doc_id FROM agreed)
  UNION ALL SELECT doc_id, 'GENERAL', 'neutral', true FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM agreed) AND doc_id NOT IN (SELECT doc_id FROM annotations WHERE j = 0))"""
CELLS = f"""{AN}, cells AS (SELECT d.doc_id, x.aspect, x.ord, coalesce(h.polarity, 'none') AS h, coalesce(a.polarity, 'none') AS a FROM documents d CROSS JOIN aspects x
  LEFT JOIN annotations h ON h.doc_id = d.doc_id AND h.aspect = x.aspect AND h.j = 0 LEFT JOIN annotations a ON a.doc_id = d.doc_id AND a.aspect = x.aspect AND a.j = 1)"""


def kappa_sql(agree, n, chance):
    return f"CASE WHEN {n} > 0 AND abs(1 - ({chance}) / ({n} * {n})) > 1e-12 THEN round((({agree}) / {n} - ({chance}) / ({n} * {n})) / (1 - ({chance}) / ({n} * {n})), 6) END"


def detection(keys):
    g = f"GROUP BY {keys}" if keys else ""
    k = f"{keys}," if keys else ""
    return f"""SELECT {k} CAST(x AS BIGINT) AS n_human, CAST(y AS BIGINT) AS n_auto, CAST(b AS BIGINT) AS n_both, {kappa_sql('b + n - x - y + b', 'n', 'x * y + (n - x) * (n - y)')} AS detection_kappa
    FROM (SELECT {k} count(*)::DOUBLE AS n, (count(*) FILTER (WHERE h <> 'none'))::DOUBLE AS x, (count(*) FILTER (WHERE a <> 'none'))::DOUBLE AS y, (count(*) FILTER (WHERE h <> 'none' AND a <> 'none'))::DOUBLE AS b FROM cells {g})"""


SIX = ", ".join(f"(count(*) FILTER (WHERE {s} = '{p}'))::DOUBLE AS {s}_{p}" for s in "ha" for p in ("positive", "negative", "neutral"))
POLAR = f"""SELECT aspect, CAST(n AS BIGINT) AS polarity_n, CASE WHEN n >= 2 THEN {kappa_sql('g', 'n', 'h_positive * a_positive + h_negative * a_negative + h_neutral * a_neutral')} END AS polarity_kappa
  FROM (SELECT aspect, count(*)::DOUBLE AS n, (count(*) FILTER (WHERE h = a))::DOUBLE AS g, {SIX} FROM cells WHERE h <> 'none' AND a <> 'none' GROUP BY aspect)"""
AGREE = f"SELECT d.aspect, n_human, n_auto, n_both, detection_kappa, coalesce(polarity_n, 0) AS polarity_n, polarity_kappa FROM ({detection('aspect')}) d LEFT JOIN ({POLAR}) p ON d.aspect = p.aspect"


@C.query("jn1_merge_annotators", f"{AN} SELECT d.doc_id, count(*) FILTER (WHERE j = 0) AS n0, count(*) FILTER (WHERE j = 1) AS n1, count(*) FILTER (WHERE j = 2) AS n2 FROM documents d LEFT JOIN annotations a ON a.doc_id = d.doc_id GROUP BY d.doc_id")
def _(spark, sf):
    df = an(spark, sf)
    merged = N.merge_annotators(df.select("doc_id"), *(df.where(F.size(c) > 0).select("doc_id", c) for c in SIDES), key="doc_id")
    return merged.select("doc_id", *(F.coalesce(F.size(F.coalesce(c, F.array().cast(N.PAIR))), F.lit(0)).cast("long").alias(f"n{i}") for i, c in enumerate(SIDES)))


@C.query("jn2_compile_annotations", "SELECT doc_id, doc_id % 5 = 0 AS missing, CASE WHEN doc_id % 5 = 0 THEN '[{\"aspect\":\"GENERAL\",\"polarity\":\"neutral\"}]' ELSE '[' || doc_id || ']' END AS aspects FROM documents")
def _(spark, sf):
    d = A.table(spark, sf, "documents").select("doc_id")
    done = d.where("doc_id % 5 <> 0").withColumn("aspects", F.concat(F.lit("["), "doc_id", F.lit("]")))
    return N.compile_annotations(d, done, "doc_id").select("doc_id", "missing", "aspects")


@C.query("jn3_silver", f"{CO} SELECT doc_id FROM corpus WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    return A.corpus(spark, sf).join(A.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id")


@C.query("jn4_resume", "SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'purchase')")
def _(spark, sf):
    e = A.table(spark, sf, "events")
    return e.join(e.where("event_type = 'purchase'").select("event_id"), "event_id", "left_anti").select("event_id")


@C.query("jn8_cached_annotations", f"{PP}, ann AS (SELECT doc_id, aspect, pred_label_id FROM pairs WHERE (doc_id + ord) % 3 <> 0) SELECT p.doc_id, p.aspect, p.label_id, coalesce(a.pred_label_id, 0) AS pred FROM pairs p LEFT JOIN ann a ON a.doc_id = p.doc_id AND a.aspect = p.aspect")
def _(spark, sf):
    p = A.pair_predictions(spark, sf)
    cached = p.where("(doc_id + ord) % 3 <> 0").select("doc_id", "aspect", "pred_label_id")
    return p.select("doc_id", "aspect", "label_id").join(cached, ["doc_id", "aspect"], "left").select("doc_id", "aspect", "label_id", F.coalesce("pred_label_id", F.lit(0)).alias("pred"))


TOPICS = "topics(topic_id, aspect) AS (VALUES " + ", ".join(f"({k}, '{v}')" for k, v in TOPIC_ASPECTS.items()) + "), assigned AS (SELECT doc_id, doc_id % 30 - 1 AS topic_id FROM documents)"


def assigned(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 30 - 1).alias("topic_id"))


@C.query("jn9_topic_aspects", f"WITH {TOPICS} SELECT doc_id, a.topic_id, coalesce(aspect, 'GENERAL') AS aspect FROM assigned a LEFT JOIN topics t ON a.topic_id = t.topic_id")
def _(spark, sf):
    return N.topic_aspects(assigned(spark, sf), N.topic_table(spark)).select("doc_id", "topic_id", "aspect")


@C.query("agg22_topic_coverage", f"WITH {TOPICS} SELECT coalesce(aspect, 'GENERAL') AS aspect, count(*) AS documents FROM assigned a LEFT JOIN topics t ON a.topic_id = t.topic_id WHERE a.topic_id <> -1 GROUP BY 1")
def _(spark, sf):
    return N.topic_coverage(assigned(spark, sf), N.topic_table(spark))


@C.query("agg23_topics_summary", f"WITH {TOPICS} SELECT count(DISTINCT topic_id) FILTER (WHERE topic_id <> -1) AS topics, round(avg(CASE WHEN topic_id = -1 THEN 1 ELSE 0 END), 6) AS noise FROM assigned")
def _(spark, sf):
    return N.topics_summary(assigned(spark, sf))


@C.query("set1_union_all", "SELECT doc_id, 'train' AS split FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 'test' FROM documents WHERE doc_id % 3 = 0")
def _(spark, sf):
    d = A.table(spark, sf, "documents")
    return d.where("doc_id % 3 <> 0").select("doc_id", F.lit("train").alias("split")).unionByName(d.where("doc_id % 3 = 0").select(F.lit("test").alias("split"), "doc_id"))


@C.query("ann1_majority_vote", f"{VOTED} SELECT doc_id, aspect, polarity, fallback, count(*) AS n FROM final GROUP BY ALL")
def _(spark, sf):
    return voted(spark, sf).select("doc_id", F.col("llm_fallback").alias("fallback"), F.explode("final").alias("p")).groupBy("doc_id", "p.aspect", "p.polarity", "fallback").agg(F.count(F.lit(1)).alias("n"))


@C.query("ann2_aggregation_report", f"{VOTED}, size AS (SELECT doc_id, bool_or(fallback) AS disagreement, count(*) AS n_final FROM final GROUP BY doc_id) SELECT s.*, (SELECT count(*) FROM annotations a WHERE a.doc_id = s.doc_id AND j = 0) AS n0, (SELECT count(*) FROM annotations a WHERE a.doc_id = s.doc_id AND j = 1) AS n1, (SELECT count(*) FROM annotations a WHERE a.doc_id = s.doc_id AND j = 2) AS n2 FROM size s")
def _(spark, sf):
    return voted(spark, sf).select("doc_id", "disagreement", F.size("final").cast("long").alias("n_final"), *(F.size(c).cast("long").alias(f"n{i}") for i, c in enumerate(SIDES)))


SCORES = "scores AS (SELECT doc_id AS id, aspect, ord, (doc_id * 7 + ord * 13) % 101 / 100.0 AS score, (doc_id * 3 + ord) % 7 AS p_pos, (doc_id * 5 + ord) % 7 AS p_neg, (doc_id + ord * 2) % 7 AS p_neu FROM documents, aspects WHERE doc_id % 4 <> 1 OR ord = 0)"


def scores(spark, sf):
    d = A.table(spark, sf, "documents").select(F.col("doc_id").alias("id")).crossJoin(F.broadcast(A.aspects(spark)))
    return d.where("id % 4 <> 1 or ord = 0").selectExpr("id", "aspect", "ord", "(id * 7 + ord * 13) % 101 / 100.0D AS score", "(id * 3 + ord) % 7 AS p_pos", "(id * 5 + ord) % 7 AS p_neg", "(id + ord * 2) % 7 AS p_neu")


@C.query("ann3_threshold_aspects", f"""WITH {A.CORPUS}, {A.ASPECT_VALUES}, {SCORES}, kept AS (SELECT id, aspect, CASE WHEN p_pos >= p_neg AND p_pos >= p_neu THEN 'positive' WHEN p_neg >= p_neu THEN 'negative' ELSE 'neutral' END AS polarity FROM scores WHERE score >= 0.8)
SELECT * FROM kept UNION ALL SELECT doc_id, 'GENERAL', polarity FROM corpus WHERE doc_id NOT IN (SELECT id FROM kept)""")
def _(spark, sf):
    stars = A.corpus(spark, sf).select(F.col("doc_id").alias("id"), "polarity")
    return N.threshold_aspects(scores(spark, sf), stars, 0.8)


KEYWORDS = [("BATERIE", 0, "baterie"), ("BATERIE", 0, "th"), ("ECRAN", 1, "er"), ("SUNET", 2, "an"), ("PRET", 7, "eau"), ("LIVRARE", 8, "und"), ("DESIGN", 5, "ción")]
KEYWORDS_SQL = "keywords(aspect, ord, keyword) AS (VALUES " + ", ".join(f"('{a}', {o}, '{k}')" for a, o, k in KEYWORDS) + ")"
WORDS_SQL = "words AS (SELECT DISTINCT doc_id % 20 AS topic_id, word FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS word FROM documents) WHERE word <> '')"


@C.query("ann4_score_topic_words", f"""WITH {KEYWORDS_SQL}, {WORDS_SQL}, counts AS (SELECT topic_id, aspect, ord, count(DISTINCT word) AS n FROM words, keywords WHERE contains(word, keyword) OR contains(keyword, word) GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY n DESC, ord) AS k FROM counts)
SELECT t.topic_id, coalesce(aspect, 'GENERAL') AS aspect, coalesce(n, 0) AS n FROM (SELECT DISTINCT topic_id FROM words) t LEFT JOIN best b ON b.topic_id = t.topic_id AND k = 1""")
def _(spark, sf):
    words = A.table(spark, sf, "documents").select((F.col("doc_id") % 20).alias("topic_id"), F.explode(F.split(F.lower("text"), " ")).alias("word")).where("word <> ''")
    return N.score_topic_words(words, spark.createDataFrame(KEYWORDS, "aspect string, ord int, keyword string"))


@C.query("ann7_detection_kappa", f"{CELLS} {detection('aspect')}")
def _(spark, sf):
    return N.detection_kappa(cells(spark, sf), "aspect")


@C.query("ann8_polarity_kappa", f"{CELLS} {POLAR}")
def _(spark, sf):
    return N.polarity_kappa(cells(spark, sf), "aspect")


@C.query("ann9_aggregate_detection_kappa", f"{CELLS} {detection('')}")
def _(spark, sf):
    return N.detection_kappa(cells(spark, sf))


@C.query("ann10_exact_match_rate", f"{CELLS} SELECT count(*) AS reviews, round(avg(CASE WHEN same THEN 1 ELSE 0 END), 6) AS exact_match FROM (SELECT doc_id, bool_and(h = a) AS same FROM cells GROUP BY doc_id)")
def _(spark, sf):
    return N.exact_match_rate(cells(spark, sf))


@C.query("ann11_macro_kappa", f"{CELLS} SELECT round(avg(detection_kappa), 6) AS macro_detection, round(avg(polarity_kappa), 6) AS macro_polarity FROM ({AGREE})")
def _(spark, sf):
    return N.macro_kappa(N.agreement(cells(spark, sf)))


@C.query("ann13_iaa_report", f"{CELLS} {AGREE}")
def _(spark, sf):
    return N.agreement(cells(spark, sf))


PAIRS = f"{AN}, sentence_pairs AS (SELECT d.doc_id, x.aspect, x.ord, coalesce(h.polarity, 'none') AS label, CASE coalesce(h.polarity, 'none') WHEN 'none' THEN 0 WHEN 'positive' THEN 1 WHEN 'negative' THEN 2 ELSE 3 END AS label_id, CASE WHEN d.doc_id % 10 = 0 THEN 'val' ELSE 'train' END AS split FROM documents d CROSS JOIN aspects x LEFT JOIN annotations h ON h.doc_id = d.doc_id AND h.aspect = x.aspect AND h.j = 0)"


def sentence_pairs(spark, sf):
    return N.to_sentence_pairs(an(spark, sf), "a0", A.aspects(spark)).withColumn("split", F.when(F.col("doc_id") % 10 == 0, "val").otherwise("train"))


SENTENCES = "CASE p.aspect " + " ".join(f"WHEN '{a}' THEN '{sentence}'" for a, sentence, _ in ASPECTS) + " END"
EDGE = "' ' || chr(9) || chr(10) || chr(13)"


@C.query("ann12_sentence_pairs", f"{PAIRS} SELECT p.doc_id, p.aspect, ord, label, label_id, trim(trim(coalesce(d.source, ''), {EDGE}) || ' ' || trim(coalesce(d.text, ''), {EDGE}), {EDGE}) AS text_a, {SENTENCES} AS text_b FROM sentence_pairs p JOIN documents d ON d.doc_id = p.doc_id")
def _(spark, sf):
    texts = A.table(spark, sf, "documents").select("doc_id", F.col("source").alias("title"), F.col("text").alias("content"))
    return N.to_sentence_pairs(an(spark, sf).join(texts, "doc_id"), "a0", A.aspects(spark))


@C.query("ann14_imbalance_flags", f"{PAIRS}, s AS (SELECT round(avg(CASE WHEN label = 'none' THEN 1 ELSE 0 END), 6) AS none_share, round(avg(CASE WHEN label = 'neutral' THEN 1 ELSE 0 END), 6) AS neutral_share FROM sentence_pairs) SELECT *, none_share > 0.8 AS too_many_none, neutral_share < 0.02 AS too_few_neutral FROM s")
def _(spark, sf):
    return N.imbalance_flags(sentence_pairs(spark, sf))


@C.query("agg12_label_distribution", f"{PAIRS} SELECT split, label, count(*) AS pairs, count(DISTINCT doc_id) AS reviews, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY split), 6) AS percent FROM sentence_pairs GROUP BY split, label")
def _(spark, sf):
    return N.label_distribution(sentence_pairs(spark, sf), "split")


@C.query("agg14_aspect_frequency", f"{VOTED}, said AS (SELECT DISTINCT doc_id, aspect, fallback FROM final) SELECT x.aspect, x.ord, count(doc_id) AS n, round(count(doc_id) * 100.0::DOUBLE / (SELECT count(*) FROM documents), 6) AS percent, count(*) FILTER (WHERE fallback) AS n_fallback FROM aspects x LEFT JOIN said s ON s.aspect = x.aspect GROUP BY x.aspect, x.ord")
def _(spark, sf):
    return N.aspect_frequency(voted(spark, sf), A.aspects(spark))


@C.query("agg15_disagreement_rate", f"{VOTED} SELECT count(*) AS total, count(*) FILTER (WHERE f) AS disagreements, round(avg(CASE WHEN f THEN 1 ELSE 0 END), 6) AS rate FROM (SELECT doc_id, bool_or(fallback) AS f FROM final GROUP BY doc_id)")
def _(spark, sf):
    return N.disagreement_rate(voted(spark, sf))


@C.query("agg20_annotation_stats", "SELECT count(*) AS total, count(*) FILTER (WHERE doc_id % 5 <> 0) AS annotated, count(*) FILTER (WHERE doc_id % 5 = 0) AS missing, count(*) FILTER (WHERE doc_id % 50 = 0) AS errored FROM documents")
def _(spark, sf):
    d = A.table(spark, sf, "documents").select(F.when(F.col("doc_id") % 5 != 0, "[]").alias("aspects"), F.when(F.col("doc_id") % 50 == 0, "timeout").alias("error"))
    return N.annotation_stats(d)


@C.query("mth2_class_weights", f"{PAIRS}, c AS (SELECT l.label, greatest(count(p.label), 1)::DOUBLE AS n FROM (VALUES ('none'), ('positive'), ('negative'), ('neutral')) l(label) LEFT JOIN sentence_pairs p ON p.label = l.label GROUP BY l.label) SELECT label, round(4.0 / n / sum(1.0 / n) OVER (), 6) AS weight FROM c")
def _(spark, sf):
    return N.class_weights(sentence_pairs(spark, sf))


WITH_DOMAIN = f"{CO}, domains AS (SELECT *, CASE lang WHEN 'en' THEN 'telefon' WHEN 'de' THEN 'audio_video' ELSE 'other' END AS domain FROM corpus)"


def domains(spark, sf):
    return A.corpus(spark, sf).withColumn("domain", F.when(F.col("lang") == "en", "telefon").when(F.col("lang") == "de", "audio_video").otherwise("other"))


SAMPLED = """quotas AS (SELECT domain, least(30, count(*) FILTER (WHERE polarity = 'negative'), count(*) FILTER (WHERE polarity = 'positive')) AS quota FROM domains GROUP BY domain),
sampled AS (SELECT d.*, row_number() OVER (PARTITION BY d.domain, polarity ORDER BY md5(doc_id || '42'), doc_id) AS k FROM domains d)"""


@C.query("win3_balanced_sample", f"{WITH_DOMAIN}, {SAMPLED} SELECT s.domain, polarity, doc_id FROM sampled s JOIN quotas q ON q.domain = s.domain WHERE k <= quota")
def _(spark, sf):
    d = domains(spark, sf).select("doc_id", "domain", "polarity")
    return S.quota_sample(d, ["domain", "polarity"], S.balanced_quotas(d, "domain", "polarity", 60), id_col="doc_id").select("domain", "polarity", "doc_id")


@C.query("agg13_domain_sample_stats", f"{WITH_DOMAIN}, {SAMPLED} SELECT s.domain, count(*) AS total, count(*) FILTER (WHERE polarity = 'negative') AS negative, count(*) FILTER (WHERE polarity = 'positive') AS positive, round(avg(length(content)), 1) AS mean_length, round(median(length(content)), 1) AS median_length FROM sampled s JOIN quotas q ON q.domain = s.domain WHERE k <= quota GROUP BY s.domain")
def _(spark, sf):
    d = domains(spark, sf).select("doc_id", "domain", "polarity", "content")
    return N.domain_sample_stats(S.quota_sample(d, ["domain", "polarity"], S.balanced_quotas(d, "domain", "polarity", 60), id_col="doc_id"))


@C.query("win4_gold_split", f"{CO}, ranked AS (SELECT doc_id, polarity, row_number() OVER (PARTITION BY polarity ORDER BY md5(doc_id || '42'), doc_id) AS k FROM corpus), q AS (SELECT least(200, count(*) FILTER (WHERE polarity = 'negative'), count(*) FILTER (WHERE polarity = 'positive')) AS quota FROM corpus) SELECT doc_id, polarity, CASE WHEN k <= quota THEN 'gold' ELSE 'silver' END AS split FROM ranked, q")
def _(spark, sf):
    d = A.corpus(spark, sf).select("doc_id", "polarity")
    gold = S.quota_sample(d, ["polarity"], S.balanced_quotas(d, None, "polarity", 400), id_col="doc_id")
    silver = d.join(gold.select("doc_id"), "doc_id", "left_anti")
    return gold.withColumn("split", F.lit("gold")).unionByName(silver.withColumn("split", F.lit("silver")))


@C.query("win5_train_val_split", f"{CO}, ranked AS (SELECT doc_id, polarity, row_number() OVER (PARTITION BY polarity ORDER BY md5(doc_id || '42'), doc_id) AS k, count(*) OVER (PARTITION BY polarity) AS n FROM corpus) SELECT doc_id, polarity, CASE WHEN k <= floor(n * 10 / 100) THEN 'val' ELSE 'train' END AS split FROM ranked")
def _(spark, sf):
    d = A.corpus(spark, sf).select("doc_id", "polarity")
    val = S.quota_sample(d, ["polarity"], S.share_quotas(d, "polarity", 10), id_col="doc_id").select("doc_id", F.lit("val").alias("split"))
    return d.join(val, "doc_id", "left").withColumn("split", F.coalesce("split", F.lit("train")))


@C.query("jn6_split_semi_join", f"{PAIRS} SELECT doc_id, aspect, label FROM sentence_pairs WHERE split = 'val'")
def _(spark, sf):
    p = sentence_pairs(spark, sf)
    return p.join(p.where("split = 'val'").select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "aspect", "label")


@C.query("win6_random_sample", "SELECT doc_id FROM documents ORDER BY md5(doc_id || '42'), doc_id LIMIT 100")
def _(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id").orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("42"))), "doc_id").limit(100)


# predictions


def pr(spark, sf):
    return A.predictions(spark, sf)


MATRIX = "matrix AS (SELECT t.l AS true_label, p.l AS pred_label, (SELECT count(*) FROM predictions WHERE y_true = t.l AND y_pred = p.l) AS n FROM (VALUES (0), (1)) t(l), (VALUES (0), (1)) p(l))"
CLASSES = f"""{PR}, {MATRIX}, per_class AS (SELECT l.l AS label, (SELECT sum(n) FROM matrix WHERE true_label = l.l)::DOUBLE AS support, (SELECT sum(n) FROM matrix WHERE true_label = l.l AND pred_label = l.l)::DOUBLE AS tp,
  (SELECT sum(n) FROM matrix WHERE pred_label = l.l)::DOUBLE AS predicted, (SELECT sum(n) FROM matrix)::DOUBLE AS total FROM (VALUES (0), (1)) l(l)),
m AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall, coalesce(2 * tp / nullif(predicted + support, 0), 0) AS f1 FROM per_class)"""


@C.query("evl1_confusion_matrix", f"{PR}, {MATRIX} SELECT true_label, pred_label, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY true_label), 6) AS row_share FROM matrix")
def _(spark, sf):
    return E.confusion_matrix(pr(spark, sf))


@C.query("evl2_classification_metrics", f"{CLASSES} SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(1 - sum(tp) / sum(support), 6) AS error_rate, round(avg(precision), 6) AS precision_macro, round(avg(recall), 6) AS recall_macro, round(avg(f1), 6) AS f1_macro, round(sum(precision * support) / sum(support), 6) AS precision_weighted, round(sum(recall * support) / sum(support), 6) AS recall_weighted, round(sum(f1 * support) / sum(support), 6) AS f1_weighted FROM m")
def _(spark, sf):
    return E.classification_metrics(E.confusion_matrix(pr(spark, sf)))


@C.query("evl9_one_vs_rest", f"{CLASSES} SELECT label, CAST(tp AS BIGINT) AS tp, CAST(predicted - tp AS BIGINT) AS fp, CAST(support - tp AS BIGINT) AS fn, CAST(total - predicted - support + tp AS BIGINT) AS tn, round(f1, 6) AS f1 FROM m")
def _(spark, sf):
    return E.class_metrics(E.confusion_matrix(pr(spark, sf))).select("label", "tp", "fp", "fn", "tn", F.round("f1", 6).alias("f1"))


@C.query("flt14_misclassified", f"{PR} SELECT doc_id, y_true, y_pred, CASE WHEN y_pred > y_true THEN 'false_positive' ELSE 'false_negative' END AS kind FROM predictions WHERE y_true <> y_pred")
def _(spark, sf):
    return E.misclassified(pr(spark, sf)).select("doc_id", "y_true", "y_pred", "kind")


@C.query("top5_lowest_confidence_errors", f"{PR} SELECT doc_id, y_score FROM predictions WHERE y_true <> y_pred ORDER BY greatest(y_score, 1 - y_score), doc_id LIMIT 5")
def _(spark, sf):
    return E.misclassified(pr(spark, sf)).orderBy(F.greatest("y_score", 1 - F.col("y_score")), "doc_id").limit(5).select("doc_id", "y_score")


@C.query("agg19_prediction_summary", f"{PR} SELECT count(*) AS total, count(*) FILTER (WHERE y_pred = 0) AS negative, count(*) FILTER (WHERE y_pred = 1) AS positive, round(avg(y_pred), 6) AS positive_share, round(avg(greatest(y_score, 1 - y_score)), 6) AS mean_confidence FROM predictions")
def _(spark, sf):
    return pr(spark, sf).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("y_pred") == 0).alias("negative"), F.count_if(F.col("y_pred") == 1).alias("positive"), F.round(F.avg("y_pred"), 6).alias("positive_share"), F.round(F.avg(F.greatest("y_score", 1 - F.col("y_score"))), 6).alias("mean_confidence"))


def aspect_metrics_sql(keys):
    k, g = (f"{keys},", f"GROUP BY {keys}") if keys else ("", "")
    counts = ", ".join(f"count(*) FILTER (WHERE label_id = {x} AND pred_label_id = {x})::DOUBLE AS tp{x}, count(*) FILTER (WHERE label_id <> {x} AND pred_label_id = {x})::DOUBLE AS fp{x}, count(*) FILTER (WHERE label_id = {x} AND pred_label_id <> {x})::DOUBLE AS fn{x}, count(*) FILTER (WHERE label_id > 0 AND label_id <> {x} AND pred_label_id = {x})::DOUBLE AS mfp{x}" for x in range(4))
    f = lambda tp, fp, fn: f"coalesce(2 * {tp} / nullif(2 * {tp} + {fp} + {fn}, 0), 0)"
    mean = lambda xs: f"({' + '.join(xs)}) / {len(xs)}"
    return f"""SELECT {k} n_human, n_pred, round(coalesce(b / nullif(n_pred, 0), 0), 6) AS detection_precision, round(coalesce(b / nullif(n_human, 0), 0), 6) AS detection_recall, round(coalesce(2 * b / nullif(n_pred + n_human, 0), 0), 6) AS detection_f1,
    round({mean([f'coalesce(tp{x} / nullif(tp{x} + mfp{x}, 0), 0)' for x in (1, 2, 3)])}, 6) AS polarity_precision, round({mean([f'coalesce(tp{x} / nullif(tp{x} + fn{x}, 0), 0)' for x in (1, 2, 3)])}, 6) AS polarity_recall,
    round({mean([f(f'tp{x}', f'mfp{x}', f'fn{x}') for x in (1, 2, 3)])}, 6) AS polarity_f1, round({mean([f(f'tp{x}', f'fp{x}', f'fn{x}') for x in range(4)])}, 6) AS combined_f1
    FROM (SELECT {k} count(*) FILTER (WHERE label_id > 0) AS n_human, count(*) FILTER (WHERE pred_label_id > 0) AS n_pred, count(*) FILTER (WHERE label_id > 0 AND pred_label_id > 0)::DOUBLE AS b, {counts} FROM pairs {g})"""


@C.query("evl3_aspect_metrics", f"{PP} {aspect_metrics_sql('aspect')}")
def _(spark, sf):
    return E.aspect_metrics(A.pair_predictions(spark, sf), "aspect")


@C.query("evl4_macro_over_aspects", f"{PP} SELECT round(avg(detection_f1), 6) AS macro_detection_f1, round(avg(polarity_f1), 6) AS macro_polarity_f1, round(avg(combined_f1), 6) AS macro_combined_f1 FROM ({aspect_metrics_sql('aspect')})")
def _(spark, sf):
    return E.macro_over_aspects(E.aspect_metrics(A.pair_predictions(spark, sf), "aspect"))


def two_models(spark, sf):
    p = A.pair_predictions(spark, sf)
    m = E.aspect_metrics(p, "aspect").withColumn("model", F.lit("one"))
    return m.unionByName(E.aspect_metrics(p.withColumn("pred_label_id", F.when(F.col("doc_id") % 3 == 0, F.lit(0)).otherwise(F.col("pred_label_id"))), "aspect").withColumn("model", F.lit("two")))


MODELS = f"{PP}, pairs_two AS (SELECT doc_id, aspect, ord, label_id, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE pred_label_id END AS pred_label_id FROM pairs), models AS (SELECT 'one' AS model, * FROM ({aspect_metrics_sql('aspect')}) UNION ALL SELECT 'two', * FROM ({aspect_metrics_sql('aspect').replace('FROM pairs ', 'FROM pairs_two ')}))"


@C.query("evl5_comparison_table", f"{MODELS} SELECT model, round(avg(detection_f1), 6) AS macro_detection, round(avg(polarity_f1), 6) AS macro_polarity, " + ", ".join(f"round(max(detection_f1) FILTER (WHERE aspect = '{a}'), 6) AS \"{a}_detection\", round(max(polarity_f1) FILTER (WHERE aspect = '{a}'), 6) AS \"{a}_polarity\"" for a in ASPECT_NAMES) + " FROM models GROUP BY model")
def _(spark, sf):
    return E.comparison_table(two_models(spark, sf), ASPECT_NAMES)


LONG = f"{MODELS}, long AS (SELECT model, aspect AS metric, combined_f1 AS value FROM models)"


def long_metrics(spark, sf):
    return two_models(spark, sf).select("model", F.col("aspect").alias("metric"), F.col("combined_f1").alias("value"))


@C.query("jn10_model_comparison", f"{LONG} SELECT a.metric, a.value AS first, b.value AS second, round(a.value - b.value, 6) AS difference, round((a.value - b.value) * 100 / b.value, 6) AS improvement FROM long a JOIN long b ON a.metric = b.metric AND a.model = 'one' AND b.model = 'two'")
def _(spark, sf):
    return E.compare_models(long_metrics(spark, sf), "one", "two")


@C.query("top7_winner_per_metric", f"{LONG} SELECT metric, model AS winner, value FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, model) AS k FROM long) WHERE k = 1")
def _(spark, sf):
    return E.winner_per_metric(long_metrics(spark, sf))


@C.query("evl10_absa_overall", f"{PP} {aspect_metrics_sql('')}")
def _(spark, sf):
    return E.aspect_metrics(A.pair_predictions(spark, sf), single=True)


CURVE = """points AS (SELECT {k} y_score AS score, sum(y_true) AS p, sum(1 - y_true) AS n FROM predictions GROUP BY {k} y_score),
curve AS (SELECT {k} score AS threshold, CAST(sum(p) OVER w AS BIGINT) AS tps, CAST(sum(n) OVER w AS BIGINT) AS fps FROM points WINDOW w AS ({part} ORDER BY score DESC)
  UNION ALL SELECT {k} 'infinity'::DOUBLE, 0, 0 FROM predictions GROUP BY ALL),
roc AS (SELECT *, tps::DOUBLE / max(tps) OVER ({part}) AS tpr, fps::DOUBLE / max(fps) OVER ({part}) AS fpr FROM curve)"""
ONE, EACH = CURVE.format(k="", part=""), CURVE.format(k="protected_attr,", part="PARTITION BY protected_attr")


@C.query("evl6_roc_curve", f"{PR}, {EACH} SELECT protected_attr, threshold, tps, fps, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM roc WHERE threshold <> 'infinity'")
def _(spark, sf):
    return E.roc_curve(pr(spark, sf), "protected_attr").where(F.col("threshold") != float("inf")).withColumns({c: F.round(c, 6) for c in ("tpr", "fpr")})


@C.query("evl6_roc_auc", f"{PR}, {EACH} SELECT protected_attr, round(sum((fpr - f0) * (tpr + t0) / 2), 6) AS auc, max(tps) AS positives, max(fps) AS negatives FROM (SELECT *, lag(fpr) OVER w AS f0, lag(tpr) OVER w AS t0 FROM roc WINDOW w AS (PARTITION BY protected_attr ORDER BY fpr, tpr)) GROUP BY protected_attr")
def _(spark, sf):
    return E.roc_auc(pr(spark, sf), "protected_attr")


@C.query("evl7_average_precision", f"{PR}, {ONE} SELECT round(sum((tpr - t0) * tps / (tps + fps)), 6) AS average_precision FROM (SELECT *, coalesce(lag(tpr) OVER (ORDER BY threshold DESC), 0) AS t0 FROM roc WHERE threshold <> 'infinity')")
def _(spark, sf):
    return E.average_precision(pr(spark, sf))


@C.query("evl8_rank_auc", f"{PR}, ranked AS (SELECT *, rank() OVER (PARTITION BY protected_attr ORDER BY y_score) + (count(*) OVER (PARTITION BY protected_attr, y_score) - 1) / 2.0 AS r FROM predictions) SELECT protected_attr, round((sum(r) FILTER (WHERE y_true = 1) - sum(y_true) * (sum(y_true) + 1) / 2.0) / (sum(y_true) * sum(1 - y_true)), 6)::DOUBLE AS auc FROM ranked GROUP BY protected_attr")
def _(spark, sf):
    return E.rank_auc(pr(spark, sf), "protected_attr")


# groups

RATES = """rates AS (SELECT {k} protected_attr, count(*) FILTER (WHERE y_true = 1 AND {p} = 1) AS tp, count(*) FILTER (WHERE y_true = 0 AND {p} = 1) AS fp, count(*) FILTER (WHERE y_true = 0 AND {p} = 0) AS tn, count(*) FILTER (WHERE y_true = 1 AND {p} = 0) AS fn, count(*) AS n FROM {t} GROUP BY {k} protected_attr),
full_rates AS (SELECT *, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS tpr, coalesce(fp / nullif(fp + tn, 0)::DOUBLE, 0) AS fpr, (tp + fp) / n::DOUBLE AS pr FROM rates)"""
PLAIN = RATES.format(k="", p="y_pred", t="predictions")
FOUR = """SELECT {k} round(a.pr - b.pr, 6) AS spd, round(a.tpr - b.tpr, 6) AS eod, round((a.fpr - b.fpr + a.tpr - b.tpr) / 2, 6) AS aod, CASE WHEN b.pr = 0 THEN CASE WHEN a.pr > 0 THEN 'infinity'::DOUBLE ELSE 1 END ELSE round(a.pr / b.pr, 6) END AS di
FROM full_rates a JOIN full_rates b ON a.protected_attr = 0 AND b.protected_attr = 1 {on}"""
F4 = FOUR.format(k="", on="")


@C.query("fai1_group_rates", f"{PR}, {PLAIN} SELECT protected_attr, tp, fp, tn, fn, n, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(1 - fpr, 6) AS tnr, round(1 - tpr, 6) AS fnr, round(pr, 6) AS positive_rate, round((tp + tn) / n::DOUBLE, 6) AS accuracy FROM full_rates")
def _(spark, sf):
    return Y.group_rates(pr(spark, sf)).withColumns({c: F.round(c, 6) for c in ("tpr", "fpr", "tnr", "fnr", "positive_rate", "accuracy")})


for _name in ("fai2_spd", "fai3_eod", "fai4_aod", "fai5_di"):
    C.query(_name, f"{PR}, {PLAIN} SELECT {_name[5:]} FROM ({F4})")(lambda spark, sf, c=_name[5:]: Y.fairness_metrics(pr(spark, sf)).select(c))


@C.query("fai6_verdicts", f"{PR}, {PLAIN} SELECT *, abs(spd) < 0.1 AS spd_fair, abs(eod) < 0.1 AS eod_fair, abs(aod) < 0.1 AS aod_fair, di BETWEEN 0.8 AND 1.25 AS di_pass FROM ({F4})")
def _(spark, sf):
    return Y.verdicts(Y.fairness_metrics(pr(spark, sf)))


AFTER = RATES.format(k="", p="CASE WHEN y_score >= 0.4 THEN 1 ELSE 0 END", t="predictions").replace("full_rates", "after_full").replace("rates AS", "after_rates AS").replace("FROM rates", "FROM after_rates")


@C.query("fai7_compare_fairness", f"{PR}, {PLAIN}, {AFTER}, b AS ({F4}), a AS ({F4.replace('full_rates', 'after_full')}) SELECT " + ", ".join(f"b.{c} AS {c}_before, a.{c} AS {c}_after, round(coalesce((abs(b.{c} - {g}) - abs(a.{c} - {g})) * 100 / nullif(abs(b.{c} - {g}), 0), 0), 6) AS {c}_reduction" for c, g in (("spd", 0), ("eod", 0), ("aod", 0), ("di", 1))) + " FROM b, a")
def _(spark, sf):
    p = pr(spark, sf)
    return Y.compare_fairness(Y.fairness_metrics(p), Y.fairness_metrics(p.withColumn("y_pred", (F.col("y_score") >= 0.4).cast("int"))))


@C.query("fai8_fair_weights", f"{PR}, g AS (SELECT y_true, protected_attr, count(*) AS n FROM predictions GROUP BY ALL), w AS (SELECT *, (SELECT sum(n) FROM g)::DOUBLE / ((SELECT count(*) FROM g) * n) AS weight FROM g) SELECT doc_id, p.y_true, p.protected_attr, round(weight, 6) AS weight FROM predictions p JOIN w ON w.y_true = p.y_true AND w.protected_attr = p.protected_attr")
def _(spark, sf):
    return Y.fair_weights(pr(spark, sf), "y_true", "protected_attr").select("doc_id", "y_true", "protected_attr", F.round("weight", 6).alias("weight"))


@C.query("fai9_penalised_weights", f"{PR}, g AS (SELECT y_true, protected_attr, count(*) AS n FROM predictions GROUP BY ALL), w AS (SELECT *, (SELECT sum(n) FROM g)::DOUBLE / ((SELECT count(*) FROM g) * n) AS weight FROM g) SELECT doc_id, round(pow(weight, 1.5), 6) AS weight FROM predictions p JOIN w ON w.y_true = p.y_true AND w.protected_attr = p.protected_attr")
def _(spark, sf):
    return Y.penalised_weights(Y.fair_weights(pr(spark, sf), "y_true", "protected_attr"), 0.5, "protected_attr").select("doc_id", F.round("weight", 6).alias("weight"))


KEPT = "kept AS (SELECT * FROM (SELECT *, lead(tps) OVER w - 2 * tps + lag(tps) OVER w AS d1, lead(fps) OVER w - 2 * fps + lag(fps) OVER w AS d2 FROM roc WINDOW w AS (PARTITION BY protected_attr ORDER BY threshold DESC)) WHERE d1 IS NULL OR d1 <> 0 OR d2 <> 0)"
GOAL = "goal AS (SELECT count(*) FILTER (WHERE y_true = 1 AND y_score >= 0.5)::DOUBLE / count(*) FILTER (WHERE y_true = 1) AS gt, count(*) FILTER (WHERE y_true = 0 AND y_score >= 0.5)::DOUBLE / count(*) FILTER (WHERE y_true = 0) AS gf FROM predictions)"
CALIBRATED = "SELECT protected_attr, threshold FROM (SELECT protected_attr, threshold, row_number() OVER (PARTITION BY protected_attr ORDER BY round({d}, 12), threshold DESC) AS k FROM kept, goal) WHERE k = 1"
BY_TPR, BY_BOTH = CALIBRATED.format(d="abs(tpr - gt)"), CALIBRATED.format(d="sqrt((tpr - gt) * (tpr - gt) + (fpr - gf) * (fpr - gf))")
BASE = f"{PR}, {EACH}, {KEPT}, {GOAL}"


@C.query("fai10_equal_opportunity", f"{BASE} {BY_TPR}")
def _(spark, sf):
    return Y.calibrate_thresholds(pr(spark, sf))


@C.query("fai11_equalized_odds", f"{BASE} {BY_BOTH}")
def _(spark, sf):
    return Y.calibrate_thresholds(pr(spark, sf), "equalized_odds")


def mitigated(spark, sf):
    p = pr(spark, sf)
    return Y.apply_thresholds(p, Y.calibrate_thresholds(p, "equalized_odds"))


@C.query("fai12_apply_thresholds", f"{BASE}, t AS ({BY_BOTH}) SELECT doc_id, CASE WHEN y_score >= threshold THEN 1 ELSE 0 END AS y_fair FROM predictions p JOIN t ON t.protected_attr = p.protected_attr")
def _(spark, sf):
    return mitigated(spark, sf).select("doc_id", "y_fair")


METHODS = f"{BASE}, t AS ({BY_BOTH}), methods AS (SELECT 'none' AS method, y_true, y_pred, protected_attr FROM predictions UNION ALL SELECT 'odds', y_true, CASE WHEN y_score >= threshold THEN 1 ELSE 0 END, p.protected_attr FROM predictions p JOIN t ON t.protected_attr = p.protected_attr), {RATES.format(k='method,', p='y_pred', t='methods')}, four AS ({FOUR.format(k='a.method,', on='AND a.method = b.method')}), quality AS (SELECT method, round(avg(CASE WHEN y_true = y_pred THEN 1 ELSE 0 END), 6) AS accuracy, round(2.0::DOUBLE * count(*) FILTER (WHERE y_true = 1 AND y_pred = 1) / (2 * count(*) FILTER (WHERE y_true = 1 AND y_pred = 1) + count(*) FILTER (WHERE y_true <> y_pred)), 6) AS f1 FROM methods GROUP BY method)"


def methods(spark, sf):
    m = mitigated(spark, sf)
    return m.select(F.lit("none").alias("method"), "y_true", "y_pred", "protected_attr").union(m.select(F.lit("odds"), "y_true", "y_fair", "protected_attr"))


@C.query("fai13_evaluate_mitigation", f"{METHODS} SELECT four.method, accuracy, f1, spd, eod, aod, di FROM four JOIN quality ON four.method = quality.method")
def _(spark, sf):
    return Y.mitigation_table(methods(spark, sf), "none").select("method", "accuracy", "f1", "spd", "eod", "aod", "di")


@C.query("fai16_mitigation_table", f"{METHODS}, d AS (SELECT four.method, accuracy, f1, spd, eod, aod, di FROM four JOIN quality ON four.method = quality.method) SELECT d.*, round(coalesce((abs(b.eod) - abs(d.eod)) * 100 / nullif(abs(b.eod), 0), 0), 6) AS eod_reduction, round(d.accuracy - b.accuracy, 6) AS accuracy_change, d.di >= 0.8 AS four_fifths FROM d, d b WHERE b.method = 'none'")
def _(spark, sf):
    return Y.mitigation_table(methods(spark, sf), "none")


@C.query("fai14_group_balance", f"{PR} SELECT protected_attr, y_true, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY protected_attr), 6) AS percent FROM predictions GROUP BY protected_attr, y_true")
def _(spark, sf):
    return Y.group_balance(pr(spark, sf), "protected_attr", "y_true")


@C.query("fai15_encode_protected", "SELECT doc_id, lang, CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 0 END AS protected_attr FROM documents")
def _(spark, sf):
    return Y.encode_protected(A.table(spark, sf, "documents").select("doc_id", "lang"), "lang", {"en": 1, "de": 0})
