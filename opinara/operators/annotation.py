"""Annotators' aspect labels: merging, voting, agreement, sentence pairs and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.functions.text import build_text
from opinara.functions.vocab import ASPECTS, ASPECT_NAMES, LABEL_IDS, POLARITIES, TOPIC_ASPECTS

PAIR = "array<struct<aspect:string,polarity:string>>"


def merge_annotators(base: DataFrame, *sides: DataFrame, key: str = "id") -> DataFrame:
    """base left-joined with each annotator; a missing one has null labels. Repeated keys multiply rows."""
    for side in sides:
        base = base.join(side, key, "left")
    return base


def compile_annotations(candidates: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Candidates with their JSON labels; a missing one gets GENERAL/neutral and missing = true."""
    out = candidates.join(done.select(key, "aspects"), key, "left")
    return out.withColumn("missing", F.col("aspects").isNull()).withColumn("aspects", F.coalesce("aspects", F.lit('[{"aspect":"GENERAL","polarity":"neutral"}]')))


def latest_records(records: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """The last record of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return records.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def majority_vote(df: DataFrame, annotators: list[str], min_votes: int = 2) -> DataFrame:
    """final (pairs that enough annotators gave, by aspect and polarity), disagreement and llm_fallback.

    Nobody agreed: the first annotator's pairs in their order, as they are, or GENERAL/neutral. No shuffle: the 30
    possible pairs are counted in each row.
    """
    every = F.expr("array(" + ", ".join(f"named_struct('aspect', '{a}', 'polarity', '{p}')" for a in ASPECT_NAMES for p in POLARITIES) + ")")
    sides = [F.coalesce(F.col(a), F.array().cast(PAIR)) for a in annotators]
    known = lambda p: p["aspect"].isin(ASPECT_NAMES) & p["polarity"].isin(POLARITIES)
    general = F.array(F.struct(F.lit("GENERAL").alias("aspect"), F.lit("neutral").alias("polarity")))
    # a lambda over one element names a value: each annotator's expression stands in the plan once, not once for each use
    named = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    agreed = lambda s: F.filter(every, lambda p: sum((F.array_contains(s[f"s{i}"], p).cast("int") for i in range(len(sides))), F.lit(0)) >= min_votes)
    first = lambda s: F.filter(s["s0"], known)
    both = named(F.struct(*(x.alias(f"s{i}") for i, x in enumerate(sides))), lambda s: F.struct(agreed(s).alias("agreed"), first(s).alias("first")))
    vote = named(both, lambda v: F.struct(F.when(F.size(v["agreed"]) > 0, v["agreed"]).when(F.size(v["first"]) > 0, v["first"]).otherwise(general).alias("final"), (F.size(v["agreed"]) == 0).alias("nobody")))
    out = df.withColumn("vote", vote)
    return out.withColumns({"final": F.col("vote.final"), "disagreement": F.col("vote.nobody"), "llm_fallback": F.col("vote.nobody")}).drop("vote")


def aspect_frequency(voted: DataFrame, dimension: DataFrame) -> DataFrame:
    """Per aspect: how many reviews have it, and how many of the fallback ones; shares in percent; zero-filled."""
    total = voted.agg(F.count(F.lit(1)).alias("total"))
    said = voted.select("llm_fallback", F.explode(F.array_distinct(F.transform("final", lambda p: p["aspect"]))).alias("aspect"))
    counts = said.groupBy("aspect").agg(F.count(F.lit(1)).alias("n"), F.count_if("llm_fallback").alias("n_fallback"))
    out = dimension.join(counts, "aspect", "left").fillna(0, ["n", "n_fallback"]).crossJoin(F.broadcast(total))  # one row
    return out.select("aspect", "ord", "n", F.round(F.coalesce(F.try_divide(F.col("n") * 100.0, "total"), F.lit(0.0)), 6).alias("percent"), "n_fallback")


def disagreement_rate(voted: DataFrame) -> DataFrame:
    return voted.agg(F.count(F.lit(1)).alias("total"), F.count_if("disagreement").alias("disagreements"), F.round(F.avg(F.col("disagreement").cast("int")), 6).alias("rate"))


def annotation_stats(df: DataFrame) -> DataFrame:
    """df: aspects (JSON, null if missing) and error."""
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("aspects").isNotNull()).alias("annotated"), F.count_if(F.col("aspects").isNull()).alias("missing"), F.count_if(F.col("error").isNotNull()).alias("errored"))


def topic_aspects(df: DataFrame, topics: DataFrame) -> DataFrame:
    """Each topic's aspect; unmapped topics and -1 are GENERAL. topics: (topic_id, aspect), a small table."""
    return df.join(topics, "topic_id", "left").withColumn("aspect", F.when(F.col("topic_id") == -1, "GENERAL").otherwise(F.coalesce("aspect", F.lit("GENERAL"))))


def topic_table(spark) -> DataFrame:
    return spark.createDataFrame(list(TOPIC_ASPECTS.items()), "topic_id long, aspect string")


def topic_coverage(df: DataFrame, topics: DataFrame) -> DataFrame:
    return topic_aspects(df.where("topic_id <> -1"), topics).groupBy("aspect").agg(F.count(F.lit(1)).alias("documents"))


def topics_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.countDistinct(F.when(F.col("topic_id") != -1, F.col("topic_id"))).alias("topics"), F.round(F.avg((F.col("topic_id") == -1).cast("int")), 6).alias("noise"))


def threshold_aspects(scores: DataFrame, stars: DataFrame, threshold: float = 0.5) -> DataFrame:
    """scores: (id, aspect, ord, score, p_pos, p_neg, p_neu); stars: (id, polarity). (id, aspect, polarity) of what is kept.

    The first of equal polarity scores wins; an id of which nothing is kept gets GENERAL with its stars' polarity.
    """
    best = F.when((F.col("p_pos") >= F.col("p_neg")) & (F.col("p_pos") >= F.col("p_neu")), "positive").when(F.col("p_neg") >= F.col("p_neu"), "negative").otherwise("neutral")
    kept = scores.where(F.col("score") >= threshold).select("id", "aspect", best.alias("polarity"))
    nothing = stars.join(kept.select("id").distinct(), "id", "left_anti").select("id", F.lit("GENERAL").alias("aspect"), "polarity")
    return kept.unionByName(nothing)


def score_topic_words(words: DataFrame, keywords: DataFrame) -> DataFrame:
    """(topic_id, aspect, n): the aspect with the most words that hold, or are part of, one of its keywords.

    words: (topic_id, word); keywords: (aspect, ord, keyword). Each distinct word's pieces of the keywords' lengths, of which the driver learns the
    distinct ones, meet equal keywords, and keywords' pieces meet equal words: joins of equal strings, for any number of keywords. The
    first of equal aspects wins; a topic without any is GENERAL.
    """
    lengths = sorted(r[0] for r in keywords.select(F.char_length("keyword")).where("keyword is not null").distinct().collect())
    wanted = words.select("topic_id", "word").where("word is not null").distinct()
    vocabulary = wanted.select("word").distinct()
    of = lambda text, n: F.transform(F.sequence(F.lit(1), F.char_length(text) - n + 1), lambda at: F.substr(text, at, n))
    pieces = lambda text, sizes: F.array_distinct(F.flatten(F.transform(F.filter(sizes, lambda n: n <= F.char_length(text)), lambda n: of(text, n))))
    inside = vocabulary.select("word", F.explode(pieces(F.col("word"), F.array(*(F.lit(n) for n in lengths)).cast("array<int>"))).alias("keyword")).join(keywords, "keyword")
    around = keywords.select("aspect", "ord", F.explode(pieces(F.col("keyword"), F.sequence(F.lit(0), F.char_length("keyword")))).alias("word")).join(vocabulary, "word")
    hits = inside.select("word", "aspect", "ord").union(around.select("word", "aspect", "ord")).distinct().join(wanted, "word")
    counts = hits.groupBy("topic_id", "aspect", "ord").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("topic_id").agg(F.min(F.struct((-F.col("n")).alias("less"), "ord", "aspect")).alias("b")).select("topic_id", "b.aspect", (-F.col("b.less")).alias("n"))
    return words.select("topic_id").distinct().join(best, "topic_id", "left").select("topic_id", F.coalesce("aspect", F.lit("GENERAL")).alias("aspect"), F.coalesce("n", F.lit(0)).alias("n"))


def kappa_of(agree: Column, n: Column, chance: Column) -> Column:
    """Cohen's kappa; null if agreement by chance is certain."""
    observed, expected = agree / n, chance / (n * n)
    return F.when((n > 0) & (F.abs(1 - expected) > 1e-12), F.round((observed - expected) / (1 - expected), 6))


def rating_cells(df: DataFrame, human: str, auto: str, dimension: DataFrame, key: str = "doc_id", *more: str) -> DataFrame:
    """(key, aspect, h, a, more): what each side says of each aspect, none if nothing; the last of repeated aspects."""
    last = lambda c: F.element_at(F.filter(F.col(c), lambda p: p["aspect"] == F.col("aspect")), -1)["polarity"]
    safe = lambda c: F.when(F.exists(F.col(c), lambda p: p["aspect"] == F.col("aspect")), last(c)).otherwise(F.lit("none"))
    return df.crossJoin(F.broadcast(dimension)).select(key, "aspect", "ord", safe(human).alias("h"), safe(auto).alias("a"), *more)  # ten aspects


def detection_kappa(cells: DataFrame, *keys: str) -> DataFrame:
    """Agreement on whether an aspect is mentioned."""
    h, a = F.col("h") != "none", F.col("a") != "none"
    d = cells.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("n"), F.count_if(h).cast("double").alias("n_h"), F.count_if(a).cast("double").alias("n_a"), F.count_if(h & a).cast("double").alias("n_both"))
    n, x, y, both = F.col("n"), F.col("n_h"), F.col("n_a"), F.col("n_both")
    agree, chance = both + (n - x - y + both), x * y + (n - x) * (n - y)
    return d.select(*keys, x.cast("long").alias("n_human"), y.cast("long").alias("n_auto"), both.cast("long").alias("n_both"), kappa_of(agree, n, chance).alias("detection_kappa"))


def polarity_kappa(cells: DataFrame, *keys: str) -> DataFrame:
    """Agreement on the polarity where both sides mention the aspect; null below two of these."""
    both = cells.where("h <> 'none' and a <> 'none'")
    parts = [F.count_if((F.col("h") == p)).cast("double").alias(f"h_{p}") for p in POLARITIES] + [F.count_if((F.col("a") == p)).cast("double").alias(f"a_{p}") for p in POLARITIES]
    d = both.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("n"), F.count_if(F.col("h") == F.col("a")).cast("double").alias("agree"), *parts)
    chance = sum((F.col(f"h_{p}") * F.col(f"a_{p}") for p in POLARITIES), F.lit(0.0))
    return d.select(*keys, F.col("n").cast("long").alias("polarity_n"), F.when(F.col("n") >= 2, kappa_of(F.col("agree"), F.col("n"), chance)).alias("polarity_kappa"))


def agreement(cells: DataFrame) -> DataFrame:
    return detection_kappa(cells, "aspect").join(polarity_kappa(cells, "aspect"), "aspect", "left").fillna(0, ["polarity_n"])


def macro_kappa(per_aspect: DataFrame) -> DataFrame:
    return per_aspect.agg(F.round(F.avg("detection_kappa"), 6).alias("macro_detection"), F.round(F.avg("polarity_kappa"), 6).alias("macro_polarity"))


def exact_match_rate(cells: DataFrame, key: str = "doc_id") -> DataFrame:
    """Share of reviews of which both sides say the same about every aspect."""
    return cells.groupBy(key).agg(F.bool_and(F.col("h") == F.col("a")).alias("same")).agg(F.count(F.lit(1)).alias("reviews"), F.round(F.avg(F.col("same").cast("int")), 6).alias("exact_match"))


def to_sentence_pairs(df: DataFrame, aspects_col: str, dimension: DataFrame, key: str = "doc_id") -> DataFrame:
    """Ten rows for a review: its key, the aspect, the label and its number; with title and content in df, the pair of texts, too.

    text_a is title and content, text_b the aspect's auxiliary sentence.
    """
    texts = {"title", "content"} <= set(df.columns)
    if texts:
        df = df.withColumn("text_a", build_text(F.col("title"), F.col("content")))
    pairs = rating_cells(df, aspects_col, aspects_col, dimension, key, *(["text_a"] if texts else []))
    ids = F.create_map(*(F.lit(x) for kv in LABEL_IDS.items() for x in kv))
    sentences = F.create_map(*(F.lit(x) for a, sentence, _ in ASPECTS for x in (a, sentence)))
    return pairs.select(key, "aspect", "ord", F.col("h").alias("label"), F.element_at(ids, F.col("h")).alias("label_id"), *(["text_a", F.element_at(sentences, F.col("aspect")).alias("text_b")] if texts else []))


def label_distribution(pairs: DataFrame, *keys: str, key: str = "doc_id") -> DataFrame:
    """Pairs, share and distinct reviews by label within the keys."""
    d = pairs.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct(key).alias("reviews"))
    total = F.sum("pairs").over(Window.partitionBy(*keys)) if keys else F.sum("pairs").over(Window.partitionBy())  # a row per label
    return d.withColumn("percent", F.round(F.col("pairs") * 100.0 / total, 6))


def imbalance_flags(pairs: DataFrame) -> DataFrame:
    share = lambda x: F.avg((F.col("label") == x).cast("int"))
    d = pairs.agg(F.round(share("none"), 6).alias("none_share"), F.round(share("neutral"), 6).alias("neutral_share"))
    return d.withColumns({"too_many_none": F.col("none_share") > 0.80, "too_few_neutral": F.col("neutral_share") < 0.02})


def class_weights(pairs: DataFrame) -> DataFrame:
    """Inverse frequency of the four labels, zero counts as one, scaled to the sum 4."""
    counts = pairs.agg(*(F.greatest(F.count_if(F.col("label") == x), F.lit(1)).alias(x) for x in LABEL_IDS))
    scale = sum((1.0 / F.col(x) for x in LABEL_IDS), F.lit(0.0))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(x).alias("label"), F.round(4.0 / F.col(x) / scale, 6).alias("weight")) for x in LABEL_IDS))).alias("w")).select("w.*")


def domain_sample_stats(sample: DataFrame) -> DataFrame:
    n = F.char_length("content")
    return sample.groupBy("domain").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("polarity") == "negative").alias("negative"), F.count_if(F.col("polarity") == "positive").alias("positive"), F.round(F.avg(n), 1).alias("mean_length"), F.round(F.median(n), 1).alias("median_length"))
