"""Term statistics and features in long form (doc, term, weight); nothing dense, the vocabulary stays distributed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.functions.text import ngrams
from opinara.operators.ranges import running_sums


def words(text: Column) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t\n\x0B\f\r]+"), lambda t: t != "")


def terms(df: DataFrame, tokens: Column, *keys: str) -> DataFrame:
    """(keys, term, tf): counts combine before the shuffle."""
    return df.select(*keys, F.explode(tokens).alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))


def document_terms(df: DataFrame, tokens: Column, key: str) -> DataFrame:
    """(key, term, tf) where a key is a document: whole texts are dealt by it, and counting shuffles no row for each term.

    Rows of one key are counted together, in one task; where many rows share a key, as a class, `terms` is the way.
    """
    return df.repartition(F.col(key)).select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def counted(df: DataFrame, tokens: Column, *keys: str) -> DataFrame:
    """(keys, term, tf) of each row by itself, without a shuffle: its tokens are sorted, and equal neighbours are counted."""
    rows = df.select(*keys, F.sort_array(tokens).alias("sorted"))
    n = F.size("sorted")
    first = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i < n) & ((i == 0) | (F.get("sorted", i) != F.get("sorted", i - 1))))
    rows = rows.select(*keys, "sorted", first.alias("first"))
    after = F.slice(F.concat("first", F.array(n)), 2, F.size("first"))
    runs = F.zip_with("first", after, lambda a, b: F.struct(F.get("sorted", a).alias("term"), (b - a).cast("long").alias("tf")))
    return rows.select(*keys, F.inline(runs))


def document_grams(df: DataFrame, text: str, key: str, most: int = 2) -> DataFrame:
    """(key, term, tf) of the 1- to `most`-grams, where a key is a document.

    A document's grams are counted inside its row, so no row for each gram is shuffled or sorted. Only the grams of rows that share
    their key are added up after a shuffle, by key and gram.
    """
    texts = df.select(F.col(key).alias("_key"), F.col(text).alias("text")).where("text is not null")
    again = texts.groupBy("_key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.col("_key").alias("_again"))
    shared = F.col("_key").eqNullSafe(F.col("_again"))
    alone, rest = (counted(texts.join(again, shared, how).select("_key", words(F.col("text")).alias("words")), ngrams(F.col("words"), most), "_key") for how in ("left_anti", "left_semi"))
    both = alone.unionByName(rest.groupBy("_key", "term").agg(F.sum("tf").alias("tf")))
    return both.withColumnRenamed("_key", key)


def top_terms(counts: DataFrame, n: int, *keys: str, by: str = "tf") -> DataFrame:
    """The n largest per key, ties by term. Spark cuts each partition to n before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(F.desc(by), "term")
    return counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def word_frequency(df: DataFrame, text: str, n: int, *keys: str) -> DataFrame:
    counts = terms(df, words(F.col(text)), *keys)
    return top_terms(counts, n, *keys) if keys else counts.orderBy(F.desc("tf"), "term").limit(n)


def length_stats(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """n, and mean, median, min and max of the texts' characters and words.

    All are exact and taken from counts by length; medians are where running sums of these counts, by ranges of the length, pass
    the middle. So nothing holds the lengths of a group.
    """
    sizes = F.array(F.struct(F.lit("chars").alias("what"), F.char_length(F.coalesce(F.col(text), F.lit(""))).alias("size")), F.struct(F.lit("words").alias("what"), F.size(words(F.col(text))).alias("size")))
    points = df.select(*keys, F.explode(sizes).alias("s")).groupBy(*keys, "s.what", "s.size").agg(F.count(F.lit(1)).alias("rows"))
    line = running_sums(points, [*keys, "what"], [F.asc("size")], {"upto": "rows"}, totals={"all_rows": "rows"}, name="lengths")
    stats = []
    for c in ("chars", "words"):
        size = F.when(F.col("what") == c, F.col("size"))
        low, high = (F.min(F.when(F.col("upto") * 2 >= F.col("all_rows") + more, size)) for more in (0, 1))
        stats += [F.round(F.sum(size * F.col("rows")) / F.max(F.when(F.col("what") == c, F.col("all_rows"))), 6).alias(f"mean_{c}"), F.round((low + high) / 2, 6).alias(f"median_{c}"), F.min(size).alias(f"min_{c}"), F.max(size).alias(f"max_{c}")]
    return line.groupBy(*keys).agg(F.coalesce(F.max("all_rows"), F.lit(0)).alias("n"), *stats)


def doc_frequency(tf: DataFrame, min_df: int, max_df: float, n_docs: int) -> DataFrame:
    """(term, df) of terms in at least min_df documents and at most int(max_df n)."""
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df").between(min_df, int(max_df * n_docs)))


def vocabulary_index(vocabulary: DataFrame, parts: int = 256) -> DataFrame:
    """(term, df, index): index counts terms in order of a hash stretch and the term, without one sorted task."""
    v = vocabulary.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(parts)))
    before = v.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row per part
    inside = F.row_number().over(Window.partitionBy("part").orderBy("term")) - 1
    return v.withColumn("inside", inside).join(F.broadcast(before), "part").select("term", "df", (F.col("before") + F.col("inside")).alias("index"))


def micf_weights(tf: DataFrame, classes: DataFrame, key: str, label: str, vocabulary: DataFrame) -> DataFrame:
    """(term, micf): over the classes q the sum of ln(1 + AB / (max(1,C) max(1,D))) ln(1 + Q / max(1, classes with the term)).

    A: documents of q with the term, B: of q without it, C: others with it, D: others without it. Only (term, class)
    pairs that occur are counted; for classes without the term A is 0 and so is the addend.
    """
    sizes = classes.groupBy(label).agg(F.count(F.lit(1)).alias("n_q"))
    total = sizes.agg(F.sum("n_q").alias("n"), F.count(F.lit(1)).alias("n_classes"))
    sizes = sizes.crossJoin(F.broadcast(total))  # one row
    pairs = tf.join(vocabulary.select("term", "df"), "term").join(classes.select(key, label), key).groupBy("term", "df", label).agg(F.count(F.lit(1)).alias("a"))
    pairs = pairs.join(F.broadcast(sizes), label)  # a row per class
    per_term = F.count(F.lit(1)).over(Window.partitionBy("term"))  # at most one row per class
    a, b, c = F.col("a"), F.col("n_q") - F.col("a"), F.col("df") - F.col("a")
    d = F.col("n") - F.col("n_q") - c
    one = F.lit(1)
    part = F.log1p(a * b / (F.greatest(one, c) * F.greatest(one, d))) * F.log1p(F.col("n_classes") / F.greatest(one, F.col("classes_with")))
    return pairs.withColumn("classes_with", per_term).groupBy("term").agg(F.sum(part).alias("micf"))


def lf_micf(tf: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    return tf.join(weights, "term").select(key, "term", (F.log1p("tf") * F.col("micf")).alias("weight"))


def tfidf(tf: DataFrame, vocabulary: DataFrame, n_docs: int, key: str) -> DataFrame:
    """(1 + ln tf) (ln((1 + n) / (1 + df)) + 1), every document scaled to unit length."""
    raw = tf.join(vocabulary, "term").select(key, "term", ((1 + F.log("tf")) * (F.log((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1)).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))  # a document's own terms
    return raw.select(key, "term", (F.col("w") / norm).alias("weight"))


def most_frequent(tf: DataFrame, limit: int, min_df: int = 2) -> DataFrame:
    """(term, df, total): the `limit` commonest terms of at least min_df documents, ties by term."""
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).where(F.col("df") >= min_df).orderBy(F.desc("total"), "term").limit(limit)


def class_tfidf(tf: DataFrame, topic: str, n: int = 20) -> DataFrame:
    """The n terms of each cluster by tf ln(1 + A / f): A the mean words of a cluster, f the term's count over all."""
    by_topic = tf.groupBy(topic, "term").agg(F.sum("tf").alias("tf"))
    average = by_topic.groupBy(topic).agg(F.sum("tf").alias("n")).agg(F.avg("n").alias("mean_words"))
    total = by_topic.groupBy("term").agg(F.sum("tf").alias("f"))
    scored = by_topic.join(total, "term").crossJoin(F.broadcast(average))  # one row
    scored = scored.select(topic, "term", F.round(F.col("tf") * F.log1p(F.col("mean_words") / F.col("f")), 6).alias("score"))
    return top_terms(scored, n, topic, by="score")


def top_features(weights: DataFrame, n: int, by: str) -> DataFrame:
    return weights.orderBy(F.desc(F.abs(by)), "term").limit(n)
