import math
import random
import statistics

from pyspark.sql import functions as F

from opinara.operators import annotation as N
from opinara.operators import evaluation as E
from opinara.operators import fairness as Y
from opinara.operators import features as T
from opinara.operators import ranges as R


def windows(df):
    """The partition keys of the windows in a plan."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
    return [x for x in lines if "Window [" in x]


def test_sums_go_on_across_ranges(spark):
    rng = random.Random(2)
    rows = [(k, i, rng.randrange(9)) for k in ("a", "b", None) for i in rng.sample(range(10_000), 700)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert R.ranged(df, ["k"], [F.desc("i")], "t").select(R.part()).distinct().count() > 3
        got = R.running_sums(df, ["k"], [F.desc("i")], {"s": "v"}, totals={"t": "v"}, ahead={"next": "v"}).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    for k in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == k), key=lambda r: -r[1])
        sums = [sum(v for _, _, v in own[: n + 1]) for n in range(len(own))]
        expected = [(i, v, s, sums[-1], own[n + 1][2] if n + 1 < len(own) else None) for n, ((_, i, v), s) in enumerate(zip(own, sums, strict=True))]
        assert sorted((r.i, r.v, r.s, r.t, r.next) for r in got if r.k == k) == sorted(expected)
    assert R.running_sums(df.limit(0), ["k"], [F.desc("i")], {"s": "v"}).count() == 0


def test_millions_of_distinct_scores_in_one_class(spark):
    n = 2_000_000
    df = spark.range(n).select((F.col("id") % 1000 == 0).cast("int").alias("g"), ((F.xxhash64("id") % 3) == 0).cast("int").alias("y_true"), ((F.xxhash64("id") % 9_999_991) / 1e7 + F.col("id") * 1e-9).alias("y_score"))
    curve = E._curve(df, ("g",), "y_true", "y_score")
    assert windows(curve) and all("range_at#" in w or "sum(range_sum_" in w for w in windows(curve)), "a window holds one range, or a row for each range"
    auc = {r.g: r.auc for r in E.roc_auc(df, "g").collect()}
    assert auc == {r.g: r.auc for r in E.rank_auc(df, "g").collect()} and set(auc) == {0, 1}
    found = {r.g: r.average_precision for r in E.average_precision(df, "g").collect()}
    one = df.where("g = 1").select("y_true", "y_score").toPandas().sort_values("y_score", ascending=False)["y_true"].to_numpy()
    assert math.isclose(found[1], round(float(((one.cumsum() / range(1, len(one) + 1)) * one).sum() / one.sum()), 6), abs_tol=2e-6)


def test_corners_are_the_points_that_are_not_on_a_line(spark):
    rng = random.Random(3)
    rows = [(g, int(rng.random() < 0.4), round(rng.random(), 2)) for g in (0, 1) for _ in range(300)] + [(2, 0, 0.5)]
    df = spark.createDataFrame(rows, "g int, y_true int, y_score double")
    full, few = (sorted(map(tuple, E.roc_curve(df, "g", corners=c).collect()), key=lambda r: (r[0], -r[1])) for c in (False, True))
    kept = []
    for g in (0, 1, 2):
        own = [r for r in full if r[0] == g]
        kept += [r for i, r in enumerate(own) if i in (0, len(own) - 1) or (own[i + 1][2] - 2 * r[2] + own[i - 1][2], own[i + 1][3] - 2 * r[3] + own[i - 1][3]) != (0, 0)]
    assert few == kept
    assert {r.g: r.threshold for r in Y.calibrate_thresholds(df, attr="g").collect()}[2] == 0.5


def test_pages_sort_one_range_only(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"), F.col("id").alias("w"))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for skip, limit in ((0, 10), (1234, 7), (2400, 900), (4995, 10), (5000, 5), (9999, 1)):
            assert [r.v for r in R.page(df, [F.asc("v")], skip, limit).collect()] == list(range(5000))[skip : skip + limit]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_medians_are_exact_and_hold_no_group(spark):
    rng = random.Random(8)
    rows = [(g, "x " * rng.randrange(40)) for g in ("a", "b") for _ in range(rng.choice([200, 301]))] + [("c", "one two"), ("d", None), ("d", "a b c"), (None, "x")]
    df = spark.createDataFrame(rows, "g string, t string")
    got = {r.g: r for r in T.length_stats(df, "t", "g").collect()}
    for g in ("a", "b", "c", "d", None):
        for what, f in (("chars", len), ("words", lambda t: len(t.split()))):
            own = [f(t or "") for k, t in rows if k == g]
            r = got[g]
            assert (r.n, r[f"median_{what}"], r[f"min_{what}"], r[f"max_{what}"]) == (len(own), statistics.median(own), min(own), max(own))
            assert math.isclose(r[f"mean_{what}"], statistics.mean(own), abs_tol=1e-6)
    assert T.length_stats(df.limit(0), "t", "g").count() == 0
    assert T.length_stats(df, "t").first().n == len(rows)


def test_topic_words_meet_thousands_of_keywords_by_equal_strings(spark):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    words = [(k % 5, text(rng.randrange(0, 9))) for k in range(300)] + [(7, "zzz"), (1, None)]
    keywords = [(f"A{k % 10}", k % 10, text(rng.randrange(3, 8))) for k in range(10_000)]
    out = N.score_topic_words(spark.createDataFrame(words, "topic_id int, word string"), spark.createDataFrame(keywords, "aspect string, ord int, keyword string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {r.topic_id: (r.aspect, r.n) for r in out.collect()}
    by = {}
    for a, o, k in keywords:
        by.setdefault((o, a), set()).add(k)
    for topic in (0, 1, 2, 3, 4, 7):
        own = {w for t, w in words if t == topic and w is not None}
        n = {key: sum(any(k in w or w in k for k in ks) for w in own) for key, ks in by.items()}
        best = min(n, key=lambda key: (-n[key], key[0]))
        assert got[topic] == ((best[1], n[best]) if n[best] else ("GENERAL", 0))
