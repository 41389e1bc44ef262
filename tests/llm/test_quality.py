import zlib

import numpy as np
from pyspark.sql import functions as F

from opinara.llm import quality

SF = "/root/testdata/sf0.1"


def test_held_out_labels_are_told_apart(spark):
    out = quality.op6_quality(spark, SF)
    assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    judged = out.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    assert all(h == (zlib.crc32(str(d).encode()) % 3 == 1) for d, h in zip(judged.doc_id, judged.held_out, strict=True))
    assert ((judged.score >= 0.5).astype(int) == judged.predicted).all() and judged.score.between(0, 1).all()
    test = judged[judged.held_out]
    assert (test.predicted == test.quality).mean() > 0.98
    assert test[test.quality == 1].predicted.mean() > 0.99 and test[test.quality == 0].predicted.mean() < 0.1


def test_the_score_is_the_sum_over_all_pairs():
    random = np.random.default_rng(0)
    machine = quality.Machine(np.zeros(quality.STATS), np.ones(quality.STATS), 0.1, random.normal(0, 0.1, quality.SLOTS).astype(np.float32), random.normal(0, 0.1, (quality.SLOTS, quality.RANK)).astype(np.float32))
    slots, values = machine.row(b"some words and some more words")
    pairs = sum(float(machine.factors[slots[i]] @ machine.factors[slots[j]]) * values[i] * values[j] for i in range(len(slots)) for j in range(i))
    total = machine.bias + float(machine.linear[slots] @ values) + pairs
    scores = machine.score([machine.row(b"other"), (slots, values), machine.row(None)])
    assert abs(scores[1] - 1 / (1 + np.exp(-total))) < 1e-5 and len(scores) == 3


def test_partitions_and_reruns_change_nothing(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "concat(if(id % 2 = 0, 'good words ', 'BAD !!! '), id % 97) as text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 = 0 as int) as quality")
    got = []
    for n in (3, 17):
        out = quality.score_quality(docs.repartition(n), labels.repartition(n + 1), max_rows=300)
        got.append(sorted((r.doc_id, r.score) for r in out.select("doc_id", "score").collect()))
    assert got[0] == got[1]


def test_metadata_is_an_input_where_asked_for(spark):
    docs = spark.range(400).selectExpr("id as doc_id", "'the same text' as text", "if(id % 2 = 0, 'a', null) as site")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 = 0 as int) as quality")
    out = quality.score_quality(docs, labels, metadata=("site",))
    assert out.where("predicted = cast(doc_id % 2 = 0 as int)").count() == 400
    assert quality.score_quality(docs, labels).select("score").distinct().count() == 1


def test_odd_rows_and_labels(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 0), (4, 0, 0), (5, 0, 0), (99, 1, 1), (5, 0, 1), (6, 1, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")
    for docs in (odd_documents, no_documents):
        for some in (labels, labels.where(F.lit(False)), labels.where("quality = 1")):
            out = quality.score_quality(docs, some)
            assert out.count() == docs.count() and out.where("score is null or score < 0 or score > 1").count() == 0
            assert set(out.columns) == set(docs.columns) | {"score", "predicted"}
    empty = quality.score_quality(odd_documents, labels).where("text is null or text = ''").select("score").distinct()
    assert empty.count() == 1


def test_held_out_labels_and_other_columns_change_nothing(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = documents.withColumn("lang", F.lit("x")).withColumn("source", F.lit("y"))
    a, b = (sorted(map(tuple, quality.score_quality(d, x, keep=["doc_id"]).collect())) for d, x in ((documents, labels), (other, flipped)))
    assert a == b
