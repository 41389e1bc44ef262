import hashlib
import re

import numpy as np

from pyspark.sql import functions as F

from opinara.llm import decontam

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=13):
    out = []
    for key, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item, it in items:
            iw = words(it)
            for i in range(max(1, len(iw) - window + 1) if iw else 0):
                win = iw[i : i + window]
                for s in range(len(w) - len(win) + 1):
                    if w[s : s + len(win)] == win:
                        hit.update(range(s, s + len(win)))
                        found.add("" if item is None else str(item))
        out.append((key, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def check(docs, items, **options):
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()], options.get("window", 13))
    out = decontam.decontaminate(docs, items, keep=["doc_id"], **options)
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.contaminated) for r in out.collect()]
    assert sorted(got, key=repr) == want


def test_tables_and_windows(spark, documents):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    check(documents, items)
    some = documents.where("doc_id < 40")
    for window in (1, 2, 3, 40):
        check(some, items.where("item_id is null or cast(item_id as string) like '%1'"), window=window)


def test_a_full_bitmap_changes_nothing(spark, documents, monkeypatch):
    """As with a benchmark of very many shingles: every place goes to the join."""
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    monkeypatch.setattr(decontam, "bitmap", lambda hashes: np.full(1 << 21, 255, np.uint8))
    check(documents.where("doc_id % 5 = 0"), items)


def test_the_documents_are_read_twice_whatever_the_benchmark(spark, documents, tmp_path):
    """Ten times the items: the documents' words move in no exchange, and each row's search is one pass."""
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    more = items.selectExpr("explode(sequence(0, 9)) as k", "*").selectExpr("concat(item_id, '-', k) as item_id", "concat(text, ' ', k) as text")
    check(documents.where("doc_id % 20 = 0"), more)
    plan = decontam.decontaminate(documents, more, keep=["doc_id"])._jdf.queryExecution().toString()
    assert "documents.parquet" not in plan.split("== Physical Plan ==")[1]


def test_odd_rows(spark, odd_documents, no_documents):
    items = spark.createDataFrame([(1, "One"), (2, "one TWO"), (3, None), (4, "..."), (5, "the same line of words that stands here and there again and again without any"), (5, "漢字"), (None, "tail"), (7, "here and there again"), (7, "here and there again")], "item_id long, text string")
    check(odd_documents, items)
    check(no_documents, items)
    check(odd_documents, items.where(F.lit(False)))


def test_columns_are_carried(spark, odd_documents):
    out = decontam.decontaminate(odd_documents, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert set(out.columns) == set(odd_documents.columns) | {"n_hit", "n_items", "items", "contaminated"} and out.count() == odd_documents.count()
