import hashlib
import math
import re
from collections import defaultdict

from opinara.llm import mixing

SF = "/root/testdata/sf0.001"


def digits(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:12], 16)


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    want, full = share * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in full]
        left = want - sum(most * sizes[s] for s in full)
        got = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if got[s] >= most * sizes[s]}
        if not over:
            return got | {s: most * sizes[s] for s in full}
        full |= over


def brute(rows, group_rows=8192):
    sized = [(k, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), t or "") for k, s, t in rows]
    total = defaultdict(int)
    for _, s, n, _ in sized:
        total[s] += n
    target, buckets, out = targets(total), max(1, math.ceil(len(rows) / group_rows)), []
    band = lambda n: max(1, n.bit_length()) * 16 + (n >> max(max(1, n.bit_length()) - 4, 0))
    for s in total:
        rate = min(2.0, target[s] / total[s]) if total[s] else 0.0
        offset = digits("42:" + ("" if s is None else "s" + s)) / float(1 << 48)
        mine = sorted(((k, n, t) for k, x, n, t in sized if x == s), key=lambda r: (band(r[1]), digits(r[2] if r[0] is None else str(r[0])) % buckets, r[1], r[0] is not None, r[0] or 0))
        for i, (k, n, _) in enumerate(mine):
            out.append((k, n, total[s], target[s], (math.floor((i + 1) * rate + offset) - math.floor(i * rate + offset)) * n))
    return out


def check(df, **options):
    rows = [(r.doc_id, r.source, r.text) for r in df.select("doc_id", "source", "text").collect()]
    got = [(r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in mixing.mix_sources(df, keep=["doc_id"], **options).collect()]
    want = [(*x[:3], round(x[3], 6), x[4]) for x in brute(rows, options.get("group_rows", 8192))]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return got


def test_tables(documents, odd_documents, no_documents):
    check(documents)
    check(documents, group_rows=16)
    check(odd_documents)
    check(odd_documents, group_rows=2)
    check(no_documents)


def test_the_mix_keeps_its_promises(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = mixing.mix_sources(df).selectExpr("source", "target", "taken", "size").collect()
    largest, taken, target = defaultdict(int), defaultdict(int), {}
    for r in out:
        assert r.taken <= 2 * r["size"]
        largest[r.source] = max(largest[r.source], r["size"])
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= largest[s] + 1 for s in target)


def test_reruns_agree_and_columns_are_carried(odd_documents):
    runs = [mixing.mix_sources(odd_documents) for _ in range(2)]
    assert set(runs[0].columns) == set(odd_documents.columns) | {"source_size", "target", "copies"} and runs[0].count() == odd_documents.count()
    assert sorted(map(repr, runs[0].collect())) == sorted(map(repr, runs[1].collect()))
