import hashlib
import math
import os
import random
import tracemalloc
from datetime import datetime

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from opinara.llm import embedding_dedup, line_dedup, registry, url_filter
from test_simhash import brute_components  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql_agrees(spark, duck, name):
    result = duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in result.description]
    df = registry.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    tidy = lambda rows: sorted(repr([round(x, 6) if isinstance(x, float) else x for x in r]) for r in rows)
    assert tidy(tuple(r) for r in df.select(columns).collect()) == tidy(result.fetchall())


def test_an_inserted_line_moves_no_far_border(spark):
    body = [f"content line number {i}" for i in range(60)]
    df = spark.createDataFrame([(1, body), (2, ["new", *body[:30], "inserted", *body[30:]])], "doc_id long, lines array<string>")
    digests = F.transform("lines", lambda x: F.substring(F.unhex(F.sha2(x, 256)), 1, 16))
    ends = {r.doc_id: [r.lines[e - 1] for e in r.ends] for r in df.withColumn("ends", line_dedup.chunk_ends(digests, 4)).collect()}
    assert len(ends[1]) > 8 and len(set(ends[1]) ^ set(ends[2])) <= 3


def test_chunks_have_two_lines_or_more(spark, documents):
    lines = line_dedup.lines_of(F.col("text"))
    ends = documents.select(lines.alias("lines")).withColumn("ends", line_dedup.chunk_ends(F.transform("lines", lambda x: F.unhex(F.sha2(x, 256))), 4))
    for r in ends.collect():
        sizes = [b - a for a, b in zip([0, *r.ends], r.ends)]
        assert sum(sizes) == len(r.lines) and (min(sizes) > 1 or len(r.lines) == 1)


def brute_passages(rows, least=2):
    first, out = {}, []
    for n in sorted(range(len(rows)), key=lambda n: (rows[n][0] is not None, rows[n][0] or 0, n)):
        lines, gone = (rows[n][1] or "").split("\n"), set()
        for i in range(len(lines) - least + 1):
            m, j = first.setdefault(tuple(lines[i : i + least]), (n, i))
            gone |= {x for x in range(i, i + least) if (m, j) != (n, i) and (m != n or x >= j + least)}
        out.append((rows[n][0], len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return sorted(out, key=repr)


def test_passages_brute_force(spark, documents, odd_documents, no_documents):
    chance = random.Random(3)
    lines = [f"line {i}" for i in range(25)] + [""]
    texts = ["\n".join(x for _ in range(chance.randint(1, 12)) for x in [chance.choice(lines)] * chance.choice([1, 1, 1, 2, 9])) for _ in range(80)]
    own = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for df in (documents, own, odd_documents.select("doc_id", "text").coalesce(1), no_documents):
        for least in (1, 2, 3) if df is own else (2,):
            got = sorted(((r.doc_id, r.n_removed_lines, r.kept_text) for r in line_dedup.dedup_lines(df, keep=["doc_id"], least_lines=least).collect()), key=repr)
            assert got == brute_passages([(r.doc_id, r.text) for r in df.collect()], least)
    assert set(line_dedup.dedup_lines(odd_documents).columns) >= set(odd_documents.columns)


def test_op3_shrinks_a_line_repeated_many_times(spark, tmp_path):
    run = ["the same line"] * 90
    texts = ["\n".join(["a", *run, "b"]), "\n".join(["c", *run]), "alone"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in registry.QUERIES["op3_line_dedup"](spark, str(tmp_path)).collect()}
    assert [out[i].n_removed_lines for i in range(3)] == [88, 90, 0]
    assert out[1].kept_sha256 == hashlib.sha256(b"c").hexdigest()
    assert all(r.n_removed_chunks <= r.n_chunks for r in out.values())


def test_op3_removes_short_passages_among_foreign_lines(spark, tmp_path):
    texts = ["\n".join(f"line {n} {k}" for k in range(12)) for n in range(40)]
    for n in range(40):
        texts += ["\n".join([f"new {n}", *(f"line {n} {k}" for k in range(3, 5 + n % 5)), f"other {n}"])]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in registry.QUERIES["op3_line_dedup"](spark, str(tmp_path)).collect()}
    for n in range(40):
        assert out[n].n_removed_lines == 0 and 2 * out[n].n_chunks <= out[n].n_lines
        assert out[40 + n].n_removed_lines == 2 + n % 5 and out[40 + n].kept_sha256 == hashlib.sha256(f"new {n}\nother {n}".encode()).hexdigest()


def test_a_document_of_many_lines(spark):
    """Work grows with a document's lines, not with their square, repeated chunks and places between them included."""
    n = 60_000
    lines = [f"line {i * 7919 % 1000003}" for i in range(n)]
    other = [x for i, x in enumerate(lines) for x in ([x, f"foreign {i}"] if i % 50 == 0 else [x])]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(other))], "doc_id long, text string")
    out = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    want = [r[1] for r in brute_passages([(1, "\n".join(lines)), (2, "\n".join(other))])]
    assert [out[i].n_removed_lines for i in (1, 2)] == want and want[0] == 0 and out[2].n_lines == n + n // 50


def test_url_rules_in_force(spark):
    day = lambda m, d=1: datetime(2024, m, d)
    changes = [("d:example.com", day(1), "add"), ("d:example.com", day(3), "remove"), ("d:example.com", day(5), "add"), ("p:a.org/x", day(2), "add"), ("p:a.org/x", day(2), "remove"), ("d:bad", day(1), "other"), (None, day(1), "add"), ("d:b.org", None, "add"), ("d:late.org", day(12), "add"), ("d:example.com", day(1), "add")]
    captures = [
        (1, "http://www.Example.com/a", day(2)), (2, "http://example.com", day(1)), (3, "http://example.com", day(3)), (4, "https://u:p@x.example.com:8080/q?z", day(6)), (5, "http://notexample.com", day(2)),
        (6, "http://a.org/x/y", day(3)), (7, "http://a.org/xy", day(3)), (8, "http://a.org/x?y", day(2)), (9, None, day(2)), (10, "no url", day(2)), (11, "", day(2)), (12, "http://example.com", None), (13, "http://b.org", day(2)), (2, "http://example.com", day(1)), (14, "http://late.org", day(11)), (15, "http://example.com.", day(8)),
    ]
    want = {1: True, 2: True, 3: False, 4: True, 5: False, 6: True, 7: False, 8: True, 15: True}
    df = spark.createDataFrame(captures, "page_id long, url string, fetched_at timestamp").selectExpr("*", "'x' as host", "1 as row")
    rules = spark.createDataFrame(changes, "rule string, changed_at timestamp, action string")
    for days in (1, 64, 4000):
        out = url_filter.filter_urls(df, rules, period_days=days)
        assert out.count() == len(captures) and {(r.page_id, r.blocked) for r in out.collect()} == {(c[0], want.get(c[0], False)) for c in captures}
    assert url_filter.filter_urls(df, rules.limit(0)).where("blocked").count() == 0 and url_filter.filter_urls(df.limit(0), rules).count() == 0


def test_native_operators_run_no_python(spark):
    for name in ("op3_line_dedup", "op9_url_filter"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def brute_vectors(rows, threshold=0.9):
    good = {}
    for n, (_, v) in enumerate(rows):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            x = x / np.abs(x).max()
            good[n] = x / np.linalg.norm(x)
    links = {n: {m for m in good if m != n and len(good[m]) == len(good[n]) and good[n] @ good[m] >= threshold} if n in good else set() for n in range(len(rows))}
    out = []
    for n, (key, _) in enumerate(rows):
        seen, todo = {n}, [n]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        least = min((rows[m][0] for m in seen if rows[m][0] is not None), default=None)
        out.append((key, len(links[n]), least, key == least))
    return sorted(out, key=repr)


def test_vectors_brute_force(spark):
    random_ = np.random.default_rng(5)
    centre = random_.normal(size=12)
    rows = [(i, list(map(float, random_.normal(size=12)))) for i in range(150)]
    rows += [(1000 + i, list(map(float, centre + random_.normal(0, s, 12)))) for i, s in enumerate(random_.choice([0.02, 0.1, 0.3], 150))]
    rows += [(2000 + i, list(map(float, centre))) for i in range(20)] + [(3000, list(map(float, 7 * centre))), (3001, list(map(float, 1e200 * centre))), (3002, list(map(float, 1e-200 * centre)))]
    rows += [(4000, None), (4001, []), (4002, [0.0] * 12), (4003, [1.0, None] * 6), (4004, [float("nan")] * 12), (4005, [float("inf")] * 12), (4006, [1.0] * 5), (4007, [1.0] * 5), (None, [1.0] * 5), (None, list(map(float, centre))), (2000, list(map(float, centre)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as cell", "2 as n_links")
    for options in ({}, {"pivots": 40, "block_rows": 16}, {"pivots": 3}, {"threshold": 0.8, "pivots": 17}, {"max_pivots": 1}):
        got = embedding_dedup.embedding_groups(df, keep=["vec_id"], **options).collect()
        assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=repr) == sorted(((a, b, c, a == c) for a, b, c, _ in brute_vectors(rows, options.get("threshold", 0.9))), key=repr)
    assert set(embedding_dedup.embedding_groups(df).columns) == {"vec_id", "embedding", "cell", "n_links", "component_id", "kept"}
    assert embedding_dedup.embedding_groups(df.limit(0)).count() == 0 and embedding_dedup.embedding_groups(df.where("vec_id = 4000")).count() == 1


def test_a_dense_block_holds_no_pairs():
    """Of n vectors that nearly all link with each other a block holds the vectors and a slice of pairs."""
    random_, peaks = np.random.default_rng(9), []
    for n in (1000, 4000):
        v = random_.normal(size=32) + random_.normal(0, 0.28, (n, 32))
        u, many = random_.permutation(n), random_.integers(1, 4, n)
        twice = {"u": np.r_[u, u], "many": np.r_[many, many], "v": pa.ListArray.from_arrays(np.arange(0, 2 * v.size + 1, 32, dtype=np.int32), np.r_[v, v].ravel())}
        table = pa.table({"left": np.arange(2 * n) < n, "home": np.ones(2 * n, bool), "inner": np.zeros(2 * n, bool), **twice})
        tracemalloc.start()
        out = embedding_dedup._compare(32, 0.9)(table).to_pylist()
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        x = embedding_dedup.unit(v)
        linked = (np.einsum("id,jd->ij", x, x) >= 0.9) & ~np.eye(n, dtype=bool)
        assert 0.2 < linked.mean() < 0.99
        counts = np.zeros(n, np.int64)
        for r in out:
            if r["b"] is None:
                counts[r["a"]] += r["n"]
        want = np.zeros(n, np.int64)
        want[u] = linked @ many
        assert (counts == want).all()
        label, edges = np.arange(n), [(r["a"], r["b"]) for r in out if r["b"] is not None]
        for a, b in sorted(edges):
            assert b < a and label[a] == a
            label[a] = label[b]
        assert len(edges) < n and (label == embedding_dedup._forest(*(u[i] for i in np.nonzero(linked)), n)).all()
    assert peaks[1] < 200 << 20 and peaks[1] < 6 * peaks[0]


def test_long_vectors_go_in_small_blocks(spark, monkeypatch):
    rows = [(i, [float(i % 5 == k) + 0.01 * (i % 3) for k in range(6)]) for i in range(60)]
    monkeypatch.setattr(embedding_dedup, "_BLOCK_BYTES", 8 * 6 * 7)  # seven vectors
    got = embedding_dedup.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), pivots=1).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=repr) == brute_vectors(rows)


def test_pivots_are_used_where_they_pay():
    random_ = np.random.default_rng(7)
    flat = embedding_dedup.unit(random_.normal(size=(4096, 64)))
    centres = random_.normal(size=(64, 64))
    clustered = embedding_dedup.unit(centres[random_.integers(0, 64, 4096)] + random_.normal(0, 0.02, (4096, 64)))
    for vectors, many in ((flat, False), (clustered, True)):
        costs = {k: embedding_dedup._cost(vectors[2048:], vectors[:k], math.sqrt(0.2), 10_000_000, 32768) for k in (1, 8, 256)}
        assert (costs[256] < costs[1] / 8) == many
