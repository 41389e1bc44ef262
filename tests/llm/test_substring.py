import hashlib
import random

import pytest

from opinara.llm import substring_dedup


def brute(rows, length=50):
    least = {}
    texts = [(k, (t or "").encode()) for k, t in rows]
    order = lambda k: float("inf") if k is None else k
    for k, b in texts:
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            least[s] = min(least.get(s, float("inf")), order(k))
    out = []
    for k, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if least[b[i : i + length]] < order(k):
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((k, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def check(df, **options):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = substring_dedup.dedup_substrings(df, keep=["doc_id"], **options).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept_bytes).hexdigest()) for r in got), key=repr) == brute(rows, options.get("length", 50))


def test_tables(documents, no_documents):
    check(documents)
    check(documents, batch_bytes=1 << 14, bucket_rows=1 << 9, range_rows=1 << 9, hot_rows=40, max_splitters=8)
    check(no_documents)


def test_odd_rows(odd_documents):
    check(odd_documents)


@pytest.mark.parametrize("hot", [1, 8, 1000])
def test_random_passages(spark, hot):
    chance = random.Random(hot)
    alphabet = ["ab", "a", "b", "é", " "]
    passages = ["".join(chance.choice(alphabet) for _ in range(chance.randint(20, 120))) for _ in range(12)]
    rows = [(chance.randint(1, 60), "".join(chance.choice([*passages, "".join(chance.choice(alphabet) for _ in range(30))]) for _ in range(chance.randint(0, 6)))) for _ in range(80)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), batch_bytes=1 << 11, bucket_rows=64, range_rows=32, hot_rows=hot, max_splitters=4)


def test_another_length_and_columns(spark, odd_documents):
    rows = [(1, "x" + "abcdefghijklmnopqrstuvwxyz" * 2), (2, "abcdefghijklmnopqrstuvwxyz0"), (3, "k" * 70)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), length=20)
    out = substring_dedup.dedup_substrings(odd_documents)
    assert set(out.columns) == set(odd_documents.columns) | {"n_removed", "n_spans", "kept_bytes"} and out.count() == odd_documents.count()


def test_one_lead_in_every_document(spark):
    lead = "-" * 60 + "\n"
    rows = [(i, "".join(f"{lead}chapter {i % 7} {k * i % 5} of the same book\n" for k in range(6))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (1, 100, 1 << 16):
        check(df, batch_bytes=1 << 12, range_rows=64, hot_rows=hot)


def test_batches_are_cut_by_bytes():
    import pyarrow as pa

    sizes = [10, 5000, 10, 10, 9000, 0, 700, 700, 700]
    batch = pa.RecordBatch.from_pydict({"row": list(range(9)), "text": [b"x" * n if n else None for n in sizes]})
    runs = [t.column("row").to_pylist() for t in substring_dedup._batched(iter([batch.slice(0, 4), batch.slice(4, 5)]), 2000)]
    assert runs == [[0, 1], [2, 3, 4], [5, 6, 7], [8]]
