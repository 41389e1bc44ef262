import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from opinara.llm.merkle import field_digest, folded, lower_ascii, merkle_manifest, op12_merkle_manifest, proof_digest

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, lower=False):
    values = [None if row[c] is None else str(row[c]) for c in FIELDS]
    if lower and values[-1] is not None:
        values[-1] = "".join(c.lower() if "A" <= c <= "Z" else c for c in values[-1])
    return sha("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def tree(leaves, arity):
    """The root, and each leaf's path as (left, right) texts."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        runs = [level[i : i + arity] for i in range(0, len(level), arity)]
        for k, i in enumerate(at):
            run = runs[i // arity]
            paths[k].append(("".join(run[: i % arity]), "".join(run[i % arity + 1 :])))
        level, at = [sha("".join(r)) for r in runs], [i // arity for i in at]
    return level[0], paths


def brute(rows, arity=8):
    trees = {}
    for r in rows:
        trees.setdefault(r["lang"], []).append(r)
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    roots, below = [], {}
    for lang in order:
        own = sorted(trees[lang], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        root, paths = tree([leaf_of(r) for r in own], arity)
        roots.append(root)
        below[lang] = (own, paths)
    root, tops = tree(roots, arity)
    out = []
    for lang, subroot, top in zip(order, roots, tops, strict=True):
        for r, path in zip(*below[lang], strict=True):
            changed = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            fold = leaf_of(r, lower=changed)
            for left, right in path + top:
                fold = sha(left + fold + right)
            out.append((r["doc_id"], leaf_of(r), subroot, root, sha("".join(a + b for a, b in path + top)), fold, fold == root))
    return sorted(out, key=repr)


def of(df, arity):
    other = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, field_digest([*(F.col(c) for c in FIELDS[:-1]), lower_ascii(F.col("text"))]))
    out = merkle_manifest(df.withColumn("tampered", other), leaf=field_digest([F.col(c) for c in FIELDS]), arity=arity)
    fold = folded(F.coalesce("tampered", "leaf"), F.col("path"))
    rows = out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")), fold.alias("fold"), (fold == F.col("root")).alias("ok")).collect()
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("arity", [2, 3, 8])
def test_odd_documents_as_by_brute_force(odd_documents, arity):
    assert of(odd_documents, arity) == brute(odd_documents.collect(), arity)


def test_query_as_by_brute_force(spark, documents):
    got = op12_merkle_manifest(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got), key=repr) == brute(documents.collect())
    changed = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 3 == 0]
    assert changed and all(r.verified for r in got if r not in changed) and not all(r.verified for r in changed)


def test_lone_leaves_and_no_rows(spark, no_documents):
    one = spark.createDataFrame([(5, None, None, None, None)], no_documents.schema)
    assert of(one, 8) == brute(one.collect())
    assert of(no_documents, 8) == []


def test_columns_named_as_the_operators_own_pass(spark):
    rows = spark.createDataFrame([(i, "en", "x", "y", i % 2) for i in range(20)], "doc_id long, lang string, tree string, digest string, slot int")
    out = merkle_manifest(rows, leaf=field_digest([F.col("doc_id"), F.col("tree")]))
    assert out.columns == ["doc_id", "lang", "tree", "digest", "slot", "leaf", "subroot", "root", "path"]
    assert sorted((r.doc_id, r.tree, r.digest, r.slot) for r in out.collect()) == [(i, "x", "y", i % 2) for i in range(20)]
