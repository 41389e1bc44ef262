from pyspark.sql import functions as F

import corpus_pipeline
from opinara.llm.quality import score_quality
from test_decontam import brute as hits
from test_mixing import brute as mixed
from test_simhash import jaccard
from test_tokens import brute as tokens

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(repr, df.collect()))


def test_each_stage_on_its_own_input(spark, documents):
    docs, items = documents, spark.read.parquet(f"{SF}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name == "quality":
            good = score_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"), keep=["doc_id"]).where("score >= 0.5")
            assert rows(out) == rows(docs.join(good, "doc_id", "left_semi")) and 0.7 * docs.count() < out.count() < docs.count()
        elif name == "near_duplicates":
            text = {r.doc_id: r.text for r in docs.collect()}
            ids = sorted(text)
            links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if jaccard(text[a], text[b]) >= 0.8]
            stay = {r.doc_id for r in out.collect()}
            gone = set(ids) - stay
            assert all(any(b == g and a not in gone or b == g for a, b in links) for g in gone), "each that goes is near one with a smaller id"
            assert len(gone) >= 0.9 * len({b for _, b in links})
            assert rows(out) == rows(docs.where(F.col("doc_id").isin(stay)))
        elif name == "decontamination":
            bad = {r[0] for r in hits([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in items.collect()]) if r[-1]}
            assert rows(out) == rows(docs.where(~F.col("doc_id").isin(bad)))
        elif name == "mixing":
            want = {k: taken // size for k, size, _, _, taken in mixed([(r.doc_id, r.source, r.text) for r in docs.collect()]) if size}
            got = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
            assert got == {k: n for k, n in want.items() if n}
        else:
            got = [tuple(r) for r in out.orderBy("start").collect()]
            assert got == tokens([(r.doc_id, r.text) for r in docs.collect()])
            break
        assert out.columns == documents.columns
        path = f"{spark.conf.get('spark.checkpoint.dir')}/stage-{name}"
        out.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)


def through(spark, docs, name):
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        path = f"{spark.conf.get('spark.checkpoint.dir')}/{name}-{k}"
        docs.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        yield docs


def stored(spark, docs, name):
    path = f"{spark.conf.get('spark.checkpoint.dir')}/{name}"
    docs.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_run_and_empty_tables(spark, no_documents):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert [d.count() for d in through(spark, stored(spark, no_documents, "none"), "empty")] == [0] * 5


def test_odd_rows_and_clashing_columns(spark, odd_documents):
    """Columns named as the operators' own, of any stage, come out as they went in."""
    names = ("copy", "copies", "score", "predicted", "n_words", "n_hit", "key", "row", "id", "u", "component_id", "fp", "target", "taken", "contaminated", "items", "a b", "x.y")
    docs = odd_documents.select("doc_id", "text", "lang", "source", "n_chars", *(F.concat(F.lit(f"{n} of "), F.coalesce("doc_id", F.lit(-1))).alias(n) for n in names))
    docs = stored(spark, docs, "odd-in")
    before = {repr(r) for r in docs.collect()}
    for name, out in zip((n for n, _ in corpus_pipeline.STAGES), through(spark, docs, "odd"), strict=True):
        if name != "token_output":
            assert out.columns == docs.columns and {repr(r) for r in out.collect()} <= before
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_what_odd_rows_become(spark, odd_documents):
    docs = stored(spark, odd_documents.select("doc_id", "text", "lang", "source", "n_chars"), "odd-rows")
    rows_ = [(r.doc_id, r.text) for r in docs.collect()]
    near = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()]
    # of texts without words one stays, with the smallest id; of equal rows one; nulls are last
    assert [k for k, t in near if not (t or "").split()] == [3]
    assert len(near) == len(set(near)) and None not in {k for k, _ in near}
    clean = corpus_pipeline.decontamination(spark, docs, SF)
    assert clean.where("text is null or text = ''").count() == sum(not t for _, t in rows_)
    mixed = [(r.doc_id, r.text) for r in corpus_pipeline.mixing(spark, docs, SF).collect()]
    assert set(mixed) <= set(rows_) and all(mixed.count(r) <= 2 * rows_.count(r) for r in rows_)
    tokens_ = corpus_pipeline.token_output(spark, docs, SF).collect()
    assert len(tokens_) == len(rows_) and min(r.n_tokens for r in tokens_) == 1
