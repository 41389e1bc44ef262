"""Queries and their SQL over rows that the given tables lack: nulls, empty texts, white space of all kinds, quotes, repeated ids."""

from collections import Counter

import duckdb
import pytest

from opinara.plans import registry

ODD = [
    None, "", " ", " x ", "\tx\t", "\n\nx\r\n", "a\r\nb", "a\rb", "\r", "\r\n", "\n", "\u00a0x\u00a0", "\x0bx\x0c", "\x1cx\x1f", "\u2028x\u2029", "\u3000x", "\x00x\x00", "\x00", "\ufeffx\ufeff", "x\x85", "\x1a", "e\u0301", "\U0001f600",
    '"', '""', '"\x00a"\x00,', '"x"', 'x"', '"x', 'a"b', "a,b", ",", "\\", '\\"', "x\\", "\\N", "\\N ", "x\\\n", 'x\n"y"\nz', '"\n"', "null", "NULL", "#x", "doc_id,lang,text", "x x  x\ny X", "a b a b a",
]


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    rows = [(2 * i + k, text, *(("en", "s") if k else (text, text)), None if text is None else len(text)) for i, text in enumerate(ODD) for k in (0, 1)]
    rows += [(None, "no id at all", "de", "s", 1), (None, "at all", "de", "s", 1), (1, "a b again", None, None, None), (3, "x x x", "", "", 0)]
    path = f"{tmp_path_factory.mktemp('odd')}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 40, 3)], "doc_id long, quality long, toxic long").write.parquet(f"{path}/labels.parquet")
    return path


def both(spark, path, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{path}/{t}.parquet/*.parquet'")
    result = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in result.description]
    return Counter(map(tuple, registry.QUERIES[name](spark, path).select(*columns).collect())), Counter(result.fetchall())


def test_built_texts_follow_the_sql(spark, odd_tables):
    got, wanted = both(spark, odd_tables, "str11_build_text")
    assert got == wanted


def test_texts_come_back_from_csv_as_they_were(spark, odd_tables):
    got, wanted = both(spark, odd_tables, "snk1_csv_round_trip")
    assert got == wanted


def test_grams_of_shared_ids_are_added_up(spark, odd_tables):
    got, wanted = both(spark, odd_tables, "str13_ngrams")
    assert got == wanted and got[(None, "at all", 2)] == 1 and got[(3, "x x", 2)] == 1


def test_no_gram_is_shuffled_where_ids_are_unique(spark):
    df = registry.QUERIES["str13_ngrams"](spark, "/root/testdata/sf0.01")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    assert any("Generate" in line for line in plan) and not any("Exchange" in line and ("gram" in line or "term" in line) for line in plan)
