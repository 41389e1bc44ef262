"""Sorts and filters give every row that their operator's own parameters ask for."""

from opinara.plans import registry

SF = "/root/testdata/sf0.01"


def rows(spark, name):
    return [tuple(r) for r in registry.QUERIES[name](spark, SF).collect()]


def test_sorts_give_the_whole_table(spark):
    events = [(r.event_id, r.user_id, r.ts) for r in spark.read.parquet(f"{SF}/events.parquet").collect()]
    jobs = rows(spark, "srt4_jobs_by_time")
    assert [r[0] for r in jobs] == [e for e, _, _ in sorted(events, key=lambda e: (-e[2].timestamp(), e[0]))]
    reviews = rows(spark, "srt1_sort_reviews")
    assert sorted(r[0] for r in reviews) == sorted(e for e, _, _ in events if e % 97 == 7)
    assert reviews == sorted(reviews, key=lambda r: (r[1] is not None, -(r[1] or 0), r[0]))
    products = rows(spark, "srt2_sort_products")
    assert {r[0] for r in products} == {f"product-{e % 97}" for e, u, _ in events if u == 42}
    assert products == sorted(products, key=lambda r: (-r[1], r[0]))


def test_filters_drop_no_user_or_job(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id", "event_type").collect()
    assert sorted(r[0] for r in rows(spark, "flt3_by_product")) == sorted(e.event_id for e in events if e.event_id % 97 == 7)
    assert sorted(r[0] for r in rows(spark, "flt11_list_jobs")) == sorted(e.event_id for e in events if e.event_type == "error")
    users = {e.event_id: e.user_id for e in events}
    assert max(users[r[0]] for r in rows(spark, "flt1_list_reviews")) >= 100
