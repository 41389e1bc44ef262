"""URL filters by a temporal list join.

Dated changes of a list (a rule added or removed on a day) become validity intervals; every capture is judged by
the entries that were in force when it was fetched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.llm._shared import kept, q, written

_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
_ADDED = ("host", "blocked", "n_rules", "rules")


def host_of(url: Column) -> Column:
    """The lower-case host without user, port and closing dot; '' if there is none."""
    return F.coalesce(F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"\.$", ""), F.lit(""))


def keys_of(url: Column) -> Column:
    """What rules can name: the host and each parent domain (d:), two labels at least, and the host with each leading
    part of the path (p:), the whole path without query and fragment included."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    path = F.filter(F.split(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1), "/"), lambda x: x != "")
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    prefixes = F.when(F.size(path) > 0, F.transform(F.sequence(F.lit(1), F.size(path)), lambda i: F.concat(F.lit("p:"), host, F.lit("/"), F.array_join(F.slice(path, 1, i), "/"))))
    return F.when(host != "", F.array_distinct(F.concat(domains, F.coalesce(prefixes, F.array().cast("array<string>"))))).otherwise(F.array().cast("array<string>"))


def intervals(changes: DataFrame, *, rule_col: str = "rule", time_col: str = "changed_at", action_col: str = "action") -> DataFrame:
    """(rule, since, until) from dated changes; until is null while the rule is in force.

    A rule is in force from an 'add' up to, but not at, the next change of it. Of changes at one time an 'add' counts;
    repeated ones count once. Changes with a null rule or time, or another action than add and remove, are no changes.
    """
    known = changes.select(F.col(q(rule_col)).alias("rule"), F.col(q(time_col)).alias("since"), F.col(q(action_col)).alias("action")).where("rule is not null and since is not null and action in ('add', 'remove')")
    known = known.groupBy("rule", "since").agg(F.max(F.col("action") == "add").alias("on"))
    # one rule's own dated changes: a list's history, not the corpus
    return known.withColumn("until", F.lead("since").over(Window.partitionBy("rule").orderBy("since"))).where("on").select("rule", "since", "until")


def filter_urls(captures: DataFrame, changes: DataFrame, *, url_col: str = "url", time_col: str = "fetched_at", period_days: int = 64, keep: list[str] | None = None) -> DataFrame:
    """Every capture with host, n_rules, rules (those in force for it, sorted) and blocked (there is one).

    A rule 'd:example.com' names the domain and all its subdomains, 'p:example.com/a/b' the path and all below it on that host.
    A capture with a null URL, no host or a null time matches nothing and stays, not blocked. Repeated rows are judged each.
    Other columns are carried along (`keep`: only these); input columns named as an added one are replaced. Empty
    tables give an empty result, or one in which nothing is blocked.

    Intervals are cut at periods of `period_days`, and the join is on rule and period, so a rule with a long history meets a
    capture only with the few intervals of its period. Captures are joined by their keys alone, without their other
    columns; the keys' shuffle is on rule and period, and a very common host is split by Spark's adaptive skew join.
    """
    carried = kept(captures, keep, _ADDED)
    base = written(captures.select(F.monotonically_increasing_id().alias("row"), *(F.col(q(c)).alias(f"c{i}") for i, c in enumerate(carried)), F.col(q(url_col)).cast("string").alias("url"), F.col(q(time_col)).cast("timestamp").alias("at")), "captures")
    period = lambda t: F.floor(F.unix_seconds(t) / (86400 * period_days))
    last = base.agg(F.max("at").alias("at")).first()["at"]
    spans = intervals(changes).select("rule", F.col("since").cast("timestamp").alias("since"), F.col("until").cast("timestamp").alias("until"))
    spans = spans.where(F.col("since") <= F.lit(last)).select("rule", "since", "until", F.explode(F.sequence(period(F.col("since")), period(F.least(F.coalesce("until", F.lit(last)), F.lit(last))))).alias("period"))
    asked = base.where("at is not null").select("row", "at", period(F.col("at")).alias("period"), F.explode(keys_of(F.col("url"))).alias("rule"))
    hits = asked.join(spans, ["rule", "period"]).where((F.col("at") >= F.col("since")) & (F.col("until").isNull() | (F.col("at") < F.col("until"))))
    found = hits.groupBy("row").agg(F.sort_array(F.collect_set("rule")).alias("rules"))
    out = base.join(found, "row", "left").withColumn("rules", F.coalesce("rules", F.array().cast("array<string>")))
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(carried)), host_of(F.col("url")).alias("host"), (F.size("rules") > 0).alias("blocked"), F.size("rules").cast("long").alias("n_rules"), "rules")


def _dated(key: Column, salt: str, days: int) -> Column:
    """A whole day fixed by a key: up to `days` after the start of 2023."""
    return F.timestamp_seconds(F.lit(1672531200) + F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(salt), key)), 1, 8), 16, 10).cast("long"), F.lit(days)) * 86400)


def listed_changes(pages: DataFrame) -> DataFrame:
    """A dated list over the pages' own hosts and paths, as the tables hold none: about an eighth of the hosts are added, most
    of them removed later and some added again; so are some first parts of paths of a host."""
    hosts = pages.select(F.concat(F.lit("d:"), host_of(F.col("url"))).alias("rule")).where("rule <> 'd:'").distinct()
    paths = pages.select(F.concat(F.lit("p:"), host_of(F.col("url")), F.lit("/"), F.regexp_extract("url", r"^[A-Za-z]+://[^/?#]*/([^/?#]+)", 1)).alias("rule")).where("not rule like 'p:/%' and not rule like '%/'").distinct()
    listed = hosts.union(paths).where(F.pmod(F.conv(F.substring(F.md5("rule"), 1, 8), 16, 10).cast("long"), F.lit(8)) == 0)
    steps = F.array(*(F.struct(_dated(F.col("rule"), f"{n}:", days).alias("changed_at"), F.lit(action).alias("action")) for n, action, days in ((1, "add", 300), (2, "remove", 600), (3, "add", 900))))
    return listed.select("rule", F.explode(steps).alias("c")).select("rule", "c.changed_at", "c.action")


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    captures = pages.withColumn("fetched_at", _dated(F.coalesce(F.col("page_id").cast("string"), F.lit("")), "page:", 730))
    out = filter_urls(captures, listed_changes(pages), keep=["page_id", "fetched_at"])
    return out.select("page_id", "host", "fetched_at", "blocked", "n_rules", F.array_join("rules", ",").alias("rules"))


OP9_SQL = r"""
WITH captures AS (
  SELECT page_id, url, rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '.') AS host,
    make_timestamp((1672531200 + (CAST('0x' || substr(md5('page:' || coalesce(CAST(page_id AS VARCHAR), '')), 1, 8) AS BIGINT) % 730) * 86400) * 1000000) AS fetched_at,
    list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS path
  FROM pages
), listed AS (
  SELECT rule FROM (
    SELECT DISTINCT 'd:' || host AS rule FROM captures WHERE host <> ''
    UNION ALL SELECT DISTINCT 'p:' || host || '/' || path[1] FROM captures WHERE host <> '' AND len(path) > 0
  ) WHERE CAST('0x' || substr(md5(rule), 1, 8) AS BIGINT) % 8 = 0
), changes AS (
  SELECT rule, max(action = 'add') AS is_on, make_timestamp((1672531200 + (CAST('0x' || substr(md5(n || ':' || rule), 1, 8) AS BIGINT) % days) * 86400) * 1000000) AS since
  FROM listed, (VALUES ('1', 'add', 300), ('2', 'remove', 600), ('3', 'add', 900)) s(n, action, days) GROUP BY ALL
), judged AS (SELECT rule, since, max(is_on) AS is_on FROM changes GROUP BY rule, since
), keys AS (
  SELECT page_id, fetched_at, unnest(list_distinct(
    list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1), lambda i: 'd:' || array_to_string(string_split(host, '.')[i:], '.'))
    || list_transform(range(1, len(path) + 1), lambda i: 'p:' || host || '/' || array_to_string(path[1:i], '/')))) AS rule
  FROM captures WHERE host <> ''
), active AS (
  SELECT page_id, k.rule FROM keys k ASOF JOIN judged j ON k.rule = j.rule AND k.fetched_at >= j.since WHERE j.is_on
), found AS (SELECT page_id, count(*) AS n, string_agg(rule, ',' ORDER BY rule) AS rules FROM active GROUP BY page_id)
SELECT c.page_id, host, fetched_at, n IS NOT NULL AS blocked, coalesce(n, 0) AS n_rules, coalesce(rules, '') AS rules FROM captures c LEFT JOIN found USING (page_id)
"""
