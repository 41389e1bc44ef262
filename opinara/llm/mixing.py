"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.llm._shared import kept, q, written


def word_count(text: Column) -> Column:
    """Runs of anything but the six ASCII spaces; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point, null last, take the weights in turn. Together they want `share` of all sizes; a
    target stops at `most` times its source's size and the excess is dealt again by weight, round by round, until
    none is above. Only the rounds' two sums reach the driver. A round is a Newton step on a concave function with a kink
    for each source, so there are few; as each stops one more source at least, there are never more than sources.
    """
    ordered = written(sources.select("source", "source_size", F.col("source").isNull().alias("last")), "sources")
    # ranks without one sorted task: ranges of sources, numbered within, shifted by what lies in the ranges before
    ranges = written(ordered.repartitionByRange("last", "source").sortWithinPartitions("last", "source").withColumn("n", F.monotonically_increasing_id()), "ranges")
    part, place = F.shiftrightunsigned("n", 33), F.col("n").bitwiseAND((1 << 33) - 1)
    before = ranges.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"))
    before = before.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before"))  # a row per range
    rank = (F.col("before") + F.col("place")) % len(weights)
    sized = ranges.select("source", "source_size", part.alias("part"), place.alias("place")).join(before, "part")
    sized = written(sized.select("source", "source_size", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (rank + 1).cast("int")).alias("w"), (F.col("source_size") * most).alias("cap")), "weights")
    total = share * (sized.agg(F.sum("source_size").alias("n")).first().n or 0)
    level, full = 0.0, -1
    while True:
        capped = F.col("w") * level >= F.col("cap")
        row = sized.agg(F.count_if(capped).alias("full"), F.sum(F.when(capped, F.col("cap"))).alias("cap"), F.sum(F.when(~capped, F.col("w"))).alias("w")).first()
        if row.full == full or not row.w:
            break
        full, level = row.full, (total - (row["cap"] or 0.0)) / row.w
    return sized.select("source", "source_size", F.least("cap", F.col("w") * level if row.w else F.col("cap")).alias("target"))


def _null_safe(left: DataFrame, right: DataFrame, *cols: str) -> DataFrame:
    """An inner join on columns whose nulls are equal; the result has them once."""
    right = right.withColumnsRenamed({c: f"right_{c}" for c in cols})
    return left.join(right, [left[c].eqNullSafe(right[f"right_{c}"]) for c in cols]).drop(*(f"right_{c}" for c in cols))


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", size: Column | None = None, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 42, group_rows: int = 8192, keep: list[str] | None = None) -> DataFrame:
    """Every document with size, source_size, target and taken, and copies: how often the mix takes it.

    A document's expected copies are its source's target / source_size. Within a source these add up in order of
    size, one random offset (fixed by seed and source) is added, and a document is taken once for each integer that
    its stretch of the sum crosses: either floor or ceiling of the expectation, so never over `most` times. As
    similar sizes stand together, the words taken miss a target by few documents' sizes.

    size: words of `text_col` unless a column is given. A null source is a source of its own; a null text has size 0
    and is taken like any other. Ties in size are ordered by id, then equal rows stay separate rows. Reruns agree as long as
    ids differ. Other columns are carried along (`keep`: only these); input columns named as an added one are
    replaced. An empty table gives an empty result.

    The order is cut into groups of a source, a narrow range of sizes and a hash of the id (of the text where that is
    null), about `group_rows` rows each at most, so no source and no crowd of equal sizes meets in one task; only sums of groups are put in order.
    """
    own = ("size", "source_size", "target", "taken", "copies")
    carried = [docs.schema[c].name for c in kept(docs, keep, own)]
    dealt = F.coalesce(F.col(q(id_col)).cast("string"), *([F.col(q(text_col)).cast("string")] if text_col in docs.columns else []), F.lit(""))
    rows = docs.select(*(F.col(q(c)).alias(f"c{i}") for i, c in enumerate(carried)), F.col(q(id_col)).alias("id"), dealt.alias("dealt"), F.col(q(source_col)).alias("source"), (word_count(F.col(q(text_col))) if size is None else F.coalesce(size, F.lit(0)).cast("long")).alias("size"))
    buckets = max(1, math.ceil(docs.count() / group_rows))
    bits = F.length(F.bin("size"))
    rows = rows.withColumns({"band": bits * 16 + F.expr("shiftright(size, greatest(length(bin(size)) - 4, 0))").cast("int"), "part": F.pmod(F.conv(F.substring(F.md5("dealt"), 1, 12), 16, 10).cast("long"), F.lit(buckets))})
    groups = written(rows.groupBy("source", "band", "part").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("size")), "groups")
    targets = source_targets(groups.groupBy("source").agg(F.sum("size").alias("source_size")), weights=weights, share=share, most=most)
    bands = groups.groupBy("source", "band").agg(F.sum("rows").alias("rows"))
    up_to = lambda keys, order: F.sum("rows").over(Window.partitionBy(*keys).orderBy(order)) - F.col("rows")
    bands = bands.select("source", "band", up_to(["source"], "band").alias("band_before"))  # a few hundred bands at most
    bands = _null_safe(bands, targets, "source").select("source", "band", "band_before", "source_size", "target")
    groups = groups.select("source", "band", "part", up_to(["source", "band"], "part").alias("part_before"))
    groups = _null_safe(groups, bands, "source", "band").select("source", "band", "part", (F.col("band_before") + F.col("part_before")).alias("before"), "source_size", "target")
    inside = F.row_number().over(Window.partitionBy("source", "band", "part").orderBy("size", "id")) - 1
    place = F.col("before") + F.col("inside")
    expected = F.least(F.lit(float(most)), F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0)))
    word = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")))), 1, 12), 16, 10).cast("long")
    offset = word / float(1 << 48)
    copies = F.floor((place + 1) * expected + offset) - F.floor(place * expected + offset)
    mixed = rows.withColumn("inside", inside)
    mixed = _null_safe(mixed, groups, "source", "band", "part").select(*(f"c{i}" for i in range(len(carried))), "size", "source_size", "target", F.least(copies, F.ceil(expected)).alias("copies"))
    return mixed.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(carried)), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    out = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    return out.select("doc_id", "size", "source_size", "target", "taken")


#: The same in plain SQL: one window over each source and a recursion for the targets.
OP1_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, text, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), n AS (SELECT greatest(1, CAST(ceil(count(*) / 8192.0) AS BIGINT)) AS buckets, 1.5 * sum(size) AS total FROM sized
), sources AS (
  SELECT source, source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS cap
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source)
), ratios AS (
  SELECT *, coalesce(sum(cap) OVER before, 0) AS caps, (SELECT sum(w) FROM sources) - coalesce(sum(w) OVER before, 0) AS ws FROM sources
  WINDOW before AS (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT (total - caps) / ws AS level FROM ratios, n WHERE (total - caps) / ws <= cap / w ORDER BY cap / w, source LIMIT 1
), targets AS (SELECT source, source_size, least(cap, w * level) AS target FROM sources, level
), placed AS (
  SELECT doc_id, s.source, size, row_number() OVER (PARTITION BY s.source ORDER BY length(bin(size)) * 16 + (size >> greatest(length(bin(size)) - 4, 0)),
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 12) AS BIGINT) % buckets, size, doc_id) - 1 AS place
  FROM sized s, n
)
SELECT doc_id, size, source_size, target,
  CAST((floor((place + 1) * e + u) - floor(place * e + u)) * size AS BIGINT) AS taken
FROM (SELECT p.*, source_size, target, least(2.0::DOUBLE, target / source_size) AS e,
    CAST('0x' || substr(md5('42:' || coalesce('s' || p.source, '')), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE AS u
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source)
"""
