"""Line dedup over content-defined chunks of lines.

A rolling hash over the hashes of two neighbouring lines decides where a chunk ends, so an inserted or deleted line moves
the borders beside it and no others, and the same passage is cut alike wherever it stands.

1. Every line gets a digest, 128 bits of its SHA-256, by which chunks and windows are looked up.
2. Chunks of several lines that occur earlier, in this or another document, go whole, once their bytes have been compared.
3. A repeated passage seldom ends where chunks end. At its two ends, and where it is shorter than a chunk, it lies among
   foreign lines in chunks that stayed: there, and only there, windows of `least_lines` lines are looked up line by line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.llm._shared import kept, q, written

_ADDED = ("n_lines", "n_chunks", "n_removed_chunks", "n_removed_lines", "kept_text")


def lines_of(text: Column) -> Column:
    """What stands between newlines; a null text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def chunk_ends(digests: Column, divisor: int) -> Column:
    """The 1-based last line of every chunk, from the lines' digests.

    A chunk ends at a line where a hash of it and the line before falls into one of `divisor` equal parts. Of such lines in
    a row only the first counts, and the one before a text's last line doesn't, so no chunk is one line long unless the
    text is. As the hash is of both lines, equal lines in a row end a chunk no more often than others.
    """
    n = F.size(digests)
    marks = F.transform(digests, lambda d: F.conv(F.hex(F.substring(d, 1, 4)), 16, 10).cast("long"))
    later = F.slice(marks, 2, F.greatest(n - 1, F.lit(0)))
    cuts = F.concat(F.array(F.lit(False)), F.zip_with(F.slice(marks, 1, F.greatest(n - 1, F.lit(0))), later, lambda a, b: F.pmod(b * 31 + a * 17, F.lit(65537)) * divisor < 65537))
    firsts = F.zip_with(cuts, F.concat(F.array(F.lit(False)), F.slice(cuts, 1, F.greatest(n - 1, F.lit(0)))), lambda c, before: c & ~before)
    # neither the last line's mark nor the one before counts; the text's end does. No lambda asks for `digests`, which would be computed for each line
    inner = F.filter(F.transform(F.slice(firsts, 1, F.greatest(n - 2, F.lit(0))), lambda c, i: F.when(c, i + 1)), lambda i: i.isNotNull())
    return F.concat(inner, F.array(n))


def _later(rows: DataFrame, name: str) -> DataFrame:
    """Rows (has, id, row, start, .., key) whose key has an earlier place, with that place as `first`.

    Counts and minima combine before the shuffle, and the keys that repeat are written, so that the join stands right
    on its shuffles and Spark can split a key that a third of all rows share over tasks.
    """
    place = F.struct("has", "id", "row", "start")
    first = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1").select("key", "first"), name)
    return rows.join(first, "key").where(place > F.col("first"))


def _equal(base: DataFrame, repeated: DataFrame) -> DataFrame:
    """Of chunks (row, start, end, key, first) those whose text is byte by byte that of the key's first one.

    Only texts of repeated chunks move: documents cut out what is asked of them, the first chunk of a key once.
    """
    firsts = repeated.groupBy("key").agg(F.min("first").alias("first"), F.min(F.col("end") - F.col("start")).alias("n")).select("first.row", "first.start", (F.col("first.start") + F.col("n")).alias("end"), "key", F.lit(True).alias("leads"))
    places = repeated.select("row", "start", "end", "key", F.lit(False).alias("leads")).union(firsts)
    asked = places.groupBy("row").agg(F.collect_list(F.struct("start", "end", "key", "leads")).alias("asked"))
    lined = base.select("row", lines_of(F.col("text")).alias("lines")).join(asked, "row")
    cut = F.transform("asked", lambda a: F.struct(a["start"].alias("start"), a["end"].alias("end"), a["key"].alias("key"), a["leads"].alias("leads"), F.array_join(F.slice("lines", a["start"], a["end"] - a["start"] + 1), "\n").cast("binary").alias("bytes")))
    texts = written(lined.select("row", F.explode_outer(cut).alias("c")).select("row", "c.*"), "bytes")
    return texts.where("not leads").join(texts.where("leads").select("key", F.col("bytes").alias("of")), "key").where(F.col("bytes") == F.col("of"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", divisor: int = 4, least_lines: int = 2, keep: list[str] | None = None) -> DataFrame:
    """Every document with n_lines, n_chunks, n_removed_chunks, n_removed_lines and kept_text.

    Lines are what stands between newlines. A line goes where it lies in a passage of `least_lines` lines or more that stands
    earlier, by id (null first) and place, in this or another document. Of a passage that overlaps its own first occurrence, as in a
    run of one line, that occurrence stays whole; so each line that goes has an equal one before it that stays.
    n_removed_chunks counts the chunks whose lines all go. Very long texts cost time and memory in proportion to their lines. The divisor sets how long chunks are, not which lines go.

    Repeated rows are told apart by their place in the input, which has to be the same each time it is read, as a table's
    is: of two equal documents one keeps its lines. Null and empty texts are one empty line. A document whose lines all go
    has an empty kept_text. Other columns are carried along (`keep`: only these); input columns named as an added one
    are replaced. An empty table gives an empty result.
    """
    carried = kept(docs, keep, _ADDED)
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(q(id_col)).alias("id"), *(F.col(q(c)).alias(f"c{i}") for i, c in enumerate(carried)), F.col(q(text_col)).cast("string").alias("text"))
    digest = lambda x: F.substring(F.unhex(F.sha2(x, 256)), 1, 16)
    marked = written(base.select("row", F.col("id").isNotNull().alias("has"), "id", F.transform(lines_of(F.col("text")), digest).alias("d")), "digests")

    # places and keys are made inside the arrays and leave them alone: no exploded row carries its document
    ends = chunk_ends(F.col("d"), divisor)
    spans = marked.select("row", "has", "id", "d", ends.alias("ends")).withColumn("spans", F.zip_with(F.concat(F.array(F.lit(0)), F.slice("ends", 1, F.size("ends") - 1)), "ends", lambda a, b: F.struct((a + 1).alias("start"), b.alias("end"))))
    joined = lambda s: F.aggregate(F.slice("d", s["start"], s["end"] - s["start"] + 1), F.lit("").cast("binary"), lambda x, y: F.concat(x, y))
    long = F.filter("spans", lambda s: s["end"] - s["start"] + 1 >= least_lines)
    chunks = spans.select("row", "has", "id", F.explode(F.transform(long, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), digest(joined(s)).alias("key")))).alias("c")).select("row", "has", "id", "c.*")
    whole = written(_equal(base, written(_later(chunks, "chunks"), "repeated")).select("row", F.struct("start", "end").alias("w")), "whole")

    # windows that no removed chunk holds: what the chunks found needs no second look, nor can it be the first of anything
    left = marked.join(whole.groupBy("row").agg(F.collect_list("w").alias("whole")), "row", "left")
    starts = F.when(F.size("d") >= least_lines, F.sequence(F.lit(1), F.size("d") - (least_lines - 1)))
    # chunks have `least_lines` lines or more, and none shares a line with another
    held = F.flatten(F.transform("whole", lambda w: F.sequence(w["start"], w["end"] - (least_lines - 1))))
    window = lambda i: F.concat(*(F.element_at("d", i + k) for k in range(least_lines)))
    asked = F.when(F.col("whole").isNull(), starts).otherwise(F.array_except(starts, held))
    windows = left.select("row", "has", "id", F.explode(F.transform(asked, lambda i: F.struct(i.alias("start"), window(i).alias("key")))).alias("w")).select("row", "has", "id", "w.*")
    later = _later(windows, "windows")
    # what a window shares with its own first occurrence stays
    begin = F.when(F.col("first.row") == F.col("row"), F.greatest("start", F.col("first.start") + least_lines)).otherwise(F.col("start"))
    edges = later.select("row", F.struct(begin.alias("start"), (F.col("start") + (least_lines - 1)).alias("end")).alias("w"))

    gone = whole.union(edges).groupBy("row").agg(F.collect_list("w").alias("gone"))
    full = base.join(gone, "row", "left").withColumn("lines", lines_of(F.col("text")))
    full = full.withColumn("gone", F.array_distinct(F.flatten(F.transform(F.coalesce("gone", F.array().cast("array<struct<start:int,end:int>>")), lambda w: F.sequence(w["start"], w["end"])))))
    full = full.withColumns({"stays": F.array_except(F.sequence(F.lit(1), F.size("lines")), "gone"), "d": F.transform("lines", digest)}).withColumn("ends", chunk_ends(F.col("d"), divisor))
    text = F.array_join(F.transform("stays", lambda i: F.element_at("lines", i)), "\n")
    # sorted together, a chunk's end stands right behind a line that stays only if the chunk has one
    marks = F.array_sort(F.concat(F.transform("stays", lambda i: i * 2), F.transform("ends", lambda e: e * 2 + 1)))
    full = full.withColumn("marks", marks).withColumn("touched", F.size(F.filter("marks", lambda m, j: (m % 2 == 1) & (j > 0) & (F.element_at("marks", F.greatest(j, F.lit(1))) % 2 == 0))))
    return full.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(carried)), F.size("lines").cast("long").alias("n_lines"), F.size("ends").cast("long").alias("n_chunks"), (F.size("ends") - F.col("touched")).cast("long").alias("n_removed_chunks"), F.size("gone").cast("long").alias("n_removed_lines"), text.alias("kept_text"))


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    return out.select("doc_id", "n_lines", "n_chunks", "n_removed_chunks", "n_removed_lines", F.sha2("kept_text", 256).alias("kept_sha256"))


#: The same rule without chunks as a first step: every pair of neighbouring lines, by the lines themselves.
OP3_SQL = r"""
WITH lined AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), lines AS (
  SELECT doc_id, len(lines) AS n, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM lined
), pairs AS (
  SELECT doc_id, i, line, lead(line) OVER doc AS next, n,
    coalesce((CAST('0x' || substr(sha256(line), 1, 8) AS BIGINT) * 31 + CAST('0x' || substr(sha256(lag(line) OVER doc), 1, 8) AS BIGINT) * 17) % 65537 * 4 < 65537, false) AS cut
  FROM lines WINDOW doc AS (PARTITION BY doc_id ORDER BY i)
), ends AS (
  SELECT *, i = n OR (cut AND NOT coalesce(lag(cut) OVER doc, false) AND i <> n - 1) AS ends FROM pairs WINDOW doc AS (PARTITION BY doc_id ORDER BY i)
), placed AS (
  SELECT *, first_value(doc_id) OVER same AS first_doc, first_value(i) OVER same AS first_i, coalesce(sum(CASE WHEN ends THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk
  FROM ends WINDOW same AS (PARTITION BY line, next, next IS NULL ORDER BY doc_id, i)
), later AS (
  SELECT doc_id, i, CASE WHEN doc_id = first_doc THEN greatest(i, first_i + 2) ELSE i END AS begin FROM placed WHERE next IS NOT NULL AND (doc_id, i) <> (first_doc, first_i)
), gone AS (SELECT DISTINCT doc_id, unnest(range(begin, i + 2)) AS i FROM later
), judged AS (SELECT p.doc_id, p.i, p.line, p.chunk, g.i IS NOT NULL AS gone FROM placed p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i
), per_chunk AS (SELECT doc_id, count(*) AS n_chunks, count(*) FILTER (WHERE all_gone) AS n_removed_chunks FROM (SELECT doc_id, chunk, bool_and(gone) AS all_gone FROM judged GROUP BY doc_id, chunk) GROUP BY doc_id)
SELECT doc_id, count(*) AS n_lines, any_value(n_chunks) AS n_chunks, any_value(n_removed_chunks) AS n_removed_chunks, count(*) FILTER (WHERE gone) AS n_removed_lines,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged JOIN per_chunk USING (doc_id) GROUP BY doc_id
"""
