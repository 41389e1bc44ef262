"""Benchmark decontamination as a prefix-filtered set join.

Benchmark items are cut into item-sized windows of words, windows into shingles of two words, and these are ordered by how
rare they are in the corpus. Exact containment needs every shingle, so a window's rarest one is its necessary prefix:
documents send the places of prefix shingles, with the words around them, and these are joined with the windows on the
shingle. Positional and length bounds (the window has to fit around that place) come next, then the words themselves are
compared, inside the join. Hits are merged by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinara.llm._shared import Codes, bitmap, kept, marked, q, written

#: A-Z becomes a-z, every other ASCII byte that is neither a digit nor a letter becomes a space; bytes of other
#: characters stay, so words are runs of [^\x00-\x2F\x3A-\x60\x7B-\x7F].
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

_ADDED = ("n_words", "n_hit", "n_items", "items", "contaminated")


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def _texts(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """Distinct (item, win): each item's windows, words joined by a space."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), _texts(batch, "text"), strict=True):
                words = words_of(text)
                if words:
                    out = {b" ".join(words[i : i + window]).decode() for i in range(max(1, len(words) - window + 1))}
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(out), pa.string()), pa.array(list(out), pa.string())], ["item", "win"])

    pairs = benchmark.select(F.coalesce(F.col(q(item_col)).cast("string"), F.lit("")).alias("item"), F.col(q(text_col)).cast("string").alias("text"))
    return pairs.mapInArrow(cut, "item string, win string").distinct()


def _shingle_hash(first: Column, second: Column) -> Column:
    """64 bits of two words in a row."""
    h = F.xxhash64(first)
    return F.shiftleft(h, 7).bitwiseOR(F.shiftrightunsigned(h, 57)).bitwiseXOR(F.xxhash64(second))


def _hashes(words: list[bytes], codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, and of each with the next one."""
    one = codes.of(words)
    return one, ((one[:-1] << np.uint64(7)) | (one[:-1] >> np.uint64(57))) ^ one[1:]


def _shingles(windows: DataFrame) -> DataFrame:
    """(win, words, place, hash) of each two words in a row of a window; a window of one word has itself."""
    cut = windows.select("win", F.split("win", " ").alias("words"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda i: _shingle_hash(F.element_at("words", i), F.element_at("words", i + 1)))
    return cut.select("win", F.size("words").alias("n"), F.posexplode(F.when(F.size("words") == 1, F.array(F.xxhash64("win"))).otherwise(pairs)).alias("place", "hash"))


def _rarity(texts: DataFrame, bits: np.ndarray, single: bool) -> DataFrame:
    """(hash, n): how often the benchmark's shingles occur in all documents (others that share a slot, too)."""
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                found = [np.empty(0, np.uint64)]
                for text in _texts(batch.slice(at, 512), "text"):
                    one, two = _hashes(words_of(text), codes)
                    found += [h[marked(h, shared.value)] for h in ((one, two) if single else (two,))]
                hashes, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n)], ["hash", "n"])

    return texts.select("text").mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, share: int = 20, keep: list[str] | None = None) -> DataFrame:
    """Every document with the words that benchmark windows cover.

    Adds n_words, n_hit (words inside any occurrence of a window), n_items, items (ids of items with an occurring
    window, as strings, sorted), contaminated (n_hit > 0 and share * n_hit >= n_words). An item of fewer words than
    `window` is one window; one without words, or with a null text, never occurs. Null and empty documents have no
    words and are clean. Items that share an id count once; a null id counts as the id ''. Repeated documents are
    judged row by row, ties cannot arise, and any other column is carried along (`keep`: only these); an input column
    named as an added one is replaced. With no benchmark, or an empty table, nothing is contaminated.

    The documents are read twice, however large the benchmark is: once to count its shingles, once to send the places
    that may be a window's prefix to the join. What the driver and every executor hold of the benchmark is a bitmap of 2 MB;
    the fuller it is, the more places go to the join in vain.
    """
    spark = docs.sparkSession
    carried = [docs.schema[c] for c in kept(docs, keep, _ADDED)]
    own = [f"c{i}" for i in range(len(carried))]
    rows = docs.select(*(F.col(q(f.name)).alias(c) for c, f in zip(own, carried, strict=True)), F.monotonically_increasing_id().alias("row"), F.col(q(text_col)).cast("string").alias("text"))
    pairs = written(benchmark_windows(benchmark, item_col, item_text_col, window), "windows")
    shingles = written(_shingles(pairs.select("win").distinct()), "shingles")
    single = not shingles.where("n = 1").isEmpty()
    counts = _rarity(rows, bitmap(shingles), single)
    rarest = shingles.join(counts, "hash", "left").groupBy("win").agg(F.min(F.struct(F.coalesce(counts["n"], F.lit(0)).alias("often"), "hash", "place", shingles["n"].alias("words"))).alias("p"))
    cut = F.split("win", " ")
    prefixes = written(rarest.select("win", "p.hash", "p.place", "p.words", F.concat(F.lit(" "), F.array_join(F.slice(cut, F.lit(1), F.col("p.place")), " ")).alias("pre"), F.concat(F.array_join(F.slice(cut, F.col("p.place") + 1, F.col("p.words")), " "), F.lit(" ")).alias("post")), "prefixes")
    bits = spark.sparkContext.broadcast(bitmap(prefixes))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                counts, ends, at, hashes, before, after = [], [0], [], [], [], []
                for text in _texts(part, "text"):
                    words = words_of(text)
                    for h in _hashes(words, codes)[0 if single else 1 :]:
                        for i in marked(h, bits.value).tolist():
                            at.append(i)
                            hashes.append(h[i])
                            before.append(b" " + b" ".join(words[max(0, i - window + 1) : i]))
                            after.append(b" ".join(words[i : i + window]) + b" ")
                    counts.append(len(words))
                    ends.append(len(at))
                of = lambda values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(counts, pa.int64()), of(pa.array(at, pa.int64())), of(pa.array(np.array(hashes, np.uint64).view(np.int64))), of(pa.array(before, pa.binary()).cast(pa.string())), of(pa.array(after, pa.binary()).cast(pa.string()))], [*own, "row", "n_words", "at", "hash", "before", "after"])

    schema = T.StructType([*(f for f in rows.schema if f.name != "text"), T.StructField("n_words", T.LongType()), *(T.StructField(n, T.ArrayType(k)) for n, k in (("at", T.LongType()), ("hash", T.LongType()), ("before", T.StringType()), ("after", T.StringType())))])
    scanned = written(rows.mapInArrow(search, schema), "places")
    places = scanned.where("size(at) > 0").select("row", "n_words", F.explode(F.arrays_zip("at", "hash", "before", "after")).alias("p")).select("row", "n_words", "p.*")
    bounds = (F.col("at") >= F.col("place")) & (F.col("at") - F.col("place") + F.col("words") <= F.col("n_words"))
    same = F.col("after").startswith(F.col("post")) & ((F.col("place") == 0) | F.col("before").endswith(F.col("pre")))
    hits = places.join(prefixes, "hash").where(bounds & same).select("row", "win", F.struct((F.col("at") - F.col("place")).alias("start"), (F.col("at") - F.col("place") + F.col("words")).alias("end")).alias("span"))
    merged = hits.join(pairs, "win").groupBy("row").agg(F.sort_array(F.collect_set("span")).alias("spans"), F.sort_array(F.collect_set("item")).alias("items"))
    zero = F.lit(0).cast("long")
    cover = F.aggregate("spans", F.struct(zero.alias("n"), zero.alias("end")), lambda a, s: F.struct((a["n"] + F.greatest(zero, s["end"] - F.greatest(a["end"], s["start"]))).alias("n"), F.greatest(a["end"], s["end"]).alias("end")))["n"]
    out = scanned.select(*own, "row", "n_words").join(merged.select("row", cover.alias("n_hit"), "items"), "row", "left").withColumns({"n_hit": F.coalesce("n_hit", zero), "items": F.coalesce("items", F.array().cast("array<string>"))})
    return out.select(*(F.col(c).alias(f.name) for c, f in zip(own, carried, strict=True)), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"))


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    out = decontaminate(docs, items, keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
