"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit position of the fingerprint has a non-zero vector of radius + 1 bits; every other such vector v makes a
mask of the positions whose vector has an odd inner product with it. Two fingerprints that differ in at most `radius` positions leave
some v that is orthogonal to all of these positions' vectors, so the mask of v hides every difference: each such pair
collides in some table, with certainty.

op8 links fingerprints (simhash_groups). Where texts are to be near-duplicates by their shingles, near_duplicate_groups takes the
same tables for its candidates and compares the texts of each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinara.llm._shared import Codes, bitmap, give_back, kept, marked, q, written
from opinara.llm.components import connected_components

_TALLY_BITS = 18


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """64 bits; a bit is 1 if set in over half of the shingles' hashes. No words: zero."""
    words = text.lower().split() if text else []  # bytes: A-Z and the six ASCII spaces only
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(line[a:b], seed) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)], "<u8")
    return _majority(hashes)


def _majority(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, *, text_col: str = "text", shingle: int = 3, seed: int = 42, keep: list[str] | None = None) -> DataFrame:
    """The documents with a column fp: the fingerprint's 64 bits as a signed long."""
    carried = [docs.schema[c] for c in kept(docs, keep, ("fp",))]
    schema = T.StructType([*(T.StructField(f"c{i}", f.dataType) for i, f in enumerate(carried)), T.StructField("fp", T.LongType())])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # few texts at a time are Python's
                part = batch.slice(at, 512)
                bits = np.array([fingerprint(t, shingle, seed) for t in part.column(part.num_columns - 1).cast(pa.binary()).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(bits)], [*(f"c{i}" for i in range(len(carried))), "fp"])

    rows = docs.select(*(F.col(q(f.name)).alias(f"c{i}") for i, f in enumerate(carried)), F.col(q(text_col)).cast("string").alias("text")).mapInArrow(mark, schema)
    return rows.select(*(F.col(f"c{i}").alias(f.name) for i, f in enumerate(carried)), "fp")


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """2^(radius+1) - 1 masks, as signed longs."""
    most = 1 << (radius + 1)
    masks = [sum(1 << i for i in range(bits) if ((1 + i % (most - 1)) & v).bit_count() % 2) for v in range(1, most)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links_within(points: DataFrame, radius: int, pair_limit: int = 64) -> DataFrame:
    """Edges (a, b) between the distinct longs `fp` whose graph has the same components as all pairs that differ in
    at most `radius` bits.

    Buckets of a table with up to `pair_limit` members compare their pairs. In larger ones members link without any pairs.
    Two differ in at most r bits exactly if some point lies within half of r (rounded down) of one and within the other half of the other: so
    at each point the smallest of the members within the first half links to all members within the second.
    radius: 4 at most, as the points within half of it are 2081 for a member then.
    """
    if not 0 <= radius <= 4:
        raise ValueError("radius must be 0 to 4")
    tables = F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(covering_masks(radius))))
    rows = points.select("fp", F.explode(tables).alias("b")).select("fp", "b.t", "b.k")
    sizes = rows.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(rows.join(sizes, ["t", "k"]), "buckets")
    left, right = (shared.where(F.col("n") <= pair_limit).select("t", "k", F.col("fp").alias(x)) for x in "ab")
    pairs = left.join(right, ["t", "k"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).select("a", "b")
    crowd = shared.where(F.col("n") > pair_limit).select("fp").distinct()
    hubs = [crowd.select("fp", F.explode(F.array(*map(F.lit, _ball(r)))).alias("x")).select("fp", F.col("fp").bitwiseXOR(F.col("x")).alias("hub")) for r in (radius // 2, radius - radius // 2)]
    first = hubs[0].groupBy("hub").agg(F.min("fp").alias("a"))
    return pairs.union(hubs[1].join(first, "hub").where("fp <> a").select("a", F.col("fp").alias("b")))


def _ball(radius: int, bits: int = 64) -> list[int]:
    """All masks of at most `radius` bits, as signed longs."""
    masks = [sum(1 << i for i in some) for n in range(radius + 1) for some in combinations(range(bits), n)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def simhash_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, seed: int = 42, keep: list[str] | None = None) -> DataFrame:
    """Every document with fp (its fingerprint, a long) and component_id: the smallest id that links reach.

    Documents link if their fingerprints differ in at most `radius` bits (4 at most). Null and empty texts have the fingerprint
    zero and link like any other; so do repeated rows. A row whose id is null counts for links but not for the
    smallest id; component_id is null if no id in its component isn't. Other columns are carried along
    (`keep`: only these); input columns called fp or component_id are replaced. An empty table gives an empty result.
    """
    columns = kept(docs, keep, ("fp", "component_id"))
    marked = written(with_fingerprint(docs, text_col=text_col, shingle=shingle, seed=seed, keep=list(dict.fromkeys([*columns, id_col]))), "fingerprints")
    points = written(marked.groupBy("fp").agg(F.min(F.col(q(id_col))).alias("least")), "points")
    roots = connected_components(links_within(points, radius)).withColumnRenamed("node", "fp")
    classes = written(points.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "classes")
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(*(F.col(q(c)) for c in columns), "fp", "component_id")


def _mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Bits that depend on all bits: 64 for each of an array's."""
    x = (x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _shingle_hashes(words: np.ndarray, shingle: int) -> np.ndarray:
    """A hash of each `shingle` words in a row, from the words' own; of fewer words, of them all together."""
    n, x = max(1, len(words) - shingle + 1) if len(words) else 0, np.uint64(0)
    for j in range(min(shingle, len(words))):
        x = x * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n]
    return _mixed(x) if n else np.empty(0, np.uint64)


def _buckets(points: DataFrame, radius: int) -> DataFrame:
    """(t, k, u, fp, n, first, second, third) of (u, fps): each u in each bucket k of fingerprint t that it shares, with the
    bucket's number of members, its smallest one (u and fp) and two random ones."""
    masks = covering_masks(radius)
    tables = F.flatten(F.transform("fps", lambda fp, t: F.array(*(F.struct(t.alias("t"), fp.alias("fp"), F.xxhash64(t, F.lit(i), fp.bitwiseAND(F.lit(m))).alias("k")) for i, m in enumerate(masks)))))
    # each point becomes a row for each table: dealt to many tasks first, so that none counts too many buckets at once
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = points.repartition(parts, "u").select("u", F.explode(tables).alias("b")).select("u", "b.t", "b.fp", "b.k")
    # nearly all buckets have one member: of them only keys and counts move
    shared = written(rows.join(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "k"), "shared")
    some = lambda n: F.min_by("u", F.xxhash64("u", F.lit(n)))
    return written(shared.join(shared.groupBy("k").agg(F.min(F.struct("u", "fp")).alias("first"), some(2).alias("second"), some(3).alias("third")), "k"), "buckets")


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    """The lists of a column of longs without nulls."""
    ends = column.offsets.to_numpy()
    return np.split(column.flatten().to_numpy(zero_copy_only=False), ends[1:-1] - ends[0]) if len(column) else []


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (_mixed(hashes.view(np.uint64)) >> np.uint64(64 - _TALLY_BITS)).astype(np.int64)


def _tally(sets: DataFrame) -> np.ndarray:
    """For each of 262,144 slots, how many hashes of the sets `s` fall into it: 1 MB, however many there are."""
    pieces = 64
    each = (1 << _TALLY_BITS) // pieces

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << _TALLY_BITS, np.int64)
        for batch in batches:
            n += np.bincount(_slots(batch.column(0).flatten().to_numpy(zero_copy_only=False)), minlength=len(n))
        for p in np.unique(np.flatnonzero(n) // each).tolist():
            part = n[p * each : (p + 1) * each]
            at = np.flatnonzero(part)
            yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([at.astype("<i4").tobytes()]), pa.array([part[at].tobytes()])], ["piece", "slot", "n"])

    def add(table: pa.Table) -> pa.Table:
        n = np.zeros(each, np.int64)
        for at, part in zip(table["slot"].to_pylist(), table["n"].to_pylist(), strict=True):
            n[np.frombuffer(at, "<i4")] += np.frombuffer(part, np.int64)
        return pa.table({"piece": table["piece"].slice(0, 1), "n": pa.array([np.minimum(n, (1 << 32) - 1).astype("<u4").tobytes()])})

    parts = sets.select("s").mapInArrow(count, "piece long, slot binary, n binary").groupBy("piece").applyInArrow(add, "piece long, n binary")
    out = np.zeros(1 << _TALLY_BITS, np.uint32)
    for r in parts.collect():
        out[r.piece * each : (r.piece + 1) * each] = np.frombuffer(r.n, "<u4")
    return out


def _rarest(members: DataFrame, similarity: float) -> DataFrame:
    """(u, root, size, few, place, h) of rows (u, root, s: distinct hashes): the first hashes of each, the rarest ones.

    They are ordered by how many sets hold them, as a table of 262,144 counters (`_tally`) tells: any order of all hashes gives the
    same similar pairs, a worse one after more comparisons. Of two similar sets, the smaller one's first `few` (so many that the others are too few,
    if the larger one is as small) and the larger one's (so many that the others are too few for any) share one. Only these become rows.
    """
    counts = _tally(members)

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = []
            for s in _lists(batch.column(2)):
                most = max(1, len(s) - math.ceil(len(s) * similarity - 1e-9) + 1)
                lines.append(s[np.lexsort((s, counts[_slots(s)]))[:most]])
            ends = pa.array(np.cumsum([0, *map(len, lines)]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pc.list_value_length(batch.column(2)), pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, np.int64), *lines])))], ["u", "root", "size", "line"])

    line = members.select("u", "root", "s").mapInArrow(rarest, T.StructType([*members.select("u", "root").schema.fields, T.StructField("size", T.IntegerType()), T.StructField("line", T.ArrayType(T.LongType()))]))
    few = F.col("size") - F.ceil(F.col("size") * (2 * similarity / (1 + similarity)) - 1e-9).cast("int") + 1
    return written(line.select("u", "root", "size", few.alias("few"), F.posexplode("line").alias("place", "h")), "rare")


def _centres(first: DataFrame) -> DataFrame:
    """(a, b): each row of _rarest with the one of another root in which their shared hash is nearest the front, the set with the fewest
    hashes of its own: what most of a crowd are similar to. As many pairs as rows at most."""
    centre = first.groupBy("h").agg(F.min(F.struct("place", "u", "root")).alias("c"))
    return first.join(centre, "h").where(F.col("root") != F.col("c.root")).select(F.least("u", "c.u").alias("a"), F.greatest("u", "c.u").alias("b")).distinct()


def _rare_pairs(members: DataFrame, similarity: float, first: DataFrame | None = None) -> DataFrame:
    """(a, b): of rows (u, root, s: distinct hashes) all pairs of different roots whose sets can be as similar as asked for.

    They share a hash of _rarest's rows (`first`, if these are at hand: then `members` needs no s, and its roots count). Hashes that stand
    in sets of one root only are left out before the join. What members of a crowd have in common is frequent, so it is behind these first ones unless they
    are similar. Lengths and the places of the shared hash bound the rest.
    """
    first = _rarest(members, similarity) if first is None else first.drop("root").join(members.select("u", "root"), "u")
    shared = first.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("h")
    first = first.join(shared, "h", "left_semi")
    a, b = (first.select("h", *(F.col(c).alias(f"{c}_{x}") for c in ("u", "root", "size", "few", "place"))) for x in "ab")
    smaller = F.struct("size_a", "u_a") < F.struct("size_b", "u_b")
    rest = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))
    both = a.where("place_a < few_a").join(b, "h").where(smaller & (F.col("root_a") != F.col("root_b")) & (F.col("size_a") >= similarity * F.col("size_b") - 1e-9) & (rest >= similarity / (1 + similarity) * (F.col("size_a") + F.col("size_b")) - 1e-9))
    return both.select(*_pair("u_a", "u_b")).distinct()


def near_duplicate_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, fingerprints: int = 3, fingerprint_shingle: int = 2, radius: int = 4, seed: int = 42, pair_limit: int = 64, keep: list[str] | None = None) -> DataFrame:
    """Every document with component_id: the smallest id that links reach.

    Two texts link if they have the same words, or if the sets of their shingles of `shingle` words have a Jaccard
    similarity of `similarity` or more, computed over their 64-bit hashes, and covering LSH brings them together: they share a bucket of one of
    `fingerprints` SimHashes over shingles of `fingerprint_shingle` words, which is certain within `radius` bits and likely
    some bits beyond. A text is compared with the smallest one of its buckets; then, in buckets of up to `pair_limit` members, with every
    other that it is not yet linked to over some links. Among all texts of larger ones a similarity join over rarest shingles, and no pairs, finds all that
    are similar and not yet linked, so no bucket's size costs a link. Links are exact, and which are found is not certain for texts of a similarity near the least, as SimHash may not bring them together.

    Words are as in op8: A-Z lower, six ASCII spaces between. Null texts and texts without words are equal. Repeated rows
    link. A null id is larger than any other; component_id is null if no id in its component isn't. Other columns are
    carried along (`keep`: only these); an input column called component_id is replaced. An empty table gives an empty
    result. A row is known by its place in the input, which has to be the same each time it is read, as a table's is.
    """
    carried = kept(docs, keep, ("component_id",))
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(q(id_col)).alias("id"), F.col(q(text_col)).cast("string").alias("text"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(part.num_columns - 1).cast(pa.binary()).to_pylist()
                words = [(t or b"").lower().split() for t in texts]
                same = [xxhash.xxh3_128_digest(b" ".join(w)) for w in words]
                hashes = [_shingle_hashes(codes.of(w), fingerprint_shingle) for w in words]
                fps = np.array([[_majority(_mixed(h, seed + n)) for n in range(fingerprints)] for h in hashes], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(same, pa.binary()), pa.FixedSizeListArray.from_arrays(pa.array(fps.reshape(-1)), fingerprints).cast(pa.list_(pa.int64()))], ["row", "id", "same", "fps"])

    marked_ = written(base.mapInArrow(mark, T.StructType([*base.schema.fields[:2], T.StructField("same", T.BinaryType()), T.StructField("fps", T.ArrayType(T.LongType()))])), "fingerprints")
    points = written(marked_.groupBy("same").agg(F.min("row").alias("u"), F.min("id").alias("least"), F.first("fps").alias("fps")), "points")
    buckets = _buckets(points.select("u", "fps"), radius)
    give_back(docs.sparkSession)  # here and below: each step's shuffles go before the next one's come

    # the texts are read in place: a bitmap tells which rows are asked for, and the few others that it lets pass are in no pair
    asked = bitmap(buckets.select(F.xxhash64("u").alias("hash")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in batches:
            batch = batch.take(pa.array(marked(batch.column(2).to_numpy().view(np.uint64), asked)))
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [np.unique(_shingle_hashes(codes.of((t or b"").lower().split()), shingle)) for t in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))], ["u", "s"])

    sets = written(base.select("row", "text", F.xxhash64("row")).mapInArrow(cut, "u long, s array<long>"), "shingles")

    def linked(pairs: DataFrame, sets: DataFrame = sets) -> DataFrame:
        x, y = (sets.select(F.col("u").alias(n), F.col("s").alias(f"s_{n}")) for n in "ab")
        both = F.size(F.array_intersect("s_a", "s_b"))
        links = written(pairs.distinct().join(x, "a").join(y, "b").where(both >= similarity * (F.size("s_a") + F.size("s_b") - both)).select("a", "b"), "links")
        give_back(docs.sparkSession)
        return links

    # first each text with the smallest one of all its buckets, so that large groups are joined by as many pairs as texts; then
    # pairs of small buckets that these links have not brought together, and in crowds each member with three others; then what
    # is still apart among the texts of crowds, by its rarest shingles
    root = lambda df, u, name: df.join(roots.select(F.col("node").alias(u), F.col("root").alias(name)), u, "left").withColumn(name, F.coalesce(name, u))
    links = linked(buckets.groupBy("u").agg(F.min("first.u").alias("c")).where("u <> c").select(*_pair("u", "c")))
    # each text has one such link at most, to a smaller one: two steps along them label most groups, and equal labels are linked
    up = links.select(F.col("b").alias("node"), F.col("a").alias("root"))
    roots = written(up.join(up.select(F.col("node").alias("root"), F.col("root").alias("further")), "root", "left").select("node", F.coalesce("further", "root").alias("root")), "labels")
    left = written(root(buckets.select("k", "u", "n", F.col("first.u").alias("first"), "second", "third"), "u", "root"), "buckets")
    crowd = left.where(F.col("n") > pair_limit)
    mixed = crowd.groupBy("k").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    # texts of crowds that hold several groups: the similarity join finds all links among them, so small buckets pair none of these with each other
    dense = written(crowd.join(mixed, "k", "left_semi").select("u").distinct(), "dense")
    small = left.where(F.col("n") <= pair_limit).join(dense.withColumn("dense", F.lit(True)), "u", "left")
    x, y = (small.select("k", F.col("u").alias(i), F.col("root").alias(f"root_{i}"), F.coalesce("dense", F.lit(False)).alias(f"dense_{i}")) for i in "ab")
    pairs = x.join(y, "k").where((F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & ~(F.col("dense_a") & F.col("dense_b"))).select("a", "b")
    crowds = root(crowd.select("u", "root", F.explode(F.array("first", "second", "third")).alias("c")), "c", "other").where(F.col("root") != F.col("other"))
    links = links.union(linked(pairs.union(crowds.select(*_pair("u", "c")))))
    roots = connected_components(links)
    give_back(docs.sparkSession)
    if not dense.isEmpty():
        # again first as many pairs as rows: of texts that are similar to many, only what no link reaches is compared with all that it can be near
        own_sets = written(dense.join(sets, "u"), "shingles")
        first = _rarest(root(dense, "u", "root").join(own_sets, "u"), similarity)
        for search in (lambda: _centres(first), lambda: _rare_pairs(root(dense, "u", "root"), similarity, first)):
            found = linked(search(), own_sets)
            if not found.isEmpty():
                links = links.union(found)
                roots = connected_components(links)
                give_back(docs.sparkSession)
    roots = roots.withColumnRenamed("node", "u")
    classes = written(points.join(roots, "u", "left").select("same", "least", F.coalesce("root", "u").alias("root")), "classes")
    named = classes.join(classes.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("same", "component_id")
    found = marked_.join(named, "same").select("row", "component_id")
    own = docs.select(F.monotonically_increasing_id().alias("row"), *(F.col(q(c)).alias(f"c{i}") for i, c in enumerate(carried)))
    return own.join(found, "row").select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(carried)), "component_id")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    out = simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
