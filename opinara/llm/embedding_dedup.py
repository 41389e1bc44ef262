"""Embedding near-duplicates: an exact metric range join over pivot cells.

Vectors of unit length lie in the cell of their nearest pivot. Two vectors within the radius differ in distance to any pivot
by at most the radius (triangle inequality), and so lie near the boundary between their cells: a vector is copied
to a neighbouring cell only if it is within the radius of that boundary. Each pair of cells has one of the two as its
place, so every close pair meets in exactly one cell, and cells are joined independently, in blocks of bounded size.

How many pivots pay depends on the vectors: with clusters each further one cuts the work, while vectors of no structure are all
near every boundary, and further pivots only multiply copies. So the number is chosen by what a sample says it costs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm._shared import kept, q, written
from opinara.llm.components import connected_components

_ADDED = ("n_links", "component_id", "kept")

#: A block compares so many vectors at a time, and judges so many pairs, that what it holds for either stays within this.
_SLICE_BYTES = 1 << 24
#: A side of a block holds no more bytes of vectors in double precision than this, whatever their size.
_BLOCK_BYTES = 1 << 25


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision, safe for very large and very small components."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, size)


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of n nodes reaches over the links a-b."""
    label = np.arange(n)
    while True:
        before = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        label = label[label]
        if np.array_equal(label, before):
            return label


def _joined(label: np.ndarray, left: np.ndarray, right: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """The labels of all nodes once the links between `left` and `right` nodes, a matrix, are in the forest too."""
    a, b = np.nonzero(linked & (label[left][:, None] != label[right]))  # links within a tree change nothing
    return _forest(label[left[a]], label[right[b]], len(label))[label] if len(a) else label


def embedding_groups(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, pivots: int | None = None, max_pivots: int = 4096, block_rows: int = 32768, keep: list[str] | None = None) -> DataFrame:
    """Every vector with n_links, component_id (the smallest id that links reach) and kept (it is its own component's id).

    Vectors link if their cosine, in double precision, is at least `threshold` (over 0). Null vectors, zero ones, and those that hold a null
    or non-finite component link with nothing, nor do vectors of different sizes. Equal vectors are joined once, with their number;
    repeated rows count as other vectors. A null id counts as a link but not for component_id. Other columns are carried along
    (`keep`: only these); input columns named as an added one are replaced. An empty table gives an empty result.

    Pivots are vectors drawn by a hash, at most `max_pivots` for a size of vector: that bounds what is broadcast. How many
    are used (`pivots`: so many) is a matter of speed alone and estimated over 2048 vectors. Vectors within half the radius of their pivot all link with each other; such a crowd,
    however large, is counted and not compared pair by pair. Links are counted where they are found and folded into a forest, a slice
    of a block at a time; a block holds its vectors and one slice's pairs, however many link, and what leaves it are counts and one
    edge for each vector. A side of a block has at most `block_rows` vectors and 32 MB of them, so very long vectors mean smaller blocks.
    """
    spark = vectors.sparkSession
    columns = kept(vectors, keep, _ADDED)
    base = written(vectors.select(F.monotonically_increasing_id().alias("row"), F.col(q(id_col)).alias("id"), F.col(q(vector_col)).alias("v"), *(F.col(q(c)).alias(f"c{i}") for i, c in enumerate(columns))), "vectors")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    usable = F.coalesce(F.col("v").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0), F.lit(False))
    points = written(base.where(usable).groupBy("v").agg(F.min("row").alias("u"), F.count(F.lit(1)).alias("many"), F.min("id").alias("least")), "points")
    counted, edges = [], []
    for size, n in points.groupBy(F.size("v").alias("size")).count().collect():  # a row per size of vector
        counts, links = _join(spark, points.where(F.size("v") == size), size, n, threshold, pivots, max_pivots, block_rows)
        counted.append(counts)
        edges.append(links)
    if not counted:
        return base.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].union(union(frames[1:]))
    totals = union(counted).groupBy("u").agg(F.sum("n").alias("n"))
    roots = connected_components(union(edges)).withColumnRenamed("node", "u")
    classes = written(points.join(totals, "u", "left").join(roots, "u", "left").select("u", "least", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("root", "u").alias("root")), "classes")
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(least, "root").select("u", "n_links", "component_id")
    # rows find their point by the vector itself
    of = points.select("v", "u").join(named, "u").drop("u")
    out = base.join(of, "v", "left")
    label = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), label.alias("component_id"), F.col("id").eqNullSafe(label).alias("kept"))


def _near(x: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of unit vectors: the cells that each is dealt to, its home, and the square of the distance to that one's pivot."""
    square = np.maximum(0, 2 - 2 * (x @ pivots.T))
    home = square.argmin(1)
    own = np.take_along_axis(square, home[:, None], 1)
    between = np.sqrt(np.maximum(0, 2 - 2 * pivots[home] @ pivots.T))
    near = square - own <= 2 * radius * between + 1e-9  # within the radius of the boundary between two cells
    near &= np.sqrt(square) - np.sqrt(own) <= 2 * radius + 1e-9
    i, j = home[:, None], np.arange(len(pivots))
    near &= np.where((i + j) % 2 == 0, np.minimum(i, j), np.maximum(i, j)) == j  # the cell where the pairs of two cells meet
    near[np.arange(len(x)), home] = True
    return near, home, own[:, 0]


def _cost(sample: np.ndarray, pivots: np.ndarray, radius: float, n: int, block: int) -> float:
    """Rough seconds of a join of n such vectors: 5 ns for a pair compared, 4 us for a row sent to a block."""
    homes, copies = np.zeros(len(pivots)), np.zeros(len(pivots))
    for at in range(0, len(sample), 512):
        near, home, _ = _near(sample[at : at + 512], pivots, radius)
        homes += np.bincount(home, minlength=len(pivots))
        copies += near.sum(0)
    homes, copies = homes * n / len(sample), copies * n / len(sample)
    return float((homes * copies).sum() * 5e-9 + (homes * np.ceil(copies / block) + copies * np.maximum(1, np.ceil(homes / block))).sum() * 4e-6)


def _join(spark, points: DataFrame, size: int, n: int, threshold: float, k: int | None, most: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(u, n): links by number; (a, b): edges that give the same components as all links."""
    radius = math.sqrt(2 - 2 * threshold)
    block = max(1, min(block, _BLOCK_BYTES // (8 * size)))
    # max_pivots vectors and 2048 more at most
    drawn = points.select("v", F.xxhash64("u").alias("h")).orderBy("h", "v").limit(min(most, k or max(1, n // 64)) + 2048).collect()
    drawn = unit(np.array([r.v for r in drawn], np.float64))
    every, sample = drawn[: k or most], drawn[-2048:]
    if k is None:
        tried, best = [], math.inf
        for k in (1 << i for i in range(len(every).bit_length())):
            tried.append((_cost(sample, np.unique(every[:k], axis=0), radius, n, block), k))
            if tried[-1][0] > 2 * (best := min(best, tried[-1][0])):  # copies only grow from here on
                break
        k = min(tried)[1]
    shared = spark.sparkContext.broadcast(np.unique(every[:k], axis=0))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                near, home, own = _near(unit(_matrix(part.column("v"), size)), shared.value, radius)
                row, cell = np.nonzero(near)
                inner = (np.sqrt(own) <= radius / 2 - 1e-7)[row] & (cell == home[row])
                picked = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(cell == home[row]), pa.array(inner), picked.column("u"), picked.column("many"), picked.column("v")], ["cell", "home", "inner", "u", "many", "v"])

    kind = points.schema["v"].dataType.simpleString()
    cells = written(points.select("u", "many", "v").mapInArrow(deal, f"cell long, home boolean, inner boolean, u long, many long, v {kind}"), "cells")
    # a row per pivot
    sizes = {r.cell: r for r in cells.groupBy("cell").agg(F.count_if("home").alias("home"), F.count(F.lit(1)).alias("all")).collect()}
    lefts_n, rights_n = (F.element_at(F.array(*(F.lit(max(1, math.ceil(sizes[c][x] / block)) if c in sizes else 1).cast("long") for c in range(max(sizes, default=0) + 1))), (F.col("cell") + 1).cast("int")) for x in ("home", "all"))
    hashed = F.xxhash64("u")
    left = cells.where("home").select("cell", F.pmod(hashed, lefts_n).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), rights_n - F.lit(1).cast("long"))).alias("j"), F.lit(True).alias("left"), "home", "inner", "u", "many", "v")
    right = cells.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), lefts_n - F.lit(1).cast("long"))).alias("i"), F.pmod(hashed, rights_n).alias("j"), F.lit(False).alias("left"), "home", "inner", "u", "many", "v")
    found = written(left.union(right).groupBy("cell", "i", "j").applyInArrow(_compare(size, threshold), "a long, b long, n long"), "links")
    crowds = cells.where("inner").groupBy("cell").agg(F.min("u").alias("first"), F.sum("many").alias("total"))
    # a row per pivot at most
    crowd = cells.where("inner").join(F.broadcast(crowds), "cell")
    counts = found.where("b is null").select(F.col("a").alias("u"), "n").union(crowd.select("u", F.col("total") - F.col("many")))
    return counts, found.where("b is not null").select("a", "b").union(crowd.select(F.col("first").alias("a"), F.col("u").alias("b")))


def _compare(size: int, threshold: float):
    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side = table.column("left").to_numpy()
        empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        if side.all() or not side.any():
            return empty
        x = unit(_matrix(table.column("v").combine_chunks(), size))
        u, many, home, inner = (table.column(c).to_numpy() for c in ("u", "many", "home", "inner"))
        lefts, rights = np.flatnonzero(side), np.flatnonzero(~side)
        small = x.astype(np.float32)
        nodes, node = np.unique(u, return_inverse=True)  # a vector stands on both sides: one node
        count, label = np.zeros(len(x), np.int64), np.arange(len(nodes))
        slack = 1e-5 + size * 1e-6  # what single precision may miss by; pairs that are nearer to the threshold are judged in double precision
        rows, pairs = max(1, _SLICE_BYTES // (8 * len(rights))), max(1, _SLICE_BYTES // (8 * size))
        for at in range(0, len(lefts), rows):
            some = lefts[at : at + rows]
            cosine = small[some] @ small[rights].T
            close = cosine >= threshold - slack
            if not close.any():
                continue
            i, j = np.flatnonzero(close.any(1)), np.flatnonzero(close.any(0))
            some, there, cosine = some[i], rights[j], cosine[np.ix_(i, j)]
            # pairs at home once; a crowd's own pairs are known
            asked = (~home[there] | (u[some][:, None] < u[there])) & ~(inner[some][:, None] & inner[there])
            linked = asked & (cosine >= threshold + slack)
            a, b = np.nonzero(asked & ~linked & (cosine >= threshold - slack))
            for lo in range(0, len(a), pairs):
                c, d = a[lo : lo + pairs], b[lo : lo + pairs]
                linked[c, d] = np.einsum("ij,ij->i", x[some[c]], x[there[d]]) >= threshold
            count[some] += linked @ many[there]
            count[there] += many[some] @ linked
            label = _joined(label, node[some], node[there], linked)
        tied = np.flatnonzero(label != np.arange(len(label)))
        some = np.flatnonzero(count)
        return pa.table({"a": pa.array(np.r_[u[some], nodes[tied]]), "b": pa.array([None] * len(some) + nodes[label[tied]].tolist(), pa.int64()), "n": pa.array(np.r_[count[some], np.zeros(len(tied), np.int64)])})

    return compare


def op2_embedding_groups(spark, sf_dir: str) -> DataFrame:
    out = embedding_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), keep=["vec_id"])
    return out.select("vec_id", "n_links", "component_id", "kept")


OP2_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), linked AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN linked l ON r.b = l.a
), least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), n AS (SELECT a AS vec_id, count(*) AS n FROM linked GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, component_id, v.vec_id = component_id AS kept FROM embeddings v JOIN least USING (vec_id) LEFT JOIN n USING (vec_id)
"""
