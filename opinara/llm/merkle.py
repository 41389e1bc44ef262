"""A manifest of a dataset as Merkle trees: one tree for each group of rows, and a tree over their roots.

A level of all trees is one table of nodes (tree, index, number of nodes, digest), written so that a lost executor costs a
task and not the levels below. Nodes find their siblings by equijoins on computed indices: XOR 1 in a binary tree,
the slot's offset otherwise. Only rows in slot zero take part on the other side, so each level shuffles each node once, and these rows emit the
parents. Going down again, each node meets its parent once, which hands over the run's digests and its own path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.llm._shared import kept, q, written

#: One level of a path: the digests of the siblings before and behind a node, as one string each.
_PATH = "array<struct<left: string, right: string>>"


def field_digest(values: list[Column]) -> Column:
    """Lowercase hex SHA-256 of the values, each as `-` if null, else its number of UTF-8 bytes, `:` and itself."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _numbered(rows: DataFrame, order: list[str], arity: int, name: str) -> tuple[DataFrame, int]:
    """Rows with `index` (from 0, in `order` within `tree`), `slot` and `nodes` (rows of the tree), and the most of these.

    Rows are range-partitioned by tree and order, so a large tree lies in many partitions; what is gathered by tree is
    a row for each of its partitions.
    """
    by = [F.col(c).asc_nulls_first() for c in ("tree", *order)]
    dealt = written(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()), f"{name}-sorted").withColumn("part", F.shiftright("at", 33))
    parts = dealt.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("first"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("rows").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = written(parts.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(tree).alias("nodes")), f"{name}-places")
    most = places.agg(F.max("nodes").alias("n")).first().n or 0
    rows = dealt.join(places, ["tree", "part"]).withColumn("index", F.col("at") + F.col("shift")).drop("at", "part", "shift")
    return written(rows.withColumn("slot", (F.col("index") % arity).cast("int")), name, by=["slot"]), most


def _parents(nodes: DataFrame, arity: int, name: str) -> DataFrame:
    """The next level: (tree, index, slot, nodes, digest, run). A tree of one node stays as it is, with a null run."""
    heads = nodes.where("slot = 0").select("tree", "index", "nodes", "digest")
    for slot in range(1, arity):
        sibling = F.col("index").bitwiseXOR(F.lit(1).cast("long")) if arity == 2 else F.col("index") - slot
        heads = heads.join(nodes.where(F.col("slot") == slot).select("tree", sibling.alias("index"), F.col("digest").alias(f"digest_{slot}")), ["tree", "index"], "left")
    run = F.array_compact(F.array("digest", *(f"digest_{s}" for s in range(1, arity))))
    alone = F.col("nodes") == 1
    index = F.floor(F.col("index") / F.lit(arity)).cast("long") if arity & (arity - 1) else F.shiftright("index", arity.bit_length() - 1)
    up = heads.select("tree", index.alias("index"), F.ceil(F.col("nodes") / F.lit(arity)).cast("long").alias("nodes"), F.when(alone, F.col("digest")).otherwise(F.sha2(F.array_join(run, ""), 256)).alias("digest"), F.when(~alone, run).alias("run"))
    return written(up.withColumn("slot", (F.col("index") % arity).cast("int")), name, by=["slot"])


def _levels(nodes: DataFrame, most: int, arity: int, name: str) -> list[DataFrame]:
    """All levels of all trees, the largest of which has `most` nodes; in the last each tree has one."""
    levels = [nodes]
    while most > 1:
        levels.append(_parents(levels[-1], arity, f"{name}-{len(levels)}"))
        most = -(-most // arity)
    return levels


def _paths(levels: list[DataFrame], tops: DataFrame, arity: int) -> DataFrame:
    """The lowest level with each node's `path` to the root, and what else `tops` (tree, path, ...) has for its tree."""
    more = [c for c in tops.columns if c not in ("tree", "path")]
    above = levels[-1].join(tops, "tree")
    for level in levels[-2::-1]:
        parents = above.select("tree", F.col("index").alias("parent"), "run", "path", *more)
        own = level.drop("run") if level is levels[0] else level.withColumnRenamed("run", "own_run")
        step = F.struct(F.array_join(F.slice("run", F.lit(1), F.col("slot")), "").alias("left"), F.array_join(F.slice("run", F.col("slot") + 2, F.lit(arity)), "").alias("right"))
        index = F.floor(F.col("index") / F.lit(arity)).cast("long") if arity & (arity - 1) else F.shiftright("index", arity.bit_length() - 1)
        above = own.withColumn("parent", index).join(parents, ["tree", "parent"]).withColumn("path", F.when(F.col("run").isNull(), F.col("path")).otherwise(F.concat(F.array(step), F.col("path")))).drop("parent", "run")
        above = above.withColumnRenamed("own_run", "run")
    return above


def merkle_manifest(rows: DataFrame, *, leaf: Column, id_col: str = "doc_id", tree_col: str = "lang", arity: int = 8, keep: list[str] | None = None) -> DataFrame:
    """The kept columns, `leaf`, `subroot` (the root of the row's tree), `root` and `path`, one struct (left, right) a level.

    Leaves ascend by id within their tree, null first; equal ids by their digest. Each `arity` consecutive nodes make a parent, the last
    fewer, while a tree has more than one; then the trees' roots, ordered by tree (null first, bytewise), do. A lone leaf
    is its own subroot, a lone subroot the root; their paths are empty. Repeated rows are leaves each. Null and empty texts are what
    `leaf` makes of them; long ones are read once, where leaves are computed, and go no further. An empty table has no rows and no root.
    """
    keep = kept(rows, keep, ("leaf", "subroot", "root", "path"))
    own = [F.col(q(c)).alias(f"own_{i}") for i, c in enumerate(keep)]  # columns may be named as those used here
    tree = F.coalesce(F.concat(F.lit("="), F.col(q(tree_col)).cast("string")), F.lit(""))  # null first
    leaves = written(rows.select(tree.alias("tree"), F.col(q(id_col)).alias("id"), leaf.alias("digest"), F.monotonically_increasing_id().alias("row"), *own), "merkle-leaves")
    nodes, most = _numbered(leaves, ["id", "digest", "row"], arity, "merkle")
    levels = _levels(nodes, most, arity, "merkle")
    roots = levels[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("digest"))
    top, trees = _numbered(roots, ["of"], arity, "merkle-trees")
    tops = _levels(top, trees, arity, "merkle-trees")
    root = tops[-1].select("digest").first()
    whole = _paths(tops, rows.sparkSession.createDataFrame([("",)], "tree string").withColumn("path", F.array().cast(_PATH)), arity)
    whole = whole.select(F.col("of").alias("tree"), "path", F.col("digest").alias("subroot"))
    out = _paths(levels, whole, arity)
    return out.select(*(F.col(f"own_{i}").alias(c) for i, c in enumerate(keep)), F.col("digest").alias("leaf"), "subroot", F.lit(root.digest if root else None).cast("string").alias("root"), "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest gives with the siblings of its path."""
    return F.aggregate(path, leaf, lambda digest, step: F.sha2(F.concat(step["left"], digest, step["right"]), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    other = F.when(tampered, field_digest([F.col(c) for c in fields[:-1]] + [lower_ascii(F.col("text"))]))
    out = merkle_manifest(docs.select("doc_id", "lang", "source", "n_chars", "text", other.alias("tampered")), leaf=field_digest([F.col(c) for c in fields]), keep=["doc_id", "tampered"])
    out = out.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_FIELDS = " || ".join(f"coalesce(strlen({c})::varchar || ':' || {c}, '-')" for c in ("doc_id::varchar", "source", "lang", "n_chars::varchar", "{text}"))
OP12_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, sha256({_FIELDS.format(text="text")}) AS leaf,
    sha256({_FIELDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) AS changed,
    xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END), 4294967295) AS crc
  FROM documents),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, leaf) AS id, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n
  FROM leaves),
trees(lang, lvl, idx, n, hash) AS (
  SELECT lang, 0, idx, n, leaf FROM numbered
  UNION ALL
  SELECT lang, lvl + 1, idx // 8, (max(n) + 7) // 8, sha256(string_agg(hash, '' ORDER BY idx)) FROM trees WHERE n > 1 GROUP BY lang, lvl, idx // 8),
subroots AS (SELECT lang, hash AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM trees WHERE n = 1),
tops(lvl, idx, n, hash) AS (
  SELECT 0, idx, n, subroot FROM subroots
  UNION ALL
  SELECT lvl + 1, idx // 8, (max(n) + 7) // 8, sha256(string_agg(hash, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY lvl, idx // 8),
runs AS (SELECT coalesce('=' || lang, '') AS tree, lvl, idx // 8 AS parent, list(hash ORDER BY idx) AS run FROM trees WHERE n > 1 GROUP BY ALL),
top_runs AS (SELECT lvl, idx // 8 AS parent, list(hash ORDER BY idx) AS run FROM tops WHERE n > 1 GROUP BY ALL),
climb(id, tree, lvl, idx, hash, proof, done) AS (
  SELECT id, coalesce('=' || lang, ''), 0, idx, CASE WHEN crc % 3 = 0 THEN changed ELSE leaf END, '', n = 1 FROM numbered
  UNION ALL
  SELECT c.id, c.tree, c.lvl + 1, c.idx // 8, sha256(array_to_string(run[1 : c.idx % 8], '') || c.hash || array_to_string(run[c.idx % 8 + 2 :], '')),
    c.proof || array_to_string(run[1 : c.idx % 8], '') || array_to_string(run[c.idx % 8 + 2 :], ''), t.n = 1
  FROM climb c JOIN runs r ON r.tree = c.tree AND r.lvl = c.lvl AND r.parent = c.idx // 8
    JOIN trees t ON coalesce('=' || t.lang, '') = c.tree AND t.lvl = c.lvl + 1 AND t.idx = c.idx // 8
  WHERE NOT c.done),
climb_top(id, subroot, lvl, idx, hash, proof, done) AS (
  SELECT c.id, s.subroot, 0, s.idx, c.hash, c.proof, s.n = 1 FROM climb c JOIN subroots s ON coalesce('=' || s.lang, '') = c.tree WHERE c.done
  UNION ALL
  SELECT c.id, c.subroot, c.lvl + 1, c.idx // 8, sha256(array_to_string(run[1 : c.idx % 8], '') || c.hash || array_to_string(run[c.idx % 8 + 2 :], '')),
    c.proof || array_to_string(run[1 : c.idx % 8], '') || array_to_string(run[c.idx % 8 + 2 :], ''), t.n = 1
  FROM climb_top c JOIN top_runs r ON r.lvl = c.lvl AND r.parent = c.idx // 8 JOIN tops t ON t.lvl = c.lvl + 1 AND t.idx = c.idx // 8
  WHERE NOT c.done)
SELECT n.doc_id, n.leaf, c.subroot, r.hash AS root, sha256(c.proof) AS proof_sha256, c.hash AS folded_root, c.hash = r.hash AS verified
FROM climb_top c JOIN numbered n ON n.id = c.id, (SELECT hash FROM tops WHERE n = 1) r WHERE c.done
"""
