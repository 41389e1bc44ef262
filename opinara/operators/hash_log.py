"""A log of the content hashes that a store of reviews holds, so that a batch finds its duplicates without reading the store.

Each batch adds a run: its hashes, dealt to folders by their first digits, so many of them that a folder holds about `CELL` hashes,
one file each. A lookup opens, in each run, only the folders that its own hashes can be in: a batch of b hashes reads at most b files of bounded
size of a large run, however large. Runs of one batch number after the other are merged eight at a time, so a store of n batches has fewer than
8 log8(n) runs, and a hash is written again log8(n) times at most.

A run's name says which batches it covers, and it counts when it is complete. A merged run takes the place of those it covers.
A batch first writes its run under another name, then its reviews, then renames the run; a run that was left
unnamed by a lost driver is checked against the store's reviews by the next batch. One writer at a time may add to a store.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hashes in a folder of a run, about; 64 digits each.
CELL = 1 << 16
_MERGE = 8
_NAME = re.compile(r"(run|open)-(\d+)-(\d+)-d(\d+)-[0-9a-f]+")


class Run(NamedTuple):
    path: str
    first: int
    last: int
    digits: int
    open: bool


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _folders(spark: SparkSession, path: str) -> list[str]:
    system, place = _files(spark, path)
    return [s.getPath().getName() for s in system.listStatus(place) if s.isDirectory()] if system.exists(place) else []


def runs(spark: SparkSession, store: str) -> list[Run]:
    """The complete runs of a store that no other one covers, in order of batches."""
    folder, found = f"{store}/_hashes", []
    for name in _folders(spark, folder):
        if m := _NAME.fullmatch(name):
            system, done = _files(spark, f"{folder}/{name}/_SUCCESS")
            if system.exists(done):
                found.append(Run(f"{folder}/{name}", int(m[2]), int(m[3]), int(m[4]), m[1] == "open"))
    covered = lambda r: any(not o.open and o.first <= r.first and r.last <= o.last and o.last - o.first > r.last - r.first for o in found)
    return sorted((r for r in found if not covered(r)), key=lambda r: (r.first, r.path))


def _write(hashes: DataFrame, store: str, kind: str, first: int, last: int, n: int) -> str:
    digits = 0
    while n >> 4 * digits > CELL:
        digits += 1
    path = f"{store}/_hashes/{kind}-{first}-{last}-d{digits}-{uuid.uuid4().hex}"
    cells = hashes.select("content_hash", F.concat(F.lit("c"), F.left("content_hash", F.lit(digits))).alias("cell"))
    cells.repartition("cell").sortWithinPartitions("cell").write.partitionBy("cell").parquet(path)
    return path


def found(hashes: DataFrame, store: str) -> DataFrame:
    """Those of the distinct `content_hash` values that the store's runs hold."""
    spark = hashes.sparkSession
    parts = [part for run in runs(spark, store) if (part := _read(hashes, run)) is not None]
    out = None
    for part in parts:
        out = part if out is None else out.union(part)
    return hashes.join(out, "content_hash", "left_semi") if out is not None else hashes.limit(0)


def _read(hashes: DataFrame, run: Run) -> DataFrame | None:
    """The hashes of a run's folders that the given ones can be in: the driver learns these folders, of which a run has one for each 2^16 hashes."""
    spark = hashes.sparkSession
    there = set(_folders(spark, run.path))
    cells = {f"cell=c{r[0]}" for r in hashes.select(F.left("content_hash", F.lit(run.digits))).distinct().collect()} if run.digits else there
    paths = [f"{run.path}/{c}" for c in sorted(cells & there)]
    return spark.read.schema("content_hash string").parquet(*paths) if paths else None


def prepare(spark: SparkSession, store: str, new: DataFrame, n: int) -> str:
    """Writes a batch's new hashes as a run that doesn't count yet."""
    last = max((r.last for r in runs(spark, store)), default=0) + 1
    return _write(new, store, "open", last, last, n)


def commit(spark: SparkSession, store: str, path: str) -> None:
    """Makes a run count, and merges runs of equal rank when there are eight of them."""
    system, place = _files(spark, path)
    _, to = _files(spark, path.replace("/open-", "/run-"))
    system.rename(place, to)
    while True:
        ranks: dict[int, list[Run]] = defaultdict(list)
        now = [r for r in runs(spark, store) if not r.open]
        for r in now:
            rank = 0
            while _MERGE ** (rank + 1) <= r.last - r.first + 1:
                rank += 1
            ranks[rank].append(r)
        some = next((x[:_MERGE] for x in ranks.values() if len(x) >= _MERGE), None)
        if not some:
            return
        rows = spark.read.schema("content_hash string").parquet(*(f"{r.path}/{c}" for r in some for c in _folders(spark, r.path) if c.startswith("cell=")))
        _write(rows, store, "run", some[0].first, some[-1].last, rows.count())
        for r in some:  # a reader that has listed them fails and is tried again
            system.delete(_files(spark, r.path)[1], True)


def recover(spark: SparkSession, store: str) -> None:
    """Runs that were left open count with those of their hashes whose reviews the store has."""
    for run in runs(spark, store):
        if run.open:
            system, place = _files(spark, run.path)
            hashes = spark.read.schema("content_hash string").parquet(*(f"{run.path}/{c}" for c in _folders(spark, run.path) if c.startswith("cell=")))
            try:
                stored = spark.read.schema("content_hash string").parquet(store)
                there = hashes.join(stored, "content_hash", "left_semi").persist()
                n = there.count()
            except Exception as e:
                if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                    raise
                there, n = None, 0
            if there is not None and n:
                commit(spark, store, _write(there, store, "open", run.first, run.last, n))
                there.unpersist()
            system.delete(place, True)
