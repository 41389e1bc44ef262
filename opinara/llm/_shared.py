"""What the operators of this subpackage share: the shared folder, written tables, names that cannot clash."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import types
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder in the cluster's checkpoint folder, which the driver and all executors share.

    Only on a local master, as in tests, can that setting be unset: then one is made on this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Folders that written() has made and nobody has removed.
_WRITTEN: list[str] = []


def written(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """The same rows, written to the shared folder and read again: the lineage ends there, so a lost executor
    costs a task and not the whole plan, and rows that two later steps both read are computed once.
    `by`: columns of few values, each of which can then be read by itself."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path, partitionBy=by)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_path(df: DataFrame) -> str:
    """The folder of what written() or settled() has just returned."""
    return _WRITTEN[-1]


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Removes folders that written() made, in whatever store they are."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        _WRITTEN.remove(path)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What `make` returns, written; the tables that were written on the way to it are removed."""
    before = len(_WRITTEN)
    out = written(make(), name)
    remove(out.sparkSession, _WRITTEN[before:-1])
    return out


def kept(df: DataFrame, keep: list[str] | None, drop: tuple[str, ...] = ()) -> list[str]:
    """The input columns to carry along: `keep` or all, without those whose names the operator writes itself."""
    own = {x.lower() for x in drop}
    return [c for c in (df.columns if keep is None else keep) if c.lower() not in own]


def q(name: str) -> str:
    """A column's name, quoted."""
    return "`" + name.replace("`", "``") + "`"


#: Sets of hashes too large for a broadcast are tested by their upper bits in a bitmap of 2 MB, however many there are; the
#: fuller it is, the more hashes pass that aren't in the set.
SLOT_BITS = 24


def bitmap(hashes: DataFrame) -> np.ndarray:
    """The slots of a column `hash` of longs: built by Spark in pieces of 4 KB, of which there are 512 at most."""
    slot = F.shiftrightunsigned("hash", 64 - SLOT_BITS)
    pieces = hashes.select(slot.alias("slot")).groupBy(F.shiftright("slot", 15).alias("piece")).agg(F.bitmap_construct_agg(F.col("slot").bitwiseAND(F.lit(32767))).alias("bits")).collect()
    bits = np.zeros(1 << (SLOT_BITS - 3), np.uint8)
    for r in pieces:
        bits[r.piece << 12 : (r.piece + 1) << 12] = np.frombuffer(r.bits, np.uint8)
    return bits


def marked(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The places of hashes (unsigned) whose slot is set."""
    slot = (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
    return np.flatnonzero(bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)


class Codes(dict):
    """XXH64 of words, by word; short ones are remembered, up to a number."""

    def __missing__(self, word: bytes) -> int:
        code = xxhash.xxh64_intdigest(word, 42)
        if len(word) <= 32 and len(self) < 1 << 17:
            self[word] = code
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def give_back(spark: SparkSession) -> None:
    """Returns memory that Python, Arrow and the JVM hold but no longer use: a driver that goes on for long doesn't keep the largest step's.
    Spark removes the shuffle files and broadcasts of ended steps when the driver's garbage is collected, else up to half an hour later."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)


def in_process(name: str, make):
    """What `make` returns, made once in each Python process and then kept under `name`."""
    store = sys.modules.setdefault("_opinara_in_process", types.ModuleType("_opinara_in_process"))
    if not hasattr(store, name):
        setattr(store, name, make())
    return getattr(store, name)
