"""Files in and out: annotations, checkpoints of records, plain texts, statistics."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place in the cluster's checkpoint folder. Only on a local master, as in tests, can that setting be unset: then it is on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def once(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written and read again: what several later steps read is computed once."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_corpus(spark: SparkSession, train: str, test: str) -> DataFrame:
    from opinara.operators.ingest import label_corpus

    return label_corpus(spark.read.parquet(train), spark.read.parquet(test))


def read_annotations(spark: SparkSession, path: str, annotator: str, schema: str = "id string, aspects string") -> DataFrame:
    """id and aspects_{annotator} of a CSV file whose fields may hold quotes and newlines; other columns are not read."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', schema=schema, enforceSchema=False)
    return df.select("id", F.col("aspects").alias(f"aspects_{annotator}"))


def read_checkpoint(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON lines, the last one of each id; blank and malformed lines are skipped.

    Lines have no order in Spark: a record's order is its file's name, then its seq, which the writer gave it.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), "value").where("trim(value) <> ''")
    parsed = lines.select("file", F.from_json("value", f"{schema}, seq long, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r")).where("r is not null and r._corrupt is null and r.id is not null")
    last = parsed.groupBy("r.id").agg(F.max_by("r", F.struct(F.coalesce("r.seq", F.lit(-1)), "file")).alias("r"))
    return last.select("r.*").drop("_corrupt", "seq")


def append_checkpoint(records: DataFrame, path: str) -> None:
    """Appends records (with id and seq) as JSON lines; done records are those that read_checkpoint finds."""
    records.write.mode("append").json(path)


def unfinished(df: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    return df.join(done.select(key), key, "left_anti")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(text): the text column of a CSV file with a header, or the stripped lines, blank ones left out, of another file."""
    if path.rstrip("/").endswith(".csv"):
        df = spark.read.csv(path, header=True, multiLine=True, escape='"')
        if "text" not in df.columns:
            raise ValueError(f"{path} has no column text")
        return df.select("text")
    text = F.regexp_replace("value", r"(?U)^\s+|\s+$", "")
    return spark.read.text(path).select(text.alias("text")).where("text <> ''")


def write_table(df: DataFrame, path: str, *, csv: bool = False, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    w = w.partitionBy(*partition_by) if partition_by else w
    w.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False) if csv else w.parquet(path)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows that write_table wrote as CSV, as they were: a field without quotes is null, an empty one in quotes is an empty text.

    Spark reads both as its option nullValue, so that is a word drawn anew, which no file can hold. Without charToEscapeQuoteEscaping
    zero bytes between quotes are lost.
    """
    return spark.read.csv(path, header=True, multiLine=True, escape='"', charToEscapeQuoteEscaping='"', lineSep="\n", nullValue=f"null-{uuid.uuid4().hex}", schema=schema)


def write_stats(stats: DataFrame, path: str) -> None:
    """A one-row table of statistics as JSON."""
    stats.coalesce(1).write.mode("overwrite").json(path)
