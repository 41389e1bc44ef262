"""From raw documents to token files: quality, near-duplicates, decontamination, mixing, token records.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents, as they came, whatever they are called: a stage works on
the id, the text or the source under names of its own, with each row's place in its input, and picks rows by that.
So docs has to be a table, which reads the same each time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.llm._shared import give_back, remove, settled, written_path
from opinara.llm.decontam import decontaminate
from opinara.llm.mixing import mix_sources
from opinara.llm.quality import score_quality
from opinara.llm.simhash import near_duplicate_groups
from opinara.llm.token_records import token_digest

#: A name that no table has: a row's place in the stage's input.
_ROW = "__row_of_stage"


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.withColumn(_ROW, F.monotonically_increasing_id())


def _plain(docs: DataFrame, *columns: str) -> DataFrame:
    """The row's place and the columns that a stage reads, and no others, whose names could clash with an operator's."""
    return _numbered(docs).select(_ROW, *columns)


def _only(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The documents whose place is in `rows`, each once, with all their columns."""
    return _numbered(docs).join(rows.select(_ROW), _ROW, "left_semi").select(*(f"`{c}`" for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts are judged like any other, and alike; repeated rows share their fate. A null id or label
    teaches nothing. An empty table stays empty; without labels every score is 0.5 and all stay.
    """
    own = {c: f"__stage_{i}" for i, c in enumerate(docs.columns)}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias(own["doc_id"]), F.col("quality").alias("__quality"))
    # all columns pass through, renamed: the text needs no second reading
    scored = score_quality(docs.withColumnsRenamed(own), labels, id_col=own["doc_id"], text_col=own["text"], label_col="__quality")
    give_back(spark)  # the sample that the classifier was fitted on
    return scored.where("predicted = 1").select(*(F.col(n).alias(c) for c, n in own.items()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the document with the smallest id stays.

    Of equal ids, as of repeated rows, the first stays; null ids come last. Null texts and texts without words are one
    group, of which one row stays. An empty table stays empty.
    """
    key = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col(_ROW).alias("row"))
    groups = near_duplicate_groups(_plain(docs, "doc_id", "text").select(_ROW, key.alias("key"), "text"), id_col="key", keep=[_ROW, "key"])
    return _only(docs, groups.where("key = component_id"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold enough of the benchmark go.

    Null and empty texts have no words and stay. Rows are judged one by one, so repeated rows share their fate and null
    ids don't matter. An empty table stays empty; with an empty benchmark all stay.
    """
    judged = decontaminate(_plain(docs, "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=[_ROW])
    give_back(spark)  # what the search took
    return _numbered(docs).join(judged.where("contaminated").select(_ROW), _ROW, "left_anti").select(*(f"`{c}`" for c in docs.columns))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as the mix takes it.

    A null source is a source of its own; null and empty texts have size 0 and are taken as their source's rate says.
    Ties in size are ordered by id, null first; repeated rows are taken each for itself. An empty table stays empty.
    """
    copies = mix_sources(_plain(docs, "doc_id", "source", "text"), keep=[_ROW]).where("copies > 0").select(_ROW, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__copy"))
    give_back(spark)  # what the targets took
    return _numbered(docs).join(copies, _ROW).select(*(f"`{c}`" for c in docs.columns))


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token records in binary files; returned is what is read back from them: doc_id, start, n_tokens, ids_crc32.

    A null or empty text is just the end id. Records are in order of id, null first; rows of one id, copies too, in the order of
    the input. An empty table gives no records.
    """
    return token_digest(_plain(docs, "doc_id", "text"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("token_output", token_output)]

#: SQL can't fit the classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents. A stage's tables are removed when the next one's result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
        if before:
            remove(spark, [before])
        before = written_path(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
