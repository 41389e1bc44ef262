"""Document quality by a factorisation machine over hashed words, structure statistics and hashed metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]): all pairwise interactions of
low rank in time linear in a document's features.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinara.llm._shared import kept, q

WORD_SLOTS = 1 << 14
#: Bytes whose share of a text is a statistic each.
_MARKS = b"\n.,;:!?#$%&*|<>{}[]()/\\-_'\"=@~^`+"
STATS = 17 + len(_MARKS)
SLOTS = WORD_SLOTS + STATS
RANK = 8


def structure(text: bytes, words: list[bytes], counts: Counter) -> list[float]:
    """Statistics of a text's form; all are bounded or logarithms, and defined for empty texts."""
    size = max(1, len(text))
    bytes_ = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    lines = text.split(b"\n")
    n = max(1, len(words))
    top = counts.most_common(1)[0][1] if counts else 0
    upper = sum(map(bytes.isupper, words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    alpha = sum(map(bytes.isalpha, words))
    return [
        np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)), bytes_[65:91].sum() / size, bytes_[97:123].sum() / size, bytes_[48:58].sum() / size, bytes_[128:].sum() / size, bytes_[32] / size,
        len(counts) / n, top / n, sum(map(bytes.__eq__, words, words[1:])) / n, len(set(lines)) / len(lines), upper / n, alpha / n, np.log1p(lengths.mean()), np.log1p(lengths.std()), np.log1p(len(words) / len(lines)),
        *(bytes_[list(_MARKS)] / size),
    ]


def features(text: bytes | None, metadata: tuple[bytes, ...] = ()) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Slots and values of a text's distinct words (of unit length together) and of metadata, and the text's statistics."""
    text = text or b""
    words = text.split()
    counts = Counter(words)
    slots = np.fromiter((zlib.crc32(w) % WORD_SLOTS for w in (*counts, *metadata)), np.int32, len(counts) + len(metadata))
    values = np.log1p(np.fromiter(counts.values(), np.float32, len(counts)))
    values /= max(1e-9, float(np.sqrt((values * values).sum())))
    return slots, np.concatenate((values, np.ones(len(metadata), np.float32))), structure(text, words, counts)


def _rows_features(batch: pa.RecordBatch, names: list[str]) -> list[tuple]:
    """The features of a batch whose last columns are the metadata `names` (strings) and the text."""
    texts = batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()
    first = batch.num_columns - 1 - len(names)
    metadata = zip(*([b"%s=%s" % (n.encode(), b"" if v is None else v.encode()) for v in batch.column(first + i).to_pylist()] for i, n in enumerate(names)), strict=True) if names else [()] * len(texts)
    return [features(t, m) for t, m in zip(texts, metadata, strict=True)]


class Machine:
    """The fitted weights; their size is fixed by SLOTS and RANK."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, bias: float, linear: np.ndarray, factors: np.ndarray):
        self.mean, self.scale, self.bias, self.linear, self.factors = mean, scale, bias, linear, factors

    def row(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        slots, values, stats = features(text)
        return _row(slots, values, np.array(stats), self.mean, self.scale)

    def score(self, rows: list[tuple]) -> np.ndarray:
        """Of rows of slots and values: all at once, each row summed for itself."""
        starts = np.cumsum([0, *(len(s) for s, _ in rows)])[:-1]
        slots, values = np.concatenate([s for s, _ in rows]), np.concatenate([v for _, v in rows])
        products = self.factors[slots] * values[:, None]
        pairs = np.add.reduceat(products, starts) ** 2 - np.add.reduceat(products * products, starts)
        total = self.bias + np.add.reduceat(self.linear[slots] * values, starts) + 0.5 * pairs.sum(1)
        return 1 / (1 + np.exp(-np.clip(total.astype(np.float64), -30, 30)))


def _row(slots, values, stats, mean, scale):
    return np.concatenate((slots, np.arange(WORD_SLOTS, SLOTS, dtype=np.int32))), np.concatenate((values, np.clip((stats - mean) / scale, -4, 4).astype(np.float32) / 4))


def fit(slots: list, values: list, stats: np.ndarray, y: np.ndarray, *, epochs: int = 12, rate: float = 0.1, decay: float = 1e-5, batch: int = 128, seed: int = 42) -> Machine:
    """Logistic loss, adaptive steps over shuffled small batches; the same rows in the same order give the same model."""
    if not len(y) or y.min() == y.max():  # nothing to tell apart: everything is as good as the rows are
        rate_ = float(y.mean()) if len(y) else 0.5
        return Machine(np.zeros(STATS), np.ones(STATS), float(np.log((rate_ + 1e-3) / (1 - rate_ + 1e-3))), np.zeros(SLOTS, np.float32), np.zeros((SLOTS, RANK), np.float32))
    random = np.random.default_rng(seed)
    mean, scale = stats.mean(0), stats.std(0) + 1e-6
    rows = [_row(np.asarray(s, np.int32), np.asarray(v, np.float32), x, mean, scale) for s, v, x in zip(slots, values, stats, strict=True)]
    linear, factors, bias = np.zeros(SLOTS, np.float64), random.normal(0, 0.02, (SLOTS, RANK)), float(np.log(y.mean() / (1 - y.mean())))
    g_linear, g_factors = np.full(SLOTS, 1e-3), np.full((SLOTS, RANK), 1e-3)
    for _ in range(epochs):
        order = random.permutation(len(rows))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            i = np.concatenate([rows[r][0] for r in chosen])
            x = np.concatenate([rows[r][1] for r in chosen]).astype(np.float64)
            of = np.repeat(np.arange(len(chosen)), [len(rows[r][0]) for r in chosen])
            starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            vx = factors[i] * x[:, None]
            sums = np.add.reduceat(vx, starts)
            total = bias + np.add.reduceat(linear[i] * x, starts) + 0.5 * (sums**2 - np.add.reduceat(vx * vx, starts)).sum(1)
            error = (1 / (1 + np.exp(-np.clip(total, -30, 30))) - y[chosen]) / len(chosen)
            e = error[of]
            bias -= rate * error.sum()
            d = np.bincount(i, e * x, SLOTS) + decay * linear
            g_linear += d * d
            linear -= rate * d / np.sqrt(g_linear)
            grad = (e * x)[:, None] * (sums[of] - vx)
            d = np.stack([np.bincount(i, grad[:, f], SLOTS) for f in range(RANK)], axis=1) + decay * factors
            g_factors += d * d
            factors -= 0.5 * rate * d / np.sqrt(g_factors)
    return Machine(mean, scale, bias, linear.astype(np.float32), factors.astype(np.float32))


def _lists(column: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    """A column of lists as views of one array, without an object per number."""
    whole = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    flat, lengths = np.asarray(whole.flatten(), kind), whole.value_lengths().to_numpy(zero_copy_only=False)
    return np.split(flat, np.cumsum(lengths)[:-1]) if len(lengths) else []


def held_out(id_col: Column) -> Column:
    """Rows from which no label may be learnt."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", metadata: tuple[str, ...] = (), max_rows: int = 8192) -> Machine:
    """The machine of at most `max_rows` labelled documents: those not held out whose ids have the least hashes.

    This documented bound is what reaches the driver: the sample's features, however many documents and labels there
    are. The sample, and so the machine, is the same however the tables are partitioned, as long as ids differ. Null
    labels, labels without a document and documents with a null id teach nothing.
    """
    usable = labels.where(F.col(q(label_col)).isNotNull() & F.col(q(id_col)).isNotNull() & ~held_out(F.col(q(id_col)))).select(F.col(q(id_col)).alias("id"), F.col(q(label_col)).cast("double").alias("y")).groupBy("id").agg(F.max("y").alias("y"))
    # hashes below this hold twice as many ids as are wanted; of these the least are taken, so no task sorts more
    rows = max(1, usable.count())
    share = min(1 << 20, max(1, (2 * max_rows << 20) // rows))
    hashed = F.xxhash64("id")
    sample = usable.where(F.pmod(hashed, F.lit(1 << 20)) < share).orderBy(F.pmod(hashed, F.lit(1 << 20)), hashed, "id").limit(max_rows)
    schema = "id string, y double, slots array<int>, amounts array<float>, stats array<double>"

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _rows_features(batch, list(metadata))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float32())), pa.array([r[2] for r in rows], pa.list_(pa.float64()))], ["id", "y", "slots", "amounts", "stats"])

    # broadcast: max_rows ids and labels at most
    texts = docs.select(F.col(q(id_col)).alias("id"), F.col(q(text_col)).cast("string").alias("text"), *_metadata(metadata)).join(F.broadcast(sample), "id")
    got = texts.select(F.col("id").cast("string"), "y", *(f"m{i}" for i in range(len(metadata))), "text").mapInArrow(describe, schema)
    # documents that share an id could be more than the ids: those with the least features' hashes stand for all
    got = got.orderBy(F.xxhash64("id", "slots"), "id", "stats").limit(max_rows).toArrow().sort_by([("id", "ascending"), ("y", "ascending")])
    stats = np.asarray(got["stats"].combine_chunks().flatten(), np.float64).reshape(-1, STATS)
    return fit(_lists(got["slots"], np.int32), _lists(got["amounts"], np.float32), stats, np.asarray(got["y"].combine_chunks(), np.float64))


def _metadata(names: tuple[str, ...]) -> list[Column]:
    return [F.col(q(c)).cast("string").alias(f"m{i}") for i, c in enumerate(names)]


def score_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", metadata: tuple[str, ...] = (), max_rows: int = 8192, keep: list[str] | None = None) -> DataFrame:
    """Every document with score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= 0.5, else 0).

    Inputs are the whole text and the columns named in `metadata`, each hashed as name=value (null: an empty value). Null
    and empty texts are scored alike, by statistics of nothing. Repeated rows get equal scores. Without usable labels
    the score is 0.5; with one class only it is near that class. An empty table gives an empty result. Other
    columns are carried along (`keep`: only these); input columns named as an added one are replaced.
    """
    m = train(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, metadata=metadata, max_rows=max_rows)
    weights = docs.sparkSession.sparkContext.broadcast((m.mean, m.scale, m.bias, m.linear, m.factors))  # of a fixed size
    carried = [docs.schema[c] for c in kept(docs, keep, ("score", "predicted"))]
    own = [f"c{i}" for i in range(len(carried))]
    schema = T.StructType([*(T.StructField(c, f.dataType) for c, f in zip(own, carried, strict=True)), T.StructField("score", T.DoubleType())])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine(*weights.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                scores = machine.score([_row(s, v, np.array(x), machine.mean, machine.scale) for s, v, x in _rows_features(part, list(metadata))])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(own)], pa.array(scores, pa.float64())], [*own, "score"])

    rows = docs.select(*(F.col(q(f.name)).alias(c) for c, f in zip(own, carried, strict=True)), *_metadata(metadata), F.col(q(text_col)).cast("string").alias("text")).mapInArrow(mark, schema)
    return rows.select(*(F.col(c).alias(f.name) for c, f in zip(own, carried, strict=True)), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score_quality(docs, labels, keep=["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
