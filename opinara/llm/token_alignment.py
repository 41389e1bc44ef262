"""Alignment of two tokenizers' tokens of the same texts, and what each link counts in the whole corpus.

Both token sequences of a text cover the same bytes. Where tokens of both end at one byte, the text is cut, and between two cuts
stands a group, all of whose A and B tokens are linked. Texts are taken in batches bounded by their bytes: two pointers for each
text advance over its A and B tokens, all texts of a batch in lockstep, as one NumPy vector, which shrinks as texts end.

Counts need the corpus: each batch sends every pair of ids it holds once, with its number of documents. Spark sums pairs
over all batches, finds each A id's highest count, joins both back to the batches' pairs, and gives each batch its own. So what
is shuffled are the batches' distinct pairs, never a row for each link; a very common pair has a row for each batch.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from opinara.llm._shared import in_process, kept, q, written
from opinara.llm.token_records import Encoder

_UNITS = re.compile(" +[^ ]*")
_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


class PieceEncoder:
    """Ids of whole texts as little-endian unsigned integers of 2 bytes, by a vocabulary that marks word starts.

    No piece of such a vocabulary holds a space behind another character, so no merge crosses the place before a run of spaces: the
    library encodes what stands between two such places, each distinct string once. Short ones are remembered, about `most` bytes.
    A string whose pieces don't give back its bytes, as one with the mark itself, has the ids None, and so has its text.
    """

    def __init__(self, path: str, most: int = 64 << 20):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        self.pieces = [self.library.id_to_piece(i) for i in range(self.library.vocab_size())]
        if len(self.pieces) > 1 << 16 or any("▁" in p.lstrip("▁") for p in self.pieces):
            raise ValueError(f"{path}: pieces hold spaces behind other characters, or ids have over 2 bytes")
        self.bytes = piece_bytes(self.pieces)
        self.lone = np.array([self.library.piece_to_id("▁")], "<u2").tobytes()
        self.known: dict[str, bytes | None] = {" ": self.lone}
        self.most, self.held = most, 0

    def encode(self, texts: list[str]) -> list[bytes | None]:
        units = [_UNITS.findall(" " + t) for t in texts]
        if self.held > self.most:
            self.known, self.held = {" ": self.lone}, 0
        new = list(set().union(*units).difference(self.known))
        for unit, ids in zip(new, self.library.encode([u[1:] for u in new], num_threads=1), strict=True):
            self.known[unit] = array("H", ids).tobytes() if b"".join(map(self.bytes.__getitem__, ids)) == unit.encode() else None
            self.held += 200 + len(unit) + 2 * len(ids)
        out = []
        for own in units:
            try:
                out.append(b"".join(map(self.known.__getitem__, own)))
            except TypeError:  # one of them is None
                out.append(None)
        for unit in [u for u in new if len(u) > 64]:
            self.held -= 200 + len(unit) + len(self.known.pop(unit) or b"")
        return out


def byte_level_bytes(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary: its characters stand for bytes, printable ones for themselves.

    Each of the 256 bytes has to have a token, and nothing may normalise a text: then ids give back its bytes, whatever it is.
    """
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(own))}
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    ids = model["model"]["vocab"]
    if model["normalizer"] or not all(c in ids for c in of):
        raise ValueError(f"{path}: not every text's bytes can be got back")
    out = [b""] * (max([*ids.values(), *(t["id"] for t in model["added_tokens"])]) + 1)
    for token, i in ids.items():
        out[i] = bytes(map(of.__getitem__, token)) if all(c in of for c in token) else token.encode()
    return out


def piece_bytes(pieces: list[str]) -> list[bytes]:
    """The bytes of each piece: <0xHH> is that byte, U+2581 a space."""
    return [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]


class Tokenizers:
    """Both encoders, and by id: bytes, their number, and the text of the id with what follows it in a digest."""

    def __init__(self, a: str, b: str):
        self.a, self.b = Encoder(a, plain=True), PieceEncoder(b)
        if self.a.width != 2:
            raise ValueError(f"{a}: ids have over 2 bytes")
        tables = byte_level_bytes(a), self.b.bytes
        self.sizes = tuple(np.array([len(x) for x in table], np.int64) for table in tables)
        n, m = map(len, tables)
        self.shown = np.array([b"%d%c" % (i, c) for size, ends in ((n, b",|"), (m, b",;")) for c in ends for i in range(size)], "S6")
        self.widths = np.char.str_len(self.shown)
        self.starts = 0, n, 2 * n, 2 * n + m  # in `shown`: A then `,`, A then `|`, B then `,`, B then `;`

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """A and B ids of each text; none for a text whose tokens don't give back its bytes."""
        full = [t or "" for t in texts]
        found = [np.frombuffer(x, "<u2") for x in self.a.encode([" " + t for t in full])], [np.frombuffer(x or b"", "<u2") for x in self.b.encode(full)]
        none = np.zeros(0, "<u2")
        for k, text in enumerate(full):
            if not text or not len(found[1][k]):
                found[0][k] = found[1][k] = none
        return found


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which A and which B tokens end a group.

    `ends_*` are the byte offsets where tokens end, of all documents one after the other; document i's tokens are those from
    first[i] to first[i + 1]. One step compares the tokens that every document's two pointers stand at, marks a cut where both end at
    one byte, and advances whichever ends first, or both. Documents that are through leave the vector.
    """
    cut_a, cut_b = np.zeros(len(ends_a), bool), np.zeros(len(ends_b), bool)
    some = first_a[:-1] < first_a[1:]
    at_a, at_b, last = first_a[:-1][some], first_b[:-1][some], first_a[1:][some]
    while len(at_a):
        for _ in range(int((last - at_a).min())):  # before so many steps none can be through
            a, b = ends_a[at_a], ends_b[at_b]
            cut = a == b
            cut_a[at_a] = cut
            cut_b[at_b] = cut
            at_a += a <= b
            at_b += b <= a
        live = at_a < last
        at_a, at_b, last = at_a[live], at_b[live], last[live]
    return cut_a, cut_b


def _group_starts(cut: np.ndarray) -> np.ndarray:
    """Where groups begin, and the end; every document's last token is a cut."""
    return np.r_[0, np.flatnonzero(cut) + 1]


def _weighted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each stands."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.r_[first, len(keys)])


def _links(ids_a: np.ndarray, ids_b: np.ndarray, starts_a: np.ndarray, starts_b: np.ndarray, doc: np.ndarray, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(document << 32 | A id << 16 | B id) of all links, each once, and its number of links; `doc` has each group's document.

    Links are made `most` at a time. A group of more is taken by its distinct ids and their numbers, stretch by stretch.
    """
    size_a, size_b = np.diff(starts_a), np.diff(starts_b)
    links = size_a * size_b
    keys: list[np.ndarray] = []
    times: list[np.ndarray] = []
    huge = np.flatnonzero(links > most)
    for g in huge.tolist():
        a, in_a = np.unique(ids_a[starts_a[g] : starts_a[g + 1]], return_counts=True)
        b, in_b = np.unique(ids_b[starts_b[g] : starts_b[g + 1]], return_counts=True)
        for lo in range(0, len(a), max(1, most // len(b))):
            some = slice(lo, lo + max(1, most // len(b)))
            keys.append(((int(doc[g]) << 32) + (a[some].astype(np.int64)[:, None] << 16) + b.astype(np.int64)).ravel())
            times.append((in_a[some][:, None] * in_b).ravel())
    rest = np.flatnonzero(links <= most)
    ends = np.cumsum(links[rest])
    lo = 0
    while lo < len(rest):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        g = rest[lo:hi]
        k = np.repeat(np.arange(len(g)), links[g])
        place = np.arange(len(k)) - np.repeat(np.cumsum(links[g]) - links[g], links[g])
        width = size_b[g][k]
        a = ids_a[starts_a[g][k] + place // width].astype(np.int64)
        key, n = _weighted((doc[g][k] << 32) + (a << 16) + ids_b[starts_b[g][k] + place % width])
        keys.append(key)
        times.append(n)
        lo = hi
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, n = np.concatenate(keys), np.concatenate(times)
    if len(keys) > 1:  # a document can lie in several stretches
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        key, n = key[first], np.add.reduceat(n, first)
    return key, n


def _aligned(tokens: Tokenizers, texts: list[str | None], groups: bool) -> tuple[dict[str, list], np.ndarray, np.ndarray]:
    """Columns of the texts' counts and digests, and their links as `_links` gives them."""
    list_a, list_b = tokens.encode(texts)
    n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (list_a, list_b))
    first_a, first_b = np.r_[0, np.cumsum(n_a)], np.r_[0, np.cumsum(n_b)]
    ids_a, ids_b = (np.concatenate([np.zeros(0, "<u2"), *x]) for x in (list_a, list_b))
    cut_a, cut_b = lockstep(np.cumsum(tokens.sizes[0][ids_a]), np.cumsum(tokens.sizes[1][ids_b]), first_a, first_b)
    starts_a, starts_b = _group_starts(cut_a), _group_starts(cut_b)
    group_first = np.searchsorted(starts_a, first_a)
    n_groups = np.diff(group_first)
    doc = np.repeat(np.arange(len(texts)), n_groups)
    sizes = np.diff(starts_a) * np.diff(starts_b)
    n_links = np.diff(np.r_[0, np.cumsum(sizes)][group_first])
    # both ids in the order of a digest: a group's A ids, then its B ids
    of_a, of_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    line = np.empty(len(ids_a) + len(ids_b), np.int64)
    s = tokens.starts
    line[np.arange(len(ids_a)) + starts_b[of_a]] = ids_a + np.where(cut_a, s[1], s[0])
    line[np.arange(len(ids_b)) + starts_a[of_b + 1]] = ids_b + np.where(cut_b, s[3], s[2])
    cells = tokens.shown[line].view(np.uint8)
    cells = cells[cells > 0]
    ends = np.r_[0, np.cumsum(tokens.widths[line])][first_a + first_b].tolist()
    shown = [memoryview(cells)[lo : max(lo, hi - 1)] for lo, hi in zip(ends[:-1], ends[1:], strict=True)]
    out = {"n_a": n_a.tolist(), "n_b": n_b.tolist(), "n_groups": n_groups.tolist(), "n_links": n_links.tolist(), "groups_sha256": [hashlib.sha256(x).hexdigest() if len(x) else "" for x in shown]}
    if groups:
        out["groups"] = [x.tobytes().decode() for x in shown]
    return out, *_links(ids_a, ids_b, starts_a, starts_b, doc)


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.astype("<u4").tobytes())


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<u4").astype(np.int64)


def _slices(batch: pa.RecordBatch, size: int) -> Iterator[tuple[pa.RecordBatch, list[str | None], int]]:
    """A batch in parts of about `size` characters of text, which is its last column; with each part's texts and size."""
    texts = batch.column(batch.num_columns - 1)
    lo = n = 0
    some: list[str | None] = []
    for k in range(batch.num_rows):
        text = texts[k].as_py()
        some.append(text)
        n += len(text) if text else 0
        if n >= size or k + 1 == batch.num_rows:
            yield batch.slice(lo, k + 1 - lo), some, n
            lo, n, some = k + 1, 0, []


def align_tokenizers(docs: DataFrame, *, tokenizer_a: str, tokenizer_b: str, text_col: str = "text", keep: list[str] | None = None, groups: bool = False, batch_chars: int = 8 << 20, slice_chars: int = 4 << 20) -> DataFrame:
    """The kept columns with n_a, n_b (tokens), n_groups, n_links, n_best, count_sum, groups_sha256 and, if asked for, `groups`.

    `tokenizer_a` is a byte-level vocabulary's file, which encodes a space and the text, `tokenizer_b` a piece model's, which
    adds that space itself. A pair's count is the number of documents that hold it linked; n_best are the links whose count is the highest of
    their A id, ties included; count_sum is the sum over links. `groups` is text: `a1,a2|b1;a3|b2,b3`.

    Null and empty texts, and those that a tokenizer doesn't give back byte by byte, have no tokens: zeros and ''. Repeated rows
    count each. A very long text is a batch by itself, in memory in proportion to its length; the links of a group are made a
    million at a time. An empty table stays empty.
    """
    spark = docs.sparkSession
    keep = kept(docs, keep, (*_COUNTS, "n_best", "count_sum", "groups_sha256", *(["groups"] if groups else [])))
    rows = docs.select(*(F.col(q(c)).alias(f"own_{i}") for i, c in enumerate(keep)), F.col(q(text_col)).cast("string").alias("text"))
    texts = ["groups_sha256", *(["groups"] if groups else [])]
    schema = StructType([*(StructField(f.name, f.dataType) for f in rows.schema.fields[:-1]), *spark.createDataFrame([], "kind int, batch long, " + ", ".join(f"{c} long" for c in _COUNTS) + "".join(f", {c} string" for c in texts)).schema.fields, StructField("links", BinaryType()), StructField("times", BinaryType()), StructField("pair", LongType()), StructField("docs", LongType())])

    names = rows.columns[:-1]

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = in_process(f"tokenizers:{tokenizer_a}:{tokenizer_b}", lambda: Tokenizers(tokenizer_a, tokenizer_b))
        number = TaskContext.get().partitionId() << 24
        held: list[tuple[pa.RecordBatch, dict[str, list], np.ndarray, np.ndarray]] = []
        size = 0

        def table(own: pa.RecordBatch | None, columns: dict[str, pa.Array], n: int) -> pa.RecordBatch:
            arrays = {f: own.column(i) for i, f in enumerate(names)} if own is not None else {}
            kinds = {f"own_{i}": t for i, t in enumerate(own_types)} | {"kind": pa.int32(), "batch": pa.int64(), **{c: pa.int64() for c in _COUNTS}, **{c: pa.string() for c in texts}, "links": pa.binary(), "times": pa.binary(), "pair": pa.int64(), "docs": pa.int64()}
            return pa.RecordBatch.from_arrays([arrays.get(c, columns.get(c)) if c in arrays or c in columns else pa.nulls(n, kinds[c]) for c in kinds], list(kinds))

        def finish() -> Iterator[pa.RecordBatch]:
            """One batch: its documents, their links as places in the batch's list of pairs, and that list."""
            nonlocal held, size, number
            pairs, in_docs = _weighted(np.concatenate([key & 0xFFFFFFFF for _, _, key, _ in held]))
            for own, columns, key, n in held:
                place = np.searchsorted(pairs, key & 0xFFFFFFFF)
                cuts = np.searchsorted(key, np.arange(own.num_rows + 1) << 32).tolist()
                steps = [np.diff(place[lo:hi], prepend=0) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
                made = {c: pa.array(v) for c, v in columns.items()} | {"kind": pa.array(np.zeros(own.num_rows, np.int32)), "batch": pa.array(np.full(own.num_rows, number)), "links": pa.array(map(_pack, steps), pa.binary()), "times": pa.array([_pack(n[lo:hi]) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())}
                yield table(own, made, own.num_rows)
            for lo in range(0, len(pairs), 65536):
                some = slice(lo, lo + 65536)
                m = len(pairs[some])
                yield table(None, {"kind": pa.array(np.ones(m, np.int32)), "batch": pa.array(np.full(m, number)), "pair": pa.array(pairs[some]), "docs": pa.array(in_docs[some])}, m)
            held, size, number = [], 0, number + 1

        for batch in batches:
            own_types = [f.type for f in list(batch.schema)[:-1]]
            for part, strings, chars in _slices(batch, slice_chars):
                held.append((part, *_aligned(tokens, strings, groups)))
                size += chars
                if size >= batch_chars:
                    yield from finish()
        if held:
            yield from finish()

    made = written(rows.mapInArrow(align, schema), "alignment", by=["kind"])
    pairs = made.where("kind = 1").select(F.col("batch").alias("of_batch"), "pair", "docs")
    counts = written(pairs.groupBy("pair").agg(F.sum("docs").alias("count")), "pair-counts")
    best = counts.groupBy(F.shiftright("pair", 16).alias("a")).agg(F.max("count").alias("most"))
    # at most a row for each of A's ids: of 2 bytes, so 65,536
    counted = pairs.select("of_batch", "pair").join(counts.join(F.broadcast(best), F.shiftright("pair", 16) == F.col("a")).select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "pair")
    kept_docs = made.where("kind = 0").drop("kind", "pair", "docs")

    def total(docs_of: pa.Table, pairs_of: pa.Table) -> pa.Table:
        order = np.argsort(pairs_of["pair"].to_numpy(), kind="stable")
        count, top = pairs_of["count"].to_numpy()[order], pairs_of["best"].to_numpy()[order]
        n_best, sums = [], []
        for links, times in zip(docs_of["links"].to_pylist(), docs_of["times"].to_pylist(), strict=True):
            place, n = np.cumsum(_unpack(links)), _unpack(times)
            n_best.append(int(n[top[place]].sum()))
            sums.append(int((n * count[place]).sum()))
        return docs_of.drop_columns(["links", "times"]).append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))

    fields = [f for f in kept_docs.schema.fields if f.name not in ("links", "times")]
    out = kept_docs.groupBy("batch").cogroup(counted.groupBy("of_batch")).applyInArrow(total, StructType([*fields, StructField("n_best", LongType()), StructField("count_sum", LongType())]))
    return out.select(*(F.col(f"own_{i}").alias(c) for i, c in enumerate(keep)), *_COUNTS, "n_best", "count_sum", *texts)


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return align_tokenizers(docs, tokenizer_a=public_tokenizers.path("byte_bpe_50k.json"), tokenizer_b=public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])
