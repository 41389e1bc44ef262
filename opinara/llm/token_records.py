"""Token ids in binary files of length-delimited records with an offset index.

A folder holds one pair of files for each shard, shards in ascending order of id:

* shard-N-*.bin: records one after the other. A record is the payload's length (8 bytes), the length's masked
  checksum (4), the payload, the payload's masked checksum (4). The payload is a byte of flags (1: the id isn't null, 2: token ids
  have 2 bytes each and not 4, 4: they are compressed by Zstandard), the id (8, signed) and the token ids (unsigned). All integers
  are little-endian. A masked checksum is CRC-32 rotated right by 15 bits plus the constant below, as a
  checksum of data that holds checksums is weak.
* shard-N-*.idx: for each record its offset in the file and the number of ids before it in the shard (8 bytes each).
* _manifest: a Parquet table, a row per shard: which files count, and their records, ids and bytes.
"""

from __future__ import annotations

import math
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.llm._shared import in_process, q, shared_dir

MASK_DELTA = 0xA282EAD8
_MANIFEST = "shard long, bin string, idx string, records long, ids long, bytes long"
#: The Unicode white space that the tokenizer's pattern calls \s.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNITS = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]")
#: Where none of these is in a text, white space is single spaces and newlines.
_UNEVEN = ["\0", "  ", "\n\n", " \n", "\n ", *"\t\x0b\x0c\r\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B))]
#: A letter and an ASCII sign after it.
_STEM = "([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f])([!-/:-@\\[-`{-~])"
_HAS_ID, _SHORT, _PACKED = 1, 2, 4


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Encoder:
    """Token ids of whole texts, as little-endian unsigned integers of `width` bytes.

    The byte-level pattern cuts a text before a single space, and around other white space, whatever stands beside
    it. So the library encodes each distinct piece once, and a text's ids are its pieces' ids in a row. Texts that
    hold one of the vocabulary's special tokens go to the library whole, unless their strings count as `plain` text. Pieces of up to 64 characters are remembered,
    about `most` bytes of them in all; a longer one, as a text without any white space is, only while its texts are encoded.
    """

    def __init__(self, path: str, most: int = 64 << 20, *, plain: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = plain
        self.special = [] if plain else [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.newline = self.library.encode("\n", add_special_tokens=False).ids
        names = map(self.library.id_to_token, range(self.library.get_vocab_size()))
        self.begins = np.fromiter(((name or "").startswith("\u0120") for name in names), bool)  # ids that begin with a space
        self.pieces: dict[str, bytes] = {}
        self.most, self.held = most, 0

    def _remember(self, pieces: list[str], ids: list[bytes]) -> None:
        self.pieces.update(zip(pieces, ids, strict=True))
        self.held += 200 * len(pieces) + sum(map(len, pieces)) + sum(map(len, ids))

    @staticmethod
    def _size(piece: str, ids: bytes) -> int:
        return 200 + len(piece) + len(ids)

    def _packed(self, ids: list[int]) -> bytes:
        return np.array(ids, f"<u{self.width}").tobytes()

    def _each(self, texts: list[str]) -> list[bytes]:
        return [self._packed(e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Pieces without white space but for one leading space: many in one text. Each space begins a new id, and
        where it stands at the head of every piece it tells them apart; else a newline is put between them."""
        spaced = [w for w in words if w[0] == " "]
        self._remember(spaced, self._cut(spaced, ""))
        bare = [w for w in words if w[0] != " "]
        self._remember(bare, self._cut(bare, "\n"))

    def _cut(self, words: list[str], between: str) -> list[bytes]:
        out: list[bytes] = []
        groups, w = [words[i : i + 256] for i in range(0, len(words), 256)], self.width
        for group, encoded in zip(groups, self.library.encode_batch_fast([between.join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(encoded.ids, f"<u{w}")
            cuts = np.flatnonzero(ids == self.newline[0]) if between else np.flatnonzero(self.begins[ids])
            if between and (len(self.newline) != 1 or len(cuts) != len(group) - 1) or not between and (len(cuts) != len(group) or cuts[0]):
                out += self._each(group)
                continue
            data, at = ids.tobytes(), (cuts * w).tolist()
            starts, ends = ([0, *(a + w for a in at)], [*at, len(data)]) if between else (at, [*at[1:], len(data)])
            out += [data[a:b] for a, b in zip(starts, ends, strict=True)]
        return out

    @staticmethod
    def _split(texts: list[str]) -> pa.LargeListArray:
        """Units of texts whose white space is single spaces and newlines: they begin with a space, are a newline, or begin with
        an ASCII sign after a letter, where the pattern always cuts. So most words are one unit whatever sign follows them."""
        marked = pc.replace_substring(pc.replace_substring(pa.array(texts, pa.large_string()), " ", "\0 "), "\n", "\0\n\0")
        marked = pc.replace_substring_regex(marked, _STEM, "\\1\0\\2")
        return pc.split_pattern(marked, "\0")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        even, uneven, whole = [], [], []
        for i, text in enumerate(texts):
            if text:
                (whole if any(s in text for s in self.special) else uneven if any(c in text for c in _UNEVEN) else even).append(i)
        cut = [_UNITS.findall(texts[i]) for i in uneven]
        others = {"", " ", "\n"}.union(*cut)
        lists = self._split([texts[i] for i in even])
        flat = lists.flatten().dictionary_encode()
        units = flat.dictionary.to_numpy(zero_copy_only=False).tolist()
        words = set(units)
        if self.held > self.most:  # the older half goes, but not what is needed now
            for k in [k for k in islice(self.pieces, len(self.pieces) // 2) if k not in words and k not in others]:
                self.held -= self._size(k, self.pieces.pop(k))
        new = list(others.difference(self.pieces))
        self._remember(new, self._each(new))
        self._learn(list(words.difference(self.pieces, others)))
        for i, ids in zip(whole, self._each([texts[i] for i in whole]), strict=True):
            out[i] = ids
        for i, parts in zip(uneven, cut, strict=True):
            out[i] = b"".join(map(self.pieces.__getitem__, parts))
        if even:
            taken = pa.array(map(self.pieces.__getitem__, units), pa.large_binary(), size=len(units)).take(flat.indices)
            ends = np.frombuffer(taken.buffers()[1], np.int64)[lists.offsets.to_numpy()].tolist()
            data = memoryview(taken.buffers()[2] or b"")
            for i, a, b in zip(even, ends, ends[1:], strict=False):
                out[i] = data[a:b].tobytes()
        for k in [k for part in (words, others) for k in part if len(k) > 64]:
            self.held -= self._size(k, self.pieces.pop(k))
        return out


def _few(batch: pa.RecordBatch, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of up to `rows` rows that end where their texts reach `size` bytes."""
    lengths, lo = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64), 0
    while lo < batch.num_rows:
        n = min(rows, int(np.searchsorted(np.cumsum(lengths[lo : lo + rows]), size)) + 1)
        yield batch.slice(lo, n)
        lo += n


def write_token_records(docs: DataFrame, path: str, *, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, shards: int | None = None, shard_bytes: int = 256 << 20) -> DataFrame:
    """Writes the folder described above and returns its manifest.

    Records stand in ascending order of id, null first; rows with equal ids keep the input's order and repeated rows
    are written each. A null or empty text is just the end id. Further columns are not written. Documents are range-partitioned by id and
    the row's place in the input, so that many rows of one id can lie in several shards; a shard for each `shard_bytes` of
    text, but as many as the session has shuffle partitions at least. A task writes
    files of its own name and the manifest lists those of the tasks that counted, so a lost executor or a second attempt leaves nothing
    behind but unlisted files. An empty table writes no shards or empty ones.
    """
    rows = docs.select(F.col(q(id_col)).cast("long").alias("id"), F.col(q(text_col)).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    if shards is None:
        size = rows.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first().n or 0
        shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / shard_bytes))
    rows = rows.repartitionByRange(shards, "id", "row").sortWithinPartitions("id", "row")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = in_process(f"encoder:{tokenizer}", lambda: Encoder(tokenizer))
        shard, end = TaskContext.get().partitionId(), struct.pack("<H" if encoder.width == 2 else "<I", end_id)
        short, pack = _SHORT * (encoder.width == 2), zstandard.ZstdCompressor(level=1).compress
        system, folder = _place(path)
        system.create_dir(folder, recursive=True)
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}"
        records = ids = offset = 0
        with system.open_output_stream(f"{folder}/{name}.bin") as out, system.open_output_stream(f"{folder}/{name}.idx") as index:
            for batch in batches:
                for part in _few(batch, 512, 1 << 20):  # texts can be long
                    for key, tokens in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist()), strict=True):
                        tokens += end
                        packed = pack(tokens)
                        fewer = len(packed) < len(tokens)
                        payload = struct.pack("<Bq", _HAS_ID * (key is not None) | short | _PACKED * fewer, key or 0) + (packed if fewer else tokens)
                        length = struct.pack("<Q", len(payload))
                        out.write(b"".join((length, struct.pack("<I", masked_crc(length)), payload, struct.pack("<I", masked_crc(payload)))))
                        index.write(struct.pack("<QQ", offset, ids))
                        offset += len(payload) + 16
                        records, ids = records + 1, ids + len(tokens) // encoder.width
        if records:
            yield pa.RecordBatch.from_pylist([{"shard": shard, "bin": f"{name}.bin", "idx": f"{name}.idx", "records": records, "ids": ids, "bytes": offset}], pa.schema([(c, pa.string() if k == "string" else pa.int64()) for c, k in (x.split() for x in _MANIFEST.split(", "))]))

    done = rows.select("id", "text").mapInArrow(write, _MANIFEST)
    done.write.mode("overwrite").parquet(f"{path}/_manifest")
    return docs.sparkSession.read.schema(_MANIFEST).parquet(f"{path}/_manifest")


def read_token_records(spark: SparkSession, path: str, *, part_records: int = 4096) -> DataFrame:
    """(doc_id, start, ids) of every record: ids as bytes (4 each), start the number of ids before it in the whole folder.

    Tasks read stretches of up to `part_records` records, found through the index; both checksums are checked and
    a wrong one is an error.
    """
    shards = spark.read.schema(_MANIFEST).parquet(f"{path}/_manifest").orderBy("shard").collect()  # a row per shard
    files, before, parts = [], 0, 0
    for s in shards:
        files.append((s["bin"], s.idx, before, s.records, s.bytes))
        before, parts = before + s.ids, parts + math.ceil(s.records / part_records)
    schema = "doc_id long, start long, ids binary"
    if not files:
        return spark.createDataFrame([], schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _place(path)
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for p in batch.to_pylist():
                with system.open_input_file(f"{folder}/{p['idx']}") as index:
                    rows = np.frombuffer(index.read_at(16 * min(p["n"] + 1, p["records"] - p["first"]), 16 * p["first"]), "<u8").reshape(-1, 2).astype(np.int64)
                ends = np.append(rows[1:, 0], p["bytes"])[: p["n"]]
                with system.open_input_file(f"{folder}/{p['bin']}") as file:
                    for lo in range(0, p["n"], 256):
                        hi = min(lo + 256, p["n"])
                        data = file.read_at(int(ends[hi - 1] - rows[lo, 0]), int(rows[lo, 0]))
                        out: dict[str, list] = {"doc_id": [], "start": [], "ids": []}
                        for a, b, start in zip(rows[lo:hi, 0] - rows[lo, 0], ends[lo:hi] - rows[lo, 0], rows[lo:hi, 1], strict=True):
                            record = data[a:b]
                            payload = record[12:-4]
                            if struct.unpack("<QI", record[:12]) != (len(payload), masked_crc(record[:8])) or struct.unpack("<I", record[-4:])[0] != masked_crc(payload):
                                raise ValueError(f"{p['bin']}: the record at {rows[lo, 0] + a} is damaged")
                            flags, key = struct.unpack("<Bq", payload[:9])
                            ids = unpack(payload[9:]) if flags & _PACKED else payload[9:]
                            out["doc_id"].append(key if flags & _HAS_ID else None)
                            out["start"].append(int(start) + p["before"])
                            out["ids"].append(np.frombuffer(ids, "<u2").astype("<u4").tobytes() if flags & _SHORT else ids)
                        yield pa.RecordBatch.from_arrays([pa.array(out["doc_id"], pa.int64()), pa.array(out["start"], pa.int64()), pa.array(out["ids"], pa.binary())], ["doc_id", "start", "ids"])

    # executors cut the shards into stretches: the driver holds no row for each of them
    table = spark.createDataFrame(files, "bin string, idx string, before long, records long, bytes long")
    table = table.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("records") - 1, F.lit(part_records).cast("long"))))
    table = table.withColumn("n", F.least(F.lit(part_records).cast("long"), F.col("records") - F.col("first")))
    return table.repartition(min(parts, 4096)).mapInArrow(read, schema)


def token_digest(docs: DataFrame, *, tokenizer: str | None = None) -> DataFrame:
    """Writes the documents' token records to the shared folder and reads each back: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    spark = docs.sparkSession
    path = shared_dir(spark, "tokens")
    write_token_records(docs, path, tokenizer=tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
    out = read_token_records(spark, path)
    return out.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op7_token_records(spark, sf_dir: str) -> DataFrame:
    return token_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
