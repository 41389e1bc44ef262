"""Exact substring dedup by a distributed sparse suffix array.

A byte goes if a string of `length` bytes around it also starts in a document with a smaller id. A suffix array over
every byte would move each byte fifty times over. So suffixes are taken at anchors only: in each string of
`length` bytes the 16 bytes with the least hash (the leftmost of equals). Equal strings have equal anchors at equal places,
so comparing what surrounds equal anchors finds every repeat and loses none.

1. Documents lie in batches of some bytes. Each batch names the hashes of its anchors, in the task that reads it; those
   that one batch only and one document only has are done with. What comes back to a batch are the hashes that repeat.
2. Batches send the repeated anchors' suffixes, with the bytes before them that a string may need, to ranges of
   leading bytes whose splitters were sampled. Equal ones of a batch are sent once, for the document with the least id.
3. Each range is sorted by multikey quicksort over words of eight bytes. Neighbours with enough leading bytes in common
   and the same bytes before them are equal strings; the least id of each string comes out. A splitter has all 16
   leading bytes, so equal anchors never lie on both sides of a boundary and there is nothing to compare across it.
4. Batches get back which strings go, and cut them out.

An anchor that occurs very often (a passage that a third of the documents share) would bring all its surroundings to
one range. Its strings are rows of their own: a minimum by string, combined before the shuffle, and a join that Spark can split.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinara.llm._shared import bitmap, kept, marked, q, written

GRAM = 16
_WORDS = np.random.default_rng(42).integers(0, 1 << 63, 256, dtype=np.uint64)
_LAST = np.iinfo(np.int64).max


def _slide_min(x: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: len(x) - (width - n)], x[width - n :]) if n < width else x


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places, hashes, and the first and last start of the strings whose anchor stands there."""
    if len(data) < length:
        none = np.empty(0, np.int64)
        return none, none.astype(np.uint64), none, none
    x = _WORDS[data]
    for step, factor in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F), (4, 0x165667B19E3779F9), (8, 0x27D4EB2F165667C5)):
        x = x[:-step] * np.uint64(factor) + x[step:]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    least = _slide_min((x & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(x), dtype=np.uint64), length - GRAM + 1)
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:], len(at)] - 1
    return at[first], x[at[first]], first, last


def multikey_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lexicographic order of a matrix of bytes and, for each row in it, the bytes in common with the one before.

    Eight bytes at a time: rows that are still equal, and only these, are sorted by their next word.
    """
    n, width = rows.shape
    words = np.zeros((n, -(-width // 8) * 8), np.uint8)
    words[:, :width] = rows
    words = words.view(">u8").astype(np.uint64)
    order, group = np.arange(n), np.zeros(n, np.int64)
    loose = np.arange(n)  # places in the order whose rows have equals so far
    for w in range(words.shape[1]):
        if not len(loose):
            break
        rows_here = order[loose]
        by = np.lexsort((words[rows_here, w], group[loose]))
        order[loose] = rows_here[by]
        value, old = words[order[loose], w], group[loose]
        new = np.r_[True, (value[1:] != value[:-1]) | (old[1:] != old[:-1])]
        group[loose] = loose[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        more = np.r_[~new[1:], False] | ~new
        loose = loose[more]
    common = np.zeros(n, np.int64)
    if n > 1:
        differ = rows[order[1:]] != rows[order[:-1]]
        common[1:] = np.where(differ.any(1), differ.argmax(1), width)
    return order, common


def least_ids(around: np.ndarray, lo: np.ndarray, hi: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """Of each entry a mask of the starts lo..hi whose string has a smaller id in another entry.

    An entry's anchor stands at length - GRAM in `around`; the string at start o is around[o : o + length].
    """
    left = length - GRAM
    masks = np.zeros(len(around), np.uint64)
    order, common = multikey_order(around[:, left : left + length])
    around, lo, hi, ids = around[order], lo[order], hi[order], ids[order]
    back = np.zeros(len(around), np.uint64)  # a hash of the bytes from the start to the anchor
    by_id = np.argsort(ids, kind="stable")
    for o in range(left, -1, -1):
        if o < left:
            back = back * np.uint64(0x9E3779B97F4A7C15) + _WORDS[around[:, o]]
        run = np.cumsum(common < length - (left - o)).astype(np.uint64)  # equal from the anchor to the string's end
        mine = by_id[(lo[by_id] <= o) & (hi[by_id] >= o)]
        if len(mine) < 2:
            continue
        key = (run[mine] << np.uint64(32)) | (back[mine] >> np.uint64(32))
        by = np.argsort(key, kind="stable")
        key, who = key[by], mine[by]
        head = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], np.arange(len(key)), 0))
        first = who[head]
        maybe = np.flatnonzero(ids[first] < ids[who])
        for at in range(0, len(maybe), 1 << 16):
            part = maybe[at : at + (1 << 16)]
            same = (around[who[part], o:left] == around[first[part], o:left]).all(1) if o < left else np.ones(len(part), bool)
            masks[order[who[part[same]]]] |= np.uint64(1 << o)
            if not same.all():  # equal hashes of unequal bytes: the groups are judged one by one
                for h in np.unique(head[part[~same]]):
                    least: dict[bytes, int] = {}
                    for i in who[head == h]:  # in order of id
                        masks[order[i]] &= ~np.uint64(1 << o)
                        if least.setdefault(around[i, o : o + length].tobytes(), ids[i]) < ids[i]:
                            masks[order[i]] |= np.uint64(1 << o)
    return masks


def _entry(length: int) -> np.dtype:
    """An anchor's surroundings, the first and last start in them, and whose they are: id, document of the batch, place of start 0."""
    return np.dtype([("around", "u1", (2 * length - GRAM,)), ("lo", "u1"), ("hi", "u1"), ("id", "<i8"), ("doc", "<u4"), ("base", "<i8")])


#: What a batch keeps for itself or gets back: document, place of start 0, the starts that go; or (said 0) whose fate it shares.
_LOCAL = np.dtype([("doc", "<u4"), ("base", "<i8"), ("mask", "<u8"), ("as_doc", "<u4"), ("as_base", "<i8"), ("said", "u1")])
_TRAFFIC = "range long, batch long, data binary"
_STRINGS = "string binary, id long, doc long, base long, batch long, start int"


def _documents(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """A batch's rows in order of id (null last) and row: their places in the table, ids and bytes."""
    ids = table.column("id").fill_null(_LAST).to_numpy().astype(np.int64)
    order = np.lexsort((table.column("row").to_numpy(), ids))
    texts = table.column("text").to_pylist()
    return order, ids[order], [np.frombuffer(texts[i] or b"", np.uint8) for i in order]


def _pack(rows: np.ndarray) -> bytes:
    """Structured rows column by column, compressed."""
    return zstandard.compress(b"".join(np.ascontiguousarray(rows[c]).tobytes() for c in rows.dtype.names), 1)


def _unpack(blobs: list[bytes], kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The rows of several packed blobs in one array, and where each blob's begin; one blob is open at a time."""
    sizes = [zstandard.frame_content_size(b) // kind.itemsize for b in blobs]
    ends = np.cumsum([0, *sizes])
    rows = np.empty(ends[-1], kind)
    for blob, n, lo in zip(blobs, sizes, ends[:-1], strict=True):
        data, at = zstandard.decompress(blob), 0
        for c in kind.names:
            part = kind[c]
            rows[c][lo : lo + n] = np.frombuffer(data, part.base, n * int(np.prod(part.shape, dtype=int)), at).reshape(n, *part.shape)
            at += n * part.itemsize
    return rows, ends


def _batched(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """A partition's rows in runs: a run ends with the row whose text takes it to `most` bytes. Its batch is its first row's number."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lengths = pc.add(pc.fill_null(pc.binary_length(batch.column("text")), 0), 256).to_numpy(zero_copy_only=False)
        lo = 0
        while lo < len(lengths):
            reach = np.cumsum(lengths[lo:])
            n = int(np.searchsorted(reach, most - size)) + 1
            held.append(batch.slice(lo, n))
            size += int(reach[min(n, len(reach)) - 1])
            lo += n
            if size >= most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Where each run of equal values begins and ends."""
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.empty(0, np.int64)
    return list(zip(starts.tolist(), [*starts[1:].tolist(), len(values)], strict=False))


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 50, batch_bytes: int = 1 << 20, bucket_rows: int = 1 << 18, range_rows: int = 1 << 17, hot_rows: int = 1 << 16, max_splitters: int = 1 << 14, keep: list[str] | None = None) -> DataFrame:
    """Every document with n_bytes, n_removed, n_spans (maximal removed runs) and kept_bytes.

    Strings are judged on the input; those of equal ids don't remove each other, so two rows of one id both stay.
    Ids are integers; a null id is larger than any. Null and empty texts have no bytes, and texts under `length` bytes lose
    none. kept_bytes need not be valid UTF-8. Matches never cross documents. Other columns are carried along
    (`keep`: only these); input columns named as an added one are replaced. An empty table gives an empty result.

    Documents are dealt to batches of `batch_bytes` of text by their place in the input, which has to be the same each
    time it is read, as a table's is. length: 17 to 79. What a task holds is set by rows that were counted, at every size
    of input: a bucket of hashes has about `bucket_rows`, a range of suffixes about `range_rows`, and an anchor of
    over `hot_rows` occurrences goes the other way. At most `max_splitters` splitters reach the executors; where that
    many ranges are too few, each is parted once more by a hash of its leading bytes.
    """
    if not GRAM < length <= 79:
        raise ValueError("length must be 17 to 79")
    spark = docs.sparkSession
    carried = [docs.schema[c] for c in kept(docs, keep, ("n_bytes", "n_removed", "n_spans", "kept_bytes"))]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(q(id_col)).cast("long").alias("id"), F.col(q(text_col)).cast("string").cast("binary").alias("text"), *(F.col(q(f.name)).alias(f"c{i}") for i, f in enumerate(carried)))
    total = rows.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).first()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    left, width, entry = length - GRAM, 2 * length - GRAM, _entry(length)
    buckets = max(1, math.ceil((total["bytes"] or 0) / (bucket_rows * left / 2)))

    def name_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _batched(batches, batch_bytes):
            found = [np.unique(anchors(np.frombuffer(t or b"", np.uint8), length)[1], return_counts=True) for t in table.column("text").to_pylist()]
            hashes, which = np.unique(np.concatenate([h for h, _ in found]), return_inverse=True)
            times = np.bincount(which, np.concatenate([n for _, n in found]), len(hashes)).astype(np.int64)
            # how often, 2^14 at most, and a bit for several documents
            code = (np.minimum(times, 1 << 14) | (np.bincount(which, minlength=len(hashes)) > 1).astype(np.int64) << 15).astype("<u2")
            of = _bucket(hashes, buckets)
            spans = [(of[x], x, y) for x, y in _runs(of)]
            low = (hashes & np.uint64(0xFFFFFFFF)).astype("<u4")
            # sorted by the whole hash; the low halves alone are sent
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in spans], pa.int64()), pa.array([table.column("row")[0].as_py()] * len(spans), pa.int64()), pa.array([low[x:y].tobytes() for _, x, y in spans], pa.binary()), pa.array([code[x:y].tobytes() for _, x, y in spans], pa.binary())], ["bucket", "batch", "low", "code"])

    def find_repeats(table: pa.Table) -> pa.Table:
        lows = [np.frombuffer(x, "<u4") for x in table.column("low").to_pylist()]
        ends = np.cumsum([0, *map(len, lows)])
        low, code = np.concatenate(lows), np.frombuffer(b"".join(table.column("code").to_pylist()), "<u2").astype(np.int64)
        order = np.argsort(low, kind="stable")
        first = np.flatnonzero(np.r_[True, low[order][1:] != low[order][:-1]])
        group = np.empty(len(low), np.int64)
        group[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(low)]))
        again = (np.diff(np.r_[first, len(low)]) > 1) | (np.maximum.reduceat(code[order], first) >> 15 > 0)
        again, hot = again[group], (np.add.reduceat(code[order] & 0x7FFF, first) > hot_rows)[group]
        out = [(low[a:b][again[a:b]], np.packbits(hot[a:b][again[a:b]])) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        # which of a batch's hashes: the low half, and a bit for those that occur very often
        return pa.table({"batch": table.column("batch"), "bucket": table.column("bucket"), "low": pa.array([x.tobytes() for x, _ in out], pa.binary()), "hot": pa.array([h.tobytes() for _, h in out], pa.binary())})

    # the anchors are named where the texts are read: no text moves for it. Written, so the rest needn't do it again
    named = rows.select("row", "text").mapInArrow(name_anchors, "bucket long, batch long, low binary, code binary")
    repeats = written(named.groupBy("bucket").applyInArrow(find_repeats, "batch long, bucket long, low binary, hot binary").where(F.length("low") > 0), "repeats")
    anchors_ = repeats.agg(F.sum(F.length("low") / 4).alias("n")).first().n or 0
    ranges = max(1, math.ceil(anchors_ / range_rows))
    finer = math.ceil(ranges / max_splitters)
    splitters = spark.sparkContext.broadcast(_splitters(rows, total["rows"], math.ceil(ranges / finer), length))  # 16 bytes each

    def range_of(keys: np.ndarray) -> np.ndarray:
        to = _range_of(keys, splitters.value)
        return to if finer == 1 else to * finer + ((_halves(keys) @ _WORDS[:2] >> np.uint64(32)) % np.uint64(finer)).astype(np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _batched(batches, batch_bytes):
            yield from table.add_column(0, "batch", pa.array([table.column("row")[0].as_py()] * table.num_rows, pa.int64())).combine_chunks().to_batches()

    def entries_of(text: np.ndarray, pick: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The anchors of a text that `pick` takes by their hashes, with what surrounds them, without owner; and their places."""
        at, hashes, first, last = anchors(text, length)
        known = pick(hashes)
        out = np.zeros(len(known), entry)
        base = at[known] - left
        padded = np.concatenate((np.zeros(left, np.uint8), text, np.zeros(length, np.uint8)))
        around, lo, hi = padded[at[known][:, None] + np.arange(width)], first[known] - base, last[known] - base
        column = np.arange(width)
        around[(column < lo[:, None]) | (column >= hi[:, None] + length)] = 0
        out["around"], out["lo"], out["hi"], out["base"] = around, lo, hi, base
        return out, hashes[known]

    def distinct(table: pa.Table, pick: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """A batch's entries, their hashes, the places of the distinct ones (the least id's stands for equal ones), and each one's source."""
        _, ids, texts = _documents(table)
        found, hashes = [], []
        for doc, text in enumerate(texts):
            if len(text) >= length:
                some, whose = entries_of(text, pick)
                some["id"], some["doc"] = ids[doc], doc
                found.append(some)
                hashes.append(whose)
        if not sum(map(len, found)):
            return None
        every = np.concatenate(found)
        found.clear()
        look = np.ascontiguousarray(np.concatenate((every["around"], every["lo"][:, None], every["hi"][:, None]), axis=1)).view(f"V{width + 2}")[:, 0]
        _, index, inverse = np.unique(look, return_index=True, return_inverse=True)
        return every, np.concatenate(hashes), index, index[inverse]

    def send(table: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = {"range": [], "data": []}
        batch = None
        if table.num_rows and answers.num_rows:
            batch = table.column("batch")[0].as_py()
            lows = [np.frombuffer(x, "<u4").astype(np.uint64) for x in answers.column("low").to_pylist()]
            wanted = np.concatenate([np.uint64(b << 32) | x for b, x in zip(answers.column("bucket").to_pylist(), lows, strict=True)])
            hot = np.concatenate([np.unpackbits(np.frombuffer(h, np.uint8), count=len(x)) for h, x in zip(answers.column("hot").to_pylist(), lows, strict=True)]).astype(bool)
            by = np.argsort(wanted)
            wanted, hot = wanted[by], hot[by]

            def place_of(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                key = (_bucket(hashes, buckets).astype(np.uint64) << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))
                place = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
                return place, wanted[place] == key

            ready = distinct(table, lambda hashes: np.flatnonzero(place_of(hashes)[1]))
            if ready:
                every, hashes, index, source = ready
                rest = np.flatnonzero(source != np.arange(len(every)))
                if len(rest):
                    # later ids lose the strings of the first, the same id shares the first's fate
                    local, mine, whose = np.zeros(len(rest), _LOCAL), every[rest], every[source[rest]]
                    lo, hi = mine["lo"].astype(np.uint64), mine["hi"].astype(np.uint64)
                    local["doc"], local["base"], local["as_doc"], local["as_base"] = mine["doc"], mine["base"], whose["doc"], whose["base"]
                    local["mask"] = np.where(mine["id"] > whose["id"], ((np.uint64(1) << (hi - lo + np.uint64(1))) - np.uint64(1)) << lo, 0)
                    out["range"].append(-1 - batch)
                    out["data"].append(_pack(local))
                sent = every[index[~hot[place_of(hashes[index])[0]]]]
                to = range_of(np.ascontiguousarray(sent["around"][:, left : left + GRAM]).view(f"V{GRAM}")[:, 0])
                by = np.argsort(to, kind="stable")
                sent, to = sent[by], to[by]
                for a, b in _runs(to):
                    out["range"].append(int(to[a]))
                    out["data"].append(_pack(sent[a:b]))
        return pa.table({"range": pa.array(out["range"], pa.int64()), "batch": pa.array([batch] * len(out["range"]), pa.int64()), "data": pa.array(out["data"], pa.binary())})

    def unpack_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            lows = [np.frombuffer(x, "<u4")[np.unpackbits(np.frombuffer(h, np.uint8), count=len(x) // 4).astype(bool)] for x, h in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array((np.concatenate(lows).astype(np.uint64) << np.uint64(32)).view(np.int64))], ["hash"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The strings of hot anchors, each for itself; equal surroundings once in a batch."""
        for table in _batched(batches, batch_bytes):
            ready = distinct(table, lambda hashes: marked(hashes << np.uint64(32), hot_bits.value))
            if not ready:
                continue
            every, _, index, _ = ready
            batch = table.column("row")[0].as_py()
            for at in range(0, len(index), 1 << 12):
                sent = every[index[at : at + (1 << 12)]]
                n = sent["hi"].astype(np.int64) - sent["lo"] + 1
                start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(sent["lo"].astype(np.int64), n)
                strings = np.repeat(sent["around"], n, axis=0)[np.arange(len(start))[:, None], start[:, None] + np.arange(length)]
                strings = pa.FixedSizeBinaryArray.from_buffers(pa.binary(length), len(start), [None, pa.py_buffer(strings.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([strings, *(pa.array(np.repeat(sent[c], n), pa.int64()) for c in ("id", "doc", "base")), pa.array(np.full(len(start), batch)), pa.array(start, pa.int32())], ["string", "id", "doc", "base", "batch", "start"])

    def judge(table: pa.Table) -> pa.Table:
        if table.column("range")[0].as_py() < 0:  # what a batch has decided for itself passes through
            return table.select(["batch", "data"])
        out: dict[str, list] = {"batch": [], "data": []}
        every, ends = _unpack(table.column("data").to_pylist(), entry)
        masks = least_ids(every["around"], every["lo"].astype(np.int64), every["hi"].astype(np.int64), every["id"], length)
        for batch, a, b in zip(table.column("batch").to_pylist(), ends[:-1], ends[1:], strict=True):
            hit = a + np.flatnonzero(masks[a:b])
            if len(hit):
                reply = np.zeros(len(hit), _LOCAL)
                reply["doc"], reply["base"], reply["mask"], reply["said"] = every["doc"][hit], every["base"][hit], masks[hit], 1
                out["batch"].append(batch)
                out["data"].append(_pack(reply))
        return pa.table({"batch": pa.array(out["batch"], pa.int64()), "data": pa.array(out["data"], pa.binary())})

    def reply_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            batch, doc, base, start = (part.column(c).to_numpy(zero_copy_only=False) for c in ("batch", "doc", "base", "start"))
            by = np.argsort(batch, kind="stable")
            batches_, blobs = [], []
            for a, b in _runs(batch[by]):
                mine = by[a:b]
                batches_.append(batch[mine[0]])
                reply = np.zeros(len(mine), _LOCAL)
                reply["doc"], reply["base"], reply["mask"], reply["said"] = doc[mine], base[mine], np.uint64(1) << start[mine].astype(np.uint64), 1
                blobs.append(_pack(reply))
            yield pa.RecordBatch.from_arrays([pa.array(batches_, pa.int64()), pa.array(blobs, pa.binary())], ["batch", "data"])

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        order, _, texts = _documents(table)
        gone = _gone(_unpack(answers.column("data").to_pylist(), _LOCAL)[0])
        cuts = np.searchsorted(gone["doc"], np.arange(len(texts) + 1))
        (n_bytes, n_removed, n_spans), left_over = (np.zeros(len(texts), np.int64) for _ in range(3)), [b""] * len(texts)
        for doc, text in enumerate(texts):
            mine = gone[cuts[doc] : cuts[doc + 1]]
            keep_ = np.ones(len(text), bool)
            if len(mine):
                edge = np.zeros(len(text) + 1, np.int64)
                entry_, offset = np.nonzero((mine["mask"][:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1))
                starts = mine["base"][entry_] + offset
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + length, -1)
                keep_ = np.cumsum(edge[:-1]) == 0
            at = order[doc]
            n_bytes[at], n_removed[at], n_spans[at] = len(text), len(text) - keep_.sum(), np.count_nonzero(~keep_ & np.r_[True, keep_[:-1]]) if len(text) else 0
            left_over[at] = text[keep_].tobytes()
        return pa.table([*(table.column(f"c{i}") for i in range(len(carried))), pa.array(n_bytes), pa.array(n_removed), pa.array(n_spans), pa.array(left_over, pa.binary())], names=[*(f"c{i}" for i in range(len(carried))), "n_bytes", "n_removed", "n_spans", "kept_bytes"])

    dealt = rows.mapInArrow(deal, T.StructType([T.StructField("batch", T.LongType()), *rows.schema])).repartition(parts, "batch")
    asked = repeats.groupBy("batch")
    judged = dealt.groupBy("batch").cogroup(asked).applyInArrow(send, _TRAFFIC).groupBy("range").applyInArrow(judge, "batch long, data binary")
    hot_bits = spark.sparkContext.broadcast(bitmap(repeats.select("low", "hot").mapInArrow(unpack_hot, "hash long")))  # 2 MB
    if hot_bits.value.any():
        # taken where the texts are read, too. Minima combine before the shuffle, and Spark splits a hot string's side of the join
        strings = written(rows.select("row", "id", "text").mapInArrow(spell, _STRINGS), "strings")
        least = strings.groupBy("string").agg(F.min("id").alias("least"))
        judged = judged.union(strings.join(least, "string").where("id > least").select("batch", "doc", "base", "start").mapInArrow(reply_hot, "batch long, data binary"))
    schema = T.StructType([*(T.StructField(f"c{i}", f.dataType) for i, f in enumerate(carried)), *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_bytes", T.BinaryType())])
    out = dealt.groupBy("batch").cogroup(judged.groupBy("batch")).applyInArrow(cut, schema)
    return out.select(*(F.col(f"c{i}").alias(f.name) for i, f in enumerate(carried)), "n_bytes", "n_removed", "n_spans", "kept_bytes")


def _gone(said: np.ndarray) -> np.ndarray:
    """What goes, in order of document: the judged entries, and those that share their fate."""
    judged, ours = said[said["said"] == 1], said[said["said"] == 0].copy()
    key = lambda doc, base: doc.astype(np.int64) << 36 | (base + 128)  # noqa: E731  documents are under 2^31 bytes, base is -63 at least
    fates, which = np.unique(key(judged["doc"], judged["base"]), return_inverse=True)
    masks = np.zeros(len(fates) + 1, np.uint64)
    np.bitwise_or.at(masks, which, judged["mask"])
    shares = np.flatnonzero(ours["mask"] == 0)
    asked = key(ours["as_doc"][shares], ours["as_base"][shares])
    place = np.searchsorted(fates, asked)
    known = (place < len(fates)) & (fates[np.minimum(place, max(0, len(fates) - 1))] == asked) if len(fates) else np.zeros(len(asked), bool)
    ours["mask"][shares] = np.where(known, masks[np.where(known, place, len(fates))], 0)
    gone = np.concatenate((judged, ours[ours["mask"] != 0]))
    return gone[np.argsort(gone["doc"], kind="stable")]


def _halves(keys: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(keys).view(np.uint8).reshape(-1, GRAM).view(">u8").astype(np.uint64)


def _range_of(keys: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """The number of splitters at or below each key, by all of its bytes."""
    if not len(splitters) or not len(keys):
        return np.zeros(len(keys), np.int64)
    both = np.concatenate((_halves(splitters), _halves(keys)))
    is_key = np.r_[np.zeros(len(splitters), np.int8), np.ones(len(keys), np.int8)]
    order = np.lexsort((is_key, both[:, 1], both[:, 0]))
    below = np.cumsum(is_key[order] == 0)
    out = np.empty(len(both), np.int64)
    out[order] = below
    return out[len(splitters) :]


def _splitters(rows: DataFrame, n_rows: int, ranges: int, length: int, per_range: int = 64) -> np.ndarray:
    """Leading bytes that part the anchors of a sample evenly: at least `per_range` of them for a range, from 4096 documents or more."""
    if ranges < 2:
        return np.empty(0, f"V{GRAM}")

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                data = np.frombuffer(text or b"", np.uint8)
                at = anchors(data, length)[0]
                at = at[:: max(1, len(at) // 64)]
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array([data[at[:, None] + np.arange(GRAM)].tobytes()], pa.binary())], ["keys"])

    sample_rows = max(4096, ranges * per_range // 32)
    share = min(1 << 20, max(1, (sample_rows << 20) // max(1, n_rows)))
    got = rows.where(F.pmod(F.xxhash64("row", F.lit(7)), F.lit(1 << 20)) < share).select("text").mapInArrow(lead, "keys binary").toArrow()
    keys = np.frombuffer(b"".join(got["keys"].to_pylist()), f"V{GRAM}")
    if not len(keys):
        return np.empty(0, f"V{GRAM}")
    halves = _halves(keys)
    keys = keys[np.lexsort((halves[:, 1], halves[:, 0]))]
    return np.unique(keys[(np.arange(1, ranges) * len(keys)) // ranges])


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))
