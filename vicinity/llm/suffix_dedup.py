"""Operator 5: removal of repeated passages with blockwise sorted suffixes.

A byte goes if it lies in a ``WINDOW``-byte string that also starts in a document
with a smaller id. Texts are packed into compressed blocks, and a block's windows
into runs with one key (``suffix_blocks.Runs``); equal windows have equal keys. A
key's windows all meet in one bucket, and buckets are worked on one at a time:

1. keys alone tell which of them occur in several documents at all;
2. of those, hashes of whole runs find the runs that a smaller document has as
   they are; what differs around a shared key is left for
3. the texts of these few runs, one of each kind, whose suffixes are sorted with
   the ranks of a difference cover resolving long ties; equal windows then stand
   side by side and the smallest document is known;
4. verdicts go back to the blocks, where covered bytes are cut out.

A key with very many runs would not fit one bucket. Level 1 tells which keys are
that hot; at level 2 their runs are dealt by the hash of the run, and at level 3
they come as single windows, folded per block to the least id and dealt by the hash
of the window, so that equal windows meet still and nothing else has to.

Answers are bits in the order in which a block asked, so nothing but blocks holds
texts twice, and a passage that many documents share counts once per block.

Rows: a null text is empty; texts shorter than a window lose nothing. Equal ids
are not smaller than each other, so repeated rows and repetition inside one text
stay. A null id is larger than all others. Without rows the result is empty.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinity.llm.common import shuffle_partitions, text_of
from vicinity.llm.suffix_blocks import CYCLE, GRAM, PieceRuns, sorted_classes
from vicinity.session import stable

WINDOW = 50
#: Bytes of text from which a block is closed, bytes that are hashed at a time, and keys in a bucket, about.
BLOCK_BYTES, PIECE_BYTES, BUCKET_KEYS = 2_000_000, 500_000, 500_000
#: Runs, about, from which a key is hot: they are no longer kept together. Their windows in a bucket, about.
HOT_RUNS, BUCKET_WINDOWS = 20_000, 200_000
NO_ID = np.iinfo(np.int64).max
BLOCK = "block long, bytes long, ids binary, lengths binary, payload binary, rest binary"
DIGESTS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def block_rows(block_bytes: int):
    """mapInArrow function: (id, text, others...) rows to blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext
        number, packer = TaskContext.get().partitionId() << 33, zstandard.ZstdCompressor(level=3)
        texts: list[bytes] = []
        ids: list[int] = []
        others: list[pa.RecordBatch] = []
        size = 0

        def closed() -> pa.RecordBatch:
            nonlocal number, texts, ids, others, size
            rest = io.BytesIO()
            with pa.ipc.new_stream(rest, others[0].schema) as stream:
                for batch in others:
                    stream.write_batch(batch)
            row = {"block": number, "bytes": size, "ids": np.array(ids, np.int64).tobytes(),
                   "lengths": np.array([len(t) for t in texts], np.int64).tobytes(),
                   "payload": packer.compress(b"".join(texts)), "rest": packer.compress(rest.getvalue())}
            number, texts, ids, others, size = number + 1, [], [], [], 0
            return pa.RecordBatch.from_pylist([row], pa.schema(
                [("block", pa.int64()), ("bytes", pa.int64()), *[(c, pa.binary()) for c in ("ids", "lengths", "payload", "rest")]]))

        for batch in batches:
            start, batch_ids = 0, batch.column(0).to_pylist()
            rest = pa.RecordBatch.from_arrays(batch.columns[2:], [str(i) for i in range(batch.num_columns - 2)]) \
                if batch.num_columns > 2 else None
            for i, cell in enumerate(batch.column(1)):
                text = cell.as_py().encode()
                texts.append(text)
                ids.append(NO_ID if batch_ids[i] is None else batch_ids[i])
                size += len(text)
                if size >= block_bytes or i + 1 == batch.num_rows:
                    others.append((rest if rest is not None else pa.RecordBatch.from_pydict({"0": [None] * batch.num_rows})).slice(start, i + 1 - start))
                    start = i + 1
                    if size >= block_bytes:
                        yield closed()
        if texts:
            yield closed()
    return run


class Block:
    """A block's runs, and the questions it asks at each level, in a fixed order."""

    def __init__(self, row, buckets: int, window: int, spread: int = 1, piece: int = PIECE_BYTES):
        """``spread``: buckets beyond ``buckets``, which the runs and windows of hot keys are dealt into."""
        import zstandard
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["payload"]), np.uint8) if row["bytes"] else np.empty(0, np.uint8)
        self.ids, self.lengths = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["lengths"], np.int64)
        self.number, self.window, self.buckets, self.spread, self.row = row["block"], window, buckets, spread, row
        self.runs = PieceRuns(self.data, self.lengths, window, piece)
        self.run_ids = self.ids[self.runs.doc]

    def dealt(self, keys: np.ndarray, *then: np.ndarray, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Order by bucket, and the buckets in that order; what is hot is dealt by ``then[0]`` instead of the key."""
        bucket = (keys % np.uint64(self.buckets)).astype(np.int64)
        if hot is not None:
            bucket[hot] = self.buckets + (then[0][hot] % np.uint64(self.spread)).astype(np.int64)
        order = np.lexsort((*then, keys, bucket))
        return order, bucket[order]

    # level 1

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys, whether several ids have them here, and their buckets, in order.

        ``self.of`` leads from runs to them, ``self.heat`` is the binary logarithm of the number of runs, rounded up.
        """
        keys, of = np.unique(self.runs.key, return_inverse=True)
        low, high = np.full(len(keys), NO_ID), np.full(len(keys), np.iinfo(np.int64).min)
        np.minimum.at(low, of, self.run_ids)
        np.maximum.at(high, of, self.run_ids)
        order, bucket = self.dealt(keys)
        place = np.empty(len(keys), np.int64)
        place[order] = np.arange(len(keys))
        self.of = place[of]
        self.heat = np.ceil(np.log2(np.bincount(self.of, minlength=len(keys)))).astype(np.uint8)
        return keys[order], (low != high)[order], bucket

    # level 2

    def entries(self, answers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Key, shape, least id and bucket of each distinct run with a key in several documents.

        ``self.asked`` are these runs, ``self.entry`` their entries, ``self.model`` an entry's run with the least id.
        """
        _, _, bucket = self.keys()
        self.asked = np.flatnonzero(unpacked(answers, bucket)[self.of])
        shapes, first, of = np.unique(self.runs.shape[self.asked], return_index=True, return_inverse=True)
        keys = self.runs.key[self.asked][first]
        hot = unpacked(answers, bucket, "hot")[self.of[self.asked]][first]
        order, bucket = self.dealt(keys, shapes, hot=hot)
        place = np.empty(len(shapes), np.int64)
        place[order] = np.arange(len(shapes))
        self.entry = place[of]
        ids = self.run_ids[self.asked]
        by_id = np.lexsort((ids, self.entry))
        begins = np.flatnonzero(np.diff(self.entry[by_id], prepend=-1))
        self.model = self.asked[by_id][begins]
        self.least = self.run_ids[self.model]
        return keys[order], shapes[order], self.least, bucket

    # level 3

    def details(self, answers, more):
        """Models whose neighbours differ: id, lead, windows, begin, bucket; those with hot keys as single windows.

        ``self.taken`` and ``self.detail`` are bits by entry. ``self.chosen`` are the entries of whole runs, ``self.split``
        those of windows, ``self.step`` the windows' places in their runs, ``self.fold`` the question that asks for a window.
        """
        _, _, _, bucket = self.entries(answers)
        self.taken, self.detail = unpacked(more, bucket, "taken"), unpacked(more, bucket, "detail")
        self.chosen = np.flatnonzero(self.detail & (bucket < self.buckets))
        runs = self.model[self.chosen]
        whole = (self.least[self.chosen], self.runs.lead[runs], self.runs.stop[runs] - self.runs.first[runs],
                 self.runs.first[runs], bucket[self.chosen])
        hot = np.flatnonzero(self.detail & (bucket >= self.buckets))
        runs = self.model[hot]
        windows = self.runs.stop[runs] - self.runs.first[runs]
        self.split = np.repeat(hot, windows)
        self.step = np.arange(len(self.split)) - np.repeat(np.cumsum(windows) - windows, windows)
        if not len(hot):
            self.fold = self.asks_least = np.empty(0, np.int64)
            return whole
        begin, lead = self.runs.first[self.model[self.split]] + self.step, self.runs.lead[self.model[self.split]] - self.step
        hashes, ids = window_hashes(self.data, begin, lead, self.window), self.least[self.split]
        kinds, self.fold = np.unique(hashes, return_inverse=True)
        by_id = np.lexsort((ids, self.fold))
        one = by_id[np.flatnonzero(np.diff(self.fold[by_id], prepend=-1))]
        deal = self.buckets + ((kinds >> np.uint64(7)) % np.uint64(self.spread)).astype(np.int64)
        order = np.argsort(deal, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.fold, one = place[self.fold], one[order]
        self.asks_least = ids[one]
        single = (ids[one], lead[one], np.ones(len(one), np.int64), begin[one], deal[order])
        return tuple(np.r_[w, x] for w, x in zip(whole, single))

    # level 4

    def removed(self, answers, more, masks) -> np.ndarray:
        """Bytes that go."""
        *_, bucket = self.details(answers, more)
        marks = np.zeros(len(self.data) + 1, np.int64)
        ids = self.run_ids[self.asked]
        whole = (ids > self.least[self.entry]) | self.taken[self.entry]
        runs = self.asked[whole]
        np.add.at(marks, self.runs.first[runs], 1)
        np.add.at(marks, self.runs.stop[runs] - 1 + self.window, -1)
        by_entry = np.zeros(len(self.model), np.uint32)
        found = unpacked_masks(masks, bucket)
        by_entry[self.chosen] = found[:len(self.chosen)]
        goes = (found[len(self.chosen):] > 0)[self.fold] | (self.asks_least[self.fold] < self.least[self.split])
        np.bitwise_or.at(by_entry, self.split[goes], np.uint32(1) << self.step[goes].astype(np.uint32))
        some = self.asked[~whole]
        mask = by_entry[self.entry[~whole]]
        for t in range(32):
            starts = self.runs.first[some[(mask >> np.uint32(t)) & np.uint32(1) > 0]] + t
            np.add.at(marks, starts, 1)
            np.add.at(marks, starts + self.window, -1)
        return np.cumsum(marks[:-1]) > 0


def window_hashes(data: np.ndarray, begin: np.ndarray, lead: np.ndarray, window: int, part: int = 50_000) -> np.ndarray:
    """A 64-bit hash of the text of each window, equal wherever it stands."""
    views = np.lib.stride_tricks.sliding_window_view(data, window)
    out = np.empty(len(begin), np.uint64)
    for at in range(0, len(begin), part):
        h = lead[at:at + part].astype(np.uint64)
        for column in np.ascontiguousarray(views[begin[at:at + part]].T):
            h = (h ^ (column + np.uint64(1))) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(29)
        out[at:at + part] = h
    return out


def slices(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """Bucket, begin and end of each bucket's part."""
    if not len(bucket):
        return []
    begins = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    return list(zip(bucket[begins].tolist(), begins.tolist(), [*begins[1:].tolist(), len(bucket)]))


def unpacked(answers, bucket: np.ndarray, name: str = "bits") -> np.ndarray:
    """The answers' bits in the order in which the block asked; missing answers are no."""
    found = {a["bucket"]: a[name] for a in (answers if answers is not None else [])}
    out = np.zeros(len(bucket), bool)
    for number, begin, end in slices(bucket):
        if found.get(number):
            out[begin:end] = np.unpackbits(np.frombuffer(found[number], np.uint8), count=end - begin)
    return out


def unpacked_masks(answers, bucket: np.ndarray) -> np.ndarray:
    found = {a["bucket"]: a["masks"] for a in (answers if answers is not None else [])}
    out = np.zeros(len(bucket), np.uint32)
    for number, begin, end in slices(bucket):
        if number in found:
            out[begin:end] = np.frombuffer(found[number], np.uint32)
    return out


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def planes(values: np.ndarray) -> bytes:
    """64-bit values as their low halves and then their high halves, which mostly repeat and pack well."""
    halves = values.view(np.uint32).reshape(-1, 2)
    return np.ascontiguousarray(halves.T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    halves = np.frombuffer(data, np.uint32).reshape(2, -1)
    return np.ascontiguousarray(halves.T).reshape(-1).view(np.int64)


def short_keys(keys: np.ndarray) -> bytes:
    """The upper 48 bits; the lower ones tell little beyond the bucket, and a false meeting only costs a look."""
    parts = np.ascontiguousarray(keys).view(np.uint16).reshape(-1, 4)
    return np.ascontiguousarray(parts[:, 1:]).tobytes()


def from_short(data: bytes) -> np.ndarray:
    parts = np.frombuffer(data, np.uint16).reshape(-1, 3)
    out = np.zeros((len(parts), 4), np.uint16)
    out[:, 1:] = parts
    return out.reshape(-1).view(np.uint64)


KEYS = "block long, bucket long, keys binary, several binary, heat binary"
ENTRIES = "block long, bucket long, keys binary, shapes binary, ids binary"
DETAILS = "block long, bucket long, ids binary, leads binary, windows binary, texts binary"


def ask_keys(block: Block) -> Iterator[tuple]:
    keys, several, bucket = block.keys()
    for number, a, b in slices(bucket):
        yield block.number, number, short_keys(keys[a:b]), bits(several[a:b]), block.heat[a:b].tobytes() if block.heat[a:b].any() else b""


def ask_entries(block: Block) -> Iterator[tuple]:
    keys, shapes, ids, bucket = block.entries(block.row["first"])
    for number, a, b in slices(bucket):
        yield block.number, number, short_keys(keys[a:b]), np.ascontiguousarray(shapes[a:b]).tobytes(), planes(np.ascontiguousarray(ids[a:b]))


def ask_details(block: Block) -> Iterator[tuple]:
    ids, leads, windows, first, bucket = block.details(block.row["first"], block.row["second"])
    for number, a, b in slices(bucket):
        texts = b"".join(block.data[f:f + n + block.window - 1].tobytes() for f, n in zip(first[a:b].tolist(), windows[a:b].tolist()))
        yield (block.number, number, planes(np.ascontiguousarray(ids[a:b])), leads[a:b].astype(np.uint8).tobytes(),
               windows[a:b].astype(np.uint8).tobytes(), texts)


def questions(ask: Callable[[Block], Iterator[tuple]], schema: str, buckets: int, window: int, spread: int = 1):
    """mapInPandas function: what blocks ask at one level."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                rows = list(ask(Block(row, buckets, window, spread)))
                if rows:
                    yield pd.DataFrame(rows, columns=names)
    return run


def sizes_of(cells, width: int) -> np.ndarray:
    return np.array([len(c) // width for c in cells], np.int64)


def parts(values: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    return np.split(values, np.cumsum(sizes)[:-1])


def answer_keys(hot_runs: int):
    """Which keys several documents have, which of these are hot, and the runs of hot keys, about."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sizes = sizes_of(rows["keys"], 6)
        keys = np.concatenate([from_short(k) for k in rows["keys"]])
        several = np.concatenate([np.unpackbits(np.frombuffer(s, np.uint8), count=n) for s, n in zip(rows["several"], sizes)]).astype(bool)
        order = np.argsort(keys, kind="stable")
        begins = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]])
        lengths = np.diff(np.r_[begins, len(keys)])
        yes = np.empty(len(keys), bool)
        yes[order] = np.repeat((lengths > 1) | np.logical_or.reduceat(several[order], begins), lengths)
        heat = np.concatenate([np.frombuffer(h, np.uint8) if h else np.zeros(n, np.uint8) for h, n in zip(rows["heat"], sizes)])
        runs = np.add.reduceat(np.int64(1) << heat[order].astype(np.int64), begins)
        hot = np.empty(len(keys), bool)
        hot[order] = np.repeat(runs > hot_runs, lengths)
        hot &= yes
        return pd.DataFrame({
            "block": rows["block"], "bucket": rows["bucket"], "bits": [bits(p) for p in parts(yes, sizes)],
            "hot": [bits(p) if p.any() else b"" for p in parts(hot, sizes)],
            "hot_runs": [int((np.int64(1) << h[p].astype(np.int64)).sum()) if p.any() else 0 for h, p in zip(parts(heat, sizes), parts(hot, sizes))]})
    return run


def answer_entries(buckets: int):
    """Which entries a smaller document has as they are, and which meet others that differ, as all with hot keys may."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sizes = sizes_of(rows["shapes"], 8)
        keys = np.concatenate([from_short(k) for k in rows["keys"]])
        shapes = np.concatenate([np.frombuffer(s, np.uint64) for s in rows["shapes"]])
        ids = np.concatenate([from_planes(i) for i in rows["ids"]])
        order = np.lexsort((ids, shapes, keys))
        k, s, i = keys[order], shapes[order], ids[order]
        new_key = np.r_[True, k[1:] != k[:-1]]
        new_shape = new_key | np.r_[True, s[1:] != s[:-1]]
        key_begin, shape_begin = np.flatnonzero(new_key), np.flatnonzero(new_shape)
        least = np.repeat(i[shape_begin], np.diff(np.r_[shape_begin, len(i)]))
        low, high = np.minimum.reduceat(i, key_begin), np.maximum.reduceat(i, key_begin)
        mixed = (np.add.reduceat(new_shape.astype(np.int64), key_begin) > 1) & (low != high)
        mixed = np.repeat(mixed, np.diff(np.r_[key_begin, len(i)]))
        taken, detail = np.empty(len(i), bool), np.empty(len(i), bool)
        mixed |= np.repeat(rows["bucket"].to_numpy() >= buckets, sizes)[order]
        taken[order], detail[order] = least < i, mixed & (least == i)
        return pd.DataFrame({"block": rows["block"], "bucket": rows["bucket"], "taken": [bits(p) for p in parts(taken, sizes)],
                             "detail": [bits(p) for p in parts(detail, sizes)]})
    return run


def answer_details(window: int):
    """For each run, the windows that start in a smaller document too, as bits."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sizes = sizes_of(rows["leads"], 1)
        ids = np.concatenate([from_planes(i) for i in rows["ids"]])
        leads, windows = (np.concatenate([np.frombuffer(x, np.uint8) for x in rows[c]]).astype(np.int64) for c in ("leads", "windows"))
        lengths = windows + window - 1
        # Each run is laid so that the sub-string of its key starts at residue 0.
        front = (-leads) % CYCLE
        room = -(-(front + lengths) // CYCLE) * CYCLE
        begin = np.cumsum(room) - room + front
        text = np.zeros(int(room.sum()), np.uint8)
        source = np.frombuffer(b"".join(rows["texts"]), np.uint8)
        text[np.arange(len(source)) + np.repeat(begin - (np.cumsum(lengths) - lengths), lengths)] = source
        owner = np.repeat(np.arange(len(ids)), windows)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        classes = sorted_classes(text, begin[owner] + step, window)
        least = np.full(int(classes.max()) + 1 if len(classes) else 0, NO_ID)
        np.minimum.at(least, classes, ids[owner])
        goes = least[classes] < ids[owner]
        masks = np.zeros(len(ids), np.uint32)
        np.bitwise_or.at(masks, owner[goes], np.uint32(1) << step[goes].astype(np.uint32))
        return pd.DataFrame({"block": rows["block"], "bucket": rows["bucket"], "masks": [p.tobytes() for p in parts(masks, sizes)]})
    return run


#: Blocks that are kept on the executors' disks until ``release``.
_HELD: list[DataFrame] = []


def release() -> None:
    """Give up the blocks of results that have been written."""
    while _HELD:
        _HELD.pop().unpersist()


def verdicts(docs: DataFrame, others: list[str], id_col: str, text_col: str, window: int, block_bytes: int,
             hot_runs: int = HOT_RUNS) -> tuple[DataFrame, int, int]:
    """Blocks with the answers of all three levels, the number of buckets and that of buckets for hot keys."""
    spark = docs.sparkSession
    read = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"),
                       *[F.col(c).alias(f"c{i}") for i, c in enumerate(others)])
    packed = stable(read.mapInArrow(block_rows(block_bytes), BLOCK))
    size = packed.agg(F.sum("bytes")).first()[0] or 0
    parts_ = shuffle_partitions(spark)
    buckets = int(max(2 * parts_, size / 12 / BUCKET_KEYS))
    # Dealt once by block, so that the answers of every level come to the blocks and not blocks to them.
    blocks = packed.repartition(parts_, "block").persist(StorageLevel.DISK_ONLY)
    _HELD.append(blocks)

    def answered(rows: DataFrame, answer, schema: str) -> DataFrame:
        return stable(rows.groupBy("bucket").applyInPandas(answer, f"block long, bucket long, {schema}"))

    def given(frame: DataFrame, found: DataFrame, name: str, *fields: str) -> DataFrame:
        own = found.groupBy("block").agg(F.collect_list(F.struct("bucket", *fields)).alias(name))
        return frame.join(own, "block", "left")

    found = answered(blocks.mapInPandas(questions(ask_keys, KEYS, buckets, window), KEYS), answer_keys(hot_runs),
                     "bits binary, hot binary, hot_runs long")
    # A run has at most as many windows as its key has places in a window.
    hot = (found.agg(F.sum("hot_runs")).first()[0] or 0) * (window - GRAM + 1)
    spread = max(parts_, -(-hot // BUCKET_WINDOWS))
    frame = given(blocks, found, "first", "bits", "hot")
    found = answered(frame.mapInPandas(questions(ask_entries, ENTRIES, buckets, window, spread), ENTRIES),
                     answer_entries(buckets), "taken binary, detail binary")
    frame = given(frame, found, "second", "taken", "detail")
    found = answered(frame.mapInPandas(questions(ask_details, DETAILS, buckets, window, spread), DETAILS),
                     answer_details(window), "masks binary")
    return given(frame, found, "third", "masks"), buckets, spread


def cut_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                block_bytes: int = BLOCK_BYTES, hot_runs: int = HOT_RUNS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    frame, buckets, spread = verdicts(docs, [], id_col, text_col, window, block_bytes, hot_runs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                block = Block(row, buckets, window, spread)
                gone = block.removed(row["first"], row["second"], row["third"])
                out, end = [], 0
                for doc_id, length in zip(block.ids.tolist(), block.lengths.tolist()):
                    begin, end = end, end + length
                    own = gone[begin:end]
                    spans = int(np.count_nonzero(own[1:] & ~own[:-1])) + int(bool(length and own[0]))
                    kept = block.data[begin:end][~own]
                    out.append((None if doc_id == NO_ID else doc_id, length, length - len(kept), spans, hashlib.sha256(kept).hexdigest()))
                yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]).astype({"doc_id": "Int64"})

    out = stable(frame.mapInPandas(run, DIGESTS))
    release()
    return out


def whole_signs(text: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """``gone`` without the bytes of signs that would be cut apart."""
    starts = np.flatnonzero((text & 0xC0) != 0x80)
    if not len(starts):
        return gone
    whole = np.logical_and.reduceat(gone, starts)
    return np.repeat(whole, np.diff(np.r_[starts, len(text)]))


def cut_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
              block_bytes: int = BLOCK_BYTES, hot_runs: int = HOT_RUNS) -> DataFrame:
    """``docs`` with repeated passages cut out of the text, all other columns as they are; null texts become empty.

    A sign of several bytes goes only as a whole. The blocks stay until ``release`` is called.
    """
    others = [c for c in docs.columns if c != text_col]
    frame, buckets, spread = verdicts(docs, others, id_col, text_col, window, block_bytes, hot_runs)
    types = {f.name: f.dataType for f in docs.schema.fields}
    schema = T.StructType([T.StructField("text", T.StringType()), *[T.StructField(f"c{i}", types[c]) for i, c in enumerate(others)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, buckets, window, spread)
                gone = block.removed(row["first"], row["second"], row["third"])
                texts, end = [], 0
                for length in block.lengths.tolist():
                    begin, end = end, end + length
                    text = block.data[begin:end]
                    texts.append(text[~whole_signs(text, gone[begin:end])].tobytes().decode())
                rest = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(row["rest"])).read_all().combine_chunks()
                columns = [rest.column(i).combine_chunks() for i in range(len(others))]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *columns], [f.name for f in schema.fields])

    cut = frame.mapInArrow(run, schema)
    names = {c: f"c{i}" for i, c in enumerate(others)} | {text_col: "text"}
    return cut.select(*[F.col(names[c]).alias(c) for c in docs.columns])
