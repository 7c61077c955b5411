"""Operator 2: best-fit decreasing packing of token sequences.

A document's tokens, with an end token, are first cut into full windows; what is
left of it is one piece shorter than a window. Pieces are dealt at random into
groups of a bounded size. In a group they are placed longest first, each into the
open window with the least room that still takes it; a segment tree indexed by
the remaining room finds that window.

Rows: a null text is empty and gives the end token alone. Repeated rows are
packed each on its own. Other columns are not read.
"""

from __future__ import annotations

import functools
import json
import math
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinity.llm.common import text_of, tokenizer_path
from vicinity.session import stable

WINDOW = 2048
END_ID = 1
#: Pieces that one task packs together; one group leaves about one window that is not full.
GROUP_PIECES = 8192
#: Words whose ids a task remembers before it starts anew.
REMEMBERED = 120_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES.replace("doc_id long", "doc_id string") + ", sequence_id long, offset long, padding long"


class RoomTree:
    """Open windows by their remaining room, with the smallest sufficient room found by descent."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.filled = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, window: int) -> None:
        self.open[room].append(window)
        at = room + self.size
        while at:
            self.filled[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Window with the least room of at least ``need``, taken out of the tree; with its room."""
        filled, at = self.filled, need + self.size
        if not filled[at]:
            while at > 1 and (at & 1 or not filled[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if filled[2 * at] else 2 * at + 1
        room = at - self.size
        while at:
            filled[at] -= 1
            at >>= 1
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window number and offset of each piece, and the tokens in each window."""
    tree, used = RoomTree(window), []
    numbers, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = tree.take(need) if need < window else None
        room, number = found or (window, len(used))
        if found is None:
            used.append(0)
        numbers[i], offsets[i] = number, used[number]
        used[number] += need
        if room > need:
            tree.add(room - need, number)
    return numbers, offsets, np.array(used, np.int64)


def packed_ids(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit ids."""
    return struct.pack(f"<{len(ids)}I", *ids)


class WordIds(dict):
    """Little-endian ids of a word with its leading space; missing words are encoded."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = packed_ids(self.encode(word))
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = ids
        return ids


def byte_signs() -> dict[str, int]:
    """Byte of each sign of a byte-level vocabulary: visible Latin-1 signs stand for themselves, the rest follow from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def word_encoder(path: str, tokenizer):
    """Function from a word to its ids by the merges of a tokenizer file.

    Where the n-th merge makes the n-th id after the single bytes, ids are ranks, and the same merges are
    done some five times faster by the rank encoder; any other file is left to its own library.
    """
    import public_tokenizers
    import tiktoken
    with open(path) as file:
        model = json.load(file)["model"]
    vocabulary, signs = model["vocab"], byte_signs()
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    if [vocabulary.get(m) for m in merged] != list(range(len(signs), len(signs) + len(merged))):
        return lambda word: tokenizer.encode(word, add_special_tokens=False).ids
    ranks = {bytes(signs[c] for c in token): i for token, i in vocabulary.items() if i < len(signs) + len(merged)}
    return tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def byte_level(tokenizer) -> bool:
    """Whether a tokenizer only cuts the bytes of a text, by the usual pattern and merges."""
    parts = json.loads(tokenizer.to_str())
    cutter = parts["pre_tokenizer"] or {}
    return (parts["normalizer"] is None and parts["post_processor"] is None and cutter.get("type") == "ByteLevel"
            and not cutter.get("add_prefix_space") and cutter.get("use_regex", True))


#: White space before a space: only there a space may belong to the match before it.
DOUBLE = re.compile(r"\s ")


@functools.lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One encoder for a worker process, so that later tasks find its words."""
    return Encoder(path)


class Encoder:
    """Ids of whole texts.

    The vocabulary's pattern always ends a match between a character that is not
    white space and a space, so the words between single spaces have ids of their
    own and can be remembered. Texts with doubled white space or with a special
    string inside are encoded whole by the file's library, as are all texts where
    the file is not a plain byte-level vocabulary.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_words = byte_level(self.tokenizer)
        self.words = WordIds(word_encoder(path, self.tokenizer)) if self.by_words else None

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.by_words or DOUBLE.search(text) or any(s in text for s in self.special):
            return packed_ids(self.tokenizer.encode(text, add_special_tokens=False).ids)
        first, *others = text.split(" ")
        words = self.words
        return words[first] + b"".join([words[" " + w] for w in others])


def encode_pieces(path: str, window: int, end_id: int):
    """mapInArrow function: the pieces of each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = encoder_of(path), packed_ids([end_id])
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.ids(text.as_py()) + end
                tokens = len(ids) // 4
                for start in range(0, tokens, window):
                    length = min(window, tokens - start)
                    out.append((doc_id, start, length, zlib.crc32(ids[4 * start:4 * (start + length)]), tokens))
            if out:
                columns = [pa.array(c, pa.int64()) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
    return run


def padding_of(tokens: np.ndarray, window: int) -> np.ndarray:
    """Pad tokens of a sequence: up to the window, none at a power of two."""
    return np.where((tokens & (tokens - 1)) == 0, 0, window - tokens)


def pack_group(group: pd.DataFrame, groups: int, window: int) -> pd.DataFrame:
    group = group.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True])
    numbers, offsets, used = best_fit_decreasing(group["length"].to_numpy(), window)
    out = group.drop(columns="group")
    return out.assign(sequence_id=group["group"].to_numpy() + groups * numbers, offset=offsets,
                      padding=padding_of(used, window)[numbers])


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
         window: int = WINDOW, end_id: int = END_ID, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per piece: where it lies in its document and in which sequence, at which offset."""
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    pieces = stable(read.mapInArrow(encode_pieces(path, window, end_id), PIECES))
    groups = max(1, math.ceil(pieces.count() / group_pieces))
    # The place of the stored row lets equal pieces, as of repeated rows, fall into different groups.
    dealt = pieces.withColumn("group", F.pmod(
        F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    # Ids as text: pandas would turn whole numbers among nulls into floating ones.
    dealt = dealt.withColumn("doc_id", F.col("doc_id").cast("string"))
    packed = dealt.groupBy("group").applyInPandas(lambda g: pack_group(g, groups, window), PACKED)
    return packed.withColumn("doc_id", F.col("doc_id").cast("long"))
