"""Operator 3: byte-level BPE by tree reduction.

Encoding is a monoid over stretches of text: a text is halved until the halves
are short, these are encoded, and neighbours are joined. A join encodes a window
around the seam anew and grows it until the tokens outside cannot change:

* Between matches of the pattern. At some places a match ends whatever stands
  further away (``FIRM``: for example between a letter and a space). A window
  from such a place in the left half to one in the right half holds every match
  that the seam can touch.
* Within one long match (a run of letters, say). A list of tokens is the encoding
  of its bytes exactly when each two neighbours are the encoding of their joint
  bytes. So the window grows until the pairs at its two edges fulfil that; inside
  it and outside it they do so already.

Decoding concatenates the bytes of tokens up the same kind of tree.

Rows: a null text is empty and has no ids. Repeated rows are encoded each on its
own. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinity.llm.common import text_of, tokenizer_path

#: Characters below which a text is encoded in one call.
LEAF_CHARS = 8_192
#: Characters on each side of a seam that a join looks at first, and bytes from which a match counts as long.
FIRST_WINDOW, LONG_MATCH = 64, 2_048
#: Tokens below which ids are decoded in one call.
LEAF_IDS = 65_536
ROWS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Places where every parse by the pattern ends a match: before white space, after a letter or digit run,
#: and after other signs but the apostrophe, which may begin a contraction.
FIRM = r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\p{L}])|(?<=\p{N})(?=[^\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])"


class TreeCodec:
    def __init__(self, ranks_path: str, pattern: str, leaf_chars: int = LEAF_CHARS, leaf_ids: int = LEAF_IDS,
                 long_match: int = LONG_MATCH):
        import regex
        import tiktoken
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.names = {i: str(i) for i in self.bytes_of}
        self.firm, self.match = regex.compile(FIRM), regex.compile(pattern)
        self.leaf_chars, self.leaf_ids, self.long_match = leaf_chars, leaf_ids, long_match
        self.pairs: dict[tuple[int, int], bool] = {}

    # -- encoding

    def encode(self, text: str) -> list[int]:
        if len(text) <= self.leaf_chars:
            return self.library.encode_ordinary(text)
        middle = len(text) // 2
        left, right = text[:middle], text[middle:]
        return self.join(left, self.encode(left), right, self.encode(right))

    def firm_before(self, text: str) -> int:
        """Last firm place of a left half, with two characters behind it at least; 0 if there is none."""
        reach = FIRST_WINDOW
        while True:
            begin = max(0, len(text) - reach)
            places = [m.start() for m in self.firm.finditer(text, max(0, begin - 1)) if begin < m.start() <= len(text) - 3]
            if places or not begin:
                return places[-1] if places else 0
            reach *= 2

    def firm_after(self, text: str) -> int:
        """First firm place of a right half, with two characters before it at least; its end if there is none."""
        found = self.firm.search(text, min(2, len(text)))
        return found.start() if found else len(text)

    def join(self, left: str, left_ids: list[int], right: str, right_ids: list[int]) -> list[int]:
        a, b = self.firm_before(left), self.firm_after(right)
        tail, head = left[a:], right[:b]
        cut_left = len(left_ids) - self.tokens_of_suffix(left_ids, len(tail.encode()))
        cut_right = self.tokens_of_prefix(right_ids, len(head.encode()))
        middle = self.seam(tail, left_ids[cut_left:], head, right_ids[:cut_right])
        return left_ids[:cut_left] + middle + right_ids[cut_right:]

    def seam(self, tail: str, tail_ids: list[int], head: str, head_ids: list[int]) -> list[int]:
        """Ids of the two stretches between firm places."""
        window = tail + head
        if len(window) < self.long_match:
            return self.library.encode_ordinary(window)
        at, edge, out = 0, len(tail), []
        for found in self.match.finditer(window):
            start, end = found.span()
            if end - start < self.long_match or not start < edge < end:
                out += self.library._encode_single_piece(found[0]) if end - start < self.long_match else self.one_match(found[0])
            else:
                out += self.across(window[start:edge], self.same_match(tail, tail_ids, start),
                                   window[edge:end], self.same_match(head, head_ids, 0, end - edge))
            at = end
        assert at == len(window)
        return out

    def same_match(self, text: str, ids: list[int], start: int, end: int | None = None) -> list[int]:
        """Ids of text[start:end] as one match: taken from ``ids`` where the half had that match, else encoded."""
        end = len(text) if end is None else end
        if any(m.span() == (start, end) for m in self.match.finditer(text)):
            skip = self.tokens_of_prefix(ids, len(text[:start].encode()))
            take = self.tokens_of_prefix(ids[skip:], len(text[start:end].encode()))
            return ids[skip:skip + take]
        return self.one_match(text[start:end])

    def one_match(self, piece: str) -> list[int]:
        """Ids of a piece that is one match, by halves."""
        if len(piece) < self.long_match:
            return self.library._encode_single_piece(piece)
        middle = len(piece) // 2
        return self.across(piece[:middle], self.one_match(piece[:middle]), piece[middle:], self.one_match(piece[middle:]))

    def across(self, left: str, left_ids: list[int], right: str, right_ids: list[int]) -> list[int]:
        """Ids of two parts of one match: the window of tokens grows until both its edges are stable."""
        i = j = 4
        while True:
            i, j = min(i, len(left_ids)), min(j, len(right_ids))
            window = b"".join(map(self.bytes_of.__getitem__, left_ids[len(left_ids) - i:] + right_ids[:j]))
            ids = self.library._encode_single_piece(window)
            left_firm = i == len(left_ids) or self.stable(left_ids[-i - 1], ids[0])
            right_firm = j == len(right_ids) or self.stable(ids[-1], right_ids[j])
            if left_firm and right_firm:
                return left_ids[:len(left_ids) - i] + ids + right_ids[j:]
            i, j = i * (1 if left_firm else 2), j * (1 if right_firm else 2)

    def stable(self, a: int, b: int) -> bool:
        """Whether the two tokens are the encoding of their joint bytes."""
        if (a, b) not in self.pairs:
            if len(self.pairs) >= 1 << 18:
                self.pairs.clear()
            self.pairs[a, b] = self.library._encode_single_piece(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return self.pairs[a, b]

    def tokens_of_prefix(self, ids: list[int], size: int) -> int:
        n = 0
        while size > 0:
            size -= len(self.bytes_of[ids[n]])
            n += 1
        assert size == 0, "a match ends inside a token"
        return n

    def tokens_of_suffix(self, ids: list[int], size: int) -> int:
        n = 0
        while size > 0:
            n += 1
            size -= len(self.bytes_of[ids[-n]])
        assert size == 0, "a match ends inside a token"
        return n

    # -- decoding

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf_ids:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


def codec_rows(ranks_path: str, pattern: str, leaf_chars: int):
    """mapInArrow function: length and digests of the ids of each text, and of their decoded bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = TreeCodec(ranks_path, pattern, leaf_chars)
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for cell in batch.column(1):
                ids = codec.encode(cell.as_py())
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(codec.names.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None,
                 pattern: str | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """doc_id and ``ids array<int>`` of every text."""
    path, pattern = ranks or tokenizer_path("byte_bpe_50k.tiktoken"), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = TreeCodec(path, pattern, leaf_chars)
        for batch in batches:
            ids = [codec.encode(cell.as_py()) for cell in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _read(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", ranks: str | None = None) -> DataFrame:
    """doc_id and ``data binary``, the bytes of the ids; null ids give no bytes."""
    path, pattern = ranks or tokenizer_path("byte_bpe_50k.tiktoken"), default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = TreeCodec(path, pattern)
        for batch in batches:
            data = [codec.decode(cell.as_py() or []) for cell in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["doc_id", "data"])

    picked = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return picked.mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None,
               pattern: str | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    path, pattern = ranks or tokenizer_path("byte_bpe_50k.tiktoken"), pattern or default_pattern()
    return _read(docs, id_col, text_col).mapInArrow(codec_rows(path, pattern, leaf_chars), ROWS)


def default_pattern() -> str:
    import public_tokenizers
    return public_tokenizers.PATTERN


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
