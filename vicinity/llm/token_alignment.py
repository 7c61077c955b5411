"""Operator 11: alignment of two tokenizers.

A text is encoded by a byte-level vocabulary (A, with a space in front) and by a
vocabulary of pieces (B, which adds that space). The cumulative byte ends of both
id lists go into two dictionaries from end to index; the intersection of their
keys, sorted, cuts both lists into groups, and inside a group the tokens whose
byte ranges overlap are linked.

How often a pair of ids is linked is counted by *books*: a task numbers the groups
it meets, with their links, and keeps for each text the numbers of its groups. A full
book is handed over with its pairs of ids and their totals, and a new one begins. Totals are summed over
books; a book asks once for each of its pairs, and the answers go to the book, not
to its documents. So a task holds one book and one text, and what is shuffled for
the counts are pairs, not links.

Both vocabularies end a token before a single space between two characters that
are not white space, and neither looks across it: there long texts are cut into
parts that are encoded and aligned one after the other.

Rows: a null or empty text has no tokens and zeros, as has a text whose tokens do
not give its bytes back (the piece vocabulary reads U+2581 as a space). Rows with
a null or repeated id and repeated rows are aligned each on its own and count
each. Very long texts are read part by part. Other columns are not read. An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinity.llm.common import text_of, tokenizer_path
from vicinity.llm.packing import byte_level, byte_signs, word_encoder
from vicinity.llm.token_counts import SPACE_MARK, splits_at_spaces
from vicinity.session import stable

#: Groups of a full book.
BOOK_GROUPS = 1 << 18
#: Characters of a part that is encoded at once, and parts of a text that go into one row.
PART_CHARS, ROW_PARTS = 1 << 15, 64
#: A single space between characters that are neither white space nor the mark of one.
BETWEEN = re.compile(rf"(?<=[^\s{SPACE_MARK}]) (?=[^\s{SPACE_MARK}])")
#: A pair of ids as one number: a * PAIR + b.
PAIR = 1 << 32
NOTES = ("book long, row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
         "groups binary, pairs array<long>, totals array<long>, starts binary, links binary")
SUMS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


def common_ends(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the groups begin and end in both lists (one place more than groups): dictionaries from cumulative end to index, intersected."""
    at_a, at_b = (dict(zip(sizes.cumsum().tolist(), count(1))) for sizes in (a_sizes, b_sizes))
    ends = sorted(at_a.keys() & at_b.keys())
    return tuple(np.fromiter(chain((0,), map(at.__getitem__, ends)), np.int64, len(ends) + 1) for at in (at_a, at_b))


def overlapping(a_sizes: list[int], b_sizes: list[int]) -> list[tuple[int, int]]:
    """Index pairs that overlap in a group, inside which no ends are equal: the list whose token ends first goes on."""
    if len(a_sizes) == 1 or len(b_sizes) == 1:
        return [(x, y) for x in range(len(a_sizes)) for y in range(len(b_sizes))]
    x = y = 0
    pairs, left = [(0, 0)], a_sizes[0] - b_sizes[0]
    while x < len(a_sizes) - 1 or y < len(b_sizes) - 1:
        if left > 0:
            y += 1
            left -= b_sizes[y]
        else:
            x += 1
            left += a_sizes[x]
        pairs.append((x, y))
    return pairs


class Pair:
    """Two tokenizers with the bytes of their ids."""

    def __init__(self, bytes_path: str, pieces_path: str):
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(bytes_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        signs = byte_signs()
        names = {i: token for token, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.a_bytes = [bytes(signs.get(c, 0) for c in names.get(i, "")) for i in range(self.a.get_vocab_size())]
        self.b_bytes = [self.piece_bytes(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.a_sizes, self.b_sizes = list(map(len, self.a_bytes)), list(map(len, self.b_bytes))
        self.a_lengths, self.b_lengths = np.array(self.a_sizes), np.array(self.b_sizes)
        # Parts may be taken one by one where no piece crosses a border and the model only puts a space in front.
        self.by_parts = splits_at_spaces(self.b) and byte_level(self.a)
        encode = word_encoder(bytes_path, self.a) if self.by_parts else None
        self.a_encode = encode or (lambda text: self.a.encode(text, add_special_tokens=False).ids)

    @staticmethod
    def piece_bytes(piece: str) -> bytes:
        byte = BYTE_PIECE.fullmatch(piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace(SPACE_MARK, " ").encode()

    def parts(self, text: str) -> list[str]:
        """The text cut before safe spaces, without these; each part is encoded with one in front."""
        parts, at = [], 0
        while self.by_parts and len(text) - at > PART_CHARS:
            found = BETWEEN.search(text, at + PART_CHARS)
            if not found:
                break
            parts.append(text[at:found.start()])
            at = found.end()
        return [*parts, text[at:]] if text else []

    def ids(self, part: str) -> tuple[list[int], list[int]] | None:
        """Ids of a part with a space in front, by A and by B; None where the bytes differ."""
        a_ids, b_ids, data = self.a_encode(" " + part), self.b.encode(part, num_threads=1), (" " + part).encode()
        # A byte-level vocabulary only ever cuts the bytes it is given.
        same = self.by_parts or b"".join(map(self.a_bytes.__getitem__, a_ids)) == data
        return (a_ids, b_ids) if same and b"".join(map(self.b_bytes.__getitem__, b_ids)) == data else None

    def cuts(self, a_ids: np.ndarray, b_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return common_ends(self.a_lengths[a_ids], self.b_lengths[b_ids])


class Book(dict):
    """Numbers of groups, in the order in which they were met: by pair number where both sides have one id, else by both sides' ids."""

    def __init__(self, number: int, pair: Pair):
        super().__init__()
        self.number, self.pair = number, pair
        self.texts: list[str] = []
        self.sizes: list[int] = []
        self.links, self.starts = array("q"), array("q", [0])
        self.seen = np.zeros(1024, np.int64)

    def full(self) -> bool:
        return len(self) >= BOOK_GROUPS or len(self.links) >= 4 * BOOK_GROUPS

    def __missing__(self, group: int | tuple) -> int:
        if isinstance(group, int):
            self.texts.append("{}|{}".format(*divmod(group, PAIR)))
            self.links.append(group)
        else:
            a, b = group
            self.texts.append(f"{','.join(map(str, a))}|{','.join(map(str, b))}")
            pairs = overlapping([self.pair.a_sizes[i] for i in a], [self.pair.b_sizes[i] for i in b])
            self.links.extend(a[x] * PAIR + b[y] for x, y in pairs)
        self.sizes.append(len(self.links) - self.starts[-1])
        self.starts.append(len(self.links))
        self[group] = number = len(self)
        return number

    def groups(self, a_ids: list[int], b_ids: list[int]) -> list[int]:
        """Numbers of the groups: both lists sliced at their common ends."""
        a, b = np.array(a_ids), np.array(b_ids)
        p, q = self.pair.cuts(a, b)
        keys = (a[p[:-1]] * PAIR + b[q[:-1]]).tolist()
        many = np.flatnonzero((np.diff(p) > 1) | (np.diff(q) > 1))
        for k, i, e, j, f in zip(many.tolist(), *(x.tolist() for x in (p[many], p[many + 1], q[many], q[many + 1]))):
            keys[k] = tuple(a_ids[i:e]), tuple(b_ids[j:f])
        return list(map(self.__getitem__, keys))

    def take(self, numbers: list[int]) -> tuple[int, bytes]:
        """How many links the groups have, and their numbers, counted: two bytes each while they suffice, else four."""
        found = np.array(numbers, np.int64)
        if len(self) > len(self.seen):
            self.seen = np.concatenate([self.seen, np.zeros(2 * len(self) - len(self.seen), np.int64)])
        np.add.at(self.seen, found, 1)
        return sum(map(self.sizes.__getitem__, numbers)), found.astype(np.uint16 if len(self) <= 1 << 16 else np.uint32).tobytes()

    def note(self) -> dict:
        """The book's own row: each pair once with its total, and each group's links as places among the pairs."""
        links, starts = np.array(self.links, np.int64), np.array(self.starts, np.int64)
        pairs, places = np.unique(links, return_inverse=True)
        totals = np.zeros(len(pairs), np.int64)
        np.add.at(totals, places, np.repeat(self.seen[:len(self)], np.diff(starts)))
        return {"book": self.number, "pairs": pairs.tolist(), "totals": totals.tolist(),
                "starts": starts.tobytes(), "links": places.astype(np.int32).tobytes()}


def take_notes(bytes_path: str, pieces_path: str):
    """mapInArrow function: rows of documents, or of their parts, with numbered links, and rows of books."""
    schema = pa.schema([("book", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
                        ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("groups", pa.binary()),
                        ("pairs", pa.list_(pa.int64())), ("totals", pa.list_(pa.int64())), ("starts", pa.binary()), ("links", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        pair = Pair(bytes_path, pieces_path)
        book = Book(TaskContext.get().partitionId() << 32, pair)

        def part(row: int, doc_id: int | None, n_a: int, n_b: int, groups: list[int], sha: str) -> dict:
            n_links, numbers = book.take(groups)
            return dict(zip(schema.names, (book.number, row, doc_id, n_a, n_b, len(groups), n_links, sha, numbers)))

        def aligned(row: int, doc_id: int | None, text: str) -> Iterator[dict]:
            """Rows of one text; the last one has its digest. Nothing is counted before all of the text is known to fit."""
            nonlocal book
            parts = pair.parts(text)
            if len(parts) > ROW_PARTS and not all(pair.ids(part) for part in parts):
                parts = []
            digest, n_a, n_b, groups = hashlib.sha256(), 0, 0, []
            for k, some in enumerate(parts):
                if k and k % ROW_PARTS == 0:
                    yield part(row, doc_id, n_a, n_b, groups, "")
                    n_a, n_b, groups = 0, 0, []
                    if book.full():
                        yield book.note()
                        book = Book(book.number + 1, pair)
                ids = pair.ids(some)
                if ids is None:
                    parts, n_a, n_b, groups = [], 0, 0, []
                    break
                found = book.groups(*ids)
                digest.update(((";" if k else "") + ";".join(map(book.texts.__getitem__, found))).encode())
                n_a, n_b, groups = n_a + len(ids[0]), n_b + len(ids[1]), groups + found if groups else found
            yield part(row, doc_id, n_a, n_b, groups, digest.hexdigest() if parts else "")

        for batch in batches:
            out = []
            for row, doc_id, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                out += aligned(row, doc_id, cell.as_py())
                if book.full():
                    out.append(book.note())
                    book = Book(book.number + 1, pair)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        yield pa.RecordBatch.from_pylist([book.note()], schema)
    return run


def per_segment(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values between neighbouring starts."""
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(values)])
    return total[starts[1:]] - total[starts[:-1]]


def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A book's answers come before its documents: the sums of each group, then those of each document."""
    of = counts = best = None
    names = ("book", "row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    for batch in batches:
        out, columns = [], [batch.column(n).to_pylist() for n in names]
        for k, (book, row, doc_id, *numbers, sha) in enumerate(zip(*columns)):
            if row is None:
                answers = batch.column("answers")[k].values
                each, sure = answers.field("count").to_numpy(), answers.field("best").to_numpy(zero_copy_only=False).astype(np.int64)
                starts, links = (np.frombuffer(batch.column(c)[k].as_py(), t) for c, t in (("starts", np.int64), ("links", np.int32)))
                of, counts, best = book, per_segment(each[links], starts), per_segment(sure[links], starts)
                continue
            n_best = count_sum = 0
            if numbers[2]:
                assert of == book, "the book of a document must come before it"
                data = batch.column("groups")[k].as_py()
                groups = np.frombuffer(data, np.uint16 if len(data) == 2 * numbers[2] else np.uint32)
                n_best, count_sum = int(best[groups].sum()), int(counts[groups].sum())
            out.append((row, doc_id, *numbers, n_best, count_sum, sha))
        if out:
            kinds = [pa.int64()] * 8 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[c.split()[0] for c in SUMS.split(", ")])


def notes_of(docs: DataFrame, id_col: str, text_col: str, bytes_path: str, pieces_path: str) -> DataFrame:
    read = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return stable(read.mapInArrow(take_notes(bytes_path, pieces_path), NOTES))


def counts_of(notes: DataFrame) -> DataFrame:
    """pair, count (how often it is linked in all texts), best (whether no other A id is linked to its B id more often)."""
    counts = (notes.where("row is null").select(F.explode(F.arrays_zip("pairs", "totals")).alias("p"))
              .groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.totals").alias("count")).where("count > 0"))
    counts = stable(counts.withColumn("b", F.col("pair") % PAIR))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def pair_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bytes_vocabulary: str | None = None,
                pieces_model: str | None = None) -> DataFrame:
    """One row per pair of ids that is linked somewhere: a, b, count, best."""
    notes = notes_of(docs, id_col, text_col, bytes_vocabulary or tokenizer_path("byte_bpe_50k.json"),
                     pieces_model or tokenizer_path("piece_bpe_32k.model"))
    return counts_of(notes).select(F.expr(f"pair div {PAIR}").alias("a"), (F.col("pair") % PAIR).alias("b"), "count", "best")


def token_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bytes_vocabulary: str | None = None,
                 pieces_model: str | None = None) -> DataFrame:
    """One row per group: doc_id, number (from 0 in its row), a_ids, b_ids, text (of the group's bytes, as binary)."""
    bytes_path = bytes_vocabulary or tokenizer_path("byte_bpe_50k.json")
    pieces_path = pieces_model or tokenizer_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair(bytes_path, pieces_path)
        for batch in batches:
            for doc_id, cell in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids, out = [pair.ids(part) for part in pair.parts(cell.as_py())], []
                for a_ids, b_ids in ids if all(ids) else ():
                    p, q = (x.tolist() for x in pair.cuts(np.array(a_ids), np.array(b_ids)))
                    for i, e, j, f in zip(p, p[1:], q, q[1:]):
                        out.append((doc_id, len(out), a_ids[i:e], b_ids[j:f], b"".join(map(pair.a_bytes.__getitem__, a_ids[i:e]))))
                if out:
                    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                                                     ["doc_id", "number", "a_ids", "b_ids", "text"])

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return read.mapInArrow(run, "doc_id long, number long, a_ids array<int>, b_ids array<int>, text binary")


def alignment(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bytes_vocabulary: str | None = None,
              pieces_model: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    notes = notes_of(docs, id_col, text_col, bytes_vocabulary or tokenizer_path("byte_bpe_50k.json"),
                     pieces_model or tokenizer_path("piece_bpe_32k.model"))
    books = notes.where("row is null")
    asked = books.select("book", F.posexplode("pairs").alias("place", "pair"))
    unseen = F.struct(F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("best", F.lit(False)).alias("best"))
    answers = (asked.join(counts_of(notes), "pair", "left").select("book", F.struct("place", unseen.alias("answer")).alias("a"))
               .groupBy("book").agg(F.transform(F.sort_array(F.collect_list("a")), lambda a: a["answer"]).alias("answers")))
    none = F.array().cast("array<struct<count:bigint,best:boolean>>")
    books = books.join(answers, "book", "left").withColumn("answers", F.coalesce("answers", none))
    together = books.unionByName(notes.where("row is not null"), allowMissingColumns=True).drop("pairs", "totals")
    # Nulls sort first: a book comes before its documents.
    sums = together.repartition("book").sortWithinPartitions("book", "row").mapInArrow(add_up, SUMS)
    total = [F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    whole = sums.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *total, F.max("groups_sha256").alias("groups_sha256"))
    return whole.drop("row")
