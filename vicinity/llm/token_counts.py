"""Operator 6: token counts.

Arrow functions return the number of tokens only. A task gathers texts until
they have enough bytes and encodes them in one call of the library. Long texts
are split at safe boundaries first: a single space between two characters that
are not white space, where the vocabulary has no piece that crosses it. The
library puts a space in front of every text, so the space at the boundary itself
is left out. The numbers of a text's parts add up to its own.

Rows: a null text is empty and has no tokens. Repeated rows are counted each on
its own. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinity.llm.common import text_of, tokenizer_path

LIMIT = 4096
#: Characters beyond which a text is split, and characters that one call of the library gets.
LONG_TEXT = 16_384
CALL_CHARS = 1 << 20
COUNTS = "doc_id long, n_bytes long, n_tokens long"
#: The mark that the library's vocabulary has for a space.
SPACE_MARK = "▁"
SAFE = re.compile(r"[!-~] (?=[!-~])")


def splits_at_spaces(processor) -> bool:
    """Whether no piece of the vocabulary has a space after another character, and a space is all that is put before a text."""
    one = processor.encode("a", out_type=str)
    plain = processor.encode("a  a", out_type=str) == one + [SPACE_MARK] + one and one[0].startswith(SPACE_MARK)
    return plain and all(SPACE_MARK not in processor.id_to_piece(i).lstrip(SPACE_MARK) for i in range(processor.get_piece_size()))


def parts_of(text: str, most: int = LONG_TEXT) -> list[str]:
    """The text cut at the first safe boundary after every ``most`` characters."""
    if len(text) <= most:
        return [text]
    parts, at = [], 0
    while len(text) - at > most:
        found = SAFE.search(text, at + most)
        if not found:
            break
        parts.append(text[at:found.start() + 1])
        at = found.end()
    return [*parts, text[at:]]


def count_batches(path: str, long_text: int, call_chars: int):
    """mapInArrow function: bytes and tokens of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece
        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        most = long_text if splits_at_spaces(processor) else 1 << 62

        def counted(parts: list[str], owner: list[int], totals: list[int]) -> None:
            for i, ids in zip(owner, processor.encode(parts, num_threads=1)):
                totals[i] += len(ids)

        for batch in batches:
            totals, sizes = [0] * batch.num_rows, []
            parts, owner, chars = [], [], 0
            for i, cell in enumerate(batch.column(1)):
                text = cell.as_py()
                sizes.append(len(text.encode()))
                for part in parts_of(text, most):
                    parts.append(part)
                    owner.append(i)
                    chars += len(part)
                    if chars >= call_chars:
                        counted(parts, owner, totals)
                        parts, owner, chars = [], [], 0
            if parts:
                counted(parts, owner, totals)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])
    return run


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None,
                 limit: int = LIMIT, long_text: int = LONG_TEXT, call_chars: int = CALL_CHARS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit."""
    path = model or tokenizer_path("piece_bpe_32k.model")
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    counts = read.mapInArrow(count_batches(path, long_text, call_chars), COUNTS)
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
