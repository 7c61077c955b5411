"""Operator 10: language by error-correcting output codes.

Every language has a codeword; for each bit, a classifier on hashed byte n-grams
tells languages with a 1 there from those with a 0. It weighs an n-gram by the
log ratio of its smoothed shares in the two groups, each language counting
alike, so that a frequent language does not outvote a rare one. A text gets a
margin for each bit, and the codeword with the least weighted loss wins: a bit
weighs as much as its classifier was right on the training rows. A second
codeword nearly as close flags the text as ambiguous.

The languages are all those of the training rows, whatever the size of the table.
The classifiers are fitted on a sample that is bounded for each language, chosen
by a hash of the id and the text; a language with fewer rows than its bound is
learned whole, and rows of other languages do not change which of its rows are drawn
except through the number of languages.

Rows: a null text, or one without any letter, is ``und`` with score 0. Rows with
a null language, or without any letter, are never learned from; rows that repeat
an id and its text are learned from once. Without anything to learn every text is
``und``. With one language only, every text with a letter is of it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinity.llm.common import shuffle_partitions
from vicinity.session import stable

#: Documents the classifiers are fitted on, about; those of each language however many there are; and slots of the n-gram table.
SAMPLE_DOCS, LEAST_DOCS, SLOTS = 20_000, 500, 1 << 15
#: Bits beyond those that tell languages apart; up to 4 languages get every useful column.
MOST_BITS = 31
#: Loss between the best codewords, per bit, below which a text is ambiguous.
AMBIGUOUS = 0.05
RESULT = "doc_id long, lang_pred string, score double, ambiguous boolean"
NONE = "und"


def grams(text: str) -> np.ndarray:
    """Slots of the byte n-grams of one to four bytes of the lower-cased text with a space at either end."""
    b = np.frombuffer(f" {text.lower()} ".encode(), np.uint8).astype(np.uint32)
    g2 = b[:-1] * np.uint32(257) + b[1:]
    g3 = g2[:-1] * np.uint32(257) + b[2:]
    g4 = g3[:-1] * np.uint32(257) + b[3:]
    out = np.concatenate([b, g2 + np.uint32(1 << 20), g3 + np.uint32(1 << 28), g4 ^ np.uint32(0x5BD1E995)])
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    return (out >> np.uint32(17)).astype(np.int64) & (SLOTS - 1)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def codewords(n: int, most_bits: int = MOST_BITS) -> np.ndarray:
    """n codewords of -1 and 1: all useful columns if they are few, else columns drawn by a fixed seed."""
    if n < 2:
        return np.ones((n, 1))
    if 2 ** (n - 1) - 1 <= most_bits:
        columns = [[1] + [1 if c >> i & 1 else -1 for i in range(n - 1)] for c in range(2 ** (n - 1) - 1)]
        return np.array(columns, float).T
    rng, best, bits = np.random.default_rng(0), None, max(most_bits, int(np.ceil(10 * np.log2(n))))
    for _ in range(50):
        code = np.array([rng.permutation(np.arange(n) % 2) * 2 - 1 for _ in range(bits)], float).T
        apart = ((bits - code @ code.T) / 2 + bits * np.eye(n)).min()
        if best is None or apart > best[0]:
            best = apart, code
    return best[1]


class LanguageModel:
    def __init__(self, languages: list[str], counts: np.ndarray):
        """counts: languages x slots."""
        self.languages, self.code = languages, codewords(len(languages))
        shares = (counts + 0.1) / (counts + 0.1).sum(1, keepdims=True)
        self.slots = np.empty((SLOTS, self.code.shape[1]), np.float32)
        for bit, column in enumerate(self.code.T):
            ones, zeros = shares[column > 0], shares[column < 0]
            self.slots[:, bit] = np.log(ones.mean(0) / zeros.mean(0)) if len(ones) and len(zeros) else 1.0
        self.weights = np.ones(self.code.shape[1])

    def margins(self, text: str) -> np.ndarray:
        """One margin per bit: the mean log ratio, growing with the root of the text's length."""
        found = grams(text)
        total = self.slots[found].sum(0, dtype=np.float64) if len(found) < SLOTS else \
            np.bincount(found, minlength=SLOTS) @ self.slots.astype(np.float64)
        return total / np.sqrt(len(found))

    def decode(self, margins: np.ndarray) -> tuple[str, float, bool]:
        """Language, score and ambiguity: the codeword with the least weighted logistic loss."""
        loss = (np.logaddexp(0, -self.code * margins) * self.weights).sum(1) / self.weights.sum()
        order = np.argsort(loss, kind="stable")
        odds = np.exp(-(loss - loss[order[0]]) * self.code.shape[1])
        close = len(order) > 1 and loss[order[1]] - loss[order[0]] < AMBIGUOUS
        return self.languages[order[0]], float(1 / odds.sum()), bool(close)


def sampled(training: DataFrame, sample_docs: int) -> DataFrame:
    """lang and text of about the same number of rows of each language, and of at least one."""
    spread = 1 << 62
    # Signs that this Java does not know yet may be letters to Python, which decides in the end.
    rows = training.where("lang is not null and text rlike '[\\\\p{L}\\\\p{Cn}]'").select(
        "lang", "text", F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(17)), 2).alias("place"))
    found = rows.groupBy("lang").agg(F.approx_count_distinct("place").alias("texts"), F.min("place").alias("first")).collect()
    each = max(LEAST_DOCS, math.ceil(sample_docs / max(1, len(found))))
    # One short row for each language, as the model has one long row for each.
    limits = training.sparkSession.createDataFrame(
        [(r["lang"], max(r["first"], int(min(1.0, each / max(1, r["texts"])) * (spread - 1)))) for r in found], "lang string, last long")
    return rows.join(F.broadcast(limits), "lang").where("place <= last").dropDuplicates(["lang", "place"]).select("text", "lang")


def learn(training: DataFrame, sample_docs: int = SAMPLE_DOCS) -> LanguageModel | None:
    """Model of ``training`` (doc_id, text, lang): all its languages, fitted on a bounded sample of each."""
    # Stored as the scan's own tasks draw it; only what was drawn goes through few tasks, twice.
    sample = stable(sampled(training, sample_docs))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                if has_letter(text := text.as_py()):
                    own = np.bincount(grams(text), minlength=SLOTS).astype(np.float64)
                    sums[lang] = sums.get(lang, 0) + own / own.sum()
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array([v.tobytes() for v in sums.values()])], ["lang", "counts"])

    total: dict[str, np.ndarray] = {}
    few = sample.coalesce(min(8, shuffle_partitions(training.sparkSession)))
    for row in few.mapInArrow(count, "lang string, counts binary").orderBy("lang", "counts").collect():
        total[row["lang"]] = total.get(row["lang"], 0) + np.frombuffer(row["counts"])
    if not total:
        return None
    languages = sorted(total)
    means = np.array([total[x] for x in languages])
    model = LanguageModel(languages, means / means.sum(1, keepdims=True) * 1e6)
    place = {x: i for i, x in enumerate(languages)}

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            right = np.zeros(model.code.shape[1])
            rows = 0
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                if has_letter(text := text.as_py()):
                    right += np.sign(model.margins(text)) == model.code[place[lang]]
                    rows += 1
            yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64()), pa.array([right.tolist()], pa.list_(pa.float64()))],
                                             ["rows", "right"])

    found = few.mapInArrow(check, "rows long, right array<double>").collect()
    rows = sum(r["rows"] for r in found)
    if rows and len(languages) > 1:
        model.weights = np.maximum(sum(np.array(r["right"]) for r in found) / rows - 0.5, 0.01) * 2
    return model


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous of ``docs`` (doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for cell in batch.column(1):
                text = cell.as_py()
                found.append(model.decode(model.margins(text)) if model and has_letter(text) else (NONE, 0.0, False))
            lang, score, close = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(close, pa.bool_())],
                ["doc_id", "lang_pred", "score", "ambiguous"])
    return docs.select("doc_id", "text").mapInArrow(run, RESULT)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id's decimal text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous; learned from the rows that are not held out."""
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.col(lang_col).cast("string").alias("lang"))
    model = learn(read.where(~held_out()), sample_docs)
    out = predict(read, model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
