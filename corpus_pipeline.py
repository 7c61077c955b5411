"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again for the next one. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinity.llm import exact_dedup, jaccard_join, packing, quality, suffix_dedup
from vicinity.llm.common import table
from vicinity.session import checkpoint_dir


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Rows are judged each on its own, so of repeated rows all or none stay; a null text is judged as an
    empty one, a very long one whole. Rows without a source or language share one site. Columns named
    like a verdict keep their values. An empty table, or labels of one class only, reject nothing.
    """
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id.

    Null and empty texts are equal. Of rows that repeat id and text one stays, and a row without an id
    only where no equal text has one. Very long texts are compared whole; other columns are not compared.
    """
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by links of 0.8 or more on five-word shingles, the one with the least id.

    A row is known by its id and the hash of its text: rows that share an id, or have none, are decided
    each by its own text; ids that are null come last, ties go to the least hash, and of rows that repeat
    both one stays. Texts that are null, empty or without words all stay. Very long texts count whole.
    """
    return jaccard_join.drop_near_copies(docs)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller id has; a document may become empty.

    Rows that share an id do not cut one another, and a null id is larger than all others. A null text
    becomes empty; a very long one is cut like others. ``n_chars`` is counted anew where it is there.
    """
    cut = suffix_dedup.cut_texts(docs)
    if "n_chars" not in docs.columns:
        return cut
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of tokens; null and empty texts give their end token.

    Repeated rows are packed each on its own, very long texts are cut into full windows.
    """
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", cut_passages),
    ("packing", pack_sequences),
]
#: No stage but the second can be stated in SQL.
ORACLE_SQL = None


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder that this run has written."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between two stages is removed when the second is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    home = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{home}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        suffix_dedup.release()
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs


QUERIES = {"pipeline": (run, ORACLE_SQL)}
