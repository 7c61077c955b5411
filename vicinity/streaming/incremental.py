"""The incremental loads as Structured Streaming jobs that stop when they have caught up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from vicinity.operators.spatial import near_sets, point_edges, set_pairs
from vicinity.session import stable


def stream_files(spark: SparkSession, path: str, schema: StructType, file_format: str = "parquet",
                 files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.format(file_format).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if file_format == "csv":
        reader = reader.option("header", "true")
    return reader.load(path)


def load_new_files(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append files that arrived since the last run; the checkpoint is the high-water mark."""
    return stream.writeStream.format("parquet").option("path", target) \
        .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def without_redelivery(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key, however late or old it is: keys stay in the state store and are never forgotten.

    For keys that outgrow a state store use :func:`load_once`, which looks them up in the target.
    """
    return stream.dropDuplicates(keys)


KEY_BUCKETS = "key_bucket"


def load_once(stream: DataFrame, keys: list[str], target: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Append rows whose key the target does not hold yet, however late or old they are.

    The target is partitioned by batch and by a hash bucket of the key. A batch
    reads the keys of only those buckets that it touches, and of rows that share a key within a batch the least
    (in the order of all columns) is taken. A batch that runs again replaces its own rows.
    """
    place = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        kept = stable(batch.groupBy(*keys).agg(F.min(F.struct(*batch.columns)).alias("row")).select("row.*").withColumn(KEY_BUCKETS, place))
        earlier = _loaded(spark, target, batch_id)
        if earlier is not None:
            touched = sorted(r[0] for r in kept.select(KEY_BUCKETS).distinct().collect())  # at most ``buckets`` numbers
            known_keys = earlier.where(F.col(KEY_BUCKETS).isin(touched)).select(*[F.col(k).alias(f"_k_{k}") for k in keys])
            same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
            kept = kept.join(known_keys, same, "left_anti")
        kept.write.mode("overwrite").partitionBy(KEY_BUCKETS).parquet(f"{target}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _loaded(spark: SparkSession, target: str, batch_id: int) -> DataFrame | None:
    """Rows that earlier batches have loaded; None when there are none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(target)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(place)] if files.exists(place) else []
    if not any(n.startswith("batch=") and n != f"batch={batch_id}" for n in names):
        return None
    return spark.read.option("basePath", target).parquet(target).where(F.col("batch") < batch_id)


def extend_edges(stream: DataFrame, parcels: DataFrame, parcel_id: str, event_id: str, metres: float,
                 target: str, checkpoint: str, as_sets: bool = False) -> StreamingQuery:
    """Edges of each micro-batch of new events against the static parcels.

    Every batch writes its own partition, so a batch that runs again replaces
    its rows and does not repeat them. With ``as_sets`` the table holds the same
    edges as sets of points that are near each other as a whole, which are far
    fewer numbers than the edges; :func:`read_edges` gives them as rows.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        find = near_sets if as_sets else point_edges
        edges = find(parcels, batch, [parcel_id], [event_id], metres)
        edges.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start()


def read_edges(spark: SparkSession, target: str) -> DataFrame:
    """The edges of a table that :func:`extend_edges` wrote ``as_sets``, one row each, with their distance.

    Few bytes of sets are many edges, so sets are spread over all shuffle partitions and not read by their size.
    """
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return set_pairs(spark.read.parquet(target).select("_left", "_right").repartition(spread))


def not_loaded_before(rows: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Batch counterpart of :func:`load_once`: rows whose key is not in the target."""
    return rows.join(target.select(*keys).distinct(), keys, "left_anti")
