"""Streams over an event log: dedup, windows, keyed working-set state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlane.functions.scoring import DECAY


def read_events(spark: SparkSession, sf_dir: str, name: str = "events", files_per_trigger: int = 1) -> DataFrame:
    """A table's parquet files as a stream; event time is cast to a timestamp in UTC."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    # a single file is read by its folder and a glob
    folder, _, file = path.rpartition("/")
    return stream.option("pathGlobFilter", "*.parquet").parquet(path) if _is_folder(spark, path) else stream.option("pathGlobFilter", file).parquet(folder)


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def with_time(stream: DataFrame, column: str, late: str) -> DataFrame:
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def dedup(stream: DataFrame, key: str, time: str = "ts", late: str = "40 days") -> DataFrame:
    return with_time(stream, time, late).dropDuplicatesWithinWatermark([key])


def tumbling(stream: DataFrame, size: str, by: list[str], time: str = "ts", late: str = "40 days", slide: str | None = None) -> DataFrame:
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return with_time(stream, time, late).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def sessions(stream: DataFrame, gap: str, by: str, time: str = "ts", late: str = "40 days") -> DataFrame:
    return with_time(stream, time, late).groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")


def working_set(stream: DataFrame, session: str = "user_id", region: str = "region", seq: str = "event_id") -> DataFrame:
    """(session, region, touches, frequency, last_seq) after each batch: state decays once a touch, not with time, so n
    touches f <- rho * f + 1 are (1 - rho^n) / (1 - rho), and the state is a count and the last number."""
    frequency = (1 - F.pow(F.lit(DECAY), F.col("touches"))) / (1 - DECAY)
    out = stream.groupBy(session, region).agg(F.count(F.lit(1)).alias("touches"), F.max(seq).alias("last_seq"))
    return out.select(session, region, "touches", frequency.alias("frequency"), F.col("last_seq").cast("long").alias("last_seq"))


def drain(stream: DataFrame, mode: str = "append", name: str = "drained") -> DataFrame:
    """Run a bounded stream to its end and return what it wrote: a table in the shared folder, with a batch number."""
    import uuid

    from emberlane.session import shared_dir

    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/emberlane/stream-{name}-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("append").parquet(f"{base}/out")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(put).trigger(availableNow=True).start()
    q.awaitTermination()
    names = [f for f in stream.schema.fields]
    from pyspark.sql.types import IntegerType, StructField, StructType

    return spark.read.schema(StructType([*names, StructField("_batch", IntegerType())])).parquet(f"{base}/out")


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last batch's row of each key of an update-mode stream."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("r")).select(*keys, "r.*").drop("_batch")
