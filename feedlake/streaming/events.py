"""Structured Streaming jobs over a folder that receives event files.

All stateful jobs bound their state with a watermark. Rows later than ``LATENESS`` are dropped by Spark, whose
progress report counts them. Every job takes its checkpoint folder, so a restarted query resumes where it was.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from feedlake.functions import expressions as E
from feedlake.operators.quality import split_required

LATENESS = "10 minutes"
REQUIRED = ["usuario_id", "contenido_id", "tipo_evento", "ocurrido_en"]


def read_event_files(spark: SparkSession, path: str, schema: StructType, pattern: str = "*", fmt: str = "parquet",
                     files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.format(fmt).load(path)


def _timed(stream: DataFrame, lateness: str) -> DataFrame:
    """Event time with its watermark; Spark wants an instant, so zone-less times are read as UTC."""
    return stream.withColumn("ocurrido_en", F.col("ocurrido_en").cast("timestamp")).withWatermark("ocurrido_en", lateness)


def _run(stream: DataFrame, checkpoint: str, path: str, mode: str = "append") -> None:
    """Process everything available now into a parquet folder; the file sink commits each batch once."""
    query = (stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
             .option("path", path).trigger(availableNow=True).start())
    query.awaitTermination()


#: One row a committed batch: who wrote it (id of the streaming query and batch) and under which free name its rows lie.
MANIFEST = "consulta string, lote_n bigint, lote string, aceptadas bigint, rechazadas bigint"


def ingest(stream: DataFrame, accepted: str, rejected: str, manifest: str, checkpoint: str) -> None:
    """Validate and append: valid and rejected rows of a batch go to two folders under a new name, then the manifest names it.

    A batch counts from the moment its manifest row exists; readers go through ``read_committed``. Nothing is ever
    overwritten: a batch that fails before its row leaves files that nobody reads, one that is replayed after its row is
    skipped, and a query with a new checkpoint (also one at the path of a lost one) has a new id, so its batches stand beside
    the earlier ones. Such a query reads its sources from the start again; repeated ids are for ``distinct_events`` and the
    lake's insert-if-absent to drop.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        # Written by Spark before the first batch, and new whenever the checkpoint is.
        query_id = spark.read.schema("id string").json(f"{checkpoint}/metadata").first().id
        done = committed(spark, manifest).filter((F.col("consulta") == query_id) & (F.col("lote_n") == batch_id))
        if not done.isEmpty():
            return
        lot = uuid.uuid4().hex
        batch = batch.persist()
        try:
            good, bad = split_required(batch, REQUIRED)
            good.write.mode("errorifexists").parquet(f"{accepted}/lote={lot}")
            bad.write.mode("errorifexists").parquet(f"{rejected}/lote={lot}")
            missing = F.count_if(reduce(lambda p, q: p | q, [F.col(c).isNull() for c in REQUIRED]))
            row = batch.agg((F.count("*") - missing).alias("aceptadas"), missing.alias("rechazadas")).select(
                F.lit(query_id).alias("consulta"), F.lit(batch_id).cast("bigint").alias("lote_n"), F.lit(lot).alias("lote"),
                "aceptadas", "rechazadas")
            # A single file, so the row appears at once or not at all.
            row.coalesce(1).write.mode("append").parquet(manifest)
        finally:
            batch.unpersist()

    query = (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def committed(spark: SparkSession, manifest: str) -> DataFrame:
    """Rows of the manifest, one a (query, batch): should two drivers have run one batch at once, the smallest name counts.

    Before the first batch there is no manifest and nothing is committed.
    """
    if not _exists(spark, manifest):
        return spark.createDataFrame([], MANIFEST)
    rows = spark.read.schema(MANIFEST).parquet(manifest)
    return rows.groupBy("consulta", "lote_n").agg(F.min_by(F.struct("lote", "aceptadas", "rechazadas"), "lote").alias("r")).select(
        "consulta", "lote_n", "r.*")


def read_committed(spark: SparkSession, folder: str, manifest: str, schema: StructType) -> DataFrame:
    """Rows of committed batches, none before the first; the semi join with the manifest leaves other folders out."""
    if not _exists(spark, folder):
        return spark.createDataFrame([], schema)
    lots = committed(spark, manifest).select("lote")
    rows = spark.read.schema(StructType(schema.fields + [StructField("lote", StringType())])).option("basePath", folder).parquet(folder)
    return rows.join(lots, "lote", "left_semi").drop("lote")


def rejected_schema(schema: StructType) -> StructType:
    """Rejected rows carry the first required field that they lack."""
    return StructType(schema.fields + [StructField("motivo_rechazo", StringType())])


def distinct_events(stream: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Each event id once, as long as its copies arrive within the lateness bound of each other."""
    return _timed(stream, lateness).dropDuplicatesWithinWatermark(["evento_id"])


def rate_counters(stream: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Events per user and minute. Hot users are combined before the shuffle by the partial aggregate."""
    return (_timed(stream, lateness)
            .groupBy(F.window("ocurrido_en", "1 minute").alias("w"), "usuario_id").agg(F.count("*").alias("eventos"))
            .select("usuario_id", F.col("w.start").alias("minuto"), "eventos"))


def over_limit(counters: DataFrame, limit: int) -> DataFrame:
    return counters.filter(F.col("eventos") > limit)


def sessions(stream: DataFrame, gap: str = "30 minutes", lateness: str = LATENESS) -> DataFrame:
    """Sessions that end after ``gap`` without activity."""
    return (_timed(stream, lateness)
            .groupBy(F.session_window("ocurrido_en", gap).alias("s"), "usuario_id").agg(F.count("*").alias("eventos"))
            .select("usuario_id", F.col("s.start").alias("desde"), F.col("s.end").alias("hasta"), "eventos"))


def sliding_trending(stream: DataFrame, length: str = "24 hours", step: str = "1 hour", lateness: str = LATENESS) -> DataFrame:
    """Clicks and decayed clicks per content in overlapping windows; decay is measured from the window's end.

    Events are first summed up per step. The decay factors into the part up to the end of the step and the part
    from there on, so only one row per content and step is repeated for the overlapping windows, not every event.
    """
    clicked = F.col("tipo_evento") == "clic"
    weight = F.when(clicked, E.efolding(F.col("p.end"), F.col("ocurrido_en"))).otherwise(0.0)
    per_step = (_timed(stream, lateness).withColumn("p", F.window("ocurrido_en", step))
                .groupBy("p", "contenido_id").agg(F.count("*").alias("n"), F.count_if(clicked).alias("c"), F.sum(weight).alias("s")))
    later = E.efolding(F.col("w.end"), F.col("fin"))
    return (per_step.select(F.window_time("p").alias("t"), F.col("p.end").alias("fin"), "contenido_id", "n", "c", "s")
            .withColumn("w", F.window("t", length, step)).groupBy("w", "contenido_id").agg(
                F.sum("n").alias("eventos"), F.sum("c").alias("clics"), F.round(F.sum(F.col("s") * later), 6).alias("score"))
            .select(F.col("w.start").alias("desde"), F.col("w.end").alias("hasta"), "contenido_id", "eventos", "clics", "score"))


def run_to_folder(stream: DataFrame, folder: str) -> DataFrame:
    """Run a streaming result to completion and read it back, instants as zone-less UTC times."""
    spark = stream.sparkSession
    _run(stream, f"{folder}/checkpoint", f"{folder}/datos")
    done = spark.read.schema(stream.schema).parquet(f"{folder}/datos")
    return done.select(*[F.col(f.name).cast("timestamp_ntz").alias(f.name) if f.dataType.typeName() == "timestamp"
                         else F.col(f.name) for f in stream.schema.fields])
