"""The query log and graph facts as streams: sessions while they grow, and units that are merged batch by batch."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from graphloom.common import BLANKS, cut, shared_folder
from graphloom.operators.search import REMEMBERED

#: Seconds of the entry that ends a log, in the year 9000.
END = 221_845_392_000


def log_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """time, kind, arg of log files as they arrive; a glob lets a single file stand for a folder."""
    rows = spark.readStream.schema(schema).parquet(f"{path}*").where("t is not null and kind is not null and arg is not null")
    return rows.select(F.timestamp_seconds("t").alias("time"), F.lower(F.trim("kind", F.lit(BLANKS))).alias("kind"), "arg")


def closing(stream: DataFrame) -> DataFrame:
    """The stream of a log that has ended, with one more entry far behind all others, so that the watermark passes every run and all of them come out. The entry's
    kind is null; drop what it gives."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/closing-{uuid.uuid4().hex}"
    spark.range(1).select(F.timestamp_seconds(F.lit(END)).alias("time"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("arg")).write.parquet(folder)
    return stream.unionByName(spark.readStream.schema("time timestamp, kind string, arg string").parquet(folder))


def session_counts(stream: DataFrame, late: str = "30 days", gap: int = REMEMBERED) -> DataFrame:
    """kind, w, n, end per run of entries of one kind less than gap seconds behind one another. Entries later than late are let go, repeated ones count once.

    A run is final once the watermark has passed it; its state goes then."""
    once = stream.withWatermark("time", late).dropDuplicatesWithinWatermark(["time", "kind", "arg"])
    return once.groupBy("kind", F.session_window("time", f"{gap} seconds").alias("w")).agg(F.count("*").alias("n"), F.max("time").alias("end"))


def run_to_table(counts: DataFrame, name: str) -> str:
    """Runs a stream over all there is and appends what each batch has finished to a table of the shared folder, parted by batch, so that a batch that comes again
    replaces its own rows; the table's path."""
    spark = counts.sparkSession
    root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/table/batch={number}")

    query: StreamingQuery = counts.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{root}/state").foreachBatch(keep).start()
    query.awaitTermination()
    return f"{root}/table"


def merge_units(table: str, batch: DataFrame, unit: str = "module", sha: str = "sha") -> None:
    """One batch of facts (unit, sha, ...) put into a table parted by unit: units that came with another sha than the table has are replaced as a whole, all others stay
    as they are, files included. A unit's sha is the greatest of its rows; null is a sha of its own. For use in foreachBatch, where a batch that comes again
    changes nothing."""
    spark = batch.sparkSession
    whole = batch.where(F.col(unit).isNotNull())
    of = lambda df: df.groupBy(unit).agg(F.max(sha).alias("_sha"))
    try:
        known = of(spark.read.parquet(table))
    except AnalysisException:  # no table yet
        known = of(whole.limit(0))
    same = of(whole).alias("a").join(known.alias("b"), (F.col(f"a.{unit}") == F.col(f"b.{unit}")) & F.expr("a._sha <=> b._sha")).select(F.col(f"a.{unit}").alias(unit))
    cut(whole.join(same, unit, "left_anti")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(unit).parquet(table)
