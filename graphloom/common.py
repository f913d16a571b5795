"""What every operator needs: reading tables, cleaning keys and cutting lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

BLANKS = " \t\r\n\f\u000b "


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each application, so that they need not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_graphloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / "graphloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._graphloom_shipped = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def clean_kind(kind: Column | str = "kind") -> Column:
    """A kind in upper case without blanks around it; null stays null."""
    return F.upper(F.trim(F.col(kind) if isinstance(kind, str) else kind, F.lit(BLANKS)))


def clean_sha(sha: Column | str = "sha") -> Column:
    """A hex digest in lower case without blanks or line ends around it; null stays null."""
    return F.lower(F.trim(F.col(sha) if isinstance(sha, str) else sha, F.lit(BLANKS)))


def snapshots(spark: SparkSession, folder: str) -> list[int]:
    """The snapshot numbers in order. One row per build, so the list is small by its nature."""
    rows = table(spark, folder, "snaps").select("snap_no").where("snap_no is not null").distinct().collect()
    return sorted(r[0] for r in rows)


def last_snapshot(spark: SparkSession, folder: str) -> int:
    """The number of the last snapshot; -1, which no row has, if there is none."""
    return max(snapshots(spark, folder), default=-1)


def at_snapshot(df: DataFrame, snap_no: int) -> DataFrame:
    """The rows of one snapshot; the comparison reaches the Parquet scan."""
    return df.where(F.col("snap_no") == snap_no)


def latest_rows(df: DataFrame, keys: list[str], by: str = "loaded_at") -> DataFrame:
    """Of several deliveries of a key the one loaded last. A row without a time is the oldest; rows with a null in a key are left out.

    The rows of a key are combined before the shuffle, so a key delivered very often costs no task more than others."""
    rest = [c for c in df.columns if c not in keys]
    kept = df.where(" and ".join(f"`{k}` is not null" for k in keys))
    when = F.coalesce(F.col(by).cast("timestamp"), F.timestamp_seconds(F.lit(-62135596800)))
    best = kept.groupBy(*keys).agg(F.max_by(F.struct(*rest), when).alias("_row"))
    return best.select(*keys, *(F.col("_row")[c].alias(c) for c in rest)).select(*df.columns)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Where it is unset a temporary one is made, but only if all tasks run on this machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir()


def cut(df: DataFrame, instead: DataFrame | None = None) -> DataFrame:
    """The same rows from a table written to the shared folder, so that a lost executor costs a read and not a replay.

    A table, as its true size plans the joins behind it; the size that Spark estimates for a checkpoint multiplies with every round of a loop.
    instead: what an earlier cut gave and nothing needs any more, as the state before in a loop; its table is deleted."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    drop(instead)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def cut_measured(df: DataFrame, instead: DataFrame | None = None, **measures: Column) -> tuple[DataFrame, dict[str, int]]:
    """cut, and aggregates of the rows that are taken while they are written, so that a loop's test costs no job; an aggregate of no rows is 0."""
    seen = Observation()
    out = cut(df.observe(seen, *(c.alias(name) for name, c in measures.items())), instead)
    got = seen.get
    return out, {name: got.get(name) or 0 for name in measures}


def drop(df: DataFrame | None) -> None:
    """Deletes the table behind what cut gave."""
    path = getattr(df, "_cut_path", None) if df is not None else None
    if path:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def numbered(rows: DataFrame, by: str | Column, name: str) -> DataFrame:
    """rows with a number (long) that grows with the order of by, with gaps: cut it before it is used, as each run may number otherwise."""
    return rows.orderBy(by).withColumn(name, F.monotonically_increasing_id())


def meet(rows: DataFrame, key: str, few: DataFrame, own: str, hot: Column) -> DataFrame:
    """The join of rows with few, which is unique in own, on key = own. The rows of few that are hot, a bounded number, are broadcast, so that a key which a
    third of all rows has comes into no task's group; all others meet by a shuffle. Null keys meet nothing."""
    wide = few.where(hot)
    same = F.col(key) == F.col(own)
    rest = rows.join(F.broadcast(wide.select(own)), same, "left_anti").join(few.where(~hot), same)
    return rows.join(F.broadcast(wide), same).unionByName(rest)


#: Words of 64 bits in a sieve: 2^25 bits, 8 MB at most.
SIEVE_WORDS = 1 << 19


def sieve(rows: DataFrame, keys: DataFrame, h: str) -> DataFrame:
    """The rows whose hash h (long) may be among those of keys, and few others: for a join that most rows won't pass.

    The hashes of keys are or-ed into at most SIEVE_WORDS words, whatever their number, which are broadcast. A row lost here has no equal in keys, so the
    join behind it stays exact; with very many keys the sieve lets more rows through, nothing else changes."""
    word, bit = F.pmod(F.col(h), F.lit(SIEVE_WORDS)), F.shiftrightunsigned(F.col(h), 58).cast("int")
    bits = keys.select(word.alias("_word"), F.expr("shiftleft(1L, cast(shiftrightunsigned(%s, 58) as int))" % h).alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    met = rows.withColumn("_at", word).join(F.broadcast(bits), F.col("_at") == F.col("_word"))
    return met.withColumn("_n", bit).where(F.expr("shiftright(_bits, _n) & 1 = 1")).select(*rows.columns)
