"""Per-key results where a few keys hold most records.

Quantiles come from histograms over value ranges that are narrowed round by round until each rank is resolved. Only counts are merged; the values
of a key with a third of all rows stay where they are. Exact counts of distinct values can't come from counts that merge, so they take two steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.common import cut

#: Bins of one histogram. 2^8 bins resolve a 64-bit range in eight rounds.
BITS = 8
#: A key with more than this share of all rows counts as hot, so there are at most 1 / HOT_SHARE hot keys, whatever the data.
HOT_SHARE = 1 / 1024


def distinct_per_key(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """keys and the exact number of their distinct values. Null values count for nothing, null keys are keys.

    A count in two steps: values are told apart by key and value together, so the work of a hot key is spread by its values, and then counted."""
    return df.where(F.col(value).isNotNull()).select(*keys, value).distinct().groupBy(*keys).agg(F.count("*").alias(name))


def _ranks(n: str, share: float):
    """The rank, from 0, of the smallest value that at least this share of the values don't exceed."""
    return F.greatest(F.ceil(F.col(n) * F.lit(share)).cast("long") - 1, F.lit(0).cast("long"))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """keys, n, share, value: for each key the exact quantiles (smallest value that the share reaches) of a whole-numbered column.

    Null values are left out; a key without any other value has no row; null keys are keys. Each round counts, per key and share, the values left in
    each bin of the present range and goes on with the bin that holds the rank. The ranges of hot keys, at most 1 / HOT_SHARE keys, are broadcast;
    those of all others meet their values by a shuffle in which no key has more than HOT_SHARE of the rows."""
    same = lambda a, b: F.expr(" and ".join(f"{a}.`{k}` <=> {b}.`{k}`" for k in keys))
    values = cut(df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("long").alias("_v")))
    totals = cut(values.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")))
    most = (totals.agg(F.sum("n")).first()[0] or 0) * HOT_SHARE
    hot = F.broadcast(totals.where(F.col("n") > most).select(*keys).alias("h"))
    values = values.alias("v").join(hot, same("v", "h"), "left_semi").withColumn("_hot", F.lit(True)).unionByName(values.alias("v").join(hot, same("v", "h"), "left_anti").withColumn("_hot", F.lit(False)))
    state = totals.select(*keys, "n", "lo", "hi", F.explode(F.array(*(F.struct(F.lit(float(s)).alias("share"), _ranks("n", s).alias("rank")) for s in shares))).alias("s")).select(
        *keys, "n", "lo", "hi", "s.share", "s.rank", (F.col("n") > most).alias("_is_hot"))
    done = cut(state.where("lo = hi"))
    state = cut(state.where("lo < hi"))
    while not state.isEmpty():
        # the width of a bin is a power of two: as many bits as the range has beyond BITS
        span = F.col("hi").cast("decimal(38,0)") - F.col("lo").cast("decimal(38,0)")
        ranged = state.withColumn("shift", F.greatest(F.ceil(F.log2(span + 1)).cast("int") - BITS, F.lit(0)))
        counted = []
        for is_hot in (True, False):
            ranges = ranged.where(F.col("_is_hot") == is_hot)
            ranges = (F.broadcast(ranges) if is_hot else ranges).alias("r")
            met = values.where(F.col("_hot") == is_hot).alias("v").join(ranges, same("v", "r") & F.expr("v._v between r.lo and r.hi"))
            counted.append(met.select(*(F.col(f"v.{k}") for k in keys), "r.share", F.expr("cast((cast(v._v as decimal(38,0)) - r.lo) div cast(pow(2, r.shift) as decimal(38,0)) as int)").alias("bin"), "v._v"))
        bins = counted[0].unionByName(counted[1]).groupBy(*keys, "share", "bin").agg(F.count("*").alias("c"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        upto = Window.partitionBy(*keys, "share").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        summed = bins.withColumn("upto", F.sum("c").over(upto)).alias("b")
        chosen = summed.join(state.alias("s"), same("b", "s") & F.expr("b.share = s.share and s.rank >= b.upto - b.c and s.rank < b.upto")).select(
            *(F.col(f"b.{k}") for k in keys), "s.n", F.col("b.low").alias("lo"), F.col("b.high").alias("hi"), "s.share", F.expr("s.rank - (b.upto - b.c)").alias("rank"), "s._is_hot")
        state = cut(chosen)
        done = done.unionByName(state.where("lo = hi"))
        state = state.where("lo < hi")
    return done.select(*keys, "n", "share", F.col("lo").alias("value"))
