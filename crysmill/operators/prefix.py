"""Exact running totals over hash-ordered rows, without one task ever holding more than one hash bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKETS = 4096


def running_total(df: DataFrame, group: list[str], order: str, size: str, out: str = "before", buckets: int = BUCKETS) -> DataFrame:
    """Adds ``out``: the sum of ``size`` over the rows of the same ``group`` that come earlier by ``order``.

    ``order`` is a non-negative BIGINT below 2**62 spread evenly by a hash (ties are broken by nothing else, so it must
    be unique within a group). Rows are cut into ``buckets`` ranges of ``order``; the totals of the ranges (at most
    ``buckets`` rows a group) are prefix-summed on their own and added to the totals inside each range, so a group that
    holds a third of all rows is spread over all ranges.
    """
    width = (1 << 62) // buckets
    b = df.withColumn("_b", (F.col(order) / F.lit(width)).cast("int"))
    sums = b.groupBy(*group, "_b").agg(F.sum(size).alias("_s"))
    ahead = W.partitionBy(*group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("_ahead", F.coalesce(F.sum("_s").over(ahead), F.lit(0))).drop("_s")
    inside = W.partitionBy(*group, "_b").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    left = b.withColumn("_in", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    keys = [*group, "_b"]
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    joined = left.alias("l").join(sums.alias("r"), cond, "inner")
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], (F.col("l._in") + F.col("r._ahead")).alias(out))


def hash_order(*cols, seed: int = 42):
    """An even BIGINT in [0, 2**62) from columns and a seed."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 2)
