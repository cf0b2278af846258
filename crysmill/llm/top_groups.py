"""Top N items within every group by one global, range-partitioned sort.

The rows are range-partitioned and sorted on (group, score descending, tie columns, identifier), so a group of any size
is cut over as many partitions as it fills. One pass over each partition gives, for each group in it, the number of its
rows there and its first N rows with their local places. The counts are prefix-summed over the partitions of a group,
which makes local places exact global ones, and places up to N are kept.

Edge cases: rows whose group, score or identifier is null, or whose score is NaN, take no part; in ``ties`` nulls and NaN come last;
rows equal in score and ties are ordered by the identifier. Identical rows are one item each: aggregate first if not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import Scratch

FIELDS = ["part", "g", "n", "k", "item", "score"]


def top_n(df: DataFrame, group: str, score: str, item: str, n: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """(group, item, score, place 1..n) of ``df``; ``ties`` are ascending DOUBLE columns, group and item are strings."""
    if n < 1:
        raise ValueError("n must be at least 1")
    slim = df.select(F.col(group).cast("string").alias("g"), F.col(score).cast("double").alias("s"), F.col(item).cast("string").alias("i"), *[F.nanvl(F.col(t).cast("double"), F.lit(None)).alias(f"t{k}") for k, t in enumerate(ties)])
    slim = slim.where("g IS NOT NULL AND i IS NOT NULL AND s IS NOT NULL AND NOT isnan(s)")
    order = [F.asc("g"), F.desc("s"), *[F.asc_nulls_last(f"t{k}") for k in range(len(ties))], F.asc("i")]
    # written once: the range sort reads its input twice, to sample the cuts and to lay the rows out
    slim = Scratch(df.sparkSession, "top").put(slim)
    ranged = slim.repartitionByRange(*order).sortWithinPartitions(*order).select("g", "i", "s")

    def heads(batches):
        """Of each group of the partition its first n items with their local places, and one row with its count there."""
        part = TaskContext.get().partitionId()
        last, seen = None, 0

        def counts(names: list, sizes: list):
            none = pa.nulls(len(names))
            return pa.RecordBatch.from_arrays([pa.array([part] * len(names), pa.int32()), pa.array(names, pa.string()), pa.array(sizes, pa.int64()), none.cast(pa.int64()), none.cast(pa.string()), none.cast(pa.float64())], names=FIELDS)

        for b in batches:
            m = b.num_rows
            if not m:
                continue
            g = b.column("g").dictionary_encode()
            codes = g.indices.to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1])
            sizes = np.diff(np.append(starts, m))
            place = np.arange(m) - np.repeat(starts, sizes)
            names = g.dictionary.take(pa.array(codes[starts]))
            goes_on = names[0].as_py() == last
            if goes_on:  # the first group began in an earlier batch
                place[: sizes[0]] += seen
            keep = np.flatnonzero(place < n)
            at = pa.array(keep)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keep), part, np.int32)), b.column("g").take(at), pa.nulls(len(keep)).cast(pa.int64()), pa.array(place[keep].astype(np.int64)), b.column("i").take(at), b.column("s").take(at)], names=FIELDS)
            if not goes_on and last is not None:
                yield counts([last], [seen])
            sizes[0] += seen if goes_on else 0
            if len(sizes) > 1:
                yield counts(names.slice(0, len(sizes) - 1).to_pylist(), sizes[:-1].tolist())
            last, seen = names[len(sizes) - 1].as_py(), int(sizes[-1])
        if last is not None:
            yield counts([last], [seen])

    flat = ranged.mapInArrow(heads, "part INT, g STRING, n BIGINT, k BIGINT, item STRING, score DOUBLE")
    # a group's rows of earlier partitions come before; at most n + 1 rows of each partition it lies in
    ahead = W.partitionBy("g").orderBy("part").rangeBetween(W.unboundedPreceding, -1)
    placed = flat.withColumn("place", (F.coalesce(F.sum("n").over(ahead), F.lit(0)) + F.col("k") + 1).cast("int")).where(F.col("k").isNotNull() & (F.col("place") <= n))
    return placed.select(F.col("g").alias(group), F.col("item").alias(item), F.col("score").alias(score), "place")
