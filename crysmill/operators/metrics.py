"""Ranking, uncertainty and binning metrics, and stratified splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .prefix import hash_order, running_total


def _gain(rel: str, place: str):
    return (F.pow(F.lit(2.0), F.col(rel)) - 1) / F.log2(F.col(place) + 1)


def dcg(df: DataFrame, group: str, relevance: str, order: list) -> DataFrame:
    """(group, dcg) of items in the given order."""
    ranked = df.withColumn("_p", F.row_number().over(W.partitionBy(group).orderBy(*order)))
    return ranked.groupBy(group).agg(F.sum(_gain(relevance, "_p")).alias("dcg"))


def ndcg_at_k(df: DataFrame, group: str, relevance: str, order: list, k: int) -> DataFrame:
    """(group, ndcg): the first k against the same k in best order; 0 where that is 0."""
    top = df.withColumn("_p", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("_p") <= k)
    both = top.withColumn("_i", F.row_number().over(W.partitionBy(group).orderBy(F.desc(relevance), "_p")))
    sums = both.groupBy(group).agg(F.sum(_gain(relevance, "_p")).alias("a"), F.sum(_gain(relevance, "_i")).alias("b"))
    return sums.select(group, F.when(F.col("b") > 0, F.col("a") / F.col("b")).otherwise(0.0).alias("ndcg"))


def interval_coverage(df: DataFrame, y: str, lo: str, hi: str) -> DataFrame:
    """One row, coverage: the share of rows with lo <= y <= hi; 0 without rows."""
    inside = F.col(y).between(F.col(lo), F.col(hi)).cast("double")
    return df.agg(F.coalesce(F.avg(F.coalesce(inside, F.lit(0.0))), F.lit(0.0)).alias("coverage"))


def exact_quantiles(df: DataFrame, value: str, shares: list[float], ranges: int = 512) -> DataFrame:
    """(share, quantile): exact linear quantiles of the present values, none of them in one task.

    Equal values are counted first. Approximate quantiles, a sketch of bounded size, cut the values into ranges; counts are
    summed within a range and the few totals of the ranges over all, which gives every distinct value its exact places.
    """
    v = F.nanvl(F.col(value).cast("double"), F.lit(None))
    counts = df.select(v.alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("n"))
    cuts = counts.agg(F.percentile_approx("v", [i / ranges for i in range(1, ranges)], 10_000).alias("cuts"))
    ranged = counts.crossJoin(F.broadcast(cuts)).select("v", "n", F.size(F.filter("cuts", lambda c: c < F.col("v"))).alias("r"))  # one row of cuts
    inside = ranged.withColumn("upto", F.sum("n").over(W.partitionBy("r").orderBy("v")))
    totals = ranged.groupBy("r").agg(F.sum("n").alias("t"))
    ahead = totals.withColumn("ahead", F.coalesce(F.sum("t").over(W.orderBy("r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # at most ``ranges`` rows
    whole = F.sum("t").over(W.orderBy("r").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    placed = inside.join(F.broadcast(ahead.withColumn("whole", whole)), "r").select("v", (F.col("ahead") + F.col("upto") - F.col("n")).alias("first"), (F.col("ahead") + F.col("upto") - 1).alias("last"), "whole")
    at = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    rank = F.col("share") * (F.col("whole") - 1)
    near = placed.select("*", at).withColumns({"lo": F.floor(rank), "hi": F.ceil(rank), "part": rank - F.floor(rank)})
    low = F.max(F.when(F.col("lo").between(F.col("first"), F.col("last")), F.col("v")))
    high = F.max(F.when(F.col("hi").between(F.col("first"), F.col("last")), F.col("v")))
    return near.groupBy("share").agg(low.alias("a"), high.alias("b"), F.max("part").alias("part")).select("share", (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("quantile"))


def quantile_bins(df: DataFrame, value: str, n: int = 8) -> DataFrame:
    """Adds ``bin``: right-closed bins at exact linear quantiles, repeated edges dropped; null and NaN go to bin 0."""
    v = F.nanvl(F.col(value).cast("double"), F.lit(None))
    found = exact_quantiles(df, value, [i / n for i in range(n + 1)])
    edges = found.agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("share", "quantile"))), lambda x: x["quantile"])).alias("_e"))
    inner = F.slice("_e", 2, F.greatest(F.size("_e") - 2, F.lit(0)))
    placed = F.size(F.filter(inner, lambda e: e < v))
    # one row of at most n + 1 edges
    return df.crossJoin(F.broadcast(edges)).withColumn("bin", F.coalesce(F.when(v.isNotNull(), placed), F.lit(0)).cast("int")).drop("_e")


def stratified_split(df: DataFrame, key: str, value: str, test_share: float, n: int = 8, seed: int = 0) -> DataFrame:
    """Adds bin and split: in every bin round(n * share) rows, by seeded hash order, are test rows; no bin is ever held by one task."""
    b = quantile_bins(df, value, n)
    sizes = b.groupBy("bin").agg(F.round(F.count("*") * test_share).alias("_k"))
    ordered = b.withColumns({"_o": hash_order(F.col(key), seed=seed), "_one": F.lit(1)})
    placed = running_total(ordered, ["bin"], "_o", "_one", "_p")
    return placed.join(F.broadcast(sizes), "bin").withColumn("split", F.when(F.col("_p") < F.col("_k"), "test").otherwise("train")).drop("_p", "_k", "_o", "_one")


def union_splits(train: DataFrame, test: DataFrame) -> DataFrame:
    """Both frames with a ``split`` column."""
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


def regression_arrays(both: DataFrame, target: str = "target") -> dict[str, DataFrame]:
    """train_X, train_y, test_X and test_y of a frame with ``split``; the features are all other columns."""
    out = {}
    for name in ("train", "test"):
        part = both.where(F.col("split") == name)
        out |= {f"{name}_X": part.drop(target, "split"), f"{name}_y": part.select(target)}
    return out
