"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Each source's documents are laid end to end in a seeded order and cut into blocks of equal tokens. A mix is as large as
its targets and repeats allow: the smallest, over its sources, of available tokens times allowed repeats over share. Its
blocks are given to the sources by highest quotients, share / (2 k + 1), a source's blocks to its shards the same way by
the blocks the shards hold, and every shard takes its quota in seeded order, whole rounds first where blocks repeat.

Edge cases: documents without source, without a token or with a source outside the mix take no part; a target without
any document keeps its row in the report with a share of 0 and the others keep their proportions; shares and repeats
below or at 0 and null ones count as no target; a mix without any usable source is empty; a document longer than a
block is never cut, it belongs to the block it begins in, and the report's shares count it whole.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch
from ..operators.prefix import hash_order, running_total
from .tokens import counted

BLOCK_TOKENS = 512
SHARDS = 64


def sainte_lague(weights: dict, seats: int) -> dict:
    """Seats by highest quotients w / (2 k + 1); ties go to the smaller name."""
    total = sum(w for w in weights.values() if w > 0)
    live = {k: w for k, w in weights.items() if w > 0}
    out = dict.fromkeys(weights, 0)
    if not total or seats <= 0:
        return out
    # all but a few seats a name are certain: no name gets fewer than its exact share less one
    for k, w in live.items():
        out[k] = max(0, int(seats * w / total) - 1)
    heap = [(-w / (2 * out[k] + 1), str(k), k) for k, w in live.items()]
    heapq.heapify(heap)
    for _ in range(seats - sum(out.values())):
        _, name, k = heap[0]
        out[k] += 1
        heapq.heapreplace(heap, (-live[k] / (2 * out[k] + 1), name, k))
    return out


def shard_quotas(blocks: list[int], quota: int, repeats: int) -> list[int]:
    """Quota of each shard, by the blocks it holds and never above ``repeats`` times them."""
    top = [b * repeats for b in blocks]
    quota = min(quota, sum(top))
    given = sainte_lague(dict(enumerate(blocks)), quota)
    out = [min(given[i], top[i]) for i in range(len(blocks))]
    rest = quota - sum(out)
    for i in sorted(range(len(blocks)), key=lambda i: (out[i] - top[i], i)):
        extra = min(rest, top[i] - out[i])
        out[i] += extra
        rest -= extra
    return out


def laid_out(docs: DataFrame, vocabulary: str, block_tokens: int, seed: int, scratch: Scratch) -> DataFrame:
    """(doc_id, source, n_tokens, block): documents by source, in seeded order, cut into blocks."""
    # written once, as the running total reads it twice
    sized = scratch.put(counted(docs.where("source IS NOT NULL"), ["doc_id", "source"], "text", vocabulary).where("n_tokens > 0"))
    o = running_total(sized.withColumn("_o", hash_order("doc_id", "source", seed=seed)), ["source"], "_o", "n_tokens")
    return o.select("doc_id", "source", "n_tokens", F.floor(F.col("before") / block_tokens).alias("block"))


def _cut(blocks: DataFrame, need: str, times: str, seed: int) -> DataFrame:
    """Adds ``times``: 1 for the blocks of a stratum, in seeded order, whose middle comes before ``need`` tokens."""
    keys = ["mix_name", "source", "shard"]
    run = running_total(blocks.withColumn("_o", hash_order("source", "block", seed=seed)), keys, "_o", "t", "ahead", 64)
    return run.withColumn(times, (F.col("ahead") + F.col("t") / 2 <= F.col(need)).cast("int")).drop("_o", "ahead")


def mix(docs: DataFrame, targets: DataFrame, vocabulary: str, block_tokens: int = BLOCK_TOKENS, seed: int = 42) -> DataFrame:
    """(mix_name, source, doc_id, repeat_no, n_tokens) of every document drawn; repeat_no counts from 1."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    laid = scratch.put(laid_out(docs, vocabulary, block_tokens, seed, scratch))
    wanted = targets.where("target_share > 0 AND max_repeats >= 1 AND source IS NOT NULL AND mix_name IS NOT NULL").collect()
    names = sorted({r["source"] for r in wanted})
    blocks = laid.where(F.col("source").isin(names)).groupBy("source", "block").agg(F.sum("n_tokens").alias("t"))
    # one row for each source with a target, then one for each of their shards, reaches the driver
    whole = {r["source"]: r["t"] for r in blocks.groupBy("source").agg(F.sum("t").alias("t")).collect()}
    shards = F.create_map(*[F.lit(x) for s in names for x in (s, max(1, min(SHARDS, whole.get(s, 0) // (256 * block_tokens))))]) if names else None
    if shards is None:
        return laid.select(F.lit("").alias("mix_name"), "source", "doc_id", F.lit(1).alias("repeat_no"), "n_tokens").limit(0)
    blocks = scratch.put(blocks.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "source", "block"), F.element_at(shards, F.col("source"))).cast("int")))
    held: dict[str, dict[int, tuple[int, int]]] = {}
    for r in blocks.groupBy("source", "shard").agg(F.sum("t").alias("t"), F.sum(F.when(F.col("t") > 2 * block_tokens, F.col("t")).otherwise(0)).alias("big")).collect():
        held.setdefault(r["source"], {})[r["shard"]] = (r["t"], r["big"])
    quotas = []
    for name in sorted({r["mix_name"] for r in wanted}):
        rows = {r["source"]: r for r in wanted if r["mix_name"] == name and r["source"] in held}
        if not rows:
            continue
        share = sum(r["target_share"] for r in rows.values())
        size = min(whole[s] * r["max_repeats"] / (r["target_share"] / share) for s, r in rows.items())
        seats = sainte_lague({s: r["target_share"] / share for s, r in rows.items()}, int(size // block_tokens))
        for s, r in rows.items():
            at = sorted(held[s])
            for shard, q in zip(at, shard_quotas([max(1, held[s][k][0] // block_tokens) for k in at], seats[s], r["max_repeats"])):
                t, big = held[s][shard]
                rounds = min(q * block_tokens // t, r["max_repeats"])
                rest = float(q * block_tokens - rounds * t) if rounds < r["max_repeats"] else 0.0
                quotas.append((name, s, shard, int(rounds), rest, rest * big / t))
    # at most SHARDS rows for each target
    q = F.broadcast(spark.createDataFrame(quotas, "mix_name STRING, source STRING, shard INT, rounds INT, rest DOUBLE, rest_big DOUBLE"))
    offered = blocks.join(q, ["source", "shard"])
    # blocks that begin with a long document are cut first, the even ones then fill exactly what is left of the quota
    big = _cut(offered.where(F.col("t") > 2 * block_tokens), "rest_big", "more", seed + 1)
    got = big.where("more = 1").groupBy("mix_name", "source", "shard").agg(F.sum("t").alias("got"))
    even = offered.where(F.col("t") <= 2 * block_tokens).join(got, ["mix_name", "source", "shard"], "left").withColumn("rest_even", F.col("rest") - F.coalesce("got", F.lit(0)))
    even = _cut(even, "rest_even", "more", seed + 2)
    cols = ["mix_name", "source", "block", (F.col("rounds") + F.col("more")).alias("times")]
    taken = big.select(*cols).unionByName(even.select(*cols)).where("times > 0")
    drawn = laid.join(taken, ["source", "block"])
    return drawn.select("mix_name", "source", "doc_id", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("repeat_no"), "n_tokens")


def mix_report(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_name, source, target_share, actual_share, n_tokens, n_documents, most_repeats, max_repeats) of each target."""
    per = drawn.groupBy("mix_name", "source").agg(F.sum("n_tokens").alias("n_tokens"), F.count_distinct("doc_id").alias("n_documents"), F.max("repeat_no").alias("most_repeats"))
    whole = per.groupBy("mix_name").agg(F.sum("n_tokens").alias("whole"))
    t = targets.select("mix_name", "source", "target_share", "max_repeats")
    out = t.join(per, ["mix_name", "source"], "left").join(whole, "mix_name", "left")
    tokens = F.coalesce("n_tokens", F.lit(0))
    return out.select("mix_name", "source", "target_share", F.coalesce(tokens / F.col("whole"), F.lit(0.0)).alias("actual_share"), tokens.alias("n_tokens"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), "max_repeats")
