"""Packing texts into containers of fixed capacity, neighbours by content first.

Texts are cut into tokens once. A text longer than the capacity fills whole containers with its own pieces; what is
left of it, and every other text, is an item that is never split. Items are laid out by language, source and a hash, and cut
into shards of ``shard_tokens`` tokens, and one text more at most, by exact running totals; one huge source is cut into many shards, and a
seed's neighbours in other shards are not found. Each shard has a BM25 inverted index over token ids with document frequencies of the whole corpus, a vector as long as the fixed
vocabulary. The longest open item of a shard seeds a container; the index returns its unused neighbours, best first,
and those that still fit are put in; the rest of the window is filled with the largest items that fit.

Edge cases: null, empty and blank-only texts without a token are not packed; equal texts are items of their own, and
repeated ids too (told apart by their place in the container); a text of exactly the capacity fills one container;
capacities below 1 and null ones are left out.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch
from ..operators.prefix import hash_order, running_total
from .tokens import encode, encoding

K1, B = 1.2, 0.75
SHARD_TOKENS = 1_000_000
VOCABULARY = 1 << 16


def tokenized(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, lang, source, n, ids BINARY): token ids as 16-bit numbers, 2 bytes each."""

    def run(batches):
        enc = encoding(vocabulary)
        for pdf in batches:
            ids = [np.asarray(encode(t, enc), dtype=np.uint16) if isinstance(t, str) and t else np.zeros(0, np.uint16) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang": pdf["lang"], "source": pdf["source"], "n": [len(x) for x in ids], "ids": [x.tobytes() for x in ids]})

    return docs.select("doc_id", "lang", "source", "text").mapInPandas(run, "doc_id BIGINT, lang STRING, source STRING, n INT, ids BINARY").where("n > 0")


def document_frequencies(tokens: DataFrame) -> tuple[np.ndarray, int, float]:
    """(document frequency by token id, documents, mean length) of the corpus; at most 65,536 rows reach the driver."""

    def run(batches):
        df = np.zeros(VOCABULARY, np.int64)
        for pdf in batches:
            for raw in pdf["ids"]:
                df[np.unique(np.frombuffer(raw, np.uint16))] += 1
        at = np.flatnonzero(df)
        yield pd.DataFrame({"token": at.astype(np.int32), "df": df[at]})

    counts = tokens.select("ids").mapInPandas(run, "token INT, df BIGINT").groupBy("token").agg(F.sum("df").alias("df")).toPandas()
    out = np.zeros(VOCABULARY, np.int64)
    out[counts["token"].to_numpy(dtype=np.int64)] = counts["df"].to_numpy(dtype=np.int64)
    docs, mean = tokens.agg(F.count("*"), F.avg("n")).first()
    return out, docs, float(mean or 1.0)


class Index:
    """BM25 over the items of one shard."""

    def __init__(self, items: list[np.ndarray], df: np.ndarray, docs: int, mean: float):
        self.n = len(items)
        terms, owners, tfs = [], [], []
        for i, ids in enumerate(items):
            t, c = np.unique(ids, return_counts=True)
            terms.append(t)
            owners.append(np.full(len(t), i, np.int32))
            tfs.append(c)
        term = np.concatenate(terms) if terms else np.zeros(0, np.uint16)
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int32)
        tf = np.concatenate(tfs).astype(np.float64) if tfs else np.zeros(0)
        length = np.array([len(x) for x in items], np.float64)
        idf = np.log1p((docs - df + 0.5) / (df + 0.5))
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[owner] / mean))
        order = np.argsort(term, kind="stable")
        self.owner, self.weight = owner[order], weight[order]
        self.start = np.searchsorted(term[order], np.arange(VOCABULARY + 1))

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """BM25 of every item against the terms of ``ids``, from all their posting lists at once."""
        terms = np.unique(ids).astype(np.int64)
        lo = self.start[terms]
        sizes = self.start[terms + 1] - lo
        ends = np.cumsum(sizes)
        at = np.repeat(lo - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
        return np.bincount(self.owner[at], weights=self.weight[at], minlength=self.n)


def best_first(score: np.ndarray, first: int = 64):
    """Items of positive score, best first and ties by number; the few best are found without sorting them all."""
    if len(score) > 4 * first:
        cut = np.partition(score, -first)[-first]
        if cut > 0:
            top = np.flatnonzero(score >= cut)
            yield from top[np.argsort(-score[top], kind="stable")]
            score = np.where(score >= cut, 0, score)
    rest = np.flatnonzero(score > 0)
    yield from rest[np.argsort(-score[rest], kind="stable")]


def pack_shard(sizes: np.ndarray, index: Index, items: list[np.ndarray], capacity: int) -> list[list[int]]:
    """Containers of item numbers; every item is in exactly one, and none is over capacity."""
    open_ = [(int(s), i) for i, s in enumerate(sizes)]
    by_size = sorted(open_)
    used = np.zeros(len(sizes), bool)
    out = []
    for _, seed in sorted(open_, key=lambda x: (-x[0], x[1])):
        if used[seed]:
            continue
        used[seed] = True
        box, room = [seed], capacity - int(sizes[seed])
        by_size.pop(bisect_right(by_size, (int(sizes[seed]), seed)) - 1)
        if room and by_size and by_size[0][0] <= room:
            score = index.scores(items[seed])
            score[used | (sizes > room)] = 0
            for i in best_first(score):
                if not by_size or by_size[0][0] > room:
                    break
                s = int(sizes[i])
                if s <= room:
                    used[i] = True
                    box.append(int(i))
                    room -= s
                    by_size.pop(bisect_right(by_size, (s, int(i))) - 1)
            while by_size and by_size[0][0] <= room:
                s, i = by_size.pop(bisect_right(by_size, (room, len(sizes))) - 1)
                used[i] = True
                box.append(i)
                room -= s
        out.append(box)
    return out


def placed(tokens: DataFrame, scratch: Scratch, seed: int) -> DataFrame:
    """(no, ahead): the tokens that come before each text by language, source and hash."""
    slim = tokens.select("no", "n", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), hash_order(F.col("doc_id"), F.col("no"), seed=seed).alias("_o"))
    inside = running_total(slim, ["lang", "source"], "_o", "n", "inside")
    # the groups, sources by language, are laid one behind the other in hash order
    whole = scratch.put(slim.groupBy("lang", "source").agg(F.sum("n").alias("t")).withColumn("_o", hash_order("lang", "source", seed=seed)))
    before = running_total(whole, [], "_o", "t", "before")
    return inside.join(before.select("lang", "source", "before"), ["lang", "source"]).select("no", (F.col("inside") + F.col("before")).alias("ahead"))


def pack(docs: DataFrame, containers: DataFrame, vocabulary: str, shard_tokens: int = SHARD_TOKENS, seed: int = 42) -> DataFrame:
    """(container_kind, container_id, place, doc_id, piece_no, n_tokens, capacity_tokens) of every text and kind."""
    kinds = [(r["container_kind"], r["capacity_tokens"]) for r in containers.where("capacity_tokens >= 1 AND container_kind IS NOT NULL").distinct().orderBy("container_kind", "capacity_tokens").collect()]
    scratch = Scratch(docs.sparkSession, "pack")
    # a number of its own for each text, fixed by being written: repeated ids are told apart
    tokens = scratch.put(tokenized(docs, vocabulary).withColumn("no", F.monotonically_increasing_id()))
    df, n_docs, mean = document_frequencies(tokens)
    total = tokens.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_tokens))
    laid = tokens.join(placed(tokens, scratch, seed), "no").withColumn("shard", F.floor(F.col("ahead") / shard_tokens).cast("int"))
    laid = laid.repartition(int(shards), "shard").sortWithinPartitions("shard", "no")

    def run(batches):
        now, ids, raw = None, [], []
        for pdf in batches:
            for shard, g in pdf.groupby("shard", sort=False):
                if shard != now and ids:
                    yield from packed(now, ids, raw)
                    ids, raw = [], []
                now = shard
                ids += g["doc_id"].tolist()
                raw += [np.frombuffer(x, np.uint16) for x in g["ids"]]
        if ids:
            yield from packed(now, ids, raw)

    def packed(shard, ids, raw):
        order = sorted(range(len(ids)), key=lambda i: (ids[i] if ids[i] == ids[i] else -1, len(raw[i])))
        for kind, capacity in kinds:
            rows, items, owners = [], [], []
            boxes = 0
            for i in order:
                x = raw[i]
                whole = len(x) // capacity if len(x) > capacity else 0
                for k in range(whole):
                    rows.append((kind, f"{kind}-{shard}-{boxes}", 0, ids[i], k, capacity, capacity))
                    boxes += 1
                if len(x) > whole * capacity:
                    items.append(x[whole * capacity:])
                    owners.append((ids[i], whole))
            sizes = np.array([len(x) for x in items], np.int64)
            for box in pack_shard(sizes, Index(items, df, n_docs, mean), items, capacity):
                rows += [(kind, f"{kind}-{shard}-{boxes}", place, owners[i][0], owners[i][1], int(sizes[i]), capacity) for place, i in enumerate(box)]
                boxes += 1
            yield pd.DataFrame(rows, columns=["container_kind", "container_id", "place", "doc_id", "piece_no", "n_tokens", "capacity_tokens"])

    return laid.select("shard", "doc_id", "ids").mapInPandas(run, "container_kind STRING, container_id STRING, place INT, doc_id BIGINT, piece_no INT, n_tokens INT, capacity_tokens INT")


def fill_report(packed: DataFrame) -> DataFrame:
    """(container_kind, capacity_tokens, n_containers, n_items, n_tokens, fill) of a packing."""
    return packed.groupBy("container_kind", "capacity_tokens").agg(F.count_distinct("container_id").alias("n_containers"), F.count("*").alias("n_items"), F.sum("n_tokens").alias("n_tokens")).withColumn("fill", F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")))
