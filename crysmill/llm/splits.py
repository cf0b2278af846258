"""Splits that keep tied records together.

Records that share a key (author, source, fingerprint, composition ...) are tied, and ties carry over. The operator
keeps a *component table* on disk: every key and record it has ever seen with the component it belongs to, and every
component with its split. A new batch looks its keys up, merges components by hooking and pointer jumping, lets existing
components keep their split, fills the splits' deficits with new components, and quarantines a merge of components
that already sit in different splits.

Edge cases: null or placeholder keys tie nothing; a record without keys is its own component; an empty batch leaves the
table as it is; repeated rows (same id) are one record; columns named like the operator's own are not touched, as only
the id and the keys are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formula import composition_key_udf
from ..runtime import Scratch, delete, read_bytes, write_bytes
from ..operators.prefix import hash_order, running_total

QUARANTINE = "quarantine"
# Texts that stand for a missing key.
PLACEHOLDERS = ("", "-", "--", "?", ".", "0", "n/a", "na", "nan", "nil", "none", "null", "tbd", "unknown", "missing", "not available", "undefined")


def fingerprint_key(c: Column) -> Column:
    """Fingerprint by meaning: no scheme prefix, blanks, dashes or letter case; null for placeholders, all-zero and
    other one-character fillings among them."""
    plain = F.lower(F.regexp_replace(c, r"\s", ""))
    bare = F.regexp_replace(F.regexp_replace(plain, r"^(fp|sfp|fingerprint)[:=]", ""), r"[-_:]", "")
    return F.when(~plain.isin(*PLACEHOLDERS) & bare.rlike("^[0-9a-z]+$") & bare.rlike("[0-9]") & ~bare.rlike(r"^(.)\1*$"), bare)


def immutable_key(c: Column) -> Column:
    """Immutable id by meaning: separators, blanks and letter case don't count; null for placeholders, all-zero
    and other one-digit numbers among them."""
    plain = F.lower(F.regexp_replace(c, r"\s", ""))
    bare = F.regexp_replace(plain, r"[^0-9a-z]", "")
    return F.when(~plain.isin(*PLACEHOLDERS) & bare.rlike("[0-9]") & ~bare.rlike(r"^[a-z]*(0+|([0-9])\2{5,})$"), bare)


def material_keys(df: DataFrame, id_col: str = "row_no") -> DataFrame:
    """(id, keys ARRAY<STRING>) of records like those of lemat_bulk_sample."""
    keys = F.array_compact(F.array(
        F.concat(F.lit("f:"), fingerprint_key(F.col("structure_fingerprint"))),
        F.concat(F.lit("i:"), immutable_key(F.col("immutable_id"))),
        F.concat(F.lit("c:"), F.col("_comp")),
    ))
    comp = df.select(F.col(id_col).alias("id"), "structure_fingerprint", "immutable_id", composition_key_udf("formula").alias("_comp"))
    return comp.select("id", keys.alias("keys"))


def connected(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every node in ``edges`` (a BIGINT, b BIGINT); root is the smallest node of the component.

    Each round hooks every node to its smallest neighbour, jumps pointers until all point at a root, and contracts the
    edges to roots; edges inside a root vanish. A round at least halves the nodes left, and no adjacency list is built:
    the only aggregate is a map-side combined min.
    """
    maps: list[DataFrame] = []
    live, n = scratch.put_counting(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), F.lit(True))
    while n:
        both = live.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(live.select(F.col("b").alias("node"), F.col("a").alias("near")))
        up = scratch.put(both.groupBy("node").agg(F.least(F.col("node"), F.min("near")).alias("root")))
        while True:
            parent = up.select(F.col("node").alias("root"), F.col("root").alias("next")).where("root <> next")
            step = up.join(parent, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
            jumped, moved = scratch.put_counting(step, F.col("moved"))
            scratch.drop(up)
            up = jumped
            if not moved:
                break
        up = up.select("node", "root")
        maps.append(up)
        a = up.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = up.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        rest = live.join(a, "a").join(b, "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).where("a <> b").distinct()
        nxt, n = scratch.put_counting(rest, F.lit(True))
        scratch.drop(live)
        live = nxt
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    whole = maps[0]
    for later in maps[1:]:
        step = later.select(F.col("node").alias("root"), F.col("root").alias("next"))
        whole = whole.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return whole


def components(rows: DataFrame, scratch: Scratch, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((id, root) of every row, (key, root) of every key) for rows (id BIGINT, keys ARRAY<STRING>).

    A key's node is the smallest id that names it, or its component in ``known`` (key, component_id). So nodes are
    BIGINT, one row's keys share most nodes already, and only rows whose keys disagree give edges.
    """
    rows = rows.where("id IS NOT NULL")
    # written once, as reading keys out of spellings costs more than all that follows
    every = scratch.put(rows.select("id", F.explode_outer("keys").alias("key")))
    pairs = every.where("key IS NOT NULL")
    first = pairs.groupBy("key").agg(F.min("id").alias("node"))
    if known is not None:
        old = known.select("key", F.col("component_id").alias("old"))
        first = first.join(old, "key", "left").select("key", F.coalesce("old", "node").alias("node"))
    first = scratch.put(first)
    # a hot key is one row here and its many rows are split by the skew join
    named = pairs.join(first, "key").select("id", "node")
    loose = every.where("key IS NULL").select("id", F.lit(None).cast("bigint").alias("node"))
    named = named.unionByName(loose).groupBy("id").agg(F.coalesce(F.min("node"), "id").alias("rep"), F.max("node").alias("last"), F.collect_set("node").alias("nodes"))
    named = scratch.put(named.select("id", "rep", F.when(F.col("rep") != F.col("last"), F.col("nodes")).alias("nodes")))
    edges = named.where("nodes IS NOT NULL").select(F.col("rep").alias("a"), F.explode("nodes").alias("b"))
    roots = scratch.put(connected(edges, scratch))
    to = roots.select(F.col("node").alias("rep"), "root")
    tied = named.select("id", "rep").join(to, "rep", "left").select("id", F.coalesce("root", "rep").alias("root"))
    keys = first.join(roots, "node", "left").select("key", F.coalesce("root", "node").alias("root"))
    return tied, keys


def fill_deficits(sizes: DataFrame, targets: list[tuple[str, float]], held: dict[str, int], scratch: Scratch, seed: int = 42) -> DataFrame:
    """(component_id, split) for new components (component_id, n), so that the splits come close to their targets.

    Components above 1/1000 of all rows (fewer than 1,000 of them, whatever the input's size) are given out largest
    first, each to the split that lacks most. The others are laid end to end in hash order; each split takes the
    stretch that its remaining deficit is of the whole.
    """
    total_new = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    total = total_new + sum(held.values())
    lack = {s: share * total - held.get(s, 0) for s, share in targets}
    big_at = max(1, total // 1000)
    spark = sizes.sparkSession
    big = []
    for r in sizes.where(F.col("n") > big_at).orderBy(F.desc("n"), "component_id").collect():
        split = max(lack, key=lambda s: (lack[s], s))
        lack[split] -= r["n"]
        big.append((r["component_id"], split))
    given = spark.createDataFrame(big, "component_id BIGINT, split STRING")
    small = sizes.where(F.col("n") <= big_at)
    room = {s: max(0.0, v) for s, v in lack.items()}
    left = sum(room.values()) or 1.0
    span = small.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ordered = small.select("component_id", "n", F.lit(0).alias("_g"), hash_order(F.col("component_id"), seed=seed).alias("_o"))
    placed = running_total(ordered, ["_g"], "_o", "n")
    edge, pick = 0.0, None
    names = [s for s, _ in targets]
    for s in names[:-1]:
        edge += room[s] / left * span
        cond = F.col("before") < F.lit(edge)
        pick = F.when(cond, F.lit(s)) if pick is None else pick.when(cond, F.lit(s))
    pick = F.lit(names[-1]) if pick is None else pick.otherwise(F.lit(names[-1]))
    return given.unionByName(placed.select("component_id", pick.alias("split")))


class SplitTable:
    """The persisted component table under ``path``.

    ``keys`` and ``rows`` hold, for each batch, the component that a key or record was given when it was first seen, and
    are only added to. ``components`` has every component ever given with the one it points to now (itself, or what it was
    merged into), the split, and for those that point to themselves the number of records and earlier splits; a merge only
    moves these pointers. A file names the last version; it is written last, so a batch that dies half-way leaves the
    table as it was, and a table opened again goes on from it.
    """

    def __init__(self, spark: SparkSession, path: str, targets: list[tuple[str, float]], seed: int = 42):
        if not targets or abs(sum(s for _, s in targets) - 1) > 1e-6:
            raise ValueError("the targets' shares must add up to 1")
        self.spark, self.path, self.targets, self.seed = spark, path.rstrip("/"), targets, seed
        self.version = int(read_bytes(spark, f"{self.path}/CURRENT") or 0)

    def _batches(self, name: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{name}/b{k}" for k in range(1, self.version + 1)])

    def components(self) -> DataFrame | None:
        """(component_id, root, split, n, was) after the last batch."""
        return self.spark.read.parquet(f"{self.path}/components/v{self.version}") if self.version else None

    def keys(self) -> DataFrame | None:
        """(key, component_id) as they stand after the last batch."""
        if not self.version:
            return None
        return self._batches("keys").join(self.components().select("component_id", "root"), "component_id").select("key", F.col("root").alias("component_id"))

    def add(self, rows: DataFrame) -> DataFrame:
        """Takes a batch (id BIGINT, keys ARRAY<STRING>); gives (id, component_id, split) of its records.

        A component that was split before keeps its split. Components of different splits that the batch ties are merged
        and set to ``quarantine``, with their old splits in the table's ``was`` column, so no tie ever runs between two
        splits. ids must not repeat between batches. Records of earlier batches may change their split by that: ``present``
        gives all of them, and what ``add`` gave before is superseded.
        """
        scratch = Scratch(self.spark, "splits")
        none = F.array().cast("array<string>")
        old, known = self.components(), self.keys()
        known = None if known is None else scratch.put(known)
        ids, keys = components(rows, scratch, known)
        ids = scratch.put(ids)
        counts = ids.groupBy(F.col("root").alias("component_id")).agg(F.count("*").alias("n"))
        if old is None:
            sizes = scratch.put(counts)
            new = fill_deficits(sizes, self.targets, {}, scratch, self.seed)
            roots = sizes.join(new, "component_id").select("component_id", "split", "n", none.alias("was"))
            comps = roots.select("component_id", F.col("component_id").alias("root"), "split", "n", "was")
            fresh = keys
        else:
            # what an earlier component points to now, by the keys that name it
            touched = scratch.put(keys.join(known.select("key", F.col("component_id").alias("prior")), "key").select("prior", F.col("root").alias("now")).distinct())
            moved = old.where("component_id = root").join(touched, F.col("component_id") == F.col("prior"), "left").select(F.coalesce("now", "component_id").alias("component_id"), "split", "n", "was")
            merged = moved.groupBy("component_id").agg(F.collect_set("split").alias("splits"), F.sum("n").alias("m"), F.array_distinct(F.flatten(F.collect_set("was"))).alias("earlier"))
            state = scratch.put(counts.join(merged, "component_id", "full").select(
                "component_id", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"),
                F.when(F.size("splits") == 1, F.col("splits")[0]).when(F.size("splits") > 1, F.lit(QUARANTINE)).alias("split"),
                F.when(F.size("splits") > 1, F.array_remove(F.array_distinct(F.concat("splits", "earlier")), QUARANTINE)).otherwise(F.coalesce("earlier", none)).alias("was")))
            held = {r["split"]: r["n"] for r in state.where("split IS NOT NULL").groupBy("split").agg(F.sum("n").alias("n")).collect() if r["split"] != QUARANTINE}
            new = fill_deficits(state.where("split IS NULL").select("component_id", "n"), self.targets, held, scratch, self.seed)
            roots = scratch.put(state.join(new.withColumnRenamed("split", "given"), "component_id", "left").select("component_id", F.coalesce("split", "given").alias("split"), "n", "was"))
            pointers = old.select("component_id", "root").join(touched, F.col("root") == F.col("prior"), "left").select("component_id", F.coalesce("now", "root").alias("root")).where("component_id <> root")
            pointed = pointers.join(roots.select(F.col("component_id").alias("root"), "split"), "root").select("component_id", "root", "split", F.lit(None).cast("bigint").alias("n"), none.alias("was"))
            comps = roots.select("component_id", F.col("component_id").alias("root"), "split", "n", "was").unionByName(pointed)
            fresh = keys.join(known, "key", "left_anti")
        v = self.version + 1
        comps.write.mode("overwrite").parquet(f"{self.path}/components/v{v}")
        fresh.select("key", F.col("root").alias("component_id")).write.mode("overwrite").parquet(f"{self.path}/keys/b{v}")
        ids.select("id", F.col("root").alias("component_id")).write.mode("overwrite").parquet(f"{self.path}/rows/b{v}")
        write_bytes(self.spark, f"{self.path}/CURRENT", str(v).encode())
        self.version = v
        if v > 2:
            delete(self.spark, f"{self.path}/components/v{v - 2}")
        scratch.close()
        return self._split_rows(v)

    def _split_rows(self, batch: int) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/rows/b{batch}")
        return rows.join(self.components().select("component_id", "root", "split"), "component_id").select("id", F.col("root").alias("component_id"), "split")

    def present(self) -> DataFrame:
        """(id, component_id, split, batch) of the records of all batches as they stand after the last one."""
        if not self.version:
            return self.spark.createDataFrame([], "id BIGINT, component_id BIGINT, split STRING, batch INT")
        rows = reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.path}/rows/b{k}").withColumn("batch", F.lit(k)) for k in range(1, self.version + 1)])
        return rows.join(self.components().select("component_id", "root", "split"), "component_id").select("id", F.col("root").alias("component_id"), "split", "batch")


def read_targets(df: DataFrame) -> list[tuple[str, float]]:
    """Splits and shares of a small fixed table, at most 100 rows."""
    rows = df.select("split_name", "target_share").where("split_name IS NOT NULL AND target_share > 0").orderBy(F.desc("target_share"), "split_name").limit(101).collect()
    if not rows or len(rows) > 100:
        raise ValueError("1 to 100 splits are needed")
    whole = sum(r["target_share"] for r in rows)
    return [(r["split_name"], r["target_share"] / whole) for r in rows]


