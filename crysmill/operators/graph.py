"""Periodic neighbour graphs of crystal structures, one structure a row, without any global join.

Candidates (source, target, image) are generated inside the row with a bound on images for each axis, so a shuffle only
happens for the window that ranks the neighbours of one site. All lattice algebra is Column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.elements import ELECTRONEGATIVITY, NUMBER, RADIUS, group_of
from ..functions.lattice import at, inverse, volume
from ..runtime import Scratch
from .normalize import cell_density, structure_faults

TOLERANCE = 1e-5
SHELL_GAP = 0.1


def _per_angstrom(m: Column, axis: int) -> Column:
    """Fractional units along an axis for each angstrom across its planes: the length of a column of the inverse."""
    inv = inverse(m)
    return F.sqrt(sum((at(inv, i, axis) * at(inv, i, axis) for i in range(1, 3)), at(inv, 0, axis) * at(inv, 0, axis)))


def candidates(structures: DataFrame, key: str, cutoff: float) -> DataFrame:
    """(key, src, dst, ia, ib, ic, dx, dy, dz, dist) of all pairs with 1e-5 < dist <= cutoff.

    Along each axis only images whose planes are within the cutoff are generated, for each pair of sites on its own, so
    skewed and flat cells get as many images as they need and no more.
    """
    ok = structures.where(F.coalesce(F.size(structure_faults(F.col("structure"))) == 0, F.lit(False)))
    m = F.col("structure.lattice")
    flat = {f"m{i}{k}": at(m, i, k) for i in range(3) for k in range(3)}
    s = ok.select(F.col(key).alias("key"), F.col("structure.coords").alias("x"), *[v.alias(n) for n, v in flat.items()], *[(F.lit(cutoff + TOLERANCE) * _per_angstrom(m, a)).alias(f"h{a}") for a in range(3)])
    shape = [*flat, "h0", "h1", "h2"]
    # written once: the matrix expressions would otherwise be copied into every filter the optimizer infers below
    s = Scratch(structures.sparkSession, "cells").put(s)
    one = s.select("key", *shape, "x", F.posexplode("x").alias("src", "f"))
    two = one.select("key", *shape, "src", "f", F.posexplode("x").alias("dst", "g"))
    pair = two.select("key", *shape, "src", "dst", *[(F.get("g", a) - F.get("f", a)).alias(f"d{a}") for a in range(3)])
    for a, n in enumerate(("ia", "ib", "ic")):
        lo, hi = F.ceil(-F.col(f"h{a}") - F.col(f"d{a}")).cast("int"), F.floor(F.col(f"h{a}") - F.col(f"d{a}")).cast("int")
        pair = pair.select("*", F.explode(F.when(lo <= hi, F.sequence(lo, hi))).alias(n))
    step = [F.col(f"d{a}") + F.col(n) for a, n in enumerate(("ia", "ib", "ic"))]
    cart = {n: step[0] * F.col(f"m0{k}") + step[1] * F.col(f"m1{k}") + step[2] * F.col(f"m2{k}") for k, n in enumerate(("dx", "dy", "dz"))}
    placed = pair.withColumns(cart).withColumn("dist", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")))
    return placed.where((F.col("dist") > TOLERANCE) & (F.col("dist") <= cutoff)).select("key", "src", "dst", "ia", "ib", "ic", "dx", "dy", "dz", "dist")


def nearest(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest of every source and all tied with the last of them; ``truncated`` tells if any was left out."""
    site = W.partitionBy("key", "src")
    ranked = pairs.withColumn("rn", F.row_number().over(site.orderBy("dist", "dst", "ia", "ib", "ic")))
    limit = F.max(F.when(F.col("rn") == k, F.col("dist"))).over(site)
    inside = F.coalesce(F.col("dist") <= limit + TOLERANCE, F.lit(True))
    told = ranked.withColumns({"_in": inside}).withColumn("truncated", F.max(~F.col("_in")).over(site))
    return told.where("_in").drop("rn", "_in")


def closed(edges: DataFrame) -> DataFrame:
    """Adds the reverse of every edge that lacks one, with ``added`` true."""
    e = edges.select("key", "src", "dst", "ia", "ib", "ic", "dx", "dy", "dz", "dist", F.lit(0).alias("_new"))
    back = e.select("key", F.col("dst").alias("src"), F.col("src").alias("dst"), (-F.col("ia")).alias("ia"), (-F.col("ib")).alias("ib"), (-F.col("ic")).alias("ic"), (-F.col("dx")).alias("dx"), (-F.col("dy")).alias("dy"), (-F.col("dz")).alias("dz"), "dist", F.lit(1).alias("_new"))
    both = e.unionByName(back).groupBy("key", "src", "dst", "ia", "ib", "ic").agg(*[F.min_by(c, "_new").alias(c) for c in ("dx", "dy", "dz", "dist")], (F.min("_new") == 1).alias("added"))
    return both


def edges(structures: DataFrame, key: str = "material_id", cutoff: float = 5.0, k: int = 12) -> DataFrame:
    """(key, src, dst, ia, ib, ic, dx, dy, dz, dist, added) of each structure's reciprocal neighbour graph."""
    if cutoff <= 0 or k < 1:
        raise ValueError("cutoff must be positive and k at least 1")
    return closed(nearest(candidates(structures, key, cutoff), k)).withColumnRenamed("key", key)


def numbered(e: DataFrame, key: str = "material_id") -> DataFrame:
    """Adds edge_no from 0 in the order of a structure's edges: source, distance (to 1e-6, so that equal ones are ties), target, image."""
    return e.withColumn("edge_no", F.row_number().over(W.partitionBy(key).orderBy("src", F.round("dist", 6), "dst", "ia", "ib", "ic")) - 1)


def builder_info(cutoff: float = 5.0, k: int = 12) -> dict:
    """How a graph is made: k is a soft target, as a shell of tied distances is never cut."""
    return {"cutoff_radius": cutoff, "max_neighbors": k, "max_neighbors_is_soft": True, "tied_shells": "kept whole", "tolerance": TOLERANCE}


def truncated_sources(structures: DataFrame, key: str = "material_id", cutoff: float = 5.0, k: int = 12) -> DataFrame:
    return nearest(candidates(structures, key, cutoff), k).where("truncated").groupBy(F.col("key").alias(key)).agg(F.array_sort(F.collect_set("src")).alias("truncated_sources"))


def one_way(e: DataFrame, key: str = "material_id") -> DataFrame:
    """Edges without a reverse."""
    back = e.select(key, F.col("dst").alias("src"), F.col("src").alias("dst"), (-F.col("ia")).alias("ia"), (-F.col("ib")).alias("ib"), (-F.col("ic")).alias("ic"))
    return e.join(back, [key, "src", "dst", "ia", "ib", "ic"], "left_anti")


def coordination(e: DataFrame, key: str = "material_id") -> DataFrame:
    """(key, src, coordination): edges within the first distance plus 0.1."""
    first = W.partitionBy(key, "src")
    return e.withColumn("_d", F.min("dist").over(first)).groupBy(key, "src").agg(F.count_if(F.col("dist") <= F.col("_d") + SHELL_GAP).alias("coordination"))


def shells(e: DataFrame, key: str = "material_id", value: str = "dist") -> DataFrame:
    """(key, shell_no, mean_distance, n): a shell ends where the next distance is more than 0.1 away."""
    w = W.partitionBy(key).orderBy(value)
    cut = F.coalesce((F.col(value) - F.lag(value).over(w) > SHELL_GAP).cast("int"), F.lit(0))
    numbered = e.withColumn("_cut", cut).withColumn("shell_no", F.sum("_cut").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(key, "shell_no").agg(F.avg(value).alias("mean_distance"), F.count("*").alias("n"))


FEATURE_LABELS = (*(f"Z_{z}" for z in range(1, 101)), "electronegativity", "atomic_radius", "group")


def nodes(structures: DataFrame, key: str = "material_id") -> DataFrame:
    """(key, idx, species, atomic_number, electronegativity, atomic_radius, group) of every site; unknown symbols and missing values give 0."""
    lookup = lambda table: F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    s = structures.select(key, F.posexplode("structure.species").alias("idx", "species"))
    value = lambda t, zero=0.0: F.coalesce(F.try_element_at(lookup(t), F.col("species")), F.lit(zero))
    return s.select(key, "idx", "species", value(NUMBER, 0).alias("atomic_number"), value(ELECTRONEGATIVITY).alias("electronegativity"), value(RADIUS).alias("atomic_radius"), value({x: group_of(x) for x in NUMBER}, 0).alias("group"))


def node_features(structures: DataFrame, key: str = "material_id") -> DataFrame:
    """(key, idx, features ARRAY<DOUBLE>): the 103 values of FEATURE_LABELS of every site."""
    rest = F.array(F.col("electronegativity"), F.col("atomic_radius"), F.col("group").cast("double"))
    return nodes(structures, key).select(key, "idx", F.concat(one_hot(F.col("atomic_number")), rest).alias("features"))


def covalent_radius(structures: DataFrame, key: str = "material_id") -> DataFrame:
    """(key, idx, radius) of every site, 0 where none is known."""
    return nodes(structures, key).select(key, "idx", F.col("atomic_radius").alias("radius"))


def one_hot(number: Column, width: int = 100) -> Column:
    """Atomic number as a one-hot vector, capped at its width."""
    return F.transform(F.sequence(F.lit(1), F.lit(width)), lambda z: F.when(z == F.least(number, F.lit(width)), 1.0).otherwise(0.0))


def global_features(structures: DataFrame, key: str = "material_id") -> DataFrame:
    """(key, density, n_sites, volume, space_group, space_group_status); the group needs a symmetry library."""
    return structures.select(key, cell_density(F.col("structure.lattice"), F.col("structure.species")).alias("density"), F.size("structure.species").alias("n_sites"), volume(F.col("structure.lattice")).alias("volume"), F.lit(None).cast("int").alias("space_group"), F.lit("unknown").alias("space_group_status"))


def displacement_error() -> Column:
    """How far an edge's distance is from the length of its displacement."""
    return F.abs(F.col("dist") - F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")))


def summary(structures: DataFrame, key: str = "material_id", cutoff: float = 5.0, k: int = 12, max_edges: int = 256) -> DataFrame:
    """One row a structure: nodes, its first ``max_edges`` edges, shells, coordination, global features, validation and warnings.

    Records without a valid structure have no edges and the state ``excluded``.
    """
    ranked = numbered(edges(structures, key, cutoff, k), key)
    # written once, as six aggregates read it; a structure's edges are bounded by its sites and k
    e = Scratch(structures.sparkSession, "summary").put(ranked)
    per = e.groupBy(key).agg(
        F.count("*").alias("edge_count"), F.count_if(F.col("added")).alias("added_edges"), F.count_if(F.col("dist") <= 1e-8).alias("zero_distances"), F.min("dist").alias("shortest"),
        (F.max(displacement_error()) <= 1e-8).alias("displacement_consistent"),
        F.array_sort(F.collect_list(F.when(F.col("edge_no") < max_edges, F.struct("edge_no", F.col("src").alias("source"), F.col("dst").alias("target"), F.col("dist").alias("distance"), F.array("ia", "ib", "ic").alias("image"), F.array("dx", "dy", "dz").alias("displacement_cartesian"))))).alias("edges"))
    lone = one_way(e, key).groupBy(key).agg(F.count("*").alias("one_way_edges"))
    mean = coordination(e, key).groupBy(key).agg(F.avg("coordination").alias("mean_coordination"), F.transform(F.array_sort(F.collect_list(F.struct("src", "coordination"))), lambda x: x["coordination"]).alias("coordination_numbers"))
    rings = shells(e, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("shell_no", "mean_distance", "n"))).alias("distance_shells"))
    cut = truncated_sources(structures, key, cutoff, k)
    cell = F.col("structure.lattice")
    place = lambda f: F.array(*[sum((F.get(f, i) * at(cell, i, j) for i in range(1, 3)), F.get(f, 0) * at(cell, 0, j)) for j in range(3)])
    sites = F.transform(F.arrays_zip(F.col("structure.species").alias("species"), F.col("structure.coords").alias("coords")), lambda p, i: F.struct(i.alias("index"), p["species"].alias("species"), p["coords"].alias("fractional_coordinates"), place(p["coords"]).alias("cartesian_coordinates")))
    base = global_features(structures, key).join(structures.select(key, F.when(F.size(structure_faults(F.col("structure"))) == 0, sites).alias("nodes"), cell.alias("lattice_vectors")), key)
    out = base.join(per, key, "left").join(lone, key, "left").join(mean, key, "left").join(rings, key, "left").join(cut, key, "left")
    one_ways, truncated = F.coalesce("one_way_edges", F.lit(0)), F.coalesce(F.size("truncated_sources"), F.lit(0)) > 0
    capped = F.coalesce(F.col("edge_count") > max_edges, F.lit(False))
    warnings = F.array_compact(F.array(
        F.when(one_ways > 0, "graph is not reciprocal"), F.when(F.col("zero_distances") > 0, F.concat(F.col("zero_distances").cast("string"), F.lit(" edges of no length"))),
        F.when(truncated, "neighbour lists were cut after a whole shell"), F.when(capped, F.concat(F.lit(f"only the first {max_edges} edges are shown")))))
    good = (one_ways == 0) & (F.coalesce("zero_distances", F.lit(0)) == 0) & F.coalesce("displacement_consistent", F.lit(True))
    state = F.when(F.col("nodes").isNull(), "excluded").when(good, "valid").otherwise("invalid")
    return out.select(
        key, "n_sites", "density", "volume", "nodes", "lattice_vectors", "edges", "edge_count", capped.alias("edges_truncated"), F.coalesce("added_edges", F.lit(0)).alias("added_edges"), F.coalesce("zero_distances", F.lit(0)).alias("zero_distances"),
        one_ways.alias("one_way_edges"), F.coalesce("displacement_consistent", F.lit(True)).alias("displacement_consistent"), "shortest", "mean_coordination", "coordination_numbers", "distance_shells", F.coalesce("truncated_sources", F.array().cast("array<int>")).alias("truncated_sources"),
        F.array(F.coalesce("n_sites", F.lit(0)), F.lit(len(FEATURE_LABELS))).alias("node_feature_shape"), F.array(F.coalesce("edge_count", F.lit(0)).cast("int"), F.lit(1)).alias("edge_feature_shape"), "space_group_status", state.alias("state"), warnings.alias("warnings"))
