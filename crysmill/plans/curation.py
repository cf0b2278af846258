"""A curated snapshot of a bulk table: predicate, validity, first of each fingerprint, best of each chemistry, manifest."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.dataset import present
from ..operators.normalize import max_force, structure_faults
from ..sources.readers import canonical_lines


def chemistry() -> F.Column:
    has = lambda e: F.array_contains("elements", e)
    return F.when(has("N") & has("Ti") & has("Al"), "Ti-Al-N").when(has("N") & has("Ti"), "Ti-N").when(has("N") & has("Al"), "Al-N")


def valid_forces(forces: F.Column, n_sites: F.Column) -> F.Column:
    """One finite vector of three for each site."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(forces) == n_sites) & F.forall(forces, lambda v: F.coalesce((F.size(v) == 3) & F.forall(v, finite), F.lit(False))), F.lit(False))


def candidates(bulk: DataFrame, hull: DataFrame, max_sites: int = 16) -> DataFrame:
    """Small nitrides with a valid structure and a finite hull energy from (immutable_id, dft_hull); of duplicates of a
    hull id the highest energy counts. Where the table has forces, they must be valid, and give max_force."""
    if "forces" in bulk.columns:
        bulk = bulk.where(valid_forces(F.col("forces"), F.col("nsites"))).withColumn("max_force", max_force(F.col("forces")))
    energies = hull.where("immutable_id IS NOT NULL AND dft_hull IS NOT NULL AND NOT isnan(dft_hull) AND abs(dft_hull) < double('inf')").groupBy("immutable_id").agg(F.max("dft_hull").alias("dft_hull"))
    valid = F.coalesce(F.size(structure_faults(F.col("structure"))) == 0, F.lit(False)) & (F.size("structure.species") == F.col("nsites"))
    rows = bulk.where(F.col("nelements").between(2, 3) & (F.col("nsites") <= max_sites)).withColumn("chemistry", chemistry())
    return rows.where(F.col("chemistry").isNotNull() & present("structure_fingerprint") & valid).join(energies, "immutable_id")


def snapshot(bulk: DataFrame, hull: DataFrame, order: str = "row_no", per_group: int = 8) -> DataFrame:
    """First row of each fingerprint, then the ``per_group`` lowest on the hull of each chemistry."""
    first = first_of_each(candidates(bulk, hull), "structure_fingerprint", order)
    place = F.row_number().over(W.partitionBy("chemistry").orderBy("dft_hull", "nsites", "immutable_id", order))
    return first.withColumn("place", place).where(F.col("place") <= per_group)


def first_of_each(rows: DataFrame, key: str = "structure_fingerprint", order: str = "row_no") -> DataFrame:
    """The first row of each present key."""
    kept = rows.where(present(key))
    return kept.groupBy(key).agg(F.min_by(F.struct(*[x for x in kept.columns if x != key]), order).alias("r")).select(key, "r.*")


def check_cohort(rows: DataFrame, per_group: int = 8, total: int = 24, eligible: int = 3, max_hull: float = 0.05, max_force: float = 0.2) -> DataFrame:
    """The snapshot itself, if it has enough rows of each chemistry, in all, and fit for ranking; ValueError else."""
    fit = (F.col("dft_hull") <= max_hull) & (F.nanvl("max_force", F.lit(None)) <= max_force)
    groups = {r["chemistry"]: (r["n"], r["fit"]) for r in rows.groupBy("chemistry").agg(F.count("*").alias("n"), F.count_if(fit).alias("fit")).collect()}  # three chemistries
    short = [c for c in ("Al-N", "Ti-N", "Ti-Al-N") if groups.get(c, (0, 0))[0] < per_group]
    if short:
        raise ValueError(f"fewer than {per_group} rows of {', '.join(short)}")
    if sum(n for n, _ in groups.values()) != total:
        raise ValueError(f"not {total} rows")
    if sum(f for _, f in groups.values()) < eligible:
        raise ValueError(f"fewer than {eligible} rows fit for ranking")
    return rows


def manifest(rows: DataFrame, population: int) -> dict:
    """Counts and checksum of a snapshot; a snapshot is at most a few rows a chemistry."""
    lines = sorted(r["line"] for r in canonical_lines(rows).collect())
    groups = {r["chemistry"]: r["n"] for r in rows.groupBy("chemistry").agg(F.count("*").alias("n")).collect()}
    return {"schema_version": "1", "source_population": population, "snapshot_count": len(lines), "groups": groups, "snapshot_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}
