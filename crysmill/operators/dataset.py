"""Audited candidate slices over one lazy table of material records.

A ``MaterialsDataset`` is a root table and a list of predicates. Filters only append to both; counts of every step come
from one conditional aggregate over the root, reports from a constant number of aggregates, and nothing is copied.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field, replace
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import graph
from .normalize import coerce_elements, structure_faults

STRUCTURE = "struct<lattice: array<array<double>>, species: array<string>, coords: array<array<double>>, site_properties: string>"

BASES = ("immutable_id", "structure_fingerprint", "formula_only", "none", "custom", "unknown")
OPTIONAL = {"reduced_formula": "string", "elements": "array<string>", "nelements": "int", "nsites": "int", "structure": "string", "immutable_id": "string", "structure_fingerprint": "string", "functional": "string"}
# Other names of standard columns, in order of preference.
ALIASES = {
    "material_id": ("material_id", "entry_id", "id", "record_id", "immutable_id"),
    "formula": ("formula", "chemical_formula_reduced", "reduced_formula"),
    "reduced_formula": ("reduced_formula", "chemical_formula_reduced", "formula"),
    "elements": ("elements", "element_list", "chemsys_elements"),
    "nelements": ("nelements", "n_elements"),
    "nsites": ("nsites", "n_sites"),
    "structure": ("structure", "structure_json"),
    "functional": ("functional", "xc_functional", "dft_functional"),
    "structure_fingerprint": ("structure_fingerprint", "entalpic_fingerprint", "bawl_id", "fingerprint"),
}
# Units that columns of a bulk source are in.
UNITS = {"density": "g/cm^3", "bulk_modulus": "GPa", "shear_modulus": "GPa", "energy_above_hull": "eV/atom", "formation_energy_per_atom": "eV/atom", "band_gap": "eV", "energy_per_site": "eV/site", "max_force": "eV/angstrom", "energy": "eV"}


class SliceError(ValueError):
    """A guardrail that blocks a slice."""


def present(c: str) -> Column:
    """A value that is neither null nor a blank text."""
    return F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False))


def normalized(df: DataFrame) -> DataFrame:
    """Standard columns: aliases resolved to the first column there, ids trimmed, elements sorted and distinct, counts
    filled in, missing optional columns as nulls."""
    for target, names in ALIASES.items():
        if target not in df.columns:
            source = next((n for n in names if n in df.columns), None)
            if source:
                df = df.withColumn(target, F.col(source))
    missing = [c for c in ("material_id", "formula") if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    df = df.withColumns({"material_id": F.trim(F.col("material_id").cast("string")), "formula": F.trim("formula")})
    if "reduced_formula" in df.columns:
        df = df.withColumn("reduced_formula", F.trim("reduced_formula"))
    for name, kind in OPTIONAL.items():
        if name not in df.columns:
            df = df.withColumn(name, F.col("formula") if name == "reduced_formula" else F.lit(None).cast(kind))
    df = df.withColumn("elements", coerce_elements(F.col("elements")))
    if isinstance(df.schema["structure"].dataType, T.StringType):  # JSON text; what is no structure is none
        read = F.from_json("structure", STRUCTURE)
        df = df.withColumn("structure", F.when(F.coalesce(F.size(structure_faults(read)) == 0, F.lit(False)), read))
    sites = F.size("structure.species") if isinstance(df.schema["structure"].dataType, T.StructType) else F.lit(None).cast("int")
    return df.withColumns({"nelements": F.coalesce("nelements", F.nullif(F.size("elements"), F.lit(0))), "nsites": F.coalesce("nsites", F.when(sites >= 0, sites))})


def collisions(df: DataFrame, key: Column) -> DataFrame:
    """One row, n: all members of groups of more than one row with the same present key."""
    sizes = df.select(key.alias("k")).where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"))
    return sizes.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).cast("bigint").alias("n"))


def record_digest(df: DataFrame, leave_out: tuple[str, ...] = ()) -> Column:
    """Digest of a whole record, columns in the order of their names; equal records have equal digests."""
    return F.sha2(F.to_json(F.struct(*[f"`{c}`" for c in sorted(df.columns) if c not in leave_out])), 256)


def duplicate_signals(df: DataFrame, leave_out: tuple[str, ...] = ()) -> DataFrame:
    """One row: the four duplicate counts, by 128-bit keys."""
    text = lambda c: F.when(present(c), F.col(c).cast("string"))
    keys = {
        "exact_record_duplicate_count": record_digest(df, leave_out), "formula_multiplicity_count": text("reduced_formula"),
        "immutable_id_collision_count": text("immutable_id"), "structure_fingerprint_collision_count": text("structure_fingerprint"),
    }
    # one scan: a row gives one hashed key of each kind, counted in two steps that both combine on the map side
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.when(k.isNotNull(), F.struct(F.xxhash64(k), F.xxhash64(F.lit(1), k))).alias("key")) for i, k in enumerate(keys.values())])).alias("x")
    sizes = df.select(each).where("x.key IS NOT NULL").groupBy("x.kind", "x.key").agg(F.count("*").alias("n")).where("n > 1")
    return sizes.agg(*[F.coalesce(F.sum(F.when(F.col("kind") == i, F.col("n"))), F.lit(0)).cast("bigint").alias(name) for i, name in enumerate(keys)])


def element_counts(df: DataFrame) -> DataFrame:
    """(element, n_records), each element once a record."""
    return df.select(F.explode(coerce_elements(F.col("elements"))).alias("element")).groupBy("element").agg(F.count("*").alias("n_records"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n) of present values."""
    return df.where(present(column)).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def include_elements(include: list[str]) -> Column:
    """Has elements, and only these."""
    e = coerce_elements(F.col("elements"))
    return (F.size(e) > 0) & (F.size(F.array_except(e, F.array(*map(F.lit, include)))) == 0)


def exclude_elements(exclude: list[str]) -> Column:
    return ~F.arrays_overlap(coerce_elements(F.col("elements")), F.array(*map(F.lit, exclude)))


@dataclass(frozen=True)
class MaterialsDataset:
    root: DataFrame
    source_dataset: str = "records"
    source_subset: str | None = None
    strict: bool = False
    basis: str = "unknown"
    property_units: dict = field(default_factory=dict)
    leave_out: tuple[str, ...] = ()
    steps: tuple[dict, ...] = ()
    predicates: tuple[Column, ...] = ()
    delivered: DataFrame | None = None
    bounds: tuple[Column, ...] = ()

    @classmethod
    def of(cls, df: DataFrame, source_dataset: str = "records", source_subset: str | None = None, **kw) -> MaterialsDataset:
        """A dataset without strict guardrails."""
        return cls(normalized(df), source_dataset, source_subset, delivered=df, **kw)

    @classmethod
    def bulk(cls, df: DataFrame, source_dataset: str, source_subset: str | None = None, **kw) -> MaterialsDataset:
        """A dataset of a bulk source: strict guardrails, and a deduplication basis found from the data.

        immutable_id where it is complete and the subset is named unique or deduplicated, else the fingerprint where
        that is complete, else unknown.
        """
        n = normalized(df)
        full = n.agg(*[F.coalesce(F.bool_and(present(c)), F.lit(False)).alias(c) for c in ("immutable_id", "structure_fingerprint")]).first()
        named = any(w in (source_subset or "").lower() for w in ("unique", "dedup"))
        basis = "immutable_id" if full[0] and named else "structure_fingerprint" if full[1] else "unknown"
        return cls(n, source_dataset, source_subset, True, basis, {c: u for c, u in UNITS.items() if c in n.columns}, delivered=df, **kw)

    @classmethod
    def from_records(cls, spark: SparkSession, records: list[dict], schema, **kw) -> MaterialsDataset:
        return cls.of(spark.createDataFrame(records, schema), **kw)

    @property
    def df(self) -> DataFrame:
        """The rows that pass all steps. Bounds on delivered counts are put in front of the filling-in of missing ones, as
        plain comparisons that reach the scan."""
        root = normalized(self.delivered.where(reduce(lambda a, b: a & b, self.bounds))) if self.bounds else self.root
        return root.where(reduce(lambda a, b: a & b, self.predicates)) if self.predicates else root

    def _with(self, predicate: Column, name: str, arguments: dict, columns: list[str], bounds: tuple[Column, ...] = ()) -> MaterialsDataset:
        step = {"name": name, "arguments": arguments, "columns_used": columns}
        return replace(self, steps=(*self.steps, step), predicates=(*self.predicates, F.coalesce(predicate, F.lit(False))), bounds=(*self.bounds, *bounds))

    def filter_elements(self, include: list[str] | None = None, exclude: list[str] | None = None) -> MaterialsDataset:
        inc, exc = ({e.strip() for e in x or [] if e.strip()} for x in (include, exclude))
        test = F.lit(True)
        if inc:
            test = test & include_elements(sorted(inc))
        if exc:
            test = test & exclude_elements(sorted(exc))
        return self._with(test, "filter_elements", {"include": sorted(inc) or None, "exclude": sorted(exc) or None}, ["elements"])

    def filter_complexity(self, max_nsites: int | None = None, max_nelements: int | None = None) -> MaterialsDataset:
        """Bounds on sites and elements; a missing count fails its bound."""
        bounds = {"nsites": max_nsites, "nelements": max_nelements}
        test = reduce(lambda a, b: a & b, [F.col(c) <= b for c, b in bounds.items() if b is not None], F.lit(True))
        there = self.delivered.columns if self.delivered is not None else []
        plain = tuple(F.col(c).isNull() | (F.col(c) <= b) for c, b in bounds.items() if b is not None and c in there)
        return self._with(test, "filter_complexity", {f"max_{c}": b for c, b in bounds.items()}, [c for c, b in bounds.items() if b is not None], plain)

    def candidate_pool(self, include=None, exclude=None, max_nsites=None, max_nelements=None) -> MaterialsDataset:
        out = self
        if include or exclude:
            out = out.filter_elements(include, exclude)
        if max_nsites is not None or max_nelements is not None:
            out = out.filter_complexity(max_nsites, max_nelements)
        return out

    @cached_property
    def audited_steps(self) -> tuple[int, list[dict]]:
        """(rows of the root, steps with input, output and removed counts) from one aggregate."""
        chained = [reduce(lambda a, b: a & b, self.predicates[: i + 1]) for i in range(len(self.predicates))]
        counts = list(self.root.agg(F.count("*"), *[F.count_if(c) for c in chained]).first())
        return counts[0], [s | {"input_count": a, "output_count": b, "removed_count": a - b} for s, a, b in zip(self.steps, counts, counts[1:])]

    def schema_report(self) -> dict:
        df = self.df
        row = df.agg(F.count("*"), F.count_if(present("immutable_id")), F.count_if(present("structure_fingerprint")), F.count_if(F.col("structure").isNull())).first()
        functionals = {r["value"]: r["n"] for r in value_counts(df, "functional").orderBy("value").collect()}  # a handful of names
        return {
            "source_dataset": self.source_dataset, "source_subset": self.source_subset, "row_count": row[0], "columns": [c for c in df.columns if c not in self.leave_out],
            "functional_coverage": functionals, "mixed_functionals": len(functionals) > 1, "duplicate_signals": duplicate_signals(df, self.leave_out).first().asDict(),
            "deduplication_basis": self.basis, "immutable_id_coverage": row[1], "structure_fingerprint_coverage": row[2], "missing_structure_count": row[3],
            "provenance_fields_preserved": self.provenance_fields,
        }

    @property
    def provenance_fields(self) -> list[str]:
        return sorted({"source_dataset", "source_subset"} | {c for c in ("functional", "immutable_id", "structure_fingerprint") if c in self.root.columns}) if self.strict else sorted(c for c in ("functional", "immutable_id", "structure_fingerprint") if c in self.root.columns)

    def create_slice(self, name: str, allow_mixed_functionals: bool = False, allow_duplicate_records: bool = False, basis: str | None = None, target: str | None = None) -> CandidateSlice:
        """A frozen, content-named slice; a guardrail raises SliceError unless it is allowed."""
        used = basis or self.basis
        if used == "formula_only" and basis is None:
            raise SliceError("formula_only deduplication must be asked for")
        if target is not None and target not in self.root.columns:
            raise SliceError(f"no target column {target!r}")
        df = self.df
        if self.strict and not allow_mixed_functionals and value_counts(df, "functional").limit(2).count() > 1:
            raise SliceError("mixed functionals")
        signals = duplicate_signals(df, self.leave_out).first().asDict()
        if not allow_duplicate_records:
            watched = {"immutable_id": "immutable_id_collision_count", "structure_fingerprint": "structure_fingerprint_collision_count", "formula_only": "formula_multiplicity_count"}
            if signals["exact_record_duplicate_count"]:
                raise SliceError("exact repeated records")
            if self.strict and used == "unknown":
                raise SliceError("unknown deduplication basis")
            if used in watched and signals[watched[used]]:
                raise SliceError(f"{used} collisions")
        guard = {"allow_mixed_functionals": allow_mixed_functionals, "allow_duplicate_records": allow_duplicate_records, "strict_guardrails": self.strict}
        return CandidateSlice(self, name, guard, used, target, signals)

    def to_pandas(self, max_rows: int | None = None):
        """A copy of the rows on the driver; with ``max_rows`` more of them raise ValueError."""
        if max_rows is not None and self.df.limit(max_rows + 1).count() > max_rows:
            raise ValueError(f"more than {max_rows} rows")
        return self.df.toPandas()

    def to_materials(self, columns: list[str] | None = None) -> DataFrame:
        """Nested records: material_id, formula, reduced_formula, elements, structure, properties of the present scalars, metadata."""
        df = self.df
        names = columns or scalar_columns(df)
        method = F.when(present("functional"), "dft").otherwise("unknown")
        units = self.property_units or UNITS

        def entry(c: str) -> Column:
            kind = df.schema[c].dataType
            numeric = isinstance(kind, T.NumericType)
            value = F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)) if numeric else F.lit(None).cast("double")
            text = F.lit(None).cast("string") if numeric else F.initcap(F.col(f"`{c}`").cast("string")) if isinstance(kind, T.BooleanType) else F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit(""))
            derived = c in ("density", "max_force")
            fields = (F.lit(c).alias("name"), value.alias("value"), text.alias("value_text"), F.lit(units.get(c)).alias("unit"), F.lit("crysmill" if derived else self.source_dataset).alias("source"), (F.lit("derived") if derived else method).alias("method"))
            return F.when(value.isNotNull() | text.isNotNull(), F.struct(*fields))

        kept = [c for c in ("functional", "immutable_id", "structure_fingerprint") if c in df.columns]
        told = F.map_filter(F.create_map(*[x for c in kept for x in (F.lit(c), F.col(c).cast("string"))]), lambda k, v: v.isNotNull())
        return df.select("material_id", "formula", "reduced_formula", "elements", "structure", F.array_compact(F.array(*map(entry, names))).alias("properties") if names else F.array().alias("properties"), told.alias("metadata"))

    def to_graphs(self, cutoff: float = 5.0, k: int = 12, builder=None) -> tuple[DataFrame, int]:
        """(edges of every record with a structure, how many records have none). A structure whose sites share an atom
        (disordered) raises ValueError. ``builder(structures, key, cutoff, k)`` takes the place of the own one."""
        df = self.df
        kind = df.schema["structure"].dataType
        disordered = F.exists("structure.species", lambda s: F.size(F.map_keys(s)) != 1) if isinstance(kind, T.StructType) and not isinstance(kind["species"].dataType.elementType, T.StringType) else F.lit(False)
        ok = F.coalesce(F.size(structure_faults(F.col("structure"))) == 0, F.lit(False))
        one = df.agg(F.count_if(~ok), F.count_if(F.coalesce(disordered, F.lit(False)))).first()
        if one[1]:
            raise ValueError(f"{one[1]} disordered structures")
        return (builder or graph.edges)(df.where(ok).select("material_id", "structure"), "material_id", cutoff, k), one[0]

    def export(self, path: str) -> dict:
        """Canonical lines under ``path`` with a manifest of id, checksum and count."""
        from ..sources.readers import canonical_lines, lines_digest

        canonical_lines(self.df).write.mode("overwrite").text(path)
        count, digest = lines_digest(self.df.sparkSession.read.text(path))
        return {"dataset_id": f"mg_ds_{digest[:16]}", "sha256": digest, "count": count}

    def to_benchmark_frame(self, target: str | None = None) -> DataFrame:
        """Adds the source columns, the structure as JSON text and a copy of the target."""
        df = self.df
        if target is not None and target not in df.columns:
            raise ValueError(f"no target column {target!r}")
        out = df.withColumns({"source_dataset": F.lit(self.source_dataset), "source_subset": F.lit(self.source_subset)})
        if isinstance(df.schema["structure"].dataType, T.StructType):
            out = out.withColumn("structure", F.to_json("structure"))
        return out.withColumn("target", F.col(target)) if target else out

    def to_properties(self, columns: list[str] | None = None) -> DataFrame:
        """(material_id, name, value, unit, source, method): one row for each present property of each record."""
        df = self.df
        columns = columns or property_columns(df)
        method = F.when(present("functional"), "dft").otherwise("unknown")
        entries = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.nanvl(F.col(c).cast("double"), F.lit(None)).alias("value")) for c in columns])).alias("p")
        derived = F.col("p.name").isin("density", "max_force")
        unit = F.element_at(F.create_map(*[F.lit(x) for kv in (self.property_units or UNITS).items() for x in kv]), F.col("p.name"))
        return df.select("material_id", method.alias("_m"), entries).where("p.value IS NOT NULL").select("material_id", F.col("p.name").alias("name"), F.col("p.value").alias("value"), unit.alias("unit"), F.when(derived, "crysmill").otherwise(self.source_dataset).alias("source"), F.when(derived, "derived").otherwise(F.col("_m")).alias("method"))


def property_columns(df: DataFrame) -> list[str]:
    """Numeric columns that are not part of a record's identity or shape."""
    reserved = {"nelements", "nsites", "row_no", "record_no", "dimensionality"}
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in reserved]


def scalar_columns(df: DataFrame) -> list[str]:
    """Columns of plain values that are no part of a record's identity or shape and hold a value in some row."""
    reserved = {"material_id", "formula", "reduced_formula", "functional", "immutable_id", "structure_fingerprint", "last_modified", "source_dataset", "source_subset", "nelements", "nsites", "row_no", "record_no", "dimensionality"}
    plain = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.StringType, T.BooleanType)) and f.name not in reserved]
    if not plain:
        return []
    held = df.agg(*[F.bool_or(present(c) & ~F.isnan(F.col(f"`{c}`").try_cast("double")) if isinstance(df.schema[c].dataType, T.FractionalType) else present(c)).alias(c) for c in plain]).first()
    return [c for c in plain if held[c]]


def pivot_properties(long: DataFrame, names: list[str]) -> DataFrame:
    """One column for each name, the last value by ``prop_no``; from (material_id, record_no, prop_no, name, value)."""
    return long.groupBy("material_id").agg(*[F.max_by(F.when(F.col("name") == n, F.col("value")), F.when((F.col("name") == n) & F.col("value").isNotNull(), F.struct("record_no", "prop_no"))).alias(n) for n in names])


@dataclass(frozen=True)
class CandidateSlice:
    dataset: MaterialsDataset
    slice_name: str
    guardrail_config: dict
    deduplication_basis: str
    target: str | None
    signals: dict

    @property
    def df(self) -> DataFrame:
        return self.dataset.df

    @property
    def slice_id(self) -> str:
        """Content name: sources, steps with arguments, guardrails, basis and target; not the slice's own name."""
        d = self.dataset
        what = {"source_dataset": d.source_dataset, "source_subset": d.source_subset, "filter_steps": [{"name": s["name"], "arguments": s["arguments"]} for s in d.steps], "guardrail_config": self.guardrail_config, "deduplication_basis": self.deduplication_basis, "target": self.target}
        return "mg_slice_" + hashlib.sha256(json.dumps(what, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:12]

    def report(self) -> dict:
        whole, steps = self.dataset.audited_steps
        out = steps[-1]["output_count"] if steps else whole
        row = self.df.agg(F.count_if(F.col("structure").isNull()), F.count_distinct(F.when(present("functional"), F.col("functional"))), F.count_if(~F.coalesce(F.size(structure_faults(F.col("structure"))) == 0, F.lit(False)) if isinstance(self.df.schema["structure"].dataType, T.StructType) else F.lit(True))).first()
        return {
            "slice_id": self.slice_id, "slice_name": self.slice_name, "source_dataset": self.dataset.source_dataset, "source_subset": self.dataset.source_subset,
            "input_count": whole, "output_count": out, "removed_count": whole - out, "filter_steps": steps, "columns_used": sorted({c for s in steps for c in s["columns_used"]}),
            "mixed_functionals": row[1] > 1, "duplicate_policy": "allow_duplicate_records" if self.guardrail_config["allow_duplicate_records"] else "disallow_duplicate_records",
            "deduplication_basis": self.deduplication_basis, "provenance_fields_preserved": self.dataset.provenance_fields, "missing_structure_count": row[0], "graph_export_excluded_count": row[2], "duplicate_signals": self.signals,
        }
