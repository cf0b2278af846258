"""Records of remote sources from saved pages: a page reader and a Column-expression mapper for each source.

``fetch`` has the loops that bring pages in. Saved pages are JSON files; ``PageSource`` is a Python data source whose
partitions are the pages. Bad rows are left out by the mappers and told by ``skipped``.
"""

from __future__ import annotations

import glob
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.lattice import volume
from ..functions.names import canonical_name
from ..operators.normalize import cell_density, sentinel_number, wrapped_fractional

PROPERTIES = "array<struct<name string, value double, unit string, source string, method string, extra map<string,string>>>"
SUPPORTED = {"materials_project": ("density", "formation_energy_per_atom", "energy_above_hull", "bulk_modulus", "shear_modulus"), "jarvis": ("optb88vdw_total_energy", "band_gap", "bulk_modulus", "shear_modulus"), "nomad": (), "optimade": ("density", "band_gap", "formation_energy_per_atom", "energy_above_hull")}


class PageReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.rows = options["path"], options.get("rows", "data")
        self.most = int(options.get("max_pages", "0"))

    def partitions(self):
        names = sorted(glob.glob(self.path))
        return [InputPartition(p) for p in (names[: self.most] if self.most else names)] or [InputPartition("")]

    def read(self, partition):
        if not partition.value:
            return
        with open(partition.value, encoding="utf-8") as f:
            page = json.load(f)
        rows = page.get(self.rows, []) if isinstance(page, dict) else page
        for i, row in enumerate(rows if isinstance(rows, list) else []):
            yield (partition.value, i, json.dumps(row))


class PageSource(DataSource):
    """Rows of saved pages; options path (a glob), rows (their key in a page) and max_pages."""

    @classmethod
    def name(cls):
        return "crysmill_pages"

    def schema(self):
        return "page string, row_in_page int, body string"

    def reader(self, schema):
        return PageReader(self.options)


def pages(spark: SparkSession, path: str, rows: str = "data", max_pages: int = 0) -> DataFrame:
    spark.dataSource.register(PageSource)
    return spark.read.format("crysmill_pages").option("path", path).option("rows", rows).option("max_pages", str(max_pages)).load()


def _prop(name: str, value: Column, unit: str | None, source: str, method: str, extra: dict | None = None) -> Column:
    tags = F.create_map(*[F.lit(x) for kv in (extra or {}).items() for x in kv]) if extra else F.create_map().cast("map<string,string>")
    return F.when(value.isNotNull(), F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit(unit).alias("unit"), F.lit(source).alias("source"), F.lit(method).alias("method"), tags.alias("extra")))


def provenance(source: str, source_id: Column | None = None, method: str = "dft", notes: str | None = None, parameters: dict | None = None) -> Column:
    """STRUCT(source, method, source_id, notes, parameters): where a record comes from."""
    told = F.create_map(*[F.lit(str(x)) for kv in parameters.items() for x in kv]) if parameters else F.create_map().cast("map<string,string>")
    return F.struct(F.lit(source).alias("source"), F.lit(method).alias("method"), (F.lit(None).cast("string") if source_id is None else source_id).alias("source_id"), F.lit(notes).cast("string").alias("notes"), told.alias("parameters"))


def _list(*props: Column) -> Column:
    return F.array_compact(F.array(*props)).cast(PROPERTIES)


def materials_project(docs: DataFrame, body: str = "body") -> DataFrame:
    """Summary documents: density, energies and VRH moduli; tensor summaries go to metadata."""
    kind = "material_id string, formula_pretty string, density double, formation_energy_per_atom double, energy_above_hull double, bulk_modulus string, shear_modulus string, homogeneous_poisson double, universal_anisotropy double"
    d = docs.select(F.from_json(body, kind).alias("d")).select("d.*").where("material_id IS NOT NULL AND formula_pretty IS NOT NULL")
    vrh = lambda c: F.get_json_object(c, "$.vrh").try_cast("double")
    src = "materials_project"
    return d.select(
        "material_id", F.col("formula_pretty").alias("formula"),
        _list(_prop("density", F.col("density"), "g/cm^3", src, "dft"), _prop("formation_energy_per_atom", F.col("formation_energy_per_atom"), "eV/atom", src, "dft"), _prop("energy_above_hull", F.col("energy_above_hull"), "eV/atom", src, "dft"), _prop("bulk_modulus", vrh("bulk_modulus"), "GPa", src, "dft", {"averaging_scheme": "vrh"}), _prop("shear_modulus", vrh("shear_modulus"), "GPa", src, "dft", {"averaging_scheme": "vrh"})).alias("properties"),
        F.map_filter(F.create_map(F.lit("mp_id"), F.col("material_id"), F.lit("homogeneous_poisson"), F.col("homogeneous_poisson").cast("string"), F.lit("universal_anisotropy"), F.col("universal_anisotropy").cast("string")), lambda k, v: v.isNotNull()).alias("metadata"),
    )


def jarvis(rows: DataFrame) -> DataFrame:
    """Rows of typed columns jid, formula, atoms, ...: malformed atoms leave a row out, "na" is null, moduli must be positive."""
    cell = F.col("atoms.lattice_mat")
    coords = F.when(F.col("atoms.cartesian"), wrapped_fractional(cell, F.col("atoms.coords"))).otherwise(F.col("atoms.coords"))
    ok = volume(cell).isNotNull() & (F.size("atoms.elements") > 0) & (F.size("atoms.elements") == F.size("atoms.coords"))
    positive = lambda c: F.when(sentinel_number(F.col(c)) > 0, sentinel_number(F.col(c)))
    gap = sentinel_number(F.col("optb88vdw_bandgap")) if "optb88vdw_bandgap" in rows.columns else F.lit(None).cast("double")
    return rows.where(F.coalesce(ok, F.lit(False))).select(
        F.concat(F.lit("jarvis:"), "jid").alias("material_id"), F.coalesce("formula", F.lit("UNK")).alias("formula"),
        F.struct(cell.alias("lattice"), F.col("atoms.elements").alias("species"), coords.alias("coords")).alias("structure"),
        _list(_prop("optb88vdw_total_energy", sentinel_number(F.col("optb88vdw_total_energy")), "eV", "jarvis", "dft"), _prop("band_gap", gap, "eV", "jarvis", "dft"), _prop("bulk_modulus", positive("bulk_modulus_kv"), "GPa", "jarvis", "dft", {"averaging_scheme": "voigt"}), _prop("shear_modulus", positive("shear_modulus_gv"), "GPa", "jarvis", "dft", {"averaging_scheme": "voigt"})).alias("properties"),
        F.create_map(F.lit("jid"), F.col("jid"), F.lit("source"), F.lit("jarvis_dft_3d")).alias("metadata"),
    )


def nomad(docs: DataFrame, body: str = "body") -> DataFrame:
    """Entries: reduced formula, else Hill's; rows without id or formula are left out."""
    kind = "entry_id string, upload_id string, parser_name string, results struct<material: struct<chemical_formula_reduced: string, chemical_formula_hill: string, elements: array<string>>>"
    d = docs.select(F.from_json(body, kind).alias("d")).select("d.*")
    clean = lambda c: F.nullif(F.trim(c), F.lit(""))
    formula = F.coalesce(clean(F.col("results.material.chemical_formula_reduced")), clean(F.col("results.material.chemical_formula_hill")))
    return d.select(F.concat(F.lit("nomad:"), clean(F.col("entry_id"))).alias("material_id"), formula.alias("formula"), F.array_sort(F.coalesce("results.material.elements", F.array().cast("array<string>"))).alias("elements"), F.create_map(F.lit("upload_id"), F.col("upload_id"), F.lit("parser_name"), F.col("parser_name")).alias("metadata")).where("material_id IS NOT NULL AND formula IS NOT NULL")


def nomad_payload(elements: list[str] | None, page_size: int, after: str | None = None) -> dict:
    """Request body of a page."""
    query = {"results.material.elements": {"all": [e.strip() for e in elements if e.strip()]}} if elements else {}
    pagination = {"page_size": page_size, "order_by": "entry_id", "order": "asc"} | ({"page_after_value": after} if after else {})
    return {"owner": "public", "query": query, "pagination": pagination}


_OQMD = (("_oqmd_band_gap", "band_gap", "eV", {}), ("_oqmd_delta_e", "formation_energy_per_atom", "eV/atom", {}), ("_oqmd_stability", "energy_above_hull", "eV/atom", {"hull_convention": "oqmd_hull_distance"}))


def optimade(docs: DataFrame, provider: str, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """(records, skipped) of structure entries.

    Site labels are looked up in the entry's species table; vacancies lower a site's occupancy. Rows with assemblies, a
    flat cell, unknown labels, fully vacant sites or uneven lists are skipped with a reason; a missing cell only leaves
    the structure out. Density is derived from whole three-dimensional cells; hull distances are never clamped.
    """
    own_fields = "".join(f", {c}: double" for c, *_ in _OQMD)
    attrs = "chemical_formula_reduced: string, elements: array<string>, nsites: int, nperiodic_dimensions: int, dimension_types: array<int>, structure_features: array<string>, lattice_vectors: array<array<double>>, cartesian_site_positions: array<array<double>>, species_at_sites: array<string>, species: array<struct<name: string, chemical_symbols: array<string>, concentration: array<double>>>" + own_fields
    parsed = docs.select(F.from_json(body, f"id string, attributes struct<{attrs}>").alias("d"))
    d = parsed.select(F.nullif(F.trim("d.id"), F.lit("")).alias("id"), F.col("d.attributes").isNotNull().alias("_has"), "d.attributes.*")
    cell = F.col("lattice_vectors")
    given = (F.size(cell) > 0) & (F.size("cartesian_site_positions") > 0) & (F.size("species") > 0) & (F.size("species_at_sites") > 0)
    has_cell = F.coalesce(given & ~F.exists(cell, lambda v: F.exists(v, lambda x: x.isNull())), F.lit(False))
    real = lambda s: F.filter(F.arrays_zip(s["chemical_symbols"], s["concentration"]), lambda p: ~p["chemical_symbols"].isin("vacancy", "X") & (p["concentration"] > 0))
    lookup = F.map_from_entries(F.transform(F.array_distinct(F.transform("species", lambda s: s["name"])), lambda n: F.struct(n, real(F.element_at(F.filter("species", lambda s: s["name"] == n), -1)))))
    sites = F.transform("species_at_sites", lambda n: F.try_element_at(lookup, n))
    d = d.withColumn("_sites", F.when(has_cell, sites))
    uneven = F.exists("species", lambda s: F.size(s["chemical_symbols"]) != F.size(s["concentration"]))
    reason = F.when(F.col("id").isNull(), "missing id").when(~F.col("_has"), "missing attributes").when(F.array_contains("structure_features", "assemblies"), "assemblies")
    reason = reason.when(has_cell & volume(cell).isNull(), "degenerate cell").when(has_cell & (volume(cell) < 1.0), "degenerate cell").when(has_cell & uneven, "uneven concentrations")
    reason = reason.when(F.exists("_sites", lambda s: s.isNull()), "unknown site label").when(F.exists("_sites", lambda s: F.size(s) == 0), "vacant site").when(has_cell & (F.size("_sites") != F.size("cartesian_site_positions")), "site count")
    whole = F.when(F.forall("_sites", lambda s: F.size(s) == 1), F.transform("_sites", lambda s: F.get(s, 0)["chemical_symbols"]))
    counted = F.transform(F.array_sort(F.array_distinct(whole)), lambda e: F.concat(e, F.size(F.filter(whole, lambda x: x == e)).cast("string")))
    formula = F.coalesce(F.nullif(F.trim("chemical_formula_reduced"), F.lit("")), F.nullif(F.array_join(counted, ""), F.lit("")))
    d = d.withColumn("_reason", F.coalesce(reason, F.when(formula.isNull(), "no formula")))
    summed = F.aggregate("dimension_types", F.lit(0), lambda a, x: a + x)
    dims = F.coalesce(F.when(F.col("nperiodic_dimensions").between(0, 3), F.col("nperiodic_dimensions")), F.when(F.forall("dimension_types", lambda x: x.isin(0, 1)), summed))
    src = f"optimade:{provider}"
    dense = F.when(has_cell & (dims.isNull() | (dims == 3)), cell_density(cell, whole))
    own = [_prop(name, F.col(c), unit, src, "dft", {"optimade_field": c} | extra) for c, name, unit, extra in _OQMD] if provider == "oqmd" else []
    good = d.where("_reason IS NULL").select(
        F.concat(F.lit(f"{provider}:"), "id").alias("material_id"), formula.alias("formula"), dims.alias("dimensionality"),
        F.when(has_cell, F.struct(cell.alias("lattice"), F.transform("_sites", lambda s: F.map_from_entries(F.transform(s, lambda p: F.struct(p["chemical_symbols"], p["concentration"])))).alias("species"), wrapped_fractional(cell, F.col("cartesian_site_positions")).alias("coords"))).alias("structure"),
        _list(_prop("density", dense, "g/cm^3", src, "derived", {"derived_from": "lattice_vectors + species_at_sites"}), *own).alias("properties"),
    )
    return good, d.where("_reason IS NOT NULL").select("id", F.col("_reason").alias("reason"))


def next_link(page: dict) -> str | None:
    """The link to the next page, given as a text or as {"href": ...}."""
    link = (page.get("links") or {}).get("next")
    return link.get("href") if isinstance(link, dict) else link


def elements_any(elements: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(elements, F.array(*map(F.lit, wanted)))


def elements_all(elements: Column, wanted: list[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), elements)) == 0


def project_properties(materials: DataFrame, wanted: list[str], source: str) -> DataFrame:
    """Keeps the properties asked for; names the source doesn't have raise ValueError."""
    from ..functions.names import ALIASES

    names = [ALIASES.get(w.strip().lower().replace("-", "_").replace(" ", "_"), w) for w in wanted]
    unknown = sorted(set(names) - set(SUPPORTED[source]))
    if unknown:
        raise ValueError(f"{source} has no {unknown}")
    return materials.withColumn("properties", F.filter("properties", lambda p: canonical_name(p["name"]).isin(*names)))


def oqmd(*_):
    raise NotImplementedError("a native OQMD source is not offered; use optimade(provider='oqmd')")
