"""Scalar normalization as Column expressions: units, values, elements, structures, formulas and density checks.

All of it stays inside the JVM. Unknown units give null and a code in ``unit_issue`` rather than an exception, so that
one bad row never fails a job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.elements import MASSES
from ..functions.lattice import at, inverse, volume

# u per cubic angstrom in g/cm^3
DENSITY_UNIT = 1.66053906660

# Accepted unit spellings and factors (and offsets) of the single-value converters.
ENERGY = {"ev": 1.0, "ev/atom": 1.0, "ry": 13.6056980659, "rydberg": 13.6056980659, "kj/mol": 1 / 96.485332123, "j/mol": 1 / 96485.332123, "mev": 0.001}
LENGTH = {"angstrom": 1.0, "å": 1.0, "a": 1.0, "ang": 1.0, "nm": 10.0, "bohr": 0.529177210903, "au": 0.529177210903}
PRESSURE = {"gpa": 1.0, "pa": 1e-9, "mpa": 1e-3, "kbar": 0.1}
DENSITY = {"g/cm^3": 1.0, "g/cm3": 1.0, "g/cc": 1.0, "g/ml": 1.0, "kg/m^3": 1e-3, "kg/m3": 1e-3}


def unit_key(unit: Column) -> Column:
    return F.replace(F.lower(F.trim(unit)), F.lit(" "), F.lit(""))


def _scaled(value: Column, unit: Column, factors: dict[str, float]) -> Column:
    table = F.create_map(*[F.lit(x) for kv in factors.items() for x in kv])
    return value * F.element_at(table, unit_key(unit))


def energy_ev(value: Column, unit: Column) -> Column:
    return _scaled(value, unit, ENERGY)


def length_angstrom(value: Column, unit: Column) -> Column:
    return _scaled(value, unit, LENGTH)


def pressure_gpa(value: Column, unit: Column) -> Column:
    return _scaled(value, unit, PRESSURE)


def density_gcc(value: Column, unit: Column) -> Column:
    return _scaled(value, unit, DENSITY)


def temperature_k(value: Column, unit: Column) -> Column:
    u = unit_key(unit)
    return F.when(u.isin("k", "kelvin"), value).when(u.isin("c", "°c", "degc", "celsius"), value + 273.15)


def unit_issue(converted: Column, value: Column, unit: Column) -> Column:
    return F.when(value.isNotNull() & converted.isNull(), F.concat(F.lit("unsupported unit: "), F.coalesce(unit, F.lit("null"))))


def no_nan(x: Column) -> Column:
    return F.nanvl(x, F.lit(None))


def number(text: Column) -> Column:
    """Number of a text as plain decimal or exponent notation; null for anything else, NaN and infinity included."""
    t = F.trim(text)
    return F.when(t.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"), t.try_cast("double"))


def numeric_read(value: Column, value_text: Column) -> Column:
    """The number of a property, from its value or its text."""
    return F.coalesce(no_nan(value), number(value_text))


def sentinel_number(text: Column) -> Column:
    """Number of a text, null for "na" and its like."""
    return F.when(~F.lower(F.trim(text)).isin("na", "n/a", "", "none"), number(text))


def coerce_elements(elements: Column) -> Column:
    """Distinct trimmed symbols in alphabetical order; empty array for null."""
    clean = F.filter(F.transform(elements, lambda e: F.trim(e)), lambda e: e.isNotNull() & (e != ""))
    return F.coalesce(F.array_sort(F.array_distinct(clean)), F.array().cast("array<string>"))


def elements_of_text(text: Column) -> Column:
    """Elements of a text: a JSON list, else a flat formula, else symbols between commas, dashes or blanks."""
    listed = F.from_json(text, "array<string>")
    flat = F.regexp_extract_all(text, F.lit(r"([A-Z][a-z]?)"), F.lit(1))
    apart = F.split(F.trim(text), r"[,\-\s]+")
    return coerce_elements(F.when(F.ltrim(text).startswith("["), listed).when(text.rlike(r"^([A-Z][a-z]?\d*\.?\d*)+$"), flat).otherwise(apart))


def wrapped_fractional(lattice: Column, cartesian: Column) -> Column:
    """Fractional coordinates, wrapped into the cell, of cartesian ones; null for a singular cell."""
    inv = inverse(lattice)

    def one(p: Column) -> Column:
        f = [sum((F.get(p, i) * at(inv, i, j) for i in range(1, 3)), F.get(p, 0) * at(inv, 0, j)) for j in range(3)]
        return F.array(*[x - F.floor(x) for x in f])

    return F.when(inv.isNotNull(), F.transform(cartesian, one))


def cell_density(lattice: Column, species: Column) -> Column:
    """g/cm^3 of a cell of whole atoms; null where the cell or a mass is missing."""
    table = F.create_map(*[F.lit(x) for kv in MASSES.items() for x in kv])
    mass = F.aggregate(species, F.lit(0.0), lambda a, s: a + F.try_element_at(table, s))
    return F.when(F.size(species) > 0, mass * DENSITY_UNIT / volume(lattice))


def density_check(stated: Column, derived: Column, tolerance: float = 0.05) -> Column:
    """STRUCT(ratio, consistent, diagnosis) of a stated against a cell's density."""
    ratio = F.try_divide(stated, derived)
    whole = F.bround(ratio)
    near = (whole >= 2) & (F.abs(ratio - whole) < 0.1)
    good = F.abs(ratio - 1) <= tolerance
    text = F.when(good, "consistent").when(near, F.concat(F.lit("incomplete basis: cell holds about 1/"), whole.cast("int").cast("string"), F.lit(" of the atoms"))).otherwise("inconsistent")
    return F.when(ratio.isNotNull(), F.struct(ratio.alias("ratio"), good.alias("consistent"), text.alias("diagnosis")))


def max_force(forces: Column) -> Column:
    """Largest length of the vectors of a list."""
    return F.array_max(F.transform(forces, lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))))


def structure_faults(s: Column) -> Column:
    """Codes of what is wrong with STRUCT(lattice, species, coords), empty if nothing is; null for a null structure."""
    square = F.coalesce((F.size(s["lattice"]) == 3) & F.forall(s["lattice"], lambda r: F.coalesce((F.size(r) == 3) & F.forall(r, lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False))), F.lit(False))
    vectors = F.coalesce(F.forall(s["coords"], lambda r: F.coalesce((F.size(r) == 3) & F.forall(r, lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False))), F.lit(False))
    return F.when(s.isNotNull(), F.array_compact(F.array(
        F.when(~square, "lattice_shape"),
        F.when(square & volume(s["lattice"]).isNull(), "lattice_volume"),
        F.when(F.coalesce(F.size(s["species"]), F.lit(0)) < 1, "species_empty"),
        F.when(~F.size(s["coords"]).eqNullSafe(F.size(s["species"])), "coords_count"),
        F.when(~vectors, "coords_shape"),
    )))


def record_faults() -> Column:
    """Codes of what is wrong with a material record; an empty array for a valid one."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    return F.array_compact(F.array(
        F.when(blank(F.col("material_id")), "material_id_empty"),
        F.when(blank(F.col("formula")), "formula_empty"),
        F.when(F.coalesce(F.size("elements") > 0, F.lit(False)) & F.exists("elements", lambda e: e.isNull() | ~e.isin(*MASSES)), "elements_unknown"),
        F.when(F.coalesce(F.exists("properties", lambda p: p.isNotNull() & F.coalesce(F.trim(p["name"]) == "", F.lit(True))), F.lit(False)), "property_name_empty"),
        F.when(F.coalesce(F.size(structure_faults(F.col("structure"))) > 0, F.lit(False)), "structure_invalid"),
    ))
