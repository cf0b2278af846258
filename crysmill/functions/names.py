"""Canonical property names and preferred units."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Canonical property names, their units and their aliases.
PROPERTIES = {
    "density": ("g/cm^3", ("rho", "mass_density")),
    "formation_energy_per_atom": ("eV/atom", ("formation_energy", "formation_energy_pa", "e_form", "eform")),
    "energy_above_hull": ("eV/atom", ("e_above_hull", "e_hull", "ehull", "energy_above_hull_per_atom")),
    "bulk_modulus": ("GPa", ("k_vrh", "kvrh", "bulk_modulus_kv")),
    "shear_modulus": ("GPa", ("g_vrh", "gvrh", "shear_modulus_gv")),
    "band_gap": ("eV", ("bandgap", "gap", "optb88vdw_bandgap")),
    "youngs_modulus": ("GPa", ("young_modulus", "youngs", "e_modulus")),
    "poisson_ratio": (None, ("poisson", "nu", "homogeneous_poisson")),
    "specific_stiffness": ("MN*m/kg", ("specific_modulus",)),
}
ALIASES = {a: name for name, (_, aliases) in PROPERTIES.items() for a in (name, *aliases)}


def spelled(name: Column) -> Column:
    return F.translate(F.lower(F.trim(name)), "- ", "__")


def canonical_name(name: Column) -> Column:
    """Canonical spelling; unknown names pass through in lower case with underscores."""
    lookup = F.create_map(*map(F.lit, chain.from_iterable(ALIASES.items())))
    key = spelled(name)
    return F.coalesce(F.element_at(lookup, key), key)


def preferred_unit(name: Column) -> Column:
    lookup = F.create_map(*map(F.lit, chain.from_iterable((k, u) for k, (u, _) in PROPERTIES.items() if u)))
    return F.element_at(lookup, canonical_name(name))
