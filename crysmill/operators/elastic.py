"""Isotropic elastic quantities from bulk and shear modulus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import canonical_name
from .normalize import DENSITY, PRESSURE, density_gcc, no_nan, number, pressure_gpa

# Thresholds on the Poisson ratio.
DUCTILE, BRITTLE, INCOMPRESSIBLE = 0.31, 0.20, 0.48


def youngs(k: Column, g: Column) -> Column:
    return F.lit(9.0) * k * g / (F.lit(3.0) * k + g)


def poisson(k: Column, g: Column) -> Column:
    return (F.lit(3.0) * k - F.lit(2.0) * g) / (F.lit(2.0) * (F.lit(3.0) * k + g))


def ductility(nu: Column) -> Column:
    return F.when(nu >= DUCTILE, "ductile").when(nu <= BRITTLE, "brittle").when(nu.isNotNull(), "borderline")


def stable(k: Column, g: Column) -> Column:
    finite = lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(finite(k) & finite(g) & (k > 0) & (g > 0), F.lit(False))


def derive(df: DataFrame, k: str = "bulk_modulus", g: str = "shear_modulus", density: str | None = "density") -> DataFrame:
    """Adds youngs_modulus, poisson_ratio, pugh_ratio, ductility, specific_stiffness and elastic_warnings.

    All are null where a modulus is missing, not finite or not positive; the warnings tell why. Moduli are in GPa and
    the density in g/cm^3.
    """
    kc, gc = F.col(k), F.col(g)
    ok = stable(kc, gc)
    e, nu = F.when(ok, youngs(kc, gc)), F.when(ok, poisson(kc, gc))
    rho = F.col(density) if density else F.lit(None).cast("double")
    usable = (rho > 0) & ~F.isnan(rho) & (rho < float("inf"))
    warnings = F.array_compact(F.array(
        F.when(~ok & kc.isNotNull() & gc.isNotNull(), "moduli must be finite and positive"),
        F.when(nu < 0, "negative Poisson ratio"),
        F.when(nu > INCOMPRESSIBLE, "Poisson ratio near the incompressible limit"),
        F.when(ok & rho.isNotNull() & ~usable, "density not usable"),
    ))
    return df.withColumns({"youngs_modulus": e, "poisson_ratio": nu, "pugh_ratio": F.when(ok, gc / kc), "ductility": ductility(nu), "specific_stiffness": F.when(ok & usable, e / rho), "elastic_warnings": warnings})


def first_property(name: str) -> Column:
    """The first property of a canonical name in ``properties``, or null."""
    return F.get(F.filter("properties", lambda p: p.isNotNull() & (canonical_name(p["name"]) == name)), 0)


def elastic_frame(materials: DataFrame) -> DataFrame:
    """One row for each record with both moduli: ten columns, warnings joined by "; ".

    The first property of a name counts. A modulus without a unit is taken as GPa with a warning, one in an unsupported
    unit is missing; the method is kept only if both moduli have the same.
    """
    p = materials.select("material_id", first_property("bulk_modulus").alias("k"), first_property("shear_modulus").alias("g"), first_property("density").alias("d"))

    def gpa(c: str) -> Column:
        v = F.coalesce(no_nan(F.col(f"{c}.value")), number(F.col(f"{c}.value_text")))
        return F.when(F.coalesce(F.trim(F.col(f"{c}.unit")), F.lit("")) == "", v).otherwise(pressure_gpa(v, F.col(f"{c}.unit")))

    def note(c: str, name: str) -> Column:
        unit = F.coalesce(F.trim(F.col(f"{c}.unit")), F.lit(""))
        return F.when(F.col(c).isNull(), None).when(unit == "", f"{name} has no unit; assuming GPa").when(~F.replace(F.lower(unit), F.lit(" "), F.lit("")).isin(*PRESSURE), F.concat(F.lit("unsupported unit: "), unit))

    scheme = lambda c: F.try_element_at(F.col(f"{c}.extra"), F.lit("averaging_scheme"))
    d_unit = F.coalesce(F.trim(F.col("d.unit")), F.lit(""))
    d_value = F.coalesce(no_nan(F.col("d.value")), number(F.col("d.value_text")))
    q = p.select(
        "material_id", gpa("k").alias("bulk_modulus"), gpa("g").alias("shear_modulus"),
        F.when(d_unit == "", d_value).otherwise(density_gcc(d_value, d_unit)).alias("density"),
        F.array_compact(F.array(
            note("k", "bulk_modulus"), note("g", "shear_modulus"),
            F.when(scheme("k") != scheme("g"), "bulk and shear moduli use different averaging schemes"),
            F.when((d_unit != "") & ~F.replace(F.lower(d_unit), F.lit(" "), F.lit("")).isin(*DENSITY), F.concat(F.lit("unsupported unit: "), d_unit)),
        )).alias("notes"),
        F.when(F.col("k.method") == F.col("g.method"), F.col("k.method")).otherwise("unknown").alias("method"),
    ).where(stable(F.col("bulk_modulus"), F.col("shear_modulus")))
    out = derive(q)
    return out.select("material_id", "bulk_modulus", "shear_modulus", "youngs_modulus", "poisson_ratio", "pugh_ratio", "ductility", "specific_stiffness", "method", F.array_join(F.concat("notes", "elastic_warnings"), "; ").alias("warnings"))


def with_derived(materials: DataFrame) -> DataFrame:
    """Appends youngs_modulus, poisson_ratio and, with a density, specific_stiffness to ``properties``; records without
    both moduli are unchanged. Records are matched by a unique ``record_no``."""
    kind = materials.schema["properties"].dataType.elementType
    types = {f.name: f.dataType.simpleString() for f in kind.fields}

    def entry(name: str, value: Column, unit: str | None) -> Column:
        given = {"name": F.lit(name), "value": value, "unit": F.lit(unit), "source": F.lit("derived:crysmill"), "method": F.col("_e.method")}
        return F.struct(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in types.items()])

    e = elastic_frame(materials.withColumn("material_id", F.col("record_no"))).select(F.col("material_id").alias("record_no"), F.struct("youngs_modulus", "poisson_ratio", "specific_stiffness", "method").alias("_e"))
    added = F.filter(F.array(entry("youngs_modulus", F.col("_e.youngs_modulus"), "GPa"), entry("poisson_ratio", F.col("_e.poisson_ratio"), None), entry("specific_stiffness", F.col("_e.specific_stiffness"), "MN*m/kg")), lambda p: p["value"].isNotNull())
    joined = materials.join(e, "record_no", "left")
    return joined.withColumn("properties", F.when(F.col("_e").isNotNull(), F.concat(F.coalesce("properties", F.array().cast(materials.schema["properties"].dataType)), added)).otherwise(F.col("properties"))).drop("_e")
