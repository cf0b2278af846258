"""Record validation as one ``violations`` column; rules apply to the columns and fields that a table has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.formula import composition_key_udf, formula_elements_udf
from .normalize import structure_faults

METHODS = ("dft", "experimental", "model_predicted", "derived", "unknown")


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


def _outside(c: Column, lo: float, hi: float | None) -> Column:
    bad = F.isnan(c) | (c < lo)
    return F.coalesce(bad | (c > hi) if hi is not None else bad, F.lit(False))


def _entry_rules(fields: set[str], e: Column, what: str) -> list[Column]:
    rules = []
    if "name" in fields:
        rules.append(F.when(_blank(e["name"]), f"{what}_name_empty"))
    if "source" in fields:
        rules.append(F.when(_blank(e["source"]), f"{what}_source_empty"))
    if "method" in fields:
        rules.append(F.when(~e["method"].isin(*METHODS), f"{what}_method_unknown"))
    if "confidence" in fields:
        rules.append(F.when(_outside(e["confidence"], 0.0, 1.0), f"{what}_confidence_range"))
    if "uncertainty" in fields:
        rules.append(F.when(_outside(e["uncertainty"], 0.0, None), f"{what}_uncertainty_negative"))
    return rules


def _entry_violations(c: str, fields: set[str], what: str) -> Column:
    return F.flatten(F.transform(F.filter(c, lambda e: e.isNotNull()), lambda e: F.array(*_entry_rules(fields, e, what))))


def with_violations(df: DataFrame) -> DataFrame:
    """Adds ``violations`` ARRAY<STRING>, empty for valid records. Null lists and null entries break no rule."""
    cols = set(df.columns)
    parts = [F.array(F.when(_blank(F.col(c).cast("string")), f"{c}_empty")) for c in ("material_id", "formula") if c in cols]
    added = []
    if "dimensionality" in cols:
        parts.append(F.array(F.when(_outside(F.col("dimensionality").cast("double"), 0.0, 3.0), "dimensionality_range")))
    if "formula" in cols:
        df, added = df.withColumns({"_key": composition_key_udf("formula"), "_els": formula_elements_udf("formula")}), ["_key", "_els"]
        parts.append(F.array(F.when(~_blank(F.col("formula")) & F.col("_key").isNull(), "formula_invalid")))
        if "reduced_formula" in cols:
            df, added = df.withColumn("_reduced", composition_key_udf("reduced_formula")), [*added, "_reduced"]
            parts.append(F.array(F.when(~_blank(F.col("reduced_formula")) & ~F.col("_reduced").eqNullSafe(F.col("_key")), "reduced_formula_differs")))
        if "elements" in cols:
            parts.append(F.array(F.when((F.size("elements") > 0) & (F.array_sort(F.array_distinct("elements")) != F.col("_els")), "elements_differ")))
    if "structure" in cols and isinstance(df.schema["structure"].dataType, T.StructType):
        parts.append(F.coalesce(structure_faults(F.col("structure")), F.array().cast("array<string>")))
    for c, what in (("properties", "property"), ("provenance", "provenance")):
        if c in cols and isinstance(df.schema[c].dataType, T.ArrayType) and isinstance(df.schema[c].dataType.elementType, T.StructType):
            fields = {f.name for f in df.schema[c].dataType.elementType.fields}
            if not fields & {"name", "source", "method", "confidence", "uncertainty"}:
                continue
            parts.append(F.coalesce(_entry_violations(c, fields, what), F.array().cast("array<string>")))
    return df.withColumn("violations", F.array_distinct(F.array_compact(F.concat(*parts)))).drop(*added)


def strict(df: DataFrame) -> DataFrame:
    """The table as it is, or ValueError where a record breaks a rule."""
    n = with_violations(df).where(F.size("violations") > 0).limit(1).count()
    if n:
        raise ValueError("invalid records; see with_violations")
    return df


def lenient(df: DataFrame) -> DataFrame:
    """Valid records only."""
    return with_violations(df).where(F.size("violations") == 0).drop("violations")
