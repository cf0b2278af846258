"""Quantities in mixed units to common ones.

Conversions are edges of a graph with affine functions (y = a x + b). ``compile_graph`` walks it once on the driver:
it takes the shortest composition from every unit to the common unit of its quantity and checks that every cycle comes
back to where it began. The result, one row for each unit, is a small fixed table that records are equi-joined with.

A record's unit is looked for in its unit column, else in its text value, else in its name; each spelling is brought to
one normal form first. Without any unit, the size of the number decides where only one unit is plausible.

Edge cases: null, NaN and infinite numbers and texts without a number hold no value; a value beside a text wins;
unknown units give a null factor and are reported as ``unknown``; units of another quantity than the name's are
ignored; null entries and null lists give no rows.
"""

from __future__ import annotations

import re
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import ALIASES

# Conversions (from, to, a, b) with to = a * from + b.
EDGES = (
    ("kg/m^3", "g/cm^3", 1e-3, 0.0),
    ("lb/ft^3", "kg/m^3", 16.01846337396014, 0.0),
    ("lb/ft^3", "g/cm^3", 0.01601846337396014, 0.0),
    ("MPa", "GPa", 1e-3, 0.0),
    ("Pa", "MPa", 1e-6, 0.0),
    ("TPa", "GPa", 1e3, 0.0),
    ("kbar", "GPa", 0.1, 0.0),
    ("Mbar", "kbar", 1e3, 0.0),
    ("Mbar", "TPa", 0.1, 0.0),
    ("kbar", "MPa", 100.0, 0.0),
    ("bar", "Pa", 1e5, 0.0),
    ("mbar", "bar", 1e-3, 0.0),
    ("mPa", "Pa", 1e-3, 0.0),
    ("kPa", "Pa", 1e3, 0.0),
    ("mg/m^3", "kg/m^3", 1e-6, 0.0),
    ("MeV", "eV", 1e6, 0.0),
    ("meV", "eV", 1e-3, 0.0),
    ("kJ/mol", "eV", 1 / 96.485332123, 0.0),
    ("J/mol", "kJ/mol", 1e-3, 0.0),
    ("J/mol", "eV", 1 / 96485.332123, 0.0),
    ("Ry", "eV", 13.6056980659, 0.0),
    ("Hartree", "Ry", 2.0, 0.0),
    ("nm", "angstrom", 10.0, 0.0),
    ("bohr", "angstrom", 0.529177210903, 0.0),
    ("degC", "K", 1.0, 273.15),
    ("degF", "degC", 5 / 9, -160 / 9),
)
COMMON = {"density": "g/cm^3", "pressure": "GPa", "energy": "eV", "length": "angstrom", "temperature": "K"}
QUANTITY = {
    "density": "density", "bulk_modulus": "pressure", "shear_modulus": "pressure", "youngs_modulus": "pressure",
    "formation_energy_per_atom": "energy", "energy_above_hull": "energy", "band_gap": "energy",
}

# Spellings of each unit, in lower case without blanks, "^" and dots.
SPELLINGS = {
    "g/cm^3": "g/cm3 gcm-3 g/ml gml-1 g/cc gcc-1 kg/l kgl-1 mg/m3 mgm-3 gram/cubiccentimetre gram/cubiccentimeter grams/cubiccentimetre grams/cubiccentimeter g_cm3 t/m3",
    "kg/m^3": "kg/m3 kgm-3 g/l gl-1 mg/cm3 mgcm-3 mg/ml kilogram/cubicmetre kilogram/cubicmeter kilograms/cubicmetre kilograms/cubicmeter kg_m3",
    "lb/ft^3": "lb/ft3 lbft-3 lbs/ft3 lbs/cubicfoot lb/cubicfoot pound/cubicfoot pounds/cubicfoot pcf lb_ft3",
    "mg/m^3": "milligram/m3 milligramm-3",
    "mPa": "millipascal millipascals",
    "kPa": "kpa kilopascal kilopascals",
    "mbar": "millibar millibars hpa hectopascal hectopascals",
    "bar": "bar bars",
    "GPa": "gpa gigapascal gigapascals 109pa kn/mm2 knmm-2",
    "MPa": "mpa megapascal megapascals 106pa n/mm2 nmm-2",
    "kbar": "kbar kilobar kilobars",
    "Pa": "pa pascal pascals n/m2 nm-2",
    "TPa": "tpa terapascal terapascals 1012pa",
    "Mbar": "mbar megabar megabars",
    "eV": "ev electronvolt electronvolts",
    "meV": "mev milli-ev millielectronvolt millielectronvolts milli-electronvolt 10-3ev",
    "MeV": "megaelectronvolt megaelectronvolts",
    "kJ/mol": "kj/mol kjmol-1 kj_mol kilojoule/mole",
    "J/mol": "j/mol jmol-1 j_mol joule/mole",
    "Ry": "ry rydberg rydbergs",
    "Hartree": "ha hartree hartrees eh",
    "angstrom": "angstrom angstroms å",
    "nm": "nm nanometre nanometer",
    "bohr": "bohr",
    "K": "k kelvin",
    "degC": "degc °c celsius",
    "degF": "degf °f fahrenheit",
}
PER_ATOM = ("", "/atom", "atom-1", "_atom", "/at", "_per_atom")


# Spellings whose letter case tells a prefix apart; in one case throughout ("mpa", "MEV") it tells nothing,
# and the prefix that the quantity is recorded with holds.
PREFIXES = (
    (r"(?<![A-Za-z])mPa(?![A-Za-z])", "millipascal"),
    (r"(?<![A-Za-z])m[bB]ar(?![A-Za-z])", "millibar"),
    (r"(?<![A-Za-z])MeV(?![A-Za-z])", "megaelectronvolt"),
    (r"(?<![A-Za-z])mg(?=\s*(?:/|per |[·⋅* ])\s*m\s*[\^³3⁻-])", "milligram"),
)
_PREFIXES = tuple((re.compile(p), word) for p, word in PREFIXES)


def marked(text: str) -> str:
    """The text with the prefixes that only letter case tells apart written out."""
    for p, word in _PREFIXES:
        text = p.sub(word, text)
    return text


def normal(text: Column) -> Column:
    """Normal form of a unit's spelling: lower case, plain digits, no blanks, "^" or dots, "/" for "per"."""
    for p, word in PREFIXES:
        text = F.regexp_replace(text, p, word)
    plain = F.translate(F.lower(text), "⁰¹²³⁴⁵⁶⁷⁸⁹⁻−·⋅*^ \t\n ", "0123456789--")
    return F.regexp_replace(F.regexp_replace(plain, "(?<=[a-z0-9-])per(?=[a-z])", "/"), r"^\[(.*)\]$", "$1")


def compile_graph(edges=EDGES, common=COMMON) -> dict[str, tuple[str, str, float, float]]:
    """unit -> (quantity, common unit, a, b); raises ValueError where a cycle of conversions doesn't close."""
    near: dict[str, list[tuple[str, float, float]]] = {}
    for u, v, a, b in edges:
        if not a:
            raise ValueError(f"{u} -> {v} can't be undone")
        near.setdefault(v, []).append((u, a, b))
        near.setdefault(u, []).append((v, 1 / a, -b / a))
    out = {}
    for quantity, goal in common.items():
        found = {goal: (1.0, 0.0)}
        queue = deque([goal])
        while queue:
            v = queue.popleft()
            a0, b0 = found[v]
            for u, a, b in near.get(v, ()):  # x in u is a x + b in v
                ab = (a0 * a, a0 * b + b0)
                if u not in found:
                    found[u] = ab
                    queue.append(u)
                elif abs(ab[0] - found[u][0]) > 1e-6 * abs(found[u][0]) or abs(ab[1] - found[u][1]) > 1e-6 * max(1.0, abs(found[u][1])):
                    raise ValueError(f"conversions between {u} and {goal} disagree: {ab} and {found[u]}")
        for u, (a, b) in found.items():
            if u in out:
                raise ValueError(f"{u} belongs to two quantities")
            out[u] = (quantity, goal, a, b)
    return out


def spelling_table() -> list[tuple[str, str, str, str, float, float]]:
    """(spelling, quantity, unit, common unit, a, b); a fixed table of under 200 rows."""
    graph = compile_graph()
    rows = []
    for unit, words in SPELLINGS.items():
        quantity, goal, a, b = graph[unit]
        for w in dict.fromkeys(words.split()):
            rows += [(w + tail, quantity, unit, goal, a, b) for tail in (PER_ATOM if quantity == "energy" else ("",))]
    return rows


_BLANKS = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁻−", "0123456789--", "·⋅*^ \t\n\u00a0")
_BLANKS_KEPT = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁻−", "0123456789--")
_TAILS = sorted({w for words in SPELLINGS.values() for w in words.split() if re.fullmatch(r"[a-z_0-9]{2,}", w)} | {w + "_per_atom" for w in ("ev", "mev", "ry", "ha", "kj_mol")}, key=lambda w: (-len(w), w))
_UNDER = re.compile("(.+?)_(" + "|".join(_TAILS) + ")$", re.IGNORECASE)
_BRACKET = re.compile(r"(.*?)\s*[(\[]\s*([^()\[\]]+?)\s*[)\]]\s*$", re.DOTALL)
_SLASH = re.compile(r"(.*?)\s+/\s+(\S.*)$", re.DOTALL)
_NUMBER = r"[-+]?(?:\d[\d,]*\.?\d*|(?<![a-z])\.\d+)(?:e[-+]?\d+)?"
# powers of ten that belong to the unit, told by their exponent's mark
_SCALED = tuple((re.compile(pattern, re.IGNORECASE), word) for pattern, word in ((r"10(?:\^9|⁹)\s*pa\b", " gigapascal"), (r"10(?:\^6|⁶)\s*pa\b", " megapascal"), (r"10(?:\^12|¹²)\s*pa\b", " terapascal"), (r"10(?:\^-3|⁻³)\s*ev\b", " milli-ev")))
_POWER = re.compile(r"\s*[x×]\s*10\^?([-+]?\d+)")
_WORDS = "|".join(re.escape(w) for w in sorted({w + t for u, ws in SPELLINGS.items() for w in ws.split() if len(w) > 1 or u == "K" for t in (PER_ATOM if u in ("eV", "meV", "MeV", "Ry", "Hartree", "kJ/mol", "J/mol") else ("",))}, key=lambda w: (-len(w), w)))
_BEFORE = re.compile(rf"\[({_WORDS})\]\D{{0,12}}?({_NUMBER})")
_AFTER = re.compile(rf"({_NUMBER}?)(?:(?:±|\+/-|\+-){_NUMBER}?|\({_NUMBER}\))?({_WORDS})(?![a-z/0-9])")
_ALONE = re.compile(rf"^\D{{0,16}}?({_NUMBER})")


def plain(text: str) -> str:
    """``normal`` for one text whose prefixes are marked."""
    s = re.sub(r"(?<=[a-z0-9-])per(?=[a-z])", "/", text.lower().translate(_BLANKS))
    return s[1:-1] if s.startswith("[") and s.endswith("]") and "[" not in s[1:] else s


def name_parts(name: str) -> tuple[str, str | None]:
    """(canonical property, unit's spelling or None) of names like "rho (g/cm3)", "G / MPa" and "density_kg_m3"."""
    text = name.strip()
    unit = None
    if _spelled(text) not in ALIASES:
        m = _BRACKET.match(text) or _SLASH.match(text) or _UNDER.match(text)
        if m and m[1].strip():
            # names with underscores are in lower case throughout
            text, unit = m[1], plain(m[2] if m.re is _UNDER else marked(m[2]))
    key = _spelled(text)
    return ALIASES.get(key, key), unit


_NAMED = T.StructType([T.StructField("property", T.StringType()), T.StructField("unit", T.StringType())])
_SPOKEN = T.StructType([T.StructField("number", T.DoubleType()), T.StructField("unit", T.StringType())])


def _spelled(text: str) -> str:
    return text.strip().lower().replace("-", "_").replace(" ", "_")


def text_parts(text: str) -> tuple[float | None, str | None]:
    """(number, unit's spelling or None) of texts like "~222.4 GPa", "[g/cm3] 4.567" and "rho = 1,234 kg/m^3"."""
    s = marked(text.split("=", 1)[-1])
    for pattern, word in _SCALED:
        s = pattern.sub(word, s)
    s = s.lower().translate(_BLANKS_KEPT)
    s = plain(_POWER.sub(r"e\1", s))
    m = _BEFORE.search(s)
    if m:
        unit, digits = m[1], m[2]
    else:
        m = _AFTER.search(s)
        if m:
            digits, unit = m[1], m[2]
        else:
            m = _ALONE.match(s)
            if not m:
                return None, None
            digits, unit = m[1], None
    if re.fullmatch(r"[-+]?\d{1,3}(,\d{3})+(\.\d*)?(e[-+]?\d+)?", digits):
        digits = digits.replace(",", "")
    try:
        return float(digits.replace(",", ".")), unit
    except ValueError:
        return None, unit


@F.pandas_udf(_NAMED)
def _names(values: pd.Series) -> pd.DataFrame:
    known = {v: name_parts(v) for v in values.dropna().unique()}
    return pd.DataFrame([known.get(v, (None, None)) if isinstance(v, str) else (None, None) for v in values], columns=["property", "unit"])


@F.pandas_udf(_SPOKEN)
def _texts(values: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_parts(v) if isinstance(v, str) else (None, None) for v in values], columns=["number", "unit"]).astype({"number": "float64"})


def _finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def by_size(quantity: Column, x: Column) -> Column:
    """The unit that the size of a number without any unit plainly calls for."""
    size = F.abs(x)
    density = F.when(size < 60, "g/cm^3").otherwise("kg/m^3")
    pressure = F.when(size < 2e3, "GPa").when(size < 1e7, "MPa").otherwise("Pa")
    return F.when(quantity == "density", density).when(quantity == "pressure", pressure).when(quantity == "energy", "eV")


def convert(entries: DataFrame, spark: SparkSession, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` columns, property, quantity, recorded_value, recorded_unit, unit_from, common_value, common_unit.

    ``entries`` has name, value, value_text and unit. One row for each entry that holds a value of a known quantity.
    """
    quantity = F.create_map(*[F.lit(x) for kv in QUANTITY.items() for x in kv])
    read = entries.withColumns({"_name": _names("name"), "_text": _texts("value_text")})
    v = read.select(*keep, F.col("_name.property").alias("property"), F.element_at(quantity, F.col("_name.property")).alias("_q"), _finite(F.col("value")).alias("_v"), _finite(F.col("_text.number")).alias("_n"), normal(F.col("unit")).alias("_u1"), F.col("_text.unit").alias("_u2"), F.col("_name.unit").alias("_u3"))
    v = v.withColumn("recorded_value", F.coalesce("_v", "_n")).where("recorded_value IS NOT NULL")
    units = F.broadcast(spark.createDataFrame(spelling_table(), "spelling STRING, quantity STRING, unit STRING, common STRING, a DOUBLE, b DOUBLE").coalesce(1))
    for i in (1, 2, 3):
        side = units.select(F.col("spelling").alias(f"_s{i}"), F.col("quantity").alias(f"_q{i}"), F.col("unit").alias(f"_r{i}"))
        v = v.join(side, F.col(f"_u{i}") == F.col(f"_s{i}"), "left")
    quantity = F.coalesce("_q", "_q1", "_q2", "_q3")
    fits = [F.when(F.col(f"_q{i}") == F.col("_quantity"), F.col(f"_r{i}")) for i in (1, 2, 3)]
    given = F.coalesce(*[F.when(F.col(f"_u{i}") != "", F.lit(True)) for i in (1, 2, 3)], F.lit(False))
    v = v.withColumn("_quantity", quantity).where("_quantity IS NOT NULL")
    v = v.withColumn("recorded_unit", F.coalesce(*fits, F.when(~given, by_size(F.col("_quantity"), F.col("recorded_value"))), F.lit("unknown")))
    source = F.when(fits[0].isNotNull(), "unit").when(fits[1].isNotNull(), "value_text").when(fits[2].isNotNull(), "name").when(~given, "size")
    v = v.withColumn("unit_from", source)
    factors = F.broadcast(spark.createDataFrame([(u, g, a, b) for u, (_, g, a, b) in compile_graph().items()], "recorded_unit STRING, common_unit STRING, a DOUBLE, b DOUBLE").coalesce(1))
    return v.join(factors, "recorded_unit", "left").select(*keep, "property", F.col("_quantity").alias("quantity"), "recorded_value", "recorded_unit", "unit_from", (F.col("recorded_value") * F.col("a") + F.col("b")).alias("common_value"), "common_unit")


def property_entries(materials: DataFrame) -> DataFrame:
    """(record_no, material_id, prop_no, name, value, value_text, unit) of every non-null entry."""
    e = materials.select("record_no", "material_id", F.posexplode("properties").alias("prop_no", "p")).where("p IS NOT NULL")
    return e.select("record_no", "material_id", "prop_no", "p.name", "p.value", "p.value_text", "p.unit")
