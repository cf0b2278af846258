import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from crysmill.functions.elements import ELECTRONEGATIVITY, MASSES, NUMBER, SYMBOLS, group_of
from crysmill.functions.formula import composition_key, flat_tokens, integer_ratio, parse, reduced
from crysmill.operators import units


def test_element_tables():
    assert len(SYMBOLS) == 118 and len(set(SYMBOLS)) == 118 and len(MASSES) == len(ELECTRONEGATIVITY) == 103
    assert NUMBER["Fe"] == 26 and MASSES["Au"] == pytest.approx(196.966569) and ELECTRONEGATIVITY["F"] == 3.98
    assert [group_of(s) for s in ("H", "He", "Na", "Al", "Ti", "La", "Hf", "Og")] == [1, 18, 1, 13, 4, 3, 4, 18]


@pytest.mark.parametrize("text,key", [
    ("Al2O3", "Al2O3"), ("O3 Al2", "Al2O3"), ("Al₂O₃", "Al2O3"), ("Al<sub>2</sub>O<sub>3</sub>", "Al2O3"), ("Al$_{2}$O$_{3}$", "Al2O3"), ("Al_4O_6", "Al2O3"),
    ("(AlN)2Ti2", "AlNTi"), ("Al0.5N0.5", "AlN"), ("((AlN)2Ti)3", "Al2N2Ti"), ("[TiN]2", "NTi"), ("Ti0.25Al1", "Al4Ti"),
    (None, None), ("", None), ("  ", None), ("n/a", None), ("unknown", None), ("-", None), ("Xx2", None), ("Ti0N", None), ("(TiN", None), ("TiN)2", None), ("al2o3", None),
])
def test_composition_key(text, key):
    assert composition_key(text) == key


def test_reduced_orders_by_electronegativity():
    assert reduced("N3Ti3") == "TiN" and reduced("O2") == "O2" and reduced("Fe4") == "Fe" and reduced("bad!") is None


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.sampled_from(SYMBOLS[:90]), st.integers(1, 9), min_size=1, max_size=5), st.integers(1, 5), st.randoms())
def test_key_ignores_order_and_scale(amounts, scale, rnd):
    items = list(amounts.items())
    rnd.shuffle(items)
    text = "(" + "".join(f"{k}{v}" for k, v in items) + f"){scale}"
    assert composition_key(text) == "".join(f"{k}{v if v > 1 else ''}" for k, v in sorted(integer_ratio(amounts).items()))
    assert parse(text) is not None


def test_flat_tokens(spark):
    row = spark.createDataFrame([("Al2.5O3N",)], "f string").select(flat_tokens(__import__("pyspark.sql.functions", fromlist=["col"]).col("f")).alias("t")).first()
    assert [(t["symbol"], t["amount"]) for t in row["t"]] == [("Al", 2.5), ("O", 3.0), ("N", 1.0)]


def test_graph_compiles_shortest_and_checks_cycles():
    g = units.compile_graph()
    assert g["Mbar"][2] == pytest.approx(100.0) and g["Pa"][2] == pytest.approx(1e-9) and g["degF"][1] == "K"
    assert g["degF"][2] * 212 + g["degF"][3] == pytest.approx(373.15)
    with pytest.raises(ValueError):
        units.compile_graph((*units.EDGES, ("kbar", "Pa", 2.0, 0.0)))
    with pytest.raises(ValueError):
        units.compile_graph((("x", "GPa", 0.0, 1.0),))


@pytest.mark.parametrize("text,number,unit", [
    ("~222.4 GPa", 222.4, "gpa"), ("[g/cm3] 4.567", 4.567, "g/cm3"), ("density = 1,234 kg/m^3", 1234.0, "kg/m3"), ("201.9 ± 4.048 GPa", 201.9, "gpa"), ("approx. 272.4 GPa (card 88)", 272.4, "gpa"),
    ("3.745000e+03 kilobar", 3745.0, "kilobar"), ("6.349000×10^3 g/L", 6349.0, "g/l"), ("66.2 10^9 Pa", 66.2, "gigapascal"), ("66.210^9 Pa", 66.2, "gigapascal"), ("[10⁹ Pa] 66.2", 66.2, "gigapascal"), ("5 10^-3 eV", 5.0, "milli-ev"), ("-1.7 eV atom-1", -1.7, "evatom-1"), ("138 200 000 000 N/m^2", 138.2e9, "n/m2"),
    ("7,85 g/cm^3", 7.85, "g/cm3"), ("12", 12.0, None), ("not measured", None, None), ("", None, None),
])
def test_text_parts(text, number, unit):
    n, u = units.text_parts(text)
    assert u == unit and (n is None if number is None else math.isclose(n, number))


@pytest.mark.parametrize("name,prop,unit", [("density_kg_m3", "density", "kg_m3"), ("rho (g/cm3)", "density", "g/cm3"), ("G_VRH / MPa", "shear_modulus", "mpa"), ("Bulk Modulus_gpa", "bulk_modulus", "gpa"), ("formation_energy_pa", "formation_energy_per_atom", None), ("eform [meV]", "formation_energy_per_atom", "mev"), ("novel thing", "novel_thing", None)])
def test_name_parts(name, prop, unit):
    assert units.name_parts(name) == (prop, unit)


def test_convert(spark):
    rows = [
        (1, 0, "density", 5000.0, None, None), (1, 1, "rho", None, "5 g/cm^3", ""), (1, 2, "K_VRH", 200000.0, None, None), (1, 3, "bulk_modulus", 2.0, None, "Mbar"), (1, 4, "band_gap", 1000.0, None, "meV"),
        (1, 5, "density", float("nan"), None, "kg/m^3"), (1, 6, "density", None, "n/a", "kg/m^3"), (1, 7, None, 5.0, None, "GPa"), (1, 8, "density", 1.0, None, "furlong"), (1, 9, "poisson_ratio", 0.3, None, None), (1, 10, None, None, None, None), (1, 11, "density", float("inf"), None, None),
    ]
    df = spark.createDataFrame(rows, "record_no bigint, prop_no int, name string, value double, value_text string, unit string")
    got = {r["prop_no"]: r for r in units.convert(df, spark, ("record_no", "prop_no")).collect()}
    assert set(got) == {0, 1, 2, 3, 4, 7, 8}
    assert got[0]["recorded_unit"] == "kg/m^3" and got[0]["unit_from"] == "size" and got[0]["common_value"] == pytest.approx(5.0)
    assert got[1]["recorded_unit"] == "g/cm^3" and got[1]["unit_from"] == "value_text" and got[2]["recorded_unit"] == "MPa"
    assert got[3]["common_value"] == pytest.approx(200.0) and got[4]["common_value"] == pytest.approx(1.0) and got[7]["quantity"] == "pressure"
    assert got[8]["recorded_unit"] == "unknown" and got[8]["common_value"] is None
    assert units.convert(df.limit(0), spark, ("record_no", "prop_no")).count() == 0


def test_letter_case_tells_prefixes(spark):
    rows = [(1, i, "bulk_modulus", 5.0, None, u) for i, u in enumerate(("mbar", "Mbar", "MBAR", "mPa", "MPa", "mpa", "kPa", "hPa", "bar"))]
    rows += [(2, i, "density", 5.0, None, u) for i, u in enumerate(("mg/m3", "Mg/m^3", "mg/cm^3", "mg m-3", "MG/M3"))]
    rows += [(3, i, "band_gap", 5.0, None, u) for i, u in enumerate(("MeV", "meV", "mev", "MEV"))]
    rows += [(4, 0, "bulk_modulus", None, "5 mPa", None), (4, 1, "bulk_modulus", None, "5 mbar", None), (4, 2, "density", None, "5 mg/m^3", None), (4, 5, "bulk_modulus", None, "5 Mbar", None), (4, 6, "density", None, "5 Mg/m^3", None), (4, 3, "K (mPa)", 5.0, None, None), (4, 4, "kvrh_mpa", 5.0, None, None)]
    df = spark.createDataFrame(rows, "record_no int, prop_no int, name string, value double, value_text string, unit string")
    got = {(r["record_no"], r["prop_no"]): r["common_value"] for r in units.convert(df, spark, ("record_no", "prop_no")).collect()}
    want = [(1, (5e-7, 500.0, 500.0, 5e-12, 5e-3, 5e-3, 5e-6, 5e-7, 5e-4)), (2, (5e-9, 5.0, 5e-3, 5e-9, 5.0)), (3, (5e6, 5e-3, 5e-3, 5e-3)), (4, (5e-12, 5e-7, 5e-9, 5e-12, 5e-3, 500.0, 5.0))]
    for no, values in want:
        for i, v in enumerate(values):
            assert got[no, i] == pytest.approx(v), (no, i)
