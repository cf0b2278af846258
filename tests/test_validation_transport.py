import pytest
from pyspark.sql import functions as F

from crysmill.operators import validation
from crysmill.plans import curation
from crysmill.sources import transport

REC = "material_id string, formula string, reduced_formula string, elements array<string>, dimensionality int, structure struct<lattice: array<array<double>>, species: array<string>, coords: array<array<double>>>, properties array<struct<name: string, source: string, method: string, confidence: double, uncertainty: double>>"
CELL = ([[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], ["Ti"], [[0.0, 0.0, 0.0]])


def test_rules(spark):
    rows = [
        ("a", "Ti2N2", "TiN", ["N", "Ti"], 3, CELL, [("density", "s", "dft", 0.5, 0.0), None]), ("b", "TiN", "AlN", ["Al"], 4, (CELL[0], [], CELL[2]), [(" ", None, "guess", 1.5, -1.0)]),
        (None, "Qq", None, None, None, None, None), ("c", "", None, [], None, ([[0.0] * 3] * 3, ["Ti"], [[0.0, 0.0, None]]), []), ("a", "TiN", None, None, 0, None, None),
    ]
    df = spark.createDataFrame(rows, REC)
    v = [sorted(r["violations"]) for r in validation.with_violations(df).collect()]
    assert v[0] == v[4] == []
    assert v[1] == sorted(["reduced_formula_differs", "elements_differ", "dimensionality_range", "species_empty", "coords_count", "property_name_empty", "property_source_empty", "property_method_unknown", "property_confidence_range", "property_uncertainty_negative"])
    assert v[2] == ["formula_invalid", "material_id_empty"] and v[3] == ["coords_shape", "formula_empty", "lattice_volume"]
    assert validation.lenient(df).count() == 2 and validation.lenient(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        validation.strict(df)


def test_query():
    q = transport.ConnectorQuery((" Ti ", "", "Ti"), max_records=250)
    assert q.elements == ("Ti",) and q.pages == 3
    with pytest.raises(ValueError):
        transport.ConnectorQuery(page_size=0)
    with pytest.warns(DeprecationWarning):
        assert transport.as_query(None, {"elements": ("N",)}).elements == ("N",)
    for query, legacy in ((q, {"elements": ()}), (None, {"colour": 1})):
        with pytest.raises(TypeError):
            transport.as_query(query, legacy)


def test_retries_and_cache():
    answers, waits, calls = [(503, {"Retry-After": "99"}, "x"), (500, {}, "x"), (200, {}, "ok")], [], []

    def send(method, url, **kw):
        calls.append(kw)
        return answers[min(len(calls) - 1, 2)]

    cache = transport.ResponseCache(1)
    policy = transport.Policy(retries=2, longest_wait=5)
    assert transport.request(send, "GET", "u", policy, cache, waits.append)[2] == "ok" and waits == [5, 1.0] and len(calls) == 3
    assert transport.request(send, "GET", "u", policy, cache, waits.append)[2] == "ok" and len(calls) == 3
    transport.request(send, "POST", "u", policy, cache, waits.append)
    transport.request(send, "GET", "v", policy, cache, waits.append)
    transport.request(send, "GET", "u", policy, cache, waits.append)
    assert len(calls) == 6
    with pytest.raises(ValueError):
        transport.Policy(retries=6)


def test_snapshot(spark):
    kinds = "row_no bigint, immutable_id string, elements array<string>, nelements int, nsites int, structure struct<lattice: array<array<double>>, species: array<string>, coords: array<array<double>>>, structure_fingerprint string"
    rows = [(i, f"i{i}", ["Ti", "N"] if i % 2 else ["Al", "N"], 2, 1, CELL, f"f{i // 2 if i < 4 else i}") for i in range(40)] + [(99, "i99", ["Ti", "N"], 2, 1, None, "f99"), (98, "i98", ["Fe", "N"], 2, 1, CELL, "f98")]
    hull = [(f"i{i}", 0.01 * i) for i in range(40)] + [("i5", float("nan")), ("i7", float("inf")), ("i39", None)]
    s = curation.snapshot(spark.createDataFrame(rows, kinds), spark.createDataFrame(hull, "immutable_id string, dft_hull double"))
    got = sorted(r["row_no"] for r in s.collect())
    assert got == [0, 2, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 17, 19]
    m = curation.manifest(s, len(rows))
    assert m["snapshot_count"] == 16 and m["groups"] == {"Al-N": 8, "Ti-N": 8} and m == curation.manifest(s.repartition(3), len(rows))


def test_cohort_and_forces(spark):
    rows = [(i, c, 0.01, 0.1) for i, c in enumerate(["Al-N"] * 8 + ["Ti-N"] * 8 + ["Ti-Al-N"] * 8)]
    kinds = "row_no int, chemistry string, dft_hull double, max_force double"
    assert curation.check_cohort(spark.createDataFrame(rows, kinds)).count() == 24
    for bad in (rows[1:], [*rows, (99, "Al-N", 0.0, 0.0)], [(i, c, 0.2, 0.1) for i, c, _, _ in rows]):
        with pytest.raises(ValueError):
            curation.check_cohort(spark.createDataFrame(bad, kinds))
    f = spark.createDataFrame([([[0.0, 1.0, 2.0]], 1), ([[0.0, float("nan"), 2.0]], 1), ([[0.0, 1.0]], 1), ([[0.0, 1.0, 2.0]], 2), (None, 1), ([None], 1)], "forces array<array<double>>, nsites int")
    assert [r[0] for r in f.select(curation.valid_forces(F.col("forces"), F.col("nsites"))).collect()] == [True, False, False, False, False, False]
