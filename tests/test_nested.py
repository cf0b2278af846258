import json

from crysmill.operators import nested

MAT = "record_no bigint, material_id string, structure struct<lattice: array<array<double>>, species: array<string>, coords: array<array<double>>, site_properties: string>, properties array<struct<name: string, value: double>>, parent string, child_no string"
RES = "artifact_no bigint, result string, parent_table string"


def links(spark, mats, results):
    out = nested.child_links(spark.createDataFrame(mats, MAT), spark.createDataFrame(results, RES)).collect()
    return sorted((r["parent_table"], r["parent_no"], r["child_kind"], r["child_no"]) for r in out)


def test_every_form_of_writing(spark):
    L = [[1.0, 0, 0], [0, 1.0, 0], [0, 0, 1.0]]
    forms = [
        {"relaxed_structure": {"lattice": L, "species": ["A", "B"], "coords": [[0, 0, 0], [0.5, 0.5, 0.5]]}, "trajectory": [{"step": 0}, None, {"step": 4}, {"step": 4}]},
        {"relaxed_structure": {"lattice": [x for r in L for x in r], "coords": [0, 0, 0, 0.5, 0.5, 0.5]}, "trajectory": {"0": {"volume": 1}, "7": {"volume": 2}}},
        {"relaxed_structure": {"lattice": {"a": L[0], "b": L[1], "c": L[2]}, "coords": [{"x": 0, "y": 0, "z": 0}, None, {"x": 1, "y": 1, "z": 1}]}, "trajectory": {"step": [0, 4], "volume": [1, 2]}},
        {"relaxed_structure": {"lattice": {"matrix": L}, "sites": [{"species": "A", "coords": [0, 0, 0]}, {"species": "B"}]}, "trajectory": {"step": 3, "volume": 1}},
        {"relaxed_structure": json.dumps({"lattice": L, "coords": [[0, 0, 0]]}), "trajectory": json.dumps([{"volume": 1}])},
        {"relaxed_structure": None, "trajectory": []}, {},
    ]
    res = [(i, json.dumps(f), "x") for i, f in enumerate(forms)] + [(90, None, None), (91, "null", None), (92, "not json", None), (93, "[1]", None), (94, '"t"', None)]
    got = links(spark, [], res)
    by = {i: [(k, n) for _, p, k, n in got if p == i] for i in range(len(forms))}
    lattice = [("lattice", 0), ("lattice", 1), ("lattice", 2)]
    assert by[0] == [*lattice, ("site", 0), ("site", 1), ("step", 0), ("step", 4)]
    assert by[1] == [*lattice, ("site", 0), ("site", 1), ("step", 0), ("step", 7)]
    assert by[2] == [*lattice, ("site", 0), ("site", 2), ("step", 0), ("step", 4)]
    assert by[3] == [*lattice, ("site", 0), ("step", 3)]
    assert by[4] == [*lattice, ("site", 0), ("step", 0)]
    assert by[5] == by[6] == [] and all(p < 90 for _, p, _, _ in got)


def test_materials_nulls_repeats_and_clashing_columns(spark):
    s = ([[1.0, 0.0, 0.0], None, [0.0, 0.0, 1.0]], ["A"], [[0.0, 0.0, 0.0], None, [0.1, None, 0.2]], None)
    rows = [(1, "m", s, [("d", 1.0), None, ("e", None)], "p", "q"), (2, "m", s, [], None, None), (3, None, None, None, None, None), (4, "m", (None, None, None, None), None, None, None)]
    got = links(spark, rows, [])
    assert [(p, k, n) for _, p, k, n in got] == [(1, "lattice", 0), (1, "lattice", 2), (1, "property", 0), (1, "property", 2), (1, "site", 0), (2, "lattice", 0), (2, "lattice", 2), (2, "site", 0)]
    assert links(spark, [], []) == []


def test_child_tables_carry_values(spark):
    s = ([[1.0, 2.0, 3.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], ["Ti", "N"], [[0.0, 0.0, 0.0], [0.5, 0.25, 0.75]], None)
    n = nested.normalized_materials(spark.createDataFrame([(9, "m", s, [("d", 4.0)], None, None)], MAT))
    site = nested.flatten(n, "key", "site").orderBy("child_no").collect()
    assert [(r["parent"], r["species"], r["z"]) for r in site] == [(9, "Ti", 0.0), (9, "N", 0.75)]
    assert nested.flatten(n, "key", "lattice").where("child_no = 0").first()["z"] == 3.0
    assert nested.flatten(n, "key", "property").first()["value"] == 4.0


def test_maps_of_properties_have_rows_of_their_own(spark, tmp_path):
    from crysmill.plans.core_problems import QUERIES

    kinds = "record_no bigint, structure struct<lattice: array<array<double>>, species: array<string>, coords: array<array<double>>, site_properties: string>, properties array<struct<name: string, extra: map<string, double>>>"
    rows = [(1, None, [("d", {"a": 1.0, "b": None}), None, ("e", None), ("f", {})]), (2, None, None), (3, None, []), (4, None, [("g", None), ("h", {"c": 2.5})])]
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/materials_sample.parquet")
    got = sorted((r["record_no"], r["child_no"], r["key"], r["value"]) for r in QUERIES["p2_extras"](spark, str(tmp_path)).collect())
    assert got == [(1, 0, "a", 1.0), (1, 0, "b", None), (4, 1, "c", 2.5)]


def test_offsets_hold_in_large_batches(spark):
    df = spark.range(30_000).selectExpr("id AS key", "transform(sequence(1, int(id % 4)), x -> named_struct('v', id * 10 + x)) AS xs", "1 AS one").selectExpr("key", "CASE WHEN key % 4 = 0 THEN NULL ELSE xs END AS xs")
    out = nested.flatten(df, "key", "xs")
    assert out.count() == sum(i % 4 for i in range(30_000)) and out.where("v <> parent * 10 + child_no + 1").count() == 0
