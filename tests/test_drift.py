import datetime
import json

from crysmill.operators import drift

SCHEMA = "file_no bigint, feed string, file_name string, written_at timestamp, line_no int, payload string, key string"


def lines(spark, files):
    rows = []
    for no, (feed, day, records) in files.items():
        for i, r in enumerate(records):
            rows.append((no, feed, f"{feed}/{no}", datetime.datetime(2024, 1, day), i + 1, r if r is None or isinstance(r, str) else json.dumps(r), "clash"))
    return spark.createDataFrame(rows, SCHEMA)


def found(df):
    return sorted((r["file_no"], r["field_name"], r["change"]) for r in drift.changes(df).collect())


def test_added_removed_renamed_retyped(spark):
    one = {"material_id": "a", "formula": "TiN", "density": 5.0, "functional": "PBE", "note": "x"}
    two = {"material_id": "a", "Formula": "TiN", "rho": "5.0", "functional": None, "run_hash": "ff"}
    df = lines(spark, {7: ("f", 1, [one, {**one, "density": None}, None, "no json", "[1]"]), 3: ("f", 2, [two, {**two, "nsites": 3}]), 5: ("g", 3, [one])})
    assert found(df) == [(3, "density", "renamed"), (3, "density", "retyped"), (3, "formula", "renamed"), (3, "functional", "removed"), (3, "note", "removed"), (3, "nsites", "added"), (3, "run_hash", "added")]


def test_type_is_that_of_most_values_and_ties_are_fixed(spark):
    a = [{"x": 1}, {"x": 2}, {"x": "3"}]
    b = [{"x": "1"}, {"x": 2}]
    assert found(lines(spark, {1: ("f", 1, a), 2: ("f", 2, b)})) == [(2, "x", "retyped")]


def test_unknown_name_is_learned_from_repeated_records(spark):
    before = [{"material_id": f"m{i}", "structure_fingerprint": f"{i:016x}"} for i in range(6)]
    after = [{"material_id": f"m{i}", "zz": {"value": f"{i:016x}", "scheme": "s"}, "run_hash": f"{i + 99:016x}"} for i in range(6)]
    assert found(lines(spark, {1: ("f", 1, before), 2: ("f", 2, after)})) == [(2, "run_hash", "added"), (2, "structure_fingerprint", "renamed"), (2, "structure_fingerprint", "retyped")]


def test_names_are_learned_in_both_directions_and_over_other_names(spark):
    ids = range(6)
    print_of = lambda i: f"{i * 7919:016x}"
    one = [{"material_id": f"m{i}", "zz": print_of(i), "n1": f"note {i}", "flag": "x"} for i in ids]
    two = [{"material_id": f"m{i}", "yy": print_of(i).upper(), "n2": f"note {i}", "mark": "x"} for i in ids]
    three = [{"material_id": f"m{i}", "structure_fingerprint": print_of(i), "n2": f"note {i}", "mark": "x", "run_hash": f"{i + 99:016x}"} for i in ids]
    df = lines(spark, {1: ("f", 1, one), 2: ("f", 2, two), 3: ("f", 3, three)})
    # a constant alone ties no two unknown names
    assert found(df) == [(2, "flag", "removed"), (2, "mark", "added"), (2, "n1", "renamed"), (2, "structure_fingerprint", "renamed"), (3, "run_hash", "added"), (3, "structure_fingerprint", "renamed")]
    kept = {(r["file_no"], r["material_id"]): r["structure_fingerprint"] for r in drift.consistent(df).collect()}
    assert all(kept[n, f"m{i}"].lower() == print_of(i) for n in (1, 2, 3) for i in ids)


def test_consistent_table_and_versions(spark):
    df = lines(spark, {1: ("f", 1, [{"material_id": "a", "chem": {"Ti": 1, "N": 2}, "species_set": "Ti-N", "xc": ["PBE"], "rho": "4.5", "nsites": "n/a"}, None]), 2: ("f", 2, [{"material_id": "b", "formula": ["Ti1", "N1"], "elements": ["Ti"], "functional": {"name": "SCAN"}, "energy_above_hull": {"value": 0.1, "unit": "eV"}}])})
    rows = {r["file_no"] * 10 + r["line_no"]: r for r in drift.consistent(df).collect()}
    assert rows[11]["formula"] == "Ti1N2" and rows[11]["elements"] == ["Ti", "N"] and rows[11]["functional"] == "PBE" and rows[11]["density"] == 4.5 and rows[11]["nsites"] is None
    assert rows[21]["formula"] == "Ti1N1" and rows[21]["functional"] == "SCAN" and rows[21]["energy_above_hull"] == 0.1 and rows[12]["material_id"] is None
    assert sorted((r["file_no"], r["version"]) for r in drift.versions(df).collect()) == [(1, 1), (2, 2)]


def test_content_beats_other_names(spark):
    # "level" and "rho" carry something else here; content tells what, and nothing is led to a column by name alone
    one = [{"material_id": f"m{i}", "functional": f"F{i}", "nsites": i + 3} for i in range(6)]
    two = [{"material_id": f"m{i}", "rho": f"F{i}", "level": i + 3} for i in range(6)]
    assert found(lines(spark, {1: ("f", 1, one), 2: ("f", 2, two)})) == [(2, "functional", "renamed"), (2, "nsites", "renamed")]
    rows = drift.consistent(lines(spark, {1: ("f", 1, one), 2: ("f", 2, two)})).where("file_no = 2").collect()
    assert {(r["functional"], r["nsites"], r["density"]) for r in rows} == {(f"F{i}", i + 3, None) for i in range(6)}


def test_steps_by_version_and_lost_values(spark):
    one = [{"material_id": f"m{i}", "density": 1.0 + i, "nsites": 4} for i in range(5)]
    two = [{"material_id": f"m{i}", "mass": str(1.0 + i), "nsites": 4} for i in range(4)] + [{"material_id": "m9", "mass": "heavy", "nsites": "n/a"}]
    df = lines(spark, {1: ("f", 1, one), 2: ("f", 2, one), 3: ("f", 3, two), 4: ("g", 1, two)})
    assert sorted((r["file_no"], r["version"]) for r in drift.versions(df).collect()) == [(1, 1), (2, 1), (3, 2), (4, 1)]
    got = sorted((r["feed"], r["version"], r["field_name"], r["step"], r["key_before"], r["key_now"]) for r in drift.steps(df).collect())
    assert got == [("f", 2, "density", "cast", "density", "mass"), ("f", 2, "density", "rename", "density", "mass")]
    odd = {(r["file_no"], r["field_name"]): (r["n_values"], r["n_odd_type"], r["n_failed"]) for r in drift.odd_values(df).collect()}
    assert odd == {(3, "density"): (5, 0, 1), (3, "nsites"): (5, 1, 0), (4, "density"): (5, 0, 1), (4, "nsites"): (5, 1, 0)}


def test_empty(spark):
    df = lines(spark, {})
    assert found(df) == [] and drift.consistent(df).count() == 0 and drift.versions(df).count() == drift.steps(df).count() == drift.odd_values(df).count() == 0
