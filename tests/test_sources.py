import json

import pytest
from pyspark.sql import functions as F

from crysmill.plans import cookbook, registry
from crysmill.sources import catalog, connectors, importer, readers
from crysmill.streaming import feeds


def lines(spark, texts):
    return spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "row_no bigint, line string")


def test_tolerant_decoder(spark, tmp_path):
    recs = [{"material_id": "a", "formula": "TiN", "reduced_formula": "", "other": 1, "properties": [{"name": "density", "value": 5.4, "note": "n", "extra": {"k": "v"}}]}, {"material_id": "b", "formula": "AlN"}]
    (tmp_path / "m.jsonl").write_text("\n".join([json.dumps(recs[0]), "", "  ", json.dumps(recs[1]), "oops"]) + "\n")
    got = readers.from_jsonl(spark, str(tmp_path / "m.jsonl")).collect()
    assert len(got) == 3 and got[0]["reduced_formula"] == "TiN" and got[0]["properties"][0]["extra"] == {"k": "v", "note": "n"} and got[0]["properties"][0]["value"] == "5.4"
    assert got[1]["properties"] is None and got[2]["material_id"] is None
    assert readers.text_lines(spark, "a\n\nb\nc", 3).count() == 2


def test_wide_csv(spark, tmp_path):
    (tmp_path / "p.csv").write_text('material_id,formula,density,label,structure_json\na,TiN,5.4,"x, y","{}"\nb,AlN,,z,\n')
    got = {(r["material_id"], r["name"]): (r["value"], r["value_text"]) for r in readers.from_csv(spark, str(tmp_path / "p.csv")).collect()}
    assert got == {("a", "density"): (5.4, "5.4"), ("a", "label"): (None, "x, y"), ("b", "label"): (None, "z")}
    with pytest.raises(ValueError):
        readers.from_csv(spark, str(tmp_path / "p.csv"), id_col="id")


def test_canonical_lines_and_ids(spark):
    df = spark.createDataFrame([("b", None, 1.5), ("a", "x", 2.0)], "material_id string, note string, v double")
    assert [r["line"] for r in readers.canonical_lines(df.coalesce(1)).collect()] == [json.dumps({"material_id": "b", "v": 1.5}, sort_keys=True), json.dumps({"material_id": "a", "note": "x", "v": 2.0}, sort_keys=True)]
    one, two = readers.content_id(df, []), readers.content_id(df.repartition(3), [])
    assert one == two and one.startswith("mg_ds_") and len(one) == 22 and one != readers.content_id(df.where("v > 1.6"), [])
    doc = json.loads(readers.schema_document(df.schema, "material"))
    assert doc["properties"]["v"] == {"type": "number"} and doc["$id"].endswith("material")


def test_mapping_and_inspect():
    m = importer.infer_mapping(["id", "composition", "cif", "density", "elements"], "csv")
    assert (m.identity, m.formula, m.structure, [p.column for p in m.properties]) == ("id", "composition", "cif", ["density"])
    assert importer.infer_mapping(["material_id", "formula", "properties", "x"], "jsonl").properties == ()
    bad = importer.Mapping("nope", "formula", properties=(importer.PropertyColumn("density", "density", "mystery"), importer.PropertyColumn("gone", "g", "GPa", method="dft")))
    assert [i.code for i in importer.mapping_issues(["formula", "density"], bad)] == ["missing_identity_column", "unknown_mapping_column", "unknown_unit", "mixed_methods"]
    assert importer.inspect(["material_id", "formula"], "csv", 3).status == "ready" and importer.inspect(["x"], "csv", 3).status == "invalid"
    with pytest.raises(ValueError):
        importer.Mapping(properties=(importer.PropertyColumn("a", "a"), importer.PropertyColumn("a", "b")))
    assert importer.safe_filename("C:\\x\\y.csv") == "y.csv" and importer.safe_filename("") == "local-dataset"


def test_import_csv(spark):
    cell = '"{""lattice"": [[1,0,0],[0,1,0],[0,0,1]], ""species"": [""Ti""], ""coords"": [[0,0,0]]}"'
    texts = ["a,TiN,5.4," + cell, "b,AlN,n/a,", "a,TiN,5.4,", "c,Qq,1,", "d,TiN,1,{}", "e,TiN", 'f,TiN,"1', ",TiN,1,"]
    cols = ["material_id", "formula", "density", "structure_json"]
    good, rep = importer.import_lines(lines(spark, texts), "csv", cols, "x/y.csv", skip_invalid=True)
    got = {r["material_id"]: r for r in good.collect()}
    assert set(got) == {"a", "b"} and got["a"]["properties"][0]["value"] == 5.4 and got["b"]["properties"][0]["value_text"] == "n/a" and got["a"]["provenance"]["source_id"] == "y.csv"
    assert rep.status == "degraded" and (rep.row_count, rep.accepted_count, rep.rejected_count) == (8, 2, 6)
    assert rep.issue_counts == {"duplicate_id": 1, "invalid_formula": 1, "invalid_structure": 1, "column_count": 1, "bad_quoting": 1, "missing_identity": 1}
    with pytest.raises(importer.ImportRejected) as refused:
        importer.import_lines(lines(spark, texts), "csv", cols, "y.csv")
    assert refused.value.report.status == "invalid" and refused.value.report.rejected_count == 6
    assert importer.import_lines(lines(spark, texts[:2]), "csv", cols, "y.csv")[1].status == "ready"
    with pytest.raises(ValueError):
        importer.import_lines(lines(spark, texts), "csv", cols, "y.csv", max_rows=3)


def test_import_jsonl(spark):
    texts = ['{"material_id": "a", "formula": "TiN", "gap": 1}', "", "[]", "{bad", '{"material_id": "b", "formula": "TiN", "gap": "x"}']
    good, rep = importer.import_lines(lines(spark, texts), "jsonl", ["material_id", "formula", "gap"], "y.jsonl", skip_invalid=True)
    assert {r["material_id"] for r in good.collect()} == {"a", "b"} and rep.issue_counts == {"malformed_jsonl": 2} and rep.row_count == 4


def test_bulk_files_and_csv_structures(spark, tmp_path):
    kinds = "material_id string, formula string, structure_fingerprint string"
    rows = [{"material_id": "a", "formula": "TiN", "structure_fingerprint": "f1"}, {"material_id": "b", "formula": "AlN", "structure_fingerprint": "f2"}]
    spark.createDataFrame(rows, kinds).write.parquet(str(tmp_path / "compatible_pbe.parquet"))
    d = readers.from_parquet(spark, str(tmp_path / "compatible_pbe.parquet"), "bulk")
    assert (d.source_subset, d.strict, d.basis, d.df.count()) == ("compatible_pbe", True, "structure_fingerprint", 2)
    assert readers.from_parquet(spark, str(tmp_path / "compatible_pbe.parquet"), "bulk", "own").source_subset == "own"
    assert readers.from_bulk_records(spark, rows, kinds, "bulk").source_subset == "local_records"
    cell = '{""lattice"": [[1,0,0],[0,1,0],[0,0,1]], ""species"": [""Ti""], ""coords"": [[0,0,0]]}'
    (tmp_path / "w.csv").write_text(f'material_id,formula,structure_json\na,Ti,"{cell}"\nb,Ti,\nc,Ti,junk\n')
    assert {r["material_id"]: r["structure"] is not None for r in readers.csv_structures(spark, str(tmp_path / "w.csv")).collect()} == {"a": True, "b": False, "c": False}


def test_import_content(spark):
    good = b'material_id,formula,density\na,TiN,5.4\nb,AlN,"3.2"\n'
    one = importer.import_content(spark, "c:/x/up.csv", "csv", good)
    assert one.report.status == "ready" and one.manifest["filename"] == "up.csv" and len(one.manifest["raw_sha256"]) == 64 and one.dataset_id == "mg_ds_" + one.manifest["normalized_sha256"][:16]
    assert [p["material_id"] for p in one.preview] == ["a", "b"] and one.preview[0]["provenance"]["checksum"] == one.manifest["raw_sha256"] and one.manifest["created_at"].endswith("Z")
    bad = good + b"b,AlN,1\n,TiN,2\nc,TiN\n"
    with pytest.raises(importer.ImportRejected) as refused:
        importer.import_content(spark, "up.csv", "csv", bad)
    assert refused.value.report.issue_counts == {"duplicate_id": 1, "missing_identity": 1, "column_count": 1} and [i.row for i in refused.value.report.issues] == [3, 4, 5]
    kept = importer.import_content(spark, "up.csv", "csv", bad, error_policy="skip_invalid")
    assert kept.report.status == "degraded" and kept.records.count() == 2
    with pytest.raises(importer.ImportRejected):
        importer.import_content(spark, "up.csv", "csv", b"material_id,formula\n,\n", error_policy="skip_invalid")
    with pytest.raises(ValueError):
        importer.import_content(spark, "up.csv", "csv", good, max_bytes=10)
    with pytest.raises(ValueError):
        importer.import_content(spark, "up.csv", "csv", good, error_policy="other")
    look = importer.inspect_content(spark, "up.csv", "csv", bad)
    assert (look.status, look.row_count, look.rejected_count) == ("invalid", 5, 1) and look.checksum == importer.inspect_content(spark, "x", "csv", bad).checksum
    odd = importer.import_content(spark, "u.jsonl", "jsonl", b'{"material_id": "a", "formula": "TiN", "gap": 1}\n{"material_id": "b", "formula": "TiN", "gap": NaN}\n', error_policy="skip_invalid")
    assert odd.report.rejected_count == 1


def served(pages, calls):
    def send(method, url, timeout=None, **options):
        calls.append((method, url, options))
        return pages[len(calls) - 1]

    return send


def test_fetch_loops(spark):
    from crysmill.sources import fetch
    from crysmill.sources.transport import ConnectorQuery, Policy

    doc = lambda i: {"material_id": f"mp-{i}", "formula_pretty": "Fe", "density": 1.0 + i, "energy_above_hull": 0.0}
    calls = []
    got = fetch.materials_project(spark, ConnectorQuery(elements=("Fe",), properties=("rho",), max_records=3, page_size=2), served([(200, {}, {"data": [doc(0), doc(1)]}), (200, {}, {"data": [doc(2), doc(3)]})], calls))
    assert sorted(r["material_id"] for r in got.records.collect()) == ["mp-0", "mp-1", "mp-2"] and len(calls) == 2 and calls[1][2]["params"] == {"elements": "Fe", "_skip": 2, "_limit": 2}
    first = got.records.first()
    assert [p["name"] for p in first["properties"]] == ["density"] and first["provenance"][0]["source"] == "materials_project" and first["provenance"][0]["source_id"] == first["material_id"]
    calls = []
    assert fetch.materials_project(spark, ConnectorQuery(), served([], calls)).records.count() == 0 and calls == []
    calls = []
    entry = lambda i: {"entry_id": f"e{i}", "results": {"material": {"chemical_formula_reduced": "NTi", "elements": ["Ti", "N"]}}}
    pages = [(503, {"Retry-After": "0"}, ""), (200, {}, json.dumps({"data": [entry(0), {}], "pagination": {"next_page_after_value": "e0"}})), (200, {}, {"data": [entry(1)], "pagination": {}})]
    got = fetch.nomad(spark, ConnectorQuery(elements=("Ti",), max_records=5, page_size=2), served(pages, calls), Policy(backoff=0.0))
    assert got.records.count() == 2 and got.n_rows == 3 and got.warnings == ["1 malformed rows left out"] and calls[2][2]["json"]["pagination"]["page_after_value"] == "e0"
    with pytest.raises(ValueError):
        fetch.nomad(spark, ConnectorQuery(properties=("density",)), None)
    calls = []
    got = fetch.optimade(spark, ConnectorQuery(elements=("Na", "Cl"), max_records=3, page_size=2), served([(200, {}, {"data": [nacl(), nacl(id="asm", structure_features=["assemblies"])], "links": {"next": {"href": "http://x/next"}}}), (200, {}, {"data": [nacl(id="2")], "links": {"next": None}})], calls), "oqmd", "http://x/")
    assert {r["material_id"] for r in got.records.collect()} == {"oqmd:1", "oqmd:2"} and got.warnings == ["asm: assemblies"] and calls[0][2]["params"]["filter"] == 'elements HAS ALL "Na", "Cl"' and calls[1][1] == "http://x/next"
    with pytest.raises(fetch.FetchError):
        fetch.optimade(spark, ConnectorQuery(), served([(404, {}, "")], []), "oqmd", "http://x")
    rows = spark.createDataFrame([(f"J{i}", f, ([[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], ["Ti"], [[0.0, 0.0, 0.0]], False), "1", "2", "3") for i, f in enumerate(["TiN", "AlN", "bad!", "Fe"])], "jid string, formula string, atoms struct<lattice_mat: array<array<double>>, elements: array<string>, coords: array<array<double>>, cartesian: boolean>, optb88vdw_total_energy string, bulk_modulus_kv string, shear_modulus_gv string")
    assert [r["material_id"] for r in fetch.jarvis(rows, ConnectorQuery(elements=("Ti", "Al"), max_records=5)).records.collect()] == ["jarvis:J0", "jarvis:J1"] and fetch.jarvis(rows, ConnectorQuery(max_records=3)).records.count() == 3
    with pytest.raises(ValueError):
        fetch.jarvis(rows, ConnectorQuery(source_ids=("J0",)))


def test_lost_connections_are_tried_again():
    from crysmill.sources.transport import Policy, request

    calls = []

    def send(*a, **k):
        calls.append(a)
        if len(calls) < 3:
            raise ConnectionError("gone")
        return 200, {}, "ok"

    assert request(send, "GET", "u", Policy(retries=2), sleep=lambda s: None)[2] == "ok"
    with pytest.raises(ConnectionError):
        calls.clear() or request(send, "GET", "u", Policy(retries=1), sleep=lambda s: None)


def bodies(spark, docs):
    return spark.createDataFrame([(json.dumps(d),) for d in docs], "body string")


def test_materials_project_and_nomad(spark):
    doc = {"material_id": "mp-1", "formula_pretty": "Fe", "density": 7.9, "bulk_modulus": {"voigt": 1, "vrh": 170}, "shear_modulus": None, "homogeneous_poisson": 0.3}
    r = connectors.materials_project(bodies(spark, [doc, {"material_id": "x"}])).collect()
    assert len(r) == 1 and [(p["name"], p["value"], p["unit"]) for p in r[0]["properties"]] == [("density", 7.9, "g/cm^3"), ("bulk_modulus", 170.0, "GPa")] and r[0]["metadata"] == {"mp_id": "mp-1", "homogeneous_poisson": "0.3"}
    n = connectors.nomad(bodies(spark, [{"entry_id": " e ", "results": {"material": {"chemical_formula_hill": "NTi", "elements": ["Ti", "N"]}}}, {"entry_id": "f"}, {}])).collect()
    assert [(x["material_id"], x["formula"], x["elements"]) for x in n] == [("nomad:e", "NTi", ["N", "Ti"])]
    assert connectors.nomad_payload([" Ti "], 10, "z") == {"owner": "public", "query": {"results.material.elements": {"all": ["Ti"]}}, "pagination": {"page_size": 10, "order_by": "entry_id", "order": "asc", "page_after_value": "z"}}


def nacl(**kw):
    a = 5.64
    sites = [(0, 0, 0, "Na"), (0, 0.5, 0.5, "Na"), (0.5, 0, 0.5, "Na"), (0.5, 0.5, 0, "Na"), (0.5, 0.5, 0.5, "Cl"), (0.5, 0, 0, "Cl"), (0, 0.5, 0, "Cl"), (0, 0, 0.5, "Cl")]
    at = {"chemical_formula_reduced": "ClNa", "nperiodic_dimensions": 3, "lattice_vectors": [[a, 0, 0], [0, a, 0], [0, 0, a]], "cartesian_site_positions": [[x * a for x in s[:3]] for s in sites], "species_at_sites": [s[3] + "1" for s in sites], "species": [{"name": "Na1", "chemical_symbols": ["Na"], "concentration": [1.0]}, {"name": "Cl1", "chemical_symbols": ["Cl"], "concentration": [1.0]}], "_oqmd_stability": -0.02}
    return {"id": kw.pop("id", "1"), "attributes": at | kw}


def test_optimade(spark):
    docs = [nacl(), nacl(id="slab", nperiodic_dimensions=2), nacl(id="flat", lattice_vectors=[[1, 0, 0], [2, 0, 0], [0, 0, 1]]), nacl(id="label", species_at_sites=["Zz"] * 8), nacl(id="null cell", lattice_vectors=[[1, 0, 0], None, [0, 0, None]]), nacl(id="asm", structure_features=["assemblies"]), nacl(id="vac", species=[{"name": "Na1", "chemical_symbols": ["Na", "vacancy"], "concentration": [0.9, 0.1]}, {"name": "Cl1", "chemical_symbols": ["vacancy"], "concentration": [1.0]}]), nacl(id="part", chemical_formula_reduced=None), {"id": None}, {"id": "none"}]
    good, skipped = connectors.optimade(bodies(spark, docs), "oqmd")
    g = {r["material_id"]: r for r in good.collect()}
    props = lambda k: {p["name"]: (p["value"], p["extra"]) for p in g[k]["properties"]}
    assert props("oqmd:1")["density"][0] == pytest.approx(2.163, abs=0.01) and props("oqmd:1")["energy_above_hull"] == (-0.02, {"optimade_field": "_oqmd_stability", "hull_convention": "oqmd_hull_distance"})
    assert g["oqmd:1"]["structure"]["coords"][4] == pytest.approx([0.5, 0.5, 0.5]) and "density" not in props("oqmd:slab") and g["oqmd:slab"]["dimensionality"] == 2
    assert g["oqmd:null cell"]["structure"] is None and g["oqmd:part"]["formula"] == "Cl4Na4"
    assert {r["id"]: r["reason"] for r in skipped.collect()} == {"flat": "degenerate cell", "label": "unknown site label", "asm": "assemblies", "vac": "vacant site", None: "missing id", "none": "missing attributes"}
    assert connectors.next_link({"links": {"next": {"href": "u"}}}) == "u" and connectors.next_link({"links": {"next": "v"}}) == "v" and connectors.next_link({}) is None
    with pytest.raises(NotImplementedError):
        connectors.oqmd()


def test_pages_and_projection(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"p{i}.json").write_text(json.dumps({"data": [{"material_id": f"m{i}", "formula_pretty": "Fe", "density": 1.0, "energy_above_hull": 0.0}]}))
    m = connectors.materials_project(connectors.pages(spark, str(tmp_path / "*.json")))
    assert m.count() == 3 and connectors.pages(spark, str(tmp_path / "*.json"), max_pages=2).count() == 2 and connectors.pages(spark, str(tmp_path / "none*.json")).count() == 0
    p = connectors.project_properties(m, ["rho"], "materials_project").first()
    assert [x["name"] for x in p["properties"]] == ["density"]
    with pytest.raises(ValueError):
        connectors.project_properties(m, ["color"], "materials_project")


def test_catalog(spark, tmp_path):
    c = catalog.Catalog(spark, str(tmp_path), 2)
    for i in range(3):
        c.register(f"d{i}", spark.range(i + 1), {"n": i})
    assert c.list() == ["d1", "d2"] and c.get("d2") == {"n": 2}
    with pytest.raises(catalog.Evicted):
        c.materialize("d0")
    with pytest.raises(KeyError):
        c.get("never")
    first = c.materialize("d1")
    assert c.materialize("d1") is first and first.count() == 2 and c.stats()["active_dataset_id"] == "d1"
    c.register("d3", spark.range(1))
    assert c.list() == ["d1", "d3"] and not (tmp_path / "d0").exists() and not (tmp_path / "d2").exists()
    again = catalog.Catalog(spark, str(tmp_path), 2)
    assert again.list() == ["d1", "d3"] and again.status("d0") == "evicted" and again.status("x") == "unknown" and again.status("d3") == "present" and again.stats()["normalized_bytes"] > 0
    assert again.materialize("d1").count() == 2 and catalog.Catalog(spark, str(tmp_path), 2).list() == ["d3", "d1"]
    assert again.export("d1", str(tmp_path / "out"))["count"] == 2
    small = catalog.Catalog(spark, str(tmp_path / "small"), 8, 10)
    with pytest.raises(ValueError):
        small.register("big", spark.range(9))
    c.delete("d1")
    assert c.stats()["entry_count"] == 1 and c.stats()["active_dataset_id"] is None
    c.clear()
    assert c.list() == []


def test_preflight_leader_and_verdict(spark):
    from crysmill.operators.scorecard import Scorecard

    cell = ([[4.0, 0.0, 0.0], [0.0, 4.0, 0.0], [0.0, 0.0, 4.0]], ["Al"], [[0.0, 0.0, 0.0]])
    df = spark.createDataFrame([(f"m{i}", cell if i else None, float(i), 0.01 * i) for i in range(5)], "material_id string, structure struct<lattice: array<array<double>>, species: array<string>, coords: array<array<double>>>, density double, hull double")
    card = Scorecard({"density": "minimize"}, {"hull": {"max": 0.03}})
    p = catalog.preflight(df, card)
    assert p["status"] == "degraded" and p["graph"] == {"included_count": 4, "excluded_count": 1, "invalid_count": 0, "validation_state": "valid"} and p["ranking"]["ranked_count"] == 4 and p["default_material_id"] == "m0"
    assert [c["status"] for c in p["checks"]] == ["pass", "pass", "pass", "warn"] and catalog.preflight(df, card, reference=True)["status"] == "ready"
    assert catalog.default_leader(Scorecard({"density": "minimize"}, {"hull": {"max": -1.0}}), df) == "m0" and catalog.default_leader(card, df.limit(0)) is None
    v = spark.createDataFrame([(None, None), (0.3, 0.0), (0.1, 0.2), (float("nan"), 0.01), (0.3, 0.2)], "f double, h double")
    assert [tuple(r["v"]) for r in v.select(catalog.constraint_verdict(F.col("f"), F.col("h"), 0.2, 0.05).alias("v")).collect()] == [("", "no data"), ("fail", "force"), ("fail", "hull"), ("pass", "pass"), ("fail", "force")]
    assert catalog.slice_readiness(df.where("density < 3"), df) == {"included_count": 2, "excluded_count": 1}
    assert {r["state"] for r in catalog.capabilities(spark).collect()} >= {"offered", "not_offered"}


def test_stream_first_deliveries(spark, tmp_path):
    df = spark.range(20).selectExpr("id % 5 AS k", "timestamp_seconds(1700000000 + id) AS ts", "id AS n")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = feeds.files(spark, str(tmp_path / "in"), df.schema)
    assert sorted(r["k"] for r in feeds.run_to_table(feeds.first_deliveries(s, ["k"], "ts")).collect()) == [0, 1, 2, 3, 4]
    n = feeds.run_to_table(feeds.windowed_counts(s, "ts", "k"), "complete")
    assert n.agg(F.sum("n_events")).first()[0] == 20


def test_every_recipe_has_sql():
    assert set(cookbook.ORACLE) == set(cookbook.QUERIES) and not set(registry.oracle_sql()) - set(registry.queries())
