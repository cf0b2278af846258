import math

import pytest
from pyspark.sql import functions as F

from crysmill.operators import dataset as ds
from crysmill.operators import elastic, graph, metrics, normalize, simulation
from crysmill.operators.scorecard import Scorecard

BULK = "material_id string, formula string, elements array<string>, nelements int, nsites int, structure struct<lattice: array<array<double>>, species: array<string>, coords: array<array<double>>>, immutable_id string, structure_fingerprint string, functional string, density double, bulk_modulus double, energy_above_hull double"
CELL = ([[4.24, 0.0, 0.0], [0.0, 4.24, 0.0], [0.0, 0.0, 4.24]], ["Ti"] * 4 + ["N"] * 4, [[0.0, 0.0, 0.0], [0.0, 0.5, 0.5], [0.5, 0.0, 0.5], [0.5, 0.5, 0.0], [0.5, 0.5, 0.5], [0.5, 0.0, 0.0], [0.0, 0.5, 0.0], [0.0, 0.0, 0.5]])


def rows(n=4):
    base = [("tin-alpha", "TiN", ["Ti", "N"], 2, 2, 5.392, 285.0, 0.01), ("tin-beta", "TiN", ["Ti", "N"], 2, 4, 4.739, 278.0, 0.02), ("aln", "AlN", ["Al", "N"], 2, 4, 3.263, 205.0, 0.0), ("tialn", "TiAlN", ["Ti", "Al", "N"], 3, 3, 4.6, 240.0, 0.03)]
    return [(m, f, e, ne, ns, CELL if i < 3 else None, f"imm-{i}", f"fp-{i}", "PBEsol", d, b, h) for i, (m, f, e, ne, ns, d, b, h) in enumerate(base[:n])]


def bulk(spark, data=None, subset="compatible_pbesol"):
    return ds.MaterialsDataset.bulk(spark.createDataFrame(rows() if data is None else data, BULK), "bulk", subset)


def test_reports(spark):
    d = bulk(spark)
    r = d.schema_report()
    assert r["row_count"] == 4 and r["missing_structure_count"] == 1 and not r["mixed_functionals"] and r["deduplication_basis"] == "structure_fingerprint"
    assert r["duplicate_signals"] == {"exact_record_duplicate_count": 0, "formula_multiplicity_count": 2, "immutable_id_collision_count": 0, "structure_fingerprint_collision_count": 0}
    assert {x["element"]: x["n_records"] for x in ds.element_counts(d.df).collect()} == {"N": 4, "Ti": 3, "Al": 2}


def test_slice_report_and_id(spark):
    d = bulk(spark).filter_elements(include=["Ti", "Al", "N"]).filter_complexity(4, 3)
    s = d.create_slice("v0", target="bulk_modulus")
    r = s.report()
    assert (r["input_count"], r["output_count"], r["removed_count"], r["graph_export_excluded_count"]) == (4, 4, 0, 1)
    assert [x["name"] for x in r["filter_steps"]] == ["filter_elements", "filter_complexity"] and r["columns_used"] == ["elements", "nelements", "nsites"]
    assert r["slice_id"] == bulk(spark).filter_elements(include=["N", "Al", "Ti"]).filter_complexity(4, 3).create_slice("other name", target="bulk_modulus").slice_id
    assert r["slice_id"] != d.create_slice("v0").slice_id and len(r["slice_id"]) == 21
    public = ds.MaterialsDataset.bulk(spark.createDataFrame(rows(), BULK), "LeMaterial/LeMat-Bulk", "compatible_pbesol")
    assert public.filter_elements(include=["Ti", "Al", "N"]).filter_complexity(4, 3).create_slice("v0", target="bulk_modulus").slice_id == "mg_slice_7329526f63b1"


def test_filters_and_missing_values(spark):
    data = [*rows(), ("x", "Q", [], None, None, None, None, None, None, None, None, None), ("y", "TiN", [" N", "Ti", "Ti"], 2, None, None, None, None, None, None, None, None)]
    d = ds.MaterialsDataset.of(spark.createDataFrame(data, BULK))
    ids = lambda q: sorted(r[0] for r in q.df.select("material_id").collect())
    assert ids(d.filter_elements(include=["Ti", "N"])) == ["tin-alpha", "tin-beta", "y"]
    assert ids(d.filter_elements(exclude=["Ti"])) == ["aln", "x"]
    assert ids(d.filter_complexity(max_nsites=3)) == ["tialn", "tin-alpha"]
    _, steps = d.candidate_pool(["Ti", "N"], None, 4).audited_steps
    assert [(s["input_count"], s["output_count"], s["removed_count"]) for s in steps] == [(6, 3, 3), (3, 2, 1)]


def changed(i, **kw):
    names = [p.split()[0] for p in BULK.replace("struct<lattice: array<array<double>>, species: array<string>, coords: array<array<double>>>", "x").split(", ")]
    out = rows()
    out[i] = tuple(kw.get(n, v) for n, v in zip(names, out[i]))
    return out


def test_guardrails(spark):
    with pytest.raises(ds.SliceError, match="mixed"):
        bulk(spark, changed(0, functional="PBE")).create_slice("s")
    bulk(spark, changed(0, functional="PBE")).create_slice("s", allow_mixed_functionals=True)
    with pytest.raises(ds.SliceError, match="exact"):
        bulk(spark, [*rows(), rows()[0]]).create_slice("s")
    bulk(spark, [*rows(), rows()[0]]).create_slice("s", allow_duplicate_records=True)
    with pytest.raises(ds.SliceError, match="immutable_id"):
        bulk(spark, changed(1, immutable_id="imm-0"), "bulk_unique").create_slice("s")
    with pytest.raises(ds.SliceError, match="fingerprint"):
        bulk(spark, changed(1, structure_fingerprint="fp-0")).create_slice("s")
    with pytest.raises(ds.SliceError, match="unknown"):
        bulk(spark, changed(1, structure_fingerprint=None)).create_slice("s")
    with pytest.raises(ds.SliceError, match="formula_only"):
        bulk(spark).create_slice("s", basis="formula_only")
    with pytest.raises(ds.SliceError, match="target"):
        bulk(spark).create_slice("s", target="nope")
    with pytest.raises(ValueError):
        ds.MaterialsDataset.of(spark.range(3))


def test_aliases_take_the_first_column(spark):
    df = spark.createDataFrame([("e1", "TiN", "PBE")], "entry_id string, chemical_formula_reduced string, xc_functional string")
    r = ds.normalized(df).first()
    assert (r["material_id"], r["formula"], r["reduced_formula"], r["functional"], r["elements"]) == ("e1", "TiN", "TiN", "PBE", [])


POOL = "material_id string, density double, bulk_modulus double, energy_above_hull double"
METALS = [("fe", 7.874, 170.0, 0.0), ("ti", 4.398, 110.0, 0.01), ("al", 2.699, 72.0, 0.0)]


def test_rank_golden_and_ties(spark):
    card = Scorecard({"density": "minimize", "bulk_modulus": "maximize"}, {"energy_above_hull": {"max": 0.05}})
    got = [(r["material_id"], round(r["score"], 6)) for r in card.rank(spark.createDataFrame(METALS, POOL)).collect()]
    assert got == [("ti", 0.529723), ("al", 0.5), ("fe", 0.5)]


def test_uninformative_objectives_don_t_move_scores(spark):
    data = [("a", 1.0, 5.0, None), ("b", 2.0, 5.0, None), ("c", 3.0, 5.0, None)]
    df = spark.createDataFrame(data, POOL)
    one = {r[0]: r[1] for r in Scorecard({"density": "maximize"}).rank(df).select("material_id", "score").collect()}
    for direction in ("minimize", "maximize"):
        more = {r[0]: r[1] for r in Scorecard({"density": "maximize", "bulk_modulus": direction, "energy_above_hull": direction}).rank(df).select("material_id", "score").collect()}
        assert more == one
    rep = Scorecard({"density": "maximize", "bulk_modulus": "minimize", "energy_above_hull": "minimize"}).report(df)
    assert rep["zero_coverage_objectives"] == ["energy_above_hull"] and rep["degenerate_objectives"] == ["bulk_modulus"] and rep["effective_objectives"] == ["density"] and not rep["binary_normalization"]


def test_missing_policies_and_constraints(spark):
    data = [("a", 1.0, 10.0, 0.0), ("b", 2.0, None, 0.0), ("c", 3.0, 30.0, float("nan")), ("d", None, None, 0.0), ("e", float("nan"), 20.0, 0.1)]
    df = spark.createDataFrame(data, POOL)
    goals = {"density": "maximize", "bulk_modulus": "maximize"}
    score = lambda m: {r[0]: r[1] for r in Scorecard(goals, missing=m).rank(df).select("material_id", "score").collect()}
    worst, neutral = score("worst"), score("neutral")
    assert set(worst) == {"a", "b", "c", "e"} and worst["b"] < neutral["b"] and set(score("exclude")) == {"a", "c"}
    limited = Scorecard(goals, {"energy_above_hull": {"max": 0.05}}).rank(df)
    assert {r[0] for r in limited.select("material_id").collect()} == {"a", "b"}
    assert Scorecard({}).rank(df).count() == 0 and Scorecard(goals, {"nope": {"min": 1}}).rank(df).count() == 0
    assert Scorecard(goals).rank(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        Scorecard(goals, missing="other")


def test_mixed_conventions(spark):
    prop = "struct<name: string, value: double, method: string, extra: map<string,string>>"
    data = [("a", [("K_VRH", 1.0, "dft", {"averaging_scheme": "vrh"})]), ("b", [("bulk_modulus", 1.0, "dft", None)]), ("c", [("density", 1.0, "dft", None), ("rho", 2.0, "experimental", None)]), ("d", None)]
    df = spark.createDataFrame(data, f"material_id string, properties array<{prop}>").withColumns({"bulk_modulus": F.lit(1.0), "density": F.lit(1.0)})
    rep = Scorecard({"bulk_modulus": "maximize", "density": "minimize"}).report(df)
    assert rep["mixed_averaging_schemes"] == {"bulk_modulus": ["unspecified", "vrh"]} and rep["mixed_methods"] == {} and rep["mixed_hull_conventions"] == {}


@pytest.mark.parametrize("k,g,rho,e,nu,pugh,stiff,kind", [(170.0, 82.0, 7.874, 211.925676, 0.292230, 0.482353, 26.914615, "borderline"), (110.0, 44.0, 4.398, 116.470588, 0.323529, 0.4, 26.482626, "ductile"), (72.0, 26.0, 2.699, 69.619835, 0.338843, 0.361111, 25.794678, "ductile")])
def test_elastic_goldens(spark, k, g, rho, e, nu, pugh, stiff, kind):
    r = elastic.derive(spark.createDataFrame([(k, g, rho)], "bulk_modulus double, shear_modulus double, density double")).first()
    for name, want in (("youngs_modulus", e), ("poisson_ratio", nu), ("pugh_ratio", pugh), ("specific_stiffness", stiff)):
        assert math.isclose(r[name], want, abs_tol=1e-6)
    assert r["ductility"] == kind and r["elastic_warnings"] == []


def test_elastic_refuses_unstable_moduli(spark):
    bad = [(-10.0, 80.0), (100.0, -5.0), (0.0, 26.0), (72.0, 0.0), (float("nan"), 26.0), (None, 3.0), (float("inf"), 3.0)]
    df = elastic.derive(spark.createDataFrame([(*b, 1.0) for b in bad], "bulk_modulus double, shear_modulus double, density double"))
    assert df.where("youngs_modulus IS NOT NULL OR ductility IS NOT NULL").count() == 0
    w = elastic.derive(spark.createDataFrame([(10.0, 80.0, -1.0), (1000.0, 1.0, None)], "bulk_modulus double, shear_modulus double, density double")).collect()
    assert w[0]["elastic_warnings"] == ["negative Poisson ratio", "density not usable"] and w[1]["elastic_warnings"] == ["Poisson ratio near the incompressible limit"]


def test_elastic_frame_units(spark):
    prop = "struct<name: string, value: double, value_text: string, unit: string, source: string, method: string, extra: map<string,double>>"
    p = lambda n, v, u, m="dft": (n, v, None, u, None, m, None)
    data = [(1, "mix", [p("k_vrh", 170.0, "GPa"), p("g_vrh", 82000.0, "MPa"), p("density", 7.874, "g/cm^3")]), (2, "bare", [p("bulk_modulus", 170.0, None), p("shear_modulus", 82.0, None, "experimental")]), (3, "one", [p("bulk_modulus", 170.0, "GPa")]), (4, "odd", [p("bulk_modulus", 170.0, "furlong"), p("shear_modulus", 82.0, "GPa")]), (5, "none", None)]
    m = spark.createDataFrame(data, f"record_no bigint, material_id string, properties array<{prop}>")
    got = {r["material_id"]: r for r in elastic.elastic_frame(m).collect()}
    assert set(got) == {"mix", "bare"} and got["mix"]["youngs_modulus"] == pytest.approx(211.925676) and got["mix"]["method"] == "dft"
    assert got["bare"]["warnings"] == "bulk_modulus has no unit; assuming GPa; shear_modulus has no unit; assuming GPa" and got["bare"]["method"] == "unknown"
    sizes = {r["material_id"]: r["n"] for r in elastic.with_derived(m).selectExpr("material_id", "size(properties) AS n").collect()}
    assert (sizes["mix"], sizes["bare"], sizes["one"]) == (6, 4, 1)


CELLS = {
    "fe": ([[2.8665, 0.0, 0.0], [0.0, 2.8665, 0.0], [0.0, 0.0, 2.8665]], ["Fe", "Fe"], [[0.0, 0.0, 0.0], [0.5, 0.5, 0.5]]),
    "rocksalt": CELL,
    "skew1": ([[4.0, 0.0, 0.0], [3.6, 1.5, 0.0], [0.3, 0.2, 4.1]], ["Al"], [[0.0, 0.0, 0.0]]),
    "tri3": ([[3.0, 0.0, 0.0], [0.0, 3.4, 0.0], [0.9, 0.4, 7.0]], ["Ti", "N", "Al"], [[0.0, 0.0, 0.0], [0.31, 0.17, 0.12], [0.05, 0.52, 0.61]]),
    "broken": ([[1.0, 0.0, 0.0], [2.0, 0.0, 0.0], [0.0, 0.0, 1.0]], ["Al"], [[0.0, 0.0, 0.0]]),
    "none": None,
}


def cells(spark, names=None):
    return spark.createDataFrame([(k, v) for k, v in CELLS.items() if names is None or k in names], "material_id string, structure struct<lattice: array<array<double>>, species: array<string>, coords: array<array<double>>>")


def test_graph_goldens(spark):
    e = graph.edges(cells(spark)).cache()
    n = {r["material_id"]: r["n"] for r in e.groupBy("material_id").agg(F.count("*").alias("n")).collect()}
    assert n["fe"] == 28 and n["skew1"] == 12 and set(n) == {"fe", "rocksalt", "skew1", "tri3"} and n["tri3"] == 38
    c = graph.coordination(e).groupBy("material_id").agg(F.array_sort(F.collect_list("coordination")).alias("c")).collect()
    c = {r["material_id"]: r["c"] for r in c}
    assert c["fe"] == [8, 8] and c["rocksalt"] == [6] * 8 and c["skew1"] == [2] and c["tri3"] == [1, 1, 2]
    assert graph.one_way(e).count() == 0 and e.where("dist <= 1e-8").count() == 0
    s = [(round(r["mean_distance"], 6), r["n"]) for r in graph.shells(e.where("material_id = 'fe'")).orderBy("shell_no").collect()]
    assert s == [(2.482462, 16), (2.8665, 12)]
    assert graph.truncated_sources(cells(spark, {"tri3"})).first()["truncated_sources"] == [0, 1, 2]


@pytest.mark.parametrize("k,before,after", [(3, 11, 12), (4, 12, 14), (6, 19, 20), (8, 25, 28), (12, 36, 38)])
def test_reciprocal_closure(spark, k, before, after):
    e = graph.edges(cells(spark, {"tri3"}), k=k)
    assert e.count() == after and e.where("NOT added").count() == before


def test_graph_ignores_whole_shifts(spark):
    m, sp, x = CELLS["tri3"]
    moved = spark.createDataFrame([("tri3", (m, sp, [[c + s for c, s in zip(p, (2.0, -1.0, 3.0))] if i else p for i, p in enumerate(x)]))], cells(spark).schema)
    dists = lambda df: sorted((r["src"], r["dst"], round(r["dist"], 9)) for r in graph.edges(df).collect())
    assert dists(moved) == dists(cells(spark, {"tri3"}))
    with pytest.raises(ValueError):
        graph.edges(cells(spark), cutoff=0)


def test_densities(spark):
    row = cells(spark, {"fe"}).select(normalize.cell_density(F.col("structure.lattice"), F.col("structure.species")).alias("d"), normalize.density_check(F.lit(15.75), normalize.cell_density(F.col("structure.lattice"), F.col("structure.species"))).alias("c")).first()
    assert row["d"] == pytest.approx(7.8742, abs=1e-3) and not row["c"]["consistent"] and "1/2" in row["c"]["diagnosis"]
    g = {r["material_id"]: r for r in graph.summary(cells(spark)).collect()}
    assert g["none"]["edge_count"] is None and g["rocksalt"]["one_way_edges"] == 0 and g["fe"]["space_group_status"] == "unknown"
    r = g["rocksalt"]
    assert (g["none"]["state"], r["state"], r["edges_truncated"]) == ("excluded", "valid", r["edge_count"] > 256) and (len(r["truncated_sources"]) > 0) == ("neighbour lists were cut after a whole shell" in r["warnings"]) and r["node_feature_shape"] == [r["n_sites"], 103]
    assert len(r["edges"]) == min(256, r["edge_count"]) and [e["edge_no"] for e in r["edges"]] == list(range(len(r["edges"]))) and len(r["nodes"]) == len(r["coordination_numbers"]) == r["n_sites"]
    few = {r["material_id"]: r for r in graph.summary(cells(spark, {"rocksalt"}), max_edges=3).collect()}["rocksalt"]
    assert few["edges_truncated"] and len(few["edges"]) == 3 and few["warnings"][-1] == "only the first 3 edges are shown"


def test_site_features(spark):
    f = graph.node_features(cells(spark, {"fe"})).first()["features"]
    assert len(f) == len(graph.FEATURE_LABELS) == 103 and f[25] == 1.0 and sum(f[:100]) == 1.0 and f[100:] == [1.83, 1.4, 8.0]
    odd = spark.createDataFrame([("x", ([[1.0, 0.0, 0.0]], ["Zz", "He"], []))], "material_id string, structure struct<lattice: array<array<double>>, species: array<string>, coords: array<array<double>>>")
    assert [r["features"][100:] for r in graph.node_features(odd).orderBy("idx").collect()] == [[0.0, 0.0, 0.0], [0.0, 0.0, 18.0]]
    assert [r["radius"] for r in graph.covalent_radius(odd).collect()] == [0.0, 0.0]


def test_dataset_exports(spark, tmp_path):
    d = bulk(spark)
    e, excluded = d.to_graphs(4.0, 6)
    assert excluded == 1 and e.select("material_id").distinct().count() == 3
    assert d.to_graphs(builder=lambda s, key, cutoff, k: s.select(key))[0].count() == 3
    m = {r["material_id"]: r for r in d.to_materials().collect()}
    assert len(m) == 4 and {p["name"] for r in m.values() for p in r["properties"]} == set(ds.scalar_columns(d.df)) and all(p["value"] is not None for r in m.values() for p in r["properties"] if p["name"] == "density")
    assert len(d.to_pandas()) == 4
    with pytest.raises(ValueError):
        d.to_pandas(max_rows=3)
    one = d.export(str(tmp_path / "out"))
    assert one["count"] == 4 and len(one["sha256"]) == 64 and one == bulk(spark).export(str(tmp_path / "again"))
    text = spark.createDataFrame([("a", "TiN", '{"lattice": [[1,0,0],[0,1,0],[0,0,1]], "species": ["Ti"], "coords": [[0,0,0]]}'), ("b", "TiN", "no json"), ("c", "TiN", "  "), ("d", "TiN", None)], "material_id string, formula string, structure string")
    assert [r["n"] for r in ds.MaterialsDataset.of(text).df.selectExpr("size(structure.species) AS n", "material_id").orderBy("material_id").collect()] == [1, None, None, None]
    flags = spark.createDataFrame([("a", "TiN", True, " hard ", None), ("b", "TiN", False, "", None)], "material_id string, formula string, checked boolean, note string, empty double")
    got = {r["material_id"]: {p["name"]: p["value_text"] for p in r["properties"]} for r in ds.MaterialsDataset.of(flags).to_materials().collect()}
    assert got == {"a": {"checked": "True", "note": "hard"}, "b": {"checked": "False"}}
    mixed = spark.createDataFrame([("a", "TiN", ([[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], [{"Ti": 0.5, "V": 0.5}], [[0.0, 0.0, 0.0]]))], "material_id string, formula string, structure struct<lattice: array<array<double>>, species: array<map<string,double>>, coords: array<array<double>>>")
    with pytest.raises(ValueError):
        ds.MaterialsDataset.of(mixed).to_graphs()


def test_converters(spark):
    r = spark.range(1).select(normalize.temperature_k(F.lit(25.0), F.lit("°C")).alias("t"), normalize.length_angstrom(F.lit(1.0), F.lit("nm")).alias("l"), normalize.energy_ev(F.lit(1.0), F.lit("Ry")).alias("e"), normalize.pressure_gpa(F.lit(10.0), F.lit(" kbar ")).alias("p"), normalize.density_gcc(F.lit(1.0), F.lit("stone")).alias("d"), normalize.number(F.lit("1_000")).alias("n"), normalize.elements_of_text(F.lit("Ti-Al-N")).alias("x"), normalize.elements_of_text(F.lit('["N","Ti"]')).alias("y")).first()
    assert (r["t"], r["l"], r["e"], r["p"], r["d"], r["n"], r["x"], r["y"]) == (298.15, 10.0, 13.6056980659, 1.0, None, None, ["Al", "N", "Ti"], ["N", "Ti"])


def test_metrics(spark):
    df = spark.createDataFrame([("g", 1, 3), ("g", 2, 2), ("g", 3, 1), ("h", 1, 1), ("h", 2, 2), ("h", 3, 3), ("z", 1, 0)], "grp string, place int, rel int")
    assert {r["grp"]: r["dcg"] for r in metrics.dcg(df, "grp", "rel", ["place"]).collect()}["g"] == pytest.approx(9.392789260714373)
    n = {r["grp"]: r["ndcg"] for r in metrics.ndcg_at_k(df, "grp", "rel", ["place"], 3).collect()}
    assert n["h"] == pytest.approx(0.6806060567602009) and n["g"] == 1.0 and n["z"] == 0.0
    y = spark.createDataFrame([(1.0, 0.0, 2.0), (3.0, 0.0, 2.0), (None, 0.0, 1.0), (2.0, 0.0, 2.0)], "y double, lo double, hi double")
    assert metrics.interval_coverage(y, "y", "lo", "hi").first()["coverage"] == 0.5 and metrics.interval_coverage(y.limit(0), "y", "lo", "hi").first()["coverage"] == 0.0


def test_bins_and_split(spark):
    df = spark.range(800).selectExpr("id", "CASE WHEN id % 50 = 0 THEN NULL ELSE double(id % 97) END AS v")
    b = metrics.stratified_split(df, "id", "v", 0.25)
    shares = b.groupBy("bin").agg(F.avg((F.col("split") == "test").cast("double")).alias("s"), F.count("*").alias("n")).collect()
    assert len(shares) == 8 and all(abs(r["s"] - 0.25) <= 0.5 / r["n"] + 1e-9 for r in shares) and b.count() == 800
    assert metrics.quantile_bins(spark.createDataFrame([(1, 5.0), (2, 5.0)], "id int, v double"), "v").where("bin <> 0").count() == 0


def test_simulation(spark):
    data = [("a", CELLS["fe"]), ("b", (CELL[0], ["Al"], [[0.0, 0.0, 0.0]])), ("c", None)]
    df = spark.createDataFrame(data, cells(spark).schema)
    got = {r["material_id"]: (r["ready"], r["reason"]) for r in simulation.readiness(df, True).collect()}
    assert got == {"a": (False, "unsupported: Fe"), "b": (True, None), "c": (False, "no structure")}
    assert simulation.readiness(df, False).where("ready").count() == 0 and simulation.run_job(df, "lammps").where("status = 'failed'").count() == 3
    e = spark.createDataFrame([('{"engine": "x", "method": "y"}',), ('{"engine": "x"}',), ("[]",), (None,), ('{"engine": "x", "method": "y", "input_checksum": "zz"}',)], "p string")
    assert [r["fault"] for r in simulation.envelopes(e, "p").collect()] == [None, "method_empty", "not_object", "not_object", "checksum"]
    assert simulation.job_faults("emt", 0.0, 0, 1) == ["fmax", "max_steps"]
    with pytest.raises(ValueError):
        simulation.run_job(df, "vasp")


def test_relax_by_a_given_calculator(spark):
    kinds = "material_id string, structure struct<lattice: array<array<double>>, species: array<string>, coords: array<array<double>>>"
    cell = [[4.0, 0.0, 0.0], [0.0, 4.0, 0.0], [0.0, 0.0, 4.0]]
    df = spark.createDataFrame([("a", (cell, ["Al"], [[0.1, 0.0, 0.0]])), ("b", (cell, ["Fe"], [[0.0, 0.0, 0.0]])), ("c", None)], kinds)

    def calculator(lattice, species, coords, fmax, max_steps):
        if species == ["Fe"]:
            raise RuntimeError("diverged")
        return True, 3, -1.5, fmax / 2, lattice, [[0.0, 0.0, 0.0]]

    out = {r["material_id"]: r for r in simulation.relax(df, calculator=calculator).collect()}
    assert (out["a"]["status"], out["a"]["steps"], out["a"]["energy"], out["a"]["coords"]) == ("completed", 3, -1.5, [[0.0, 0.0, 0.0]])
    assert (out["b"]["status"], out["b"]["error"]) == ("failed", "RuntimeError: diverged") and out["c"]["error"] == "no structure"
    own = {r["material_id"]: r["error"] for r in simulation.relax(df).collect()}
    assert own["b"] == "unsupported: Fe" and own["c"] == "no structure"
    with pytest.raises(ValueError):
        simulation.relax(df, fmax=0.0)


def test_exact_quantiles(spark):
    import numpy as np

    rnd = np.random.default_rng(3)
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    for values in (rnd.normal(size=997).tolist(), [2.0] * 300 + rnd.normal(size=150).round(1).tolist(), [5.0], [1.0, 2.0]):
        df = spark.createDataFrame([(v, "clash") for v in [*values, None, float("nan")]], "v double, n string")
        for ranges in (512, 3):
            got = {r["share"]: r["quantile"] for r in metrics.exact_quantiles(df, "v", shares, ranges).collect()}
            assert got == pytest.approx({s: float(np.quantile(values, s)) for s in shares})
    empty = spark.createDataFrame([(None, 1), (float("nan"), 2)], "v double, id int")
    assert metrics.exact_quantiles(empty, "v", shares).count() == 0
    assert [r["bin"] for r in metrics.quantile_bins(empty, "v").collect()] == [0, 0] and metrics.quantile_bins(empty.limit(0), "v").count() == 0


def test_digest_of_lines(spark):
    from crysmill.sources.readers import lines_digest

    df = spark.createDataFrame([(str(i % 7),) for i in range(50)], "value string")
    assert lines_digest(df) == lines_digest(df.repartition(5)) and lines_digest(df)[0] == 50
    assert lines_digest(df)[1] != lines_digest(df.limit(49))[1] and lines_digest(df.limit(0))[0] == 0


def test_constraints_read_properties_and_metadata(spark):
    kinds = "material_id string, properties array<struct<name: string, value: double, value_text: string, unit: string, source: string, method: string, extra: map<string,string>>>, metadata map<string,string>"
    p = lambda name, value=None, text=None: (name, value, text, None, "x", "dft", None)
    rows = [("a", [p("rho", 4.0), p("stable", None, "True")], {"phase": "cubic"}), ("b", [p("density", None, "6.5"), p("density", 1.0)], {"stable": "no", "phase": "cubic"}), ("c", None, None), ("d", [p("density", 3.0)], {"phase": "hex", "stable": "yes"})]
    df = spark.createDataFrame(rows, kinds)
    keep = lambda c: sorted(r["material_id"] for r in df.where(Scorecard({"density": "minimize"}, c).passes(df)).collect())
    assert keep({"density": {"max": 5.0}}) == ["a", "d"] and keep({"phase": {"equals": "cubic"}}) == ["a", "b"] and keep({"stable": {"equals": True}}) == ["a", "d"] and keep({"stable": {"equals": False}}) == ["b"]
    assert [r["material_id"] for r in Scorecard({"density": "minimize"}).rank(df).collect()] == ["d", "a", "b"]
