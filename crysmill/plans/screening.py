"""Queries of the screening operators (datasets, scorecards, elasticity, graphs, metrics, sources) and their SQL."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lattice import volume
from ..functions.names import ALIASES, PROPERTIES, canonical_name, preferred_unit
from ..operators import dataset as ds
from ..operators import elastic, graph, metrics, normalize, simulation
from ..operators.scorecard import Scorecard, mixed_conventions
from ..operators.units import property_entries
from ..runtime import Scratch, shared_dir, table
from . import curation
from ..sources import catalog, connectors, fetch, readers

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def _bulk(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lemat_bulk_sample")


# --- filters, reports, slices
_E = "list_sort(list_distinct(list_filter(list_transform(coalesce(elements, []), lambda x: trim(x)), lambda y: y <> '')))"
INCLUDE, EXCLUDE = ["Ti", "Al", "N", "Si", "C"], ["Pd", "Cd"]
_IN, _OUT = (", ".join(f"'{x}'" for x in xs) for xs in (INCLUDE, EXCLUDE))
_INC = f"(len({_E}) > 0 AND list_has_all([{_IN}], {_E}))"
_SCREEN = "row_no, material_id"


def _dataset(spark, sf_dir) -> ds.MaterialsDataset:
    return ds.MaterialsDataset.of(_bulk(spark, sf_dir), "bulk", "sample", leave_out=("row_no", "ingested_at", "reduced_formula", "nelements", "nsites", "elements"))


@query(f"SELECT {_SCREEN} FROM lemat_bulk_sample WHERE {_INC}")
def filter_include(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dataset(spark, sf_dir).filter_elements(include=INCLUDE).df.select("row_no", "material_id")


@query(f"SELECT {_SCREEN} FROM lemat_bulk_sample WHERE NOT list_has_any({_E}, [{_OUT}])")
def filter_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dataset(spark, sf_dir).filter_elements(exclude=EXCLUDE).df.select("row_no", "material_id")


_NEL = f"coalesce(nelements, nullif(len({_E}), 0))"
_NSITES = "coalesce(nsites, len(structure.species))"


@query(f"SELECT {_SCREEN} FROM lemat_bulk_sample WHERE {_NSITES} <= 8 AND {_NEL} <= 3")
def filter_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dataset(spark, sf_dir).filter_complexity(8, 3).df.select("row_no", "material_id")


@query(f"SELECT {_SCREEN} FROM lemat_bulk_sample WHERE {_INC} AND {_NSITES} <= 12 AND {_NEL} <= 3")
def candidate_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dataset(spark, sf_dir).candidate_pool(INCLUDE, None, 12, 3).df.select("row_no", "material_id")


@query(f"""WITH c AS (SELECT count(*) AS a, count(*) FILTER ({_INC}) AS b, count(*) FILTER ({_INC} AND {_NSITES} <= 12 AND {_NEL} <= 3) AS d FROM lemat_bulk_sample)
SELECT 1 AS step_no, 'filter_elements' AS name, a AS input_count, b AS output_count, a - b AS removed_count FROM c UNION ALL SELECT 2, 'filter_complexity', b, d, b - d FROM c""")
def slice_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, steps = _dataset(spark, sf_dir).candidate_pool(INCLUDE, None, 12, 3).audited_steps
    return spark.createDataFrame([(i + 1, s["name"], s["input_count"], s["output_count"], s["removed_count"]) for i, s in enumerate(steps)], "step_no int, name string, input_count bigint, output_count bigint, removed_count bigint")


@query(f"SELECT element, count(*) AS n_records FROM (SELECT unnest({_E}) AS element FROM lemat_bulk_sample) GROUP BY element")
def element_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ds.element_counts(_bulk(spark, sf_dir))


@query("SELECT functional AS value, count(*) AS n FROM lemat_bulk_sample WHERE trim(functional) <> '' GROUP BY functional")
def functional_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ds.value_counts(_bulk(spark, sf_dir), "functional")


def _coll(c: str) -> str:
    return f"(SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM lemat_bulk_sample WHERE trim({c}) <> '' GROUP BY {c} HAVING count(*) > 1))"


_ALL = "trim(material_id), trim(formula), structure, immutable_id, structure_fingerprint, functional, density, bulk_modulus, energy_above_hull, energy_per_site, max_force, last_modified"


@query(f"SELECT (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM lemat_bulk_sample GROUP BY {_ALL} HAVING count(*) > 1)) AS exact_record_duplicate_count, {_coll('trim(formula)')} AS formula_multiplicity_count, {_coll('immutable_id')} AS immutable_id_collision_count, {_coll('structure_fingerprint')} AS structure_fingerprint_collision_count")
def duplicate_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _dataset(spark, sf_dir)
    return ds.duplicate_signals(d.df, d.leave_out)


@query("SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1)")
def exact_text_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ds.collisions(table(spark, sf_dir, "documents"), F.sha2("text", 256))


@query("""SELECT count(*) AS row_count, count(*) FILTER (trim(immutable_id) <> '') AS immutable_id_coverage, count(*) FILTER (trim(structure_fingerprint) <> '') AS structure_fingerprint_coverage,
count(*) FILTER (structure IS NULL) AS missing_structure_count, count(DISTINCT functional) FILTER (trim(functional) <> '') > 1 AS mixed_functionals FROM lemat_bulk_sample""")
def schema_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _dataset(spark, sf_dir).schema_report()
    keys = ("row_count", "immutable_id_coverage", "structure_fingerprint_coverage", "missing_structure_count", "mixed_functionals")
    return spark.createDataFrame([tuple(r[k] for k in keys)], "row_count bigint, immutable_id_coverage bigint, structure_fingerprint_coverage bigint, missing_structure_count bigint, mixed_functionals boolean")


@query("""SELECT material_id, name, value, unit, CASE WHEN name IN ('density', 'max_force') THEN 'crysmill' ELSE 'bulk' END AS source,
CASE WHEN name IN ('density', 'max_force') THEN 'derived' WHEN trim(functional) <> '' THEN 'dft' ELSE 'unknown' END AS method
FROM (SELECT trim(material_id) AS material_id, functional, unnest(['density', 'bulk_modulus', 'energy_above_hull', 'energy_per_site', 'max_force']) AS name, unnest([density, bulk_modulus, energy_above_hull, energy_per_site, max_force]) AS value, unnest(['g/cm^3', 'GPa', 'eV/atom', 'eV/site', 'eV/angstrom']) AS unit FROM lemat_bulk_sample)
WHERE value IS NOT NULL AND NOT isnan(value)""")
def unpivot_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dataset(spark, sf_dir).to_properties()


@query("SELECT row_no, trim(material_id) AS material_id, 'bulk' AS source_dataset, 'sample' AS source_subset, structure IS NOT NULL AS has_structure, bulk_modulus AS target FROM lemat_bulk_sample")
def benchmark_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dataset(spark, sf_dir).to_benchmark_frame("bulk_modulus").select("row_no", "material_id", "source_dataset", "source_subset", F.col("structure").isNotNull().alias("has_structure"), "target")


# --- property lists
_ENTRIES = "SELECT record_no, material_id, CAST(generate_subscripts(properties, 1) - 1 AS INTEGER) AS prop_no, unnest(properties) AS p FROM materials_sample"
_CANON = "CASE replace(replace(lower(trim(p.name)), '-', '_'), ' ', '_') " + " ".join(f"WHEN '{a}' THEN '{c}'" for a, c in ALIASES.items()) + " ELSE replace(replace(lower(trim(p.name)), '-', '_'), ' ', '_') END"


@query(f"SELECT record_no, prop_no, name, CASE name {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {chr(39)}{u}{chr(39)}' for k, (u, _) in PROPERTIES.items() if u)} END AS preferred_unit FROM (SELECT record_no, prop_no, {_CANON} AS name FROM ({_ENTRIES}) WHERE p IS NOT NULL)")
def canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = property_entries(table(spark, sf_dir, "materials_sample"))
    return e.select("record_no", "prop_no", canonical_name(F.col("name")).alias("name"), preferred_unit(F.col("name")).alias("preferred_unit"))


_NUM = r"CASE WHEN regexp_full_match(trim(p.value_text), '[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?') THEN TRY_CAST(trim(p.value_text) AS DOUBLE) END"


@query(f"SELECT record_no, prop_no, coalesce(CASE WHEN NOT isnan(p.value) THEN p.value END, {_NUM}) AS number FROM ({_ENTRIES}) WHERE p IS NOT NULL")
def numeric_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = property_entries(table(spark, sf_dir, "materials_sample"))
    return e.select("record_no", "prop_no", normalize.numeric_read(F.col("value"), F.col("value_text")).alias("number"))


def _case(factors: dict) -> str:
    return "CASE replace(lower(trim(p.unit)), ' ', '') " + " ".join(f"WHEN '{u}' THEN {f!r}::DOUBLE" for u, f in factors.items()) + " END"


@query(f"SELECT record_no, prop_no, p.value * {_case(normalize.ENERGY)} AS energy_ev, p.value * {_case(normalize.PRESSURE)} AS pressure_gpa, p.value * {_case(normalize.DENSITY)} AS density_gcc FROM ({_ENTRIES}) WHERE p.value IS NOT NULL AND NOT isnan(p.value)")
def unit_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = property_entries(table(spark, sf_dir, "materials_sample")).where("value IS NOT NULL AND NOT isnan(value)")
    v, u = F.col("value"), F.col("unit")
    return e.select("record_no", "prop_no", normalize.energy_ev(v, u).alias("energy_ev"), normalize.pressure_gpa(v, u).alias("pressure_gpa"), normalize.density_gcc(v, u).alias("density_gcc"))


_PIVOT = ("density", "bulk_modulus", "shear_modulus")


@query(f"WITH e AS (SELECT material_id, record_no, prop_no, {_CANON} AS name, CASE WHEN NOT isnan(p.value) THEN p.value END AS value FROM ({_ENTRIES}) WHERE p IS NOT NULL) SELECT material_id, " + ", ".join(f"arg_max(value, struct_pack(a := record_no, b := prop_no)) FILTER (name = '{n}' AND value IS NOT NULL) AS {n}" for n in _PIVOT) + " FROM e GROUP BY material_id")
def pivot_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = property_entries(table(spark, sf_dir, "materials_sample"))
    return ds.pivot_properties(e.withColumns({"name": canonical_name(F.col("name")), "value": normalize.no_nan(F.col("value"))}), list(_PIVOT))


@query(f"SELECT record_no, first(p.value ORDER BY prop_no) AS density FROM (SELECT record_no, prop_no, p FROM ({_ENTRIES}) WHERE p IS NOT NULL AND {_CANON} = 'density') GROUP BY record_no")
def first_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "materials_sample")
    return m.select("record_no", elastic.first_property("density").alias("p")).where("p IS NOT NULL").select("record_no", F.col("p.value").alias("density"))


@query("""SELECT record_no, array_to_string(list_filter([CASE WHEN coalesce(trim(material_id) = '', true) THEN 'material_id_empty' END, CASE WHEN coalesce(trim(formula) = '', true) THEN 'formula_empty' END], lambda x: x IS NOT NULL), ';') AS faults FROM materials_sample""")
def identity_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.filter(normalize.record_faults(), lambda c: c.isin("material_id_empty", "formula_empty"))
    return table(spark, sf_dir, "materials_sample").select("record_no", F.array_join(f, ";").alias("faults"))


@query()
def record_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "materials_sample")
    told = t.select("record_no", normalize.record_faults().alias("f"), normalize.structure_faults(F.col("structure")).alias("s")).where("size(f) > 0 OR size(s) > 0")
    return told.select("record_no", F.array_join("f", ";").alias("faults"), F.coalesce(F.array_join("s", ";"), F.lit("")).alias("structure_faults"))


_DET = "abs(l[1][1] * (l[2][2] * l[3][3] - l[2][3] * l[3][2]) - l[1][2] * (l[2][1] * l[3][3] - l[2][3] * l[3][1]) + l[1][3] * (l[2][1] * l[3][2] - l[2][2] * l[3][1]))"


@query(f"SELECT row_no, round({_DET}, 6) AS volume FROM (SELECT row_no, structure.lattice AS l FROM lemat_bulk_sample WHERE structure.lattice IS NOT NULL)")
def cell_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _bulk(spark, sf_dir).where("structure.lattice IS NOT NULL")
    return t.select("row_no", F.round(volume(F.col("structure.lattice")), 6).alias("volume"))


@query()
def density_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _bulk(spark, sf_dir).where("structure IS NOT NULL")
    c = normalize.density_check(F.col("density"), normalize.cell_density(F.col("structure.lattice"), F.col("structure.species")))
    return t.select("row_no", c.alias("c")).select("row_no", F.round("c.ratio", 6).alias("ratio"), "c.consistent", "c.diagnosis")


# --- scorecards
CARD = {"density": {"direction": "minimize", "weight": 0.6}, "bulk_modulus": {"direction": "maximize", "weight": 0.4}}
LIMITS = {"energy_above_hull": {"max": 0.05}, "nsites": {"max": 20}}


def _card_sql(missing: str) -> str:
    v = {n: f"CASE WHEN NOT isnan({n}) THEN {n} END" for n in CARD}
    both = " AND " if missing == "exclude" else " OR "
    fill = {"worst": "0.0e0", "neutral": "0.5e0", "exclude": "0.0e0"}[missing]
    total, weight = "0.0e0", "0.0e0"
    for n, spec in CARD.items():
        unit = f"({n} - lo_{n}) / (hi_{n} - lo_{n})"
        unit = f"coalesce({'1.0e0 - ' + unit if spec['direction'] == 'minimize' else unit}, {fill})"
        total += f" + CASE WHEN hi_{n} > lo_{n} THEN {spec['weight']}e0 * {unit} ELSE 0.0e0 END"
        weight += f" + CASE WHEN hi_{n} > lo_{n} THEN {spec['weight']}e0 ELSE 0.0e0 END"
    return f"""WITH k AS (SELECT row_no, {', '.join(f'{x} AS {n}' for n, x in v.items())} FROM lemat_bulk_sample WHERE CASE WHEN NOT isnan(energy_above_hull) THEN energy_above_hull END <= 0.05e0 AND nsites <= 20),
r AS (SELECT * FROM k WHERE {both.join(f'{n} IS NOT NULL' for n in CARD)}),
s AS (SELECT {', '.join(f'min({n}) AS lo_{n}, max({n}) AS hi_{n}' for n in CARD)} FROM r)
SELECT row_no, CASE WHEN {weight} > 0 THEN ({total}) / ({weight}) ELSE {total} END AS score, {', '.join(CARD)} FROM r, s"""


def _rank(missing: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Scorecard(CARD, LIMITS, missing=missing).rank(_bulk(spark, sf_dir), "row_no")

    return run


for _m in ("worst", "neutral", "exclude"):
    QUERIES[f"scorecard_{_m}"], ORACLE[f"scorecard_{_m}"] = _rank(_m), _card_sql(_m)

_OK = "(CASE WHEN NOT isnan(energy_above_hull) THEN energy_above_hull END <= 0.05e0 AND nsites <= 20 AND ((density IS NOT NULL AND NOT isnan(density)) OR (bulk_modulus IS NOT NULL AND NOT isnan(bulk_modulus))))"


@query(" UNION ALL ".join(f"SELECT '{n}' AS objective, '{s['direction']}' AS direction, {s['weight']}e0 AS weight, count(*) AS pool_size, count(*) FILTER ({_OK}) AS ranked_count, count({n}) FILTER ({_OK} AND NOT isnan({n})) AS coverage, count({n}) FILTER ({_OK} AND NOT isnan({n})) = 0 AS zero_coverage, coalesce(NOT max({n}) FILTER ({_OK} AND NOT isnan({n})) > min({n}) FILTER ({_OK} AND NOT isnan({n})), false) AS degenerate, coalesce(max({n}) FILTER ({_OK} AND NOT isnan({n})) > min({n}) FILTER ({_OK} AND NOT isnan({n})), false) AS effective FROM lemat_bulk_sample" for n, s in CARD.items()))
def scorecard_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Scorecard(CARD, LIMITS).audit(_bulk(spark, sf_dir))


@query(f"""WITH f AS (SELECT record_no, prop_no, {_CANON} AS name, p.method AS method FROM ({_ENTRIES}) WHERE p IS NOT NULL),
o AS (SELECT name AS objective, record_no, first(method ORDER BY prop_no) AS method FROM f WHERE name IN ('density', 'bulk_modulus', 'shear_modulus') GROUP BY 1, 2)
SELECT objective, string_agg(DISTINCT method, ',' ORDER BY method) AS methods FROM o WHERE method IS NOT NULL GROUP BY objective""")
def mixed_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixed_conventions(table(spark, sf_dir, "materials_sample"), ["density", "bulk_modulus", "shear_modulus"])
    return m.where("marker = 'method'").select("objective", F.array_join("conventions", ",").alias("methods"))


@query(f"WITH r AS ({_card_sql('worst')}) SELECT r.row_no, r.score, r.density, r.bulk_modulus, b.energy_above_hull, b.nsites FROM r JOIN lemat_bulk_sample b USING (row_no)")
def rank_audit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.rank_audit(Scorecard(CARD, LIMITS), _bulk(spark, sf_dir), "row_no")[0]


# --- elasticity
_JN = lambda c: f"TRY_CAST(CASE WHEN lower(trim({c})) NOT IN ('na', 'n/a', '', 'none') THEN {c} END AS DOUBLE)"


@query(f"""WITH j AS (SELECT jid, {_JN('bulk_modulus_kv')} AS k, {_JN('shear_modulus_gv')} AS g, density AS rho FROM jarvis_rows), d AS (SELECT *, 9.0e0 * k * g / (3.0e0 * k + g) AS e, (3.0e0 * k - 2.0e0 * g) / (2.0e0 * (3.0e0 * k + g)) AS nu FROM j WHERE k > 0 AND g > 0 AND NOT isnan(k) AND NOT isnan(g))
SELECT jid, e AS youngs_modulus, nu AS poisson_ratio, g / k AS pugh_ratio, CASE WHEN nu >= 0.31e0 THEN 'ductile' WHEN nu <= 0.2e0 THEN 'brittle' ELSE 'borderline' END AS ductility, CASE WHEN rho > 0 AND NOT isnan(rho) THEN e / rho END AS specific_stiffness FROM d""")
def elastic_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "jarvis_rows").select("jid", normalize.sentinel_number(F.col("bulk_modulus_kv")).alias("k"), normalize.sentinel_number(F.col("shear_modulus_gv")).alias("g"), "density")
    return elastic.derive(j, "k", "g").where("youngs_modulus IS NOT NULL").select("jid", "youngs_modulus", "poisson_ratio", "pugh_ratio", "ductility", "specific_stiffness")


@query()
def elastic_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elastic.elastic_frame(table(spark, sf_dir, "materials_sample"))


@query()
def with_derived_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elastic.with_derived(table(spark, sf_dir, "materials_sample")).select("record_no", F.size("properties").alias("n_properties"))


# --- graphs
_PAIRS = """WITH s AS (SELECT record_no, structure.lattice AS l, structure.coords AS x FROM materials_sample
  WHERE len(structure.lattice) = 3 AND len(structure.coords) > 0 AND len(structure.coords) = len(structure.species)),
u AS (SELECT record_no, l, x, unnest(range(len(x))) AS src FROM s), v AS (SELECT record_no, l, x, src, unnest(range(len(x))) AS dst FROM u),
i AS (SELECT a.range AS ia, b.range AS ib, c.range AS ic FROM range(-4, 5) a, range(-4, 5) b, range(-4, 5) c),
w AS (SELECT record_no, src, dst, ia, ib, ic, l, x[dst + 1][1] + ia - x[src + 1][1] AS d0, x[dst + 1][2] + ib - x[src + 1][2] AS d1, x[dst + 1][3] + ic - x[src + 1][3] AS d2 FROM v, i),
c AS (SELECT record_no, src, dst, ia, ib, ic, d0 * l[1][1] + d1 * l[2][1] + d2 * l[3][1] AS dx, d0 * l[1][2] + d1 * l[2][2] + d2 * l[3][2] AS dy, d0 * l[1][3] + d1 * l[2][3] + d2 * l[3][3] AS dz FROM w),
p AS (SELECT record_no, src, dst, ia, ib, ic, sqrt(dx * dx + dy * dy + dz * dz) AS dist FROM c WHERE sqrt(dx * dx + dy * dy + dz * dz) > 1e-5 AND sqrt(dx * dx + dy * dy + dz * dz) <= 4.0e0)"""
EDGES = _PAIRS + """, r AS (SELECT *, row_number() OVER (PARTITION BY record_no, src ORDER BY dist, dst, ia, ib, ic) AS rn FROM p),
m AS (SELECT *, max(CASE WHEN rn = 8 THEN dist END) OVER (PARTITION BY record_no, src) AS lim FROM r),
k AS (SELECT record_no, src, dst, ia, ib, ic, dist FROM m WHERE lim IS NULL OR dist <= lim + 1e-5),
e AS (SELECT record_no, src, dst, ia, ib, ic, min(dist) AS dist FROM (SELECT * FROM k UNION ALL SELECT record_no, dst, src, -ia, -ib, -ic, dist FROM k) GROUP BY ALL)"""


def _graph(spark, sf_dir) -> DataFrame:
    return graph.edges(table(spark, sf_dir, "materials_sample"), "record_no", 4.0, 8)


@query(_PAIRS + " SELECT record_no, count(*) AS n_pairs, round(min(dist), 6) AS shortest FROM p GROUP BY record_no")
def neighbour_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.candidates(table(spark, sf_dir, "materials_sample"), "record_no", 4.0).groupBy(F.col("key").alias("record_no")).agg(F.count("*").alias("n_pairs"), F.round(F.min("dist"), 6).alias("shortest"))


@query(EDGES + " SELECT record_no, count(*) AS n_edges, round(max(dist), 6) AS longest FROM e GROUP BY record_no")
def neighbour_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).groupBy("record_no").agg(F.count("*").alias("n_edges"), F.round(F.max("dist"), 6).alias("longest"))


@query(EDGES + " SELECT count(*) AS one_way FROM e WHERE NOT EXISTS (SELECT 1 FROM e b WHERE b.record_no = e.record_no AND b.src = e.dst AND b.dst = e.src AND b.ia = -e.ia AND b.ib = -e.ib AND b.ic = -e.ic)")
def reciprocity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.one_way(_graph(spark, sf_dir), "record_no").agg(F.count("*").alias("one_way"))


@query(EDGES + ", f AS (SELECT *, min(dist) OVER (PARTITION BY record_no, src) AS d1 FROM e) SELECT record_no, src, count(*) FILTER (dist <= d1 + 0.1e0) AS coordination FROM f GROUP BY record_no, src")
def coordination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.coordination(_graph(spark, sf_dir), "record_no")


@query(EDGES + ", g AS (SELECT *, CASE WHEN dist - lag(dist) OVER (PARTITION BY record_no ORDER BY dist) > 0.1e0 THEN 1 ELSE 0 END AS cut FROM e), h AS (SELECT *, sum(cut) OVER (PARTITION BY record_no ORDER BY dist) AS shell_no FROM g) SELECT record_no, CAST(shell_no AS BIGINT) AS shell_no, round(avg(dist), 6) AS mean_distance, count(*) AS n FROM h GROUP BY record_no, shell_no")
def distance_shells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.shells(_graph(spark, sf_dir), "record_no").select("record_no", F.col("shell_no").cast("bigint").alias("shell_no"), F.round("mean_distance", 6).alias("mean_distance"), "n")


@query()
def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = graph.summary(table(spark, sf_dir, "materials_sample").select("record_no", "structure"), "record_no", 4.0, 8)
    same = ("record_no", "n_sites", "edge_count", "added_edges", "zero_distances", "one_way_edges", "displacement_consistent", "edges_truncated", "state")
    return s.select(*same, F.round("shortest", 6).alias("shortest"), F.round("mean_coordination", 6).alias("mean_coordination"), F.greatest(F.size("edges"), F.lit(0)).cast("bigint").alias("n_shown"), F.size("truncated_sources").cast("bigint").alias("n_truncated"))


@query()
def node_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "materials_sample")
    f = F.col("features")
    # the whole vector, told by its length, the place of its one and its last three values
    told = graph.node_features(m, "record_no").select("record_no", "idx", F.size(f).alias("n_features"), F.array_position(F.slice(f, 1, 100), 1.0).cast("int").alias("hot_at"), F.get(f, 100).alias("electronegativity"), F.get(f, 101).alias("atomic_radius"), F.get(f, 102).alias("group"))
    return graph.nodes(m, "record_no").select("record_no", "idx", "species", "atomic_number").join(told, ["record_no", "idx"])


# --- metrics
_REL = "CAST(floor(score * 4) AS INTEGER)"


def _runs(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "shortlist_example").where("score IS NOT NULL AND NOT isnan(score) AND rank_no IS NOT NULL")
    return s.select("shortlist_no", "rank_no", "material_id", "scored_at", F.floor(F.col("score") * 4).cast("int").alias("rel"))


_RUNS = f"(SELECT shortlist_no, rank_no, material_id, scored_at, {_REL} AS rel FROM shortlist_example WHERE score IS NOT NULL AND NOT isnan(score) AND rank_no IS NOT NULL)"
_ORDER = ["rank_no", "material_id", "rel", "scored_at"]


@query(f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY shortlist_no ORDER BY {', '.join(_ORDER)}) AS p FROM {_RUNS}) SELECT shortlist_no, round(sum((pow(2.0e0, rel) - 1) / log2(p + 1)), 6) AS dcg FROM r GROUP BY shortlist_no")
def dcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.dcg(_runs(spark, sf_dir), "shortlist_no", "rel", _ORDER).withColumn("dcg", F.round("dcg", 6))


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY shortlist_no ORDER BY {', '.join(_ORDER)}) AS p FROM {_RUNS}), t AS (SELECT *, row_number() OVER (PARTITION BY shortlist_no ORDER BY rel DESC, p) AS i FROM r WHERE p <= 10)
SELECT shortlist_no, round(CASE WHEN sum((pow(2.0e0, rel) - 1) / log2(i + 1)) > 0 THEN sum((pow(2.0e0, rel) - 1) / log2(p + 1)) / sum((pow(2.0e0, rel) - 1) / log2(i + 1)) ELSE 0.0e0 END, 6) AS ndcg FROM t GROUP BY shortlist_no""")
def ndcg_at_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ndcg_at_k(_runs(spark, sf_dir), "shortlist_no", "rel", _ORDER, 10).withColumn("ndcg", F.round("ndcg", 6))


@query("SELECT round(coalesce(avg(CASE WHEN bulk_modulus BETWEEN 20 * density AND 60 * density THEN 1.0e0 ELSE 0.0e0 END), 0.0e0), 9) AS coverage FROM lemat_bulk_sample")
def interval_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _bulk(spark, sf_dir).select("bulk_modulus", (20 * F.col("density")).alias("lo"), (60 * F.col("density")).alias("hi"))
    return metrics.interval_coverage(t, "bulk_modulus", "lo", "hi").withColumn("coverage", F.round("coverage", 9))


@query("""WITH v AS (SELECT row_no, CASE WHEN NOT isnan(density) THEN density END AS d FROM lemat_bulk_sample), e AS (SELECT list_sort(list_distinct(quantile_cont(d, [0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1]))) AS q FROM v)
SELECT row_no, CAST(coalesce(CASE WHEN d IS NOT NULL THEN len(list_filter(q[2:-2], lambda x: x < d)) END, 0) AS INTEGER) AS bin FROM v, e""")
def quantile_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.quantile_bins(_bulk(spark, sf_dir).select("row_no", "density"), "density").select("row_no", "bin")


@query()
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each bin and split; which ones they are is up to the seed."""
    done = metrics.stratified_split(_bulk(spark, sf_dir).select("row_no", "density"), "row_no", "density", 0.2)
    return done.groupBy("bin", "split").agg(F.count("*").alias("n"))


@query("SELECT 'train' AS split, count(*) AS n FROM shortlist_example WHERE shortlist_no % 2 = 0 UNION ALL SELECT 'test', count(*) FROM shortlist_example WHERE shortlist_no % 2 <> 0")
def union_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "shortlist_example")
    even = F.col("shortlist_no") % 2 == 0
    return metrics.union_splits(s.where(even), s.where(~even)).groupBy("split").agg(F.count("*").alias("n"))


# --- joins, windows, lookups
# the lowest energy of each immutable id stands for a hull table of its own
_HULL = "(SELECT immutable_id, min(energy_above_hull) AS dft_hull FROM lemat_bulk_sample WHERE immutable_id IS NOT NULL AND NOT isnan(energy_above_hull) GROUP BY 1)"
_OK_CELL = """len(structure.lattice) = 3 AND len(list_filter(structure.lattice, lambda r: coalesce(len(r) = 3 AND len(list_filter(r, lambda x: x IS NULL OR isnan(x))) = 0, false))) = 3 AND abs(structure.lattice[1][1] * (structure.lattice[2][2] * structure.lattice[3][3] - structure.lattice[2][3] * structure.lattice[3][2]) - structure.lattice[1][2] * (structure.lattice[2][1] * structure.lattice[3][3] - structure.lattice[2][3] * structure.lattice[3][1]) + structure.lattice[1][3] * (structure.lattice[2][1] * structure.lattice[3][2] - structure.lattice[2][2] * structure.lattice[3][1])) > 1e-9
AND len(structure.species) = nsites AND len(structure.coords) = nsites AND len(list_filter(structure.coords, lambda r: coalesce(len(r) = 3 AND len(list_filter(r, lambda x: x IS NULL OR isnan(x))) = 0, false))) = nsites"""
_CURATED = f"""SELECT b.row_no, b.immutable_id, b.structure_fingerprint, b.nsites, h.dft_hull, CASE WHEN list_contains(elements, 'Ti') AND list_contains(elements, 'Al') THEN 'Ti-Al-N' WHEN list_contains(elements, 'Ti') THEN 'Ti-N' ELSE 'Al-N' END AS chemistry FROM lemat_bulk_sample b JOIN {_HULL} h USING (immutable_id)
WHERE nelements BETWEEN 2 AND 3 AND nsites <= 16 AND list_contains(elements, 'N') AND (list_contains(elements, 'Ti') OR list_contains(elements, 'Al')) AND trim(structure_fingerprint) <> '' AND {_OK_CELL}"""


def _hull(spark, sf_dir) -> DataFrame:
    t = _bulk(spark, sf_dir).where("immutable_id IS NOT NULL AND NOT isnan(energy_above_hull)")
    return t.groupBy("immutable_id").agg(F.min("energy_above_hull").alias("dft_hull"))


@query(f"SELECT row_no, immutable_id, dft_hull, chemistry FROM ({_CURATED})")
def hull_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.candidates(_bulk(spark, sf_dir), _hull(spark, sf_dir)).select("row_no", "immutable_id", "dft_hull", "chemistry")


@query("SELECT structure_fingerprint, min(row_no) AS row_no FROM lemat_bulk_sample WHERE trim(structure_fingerprint) <> '' GROUP BY structure_fingerprint")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.first_of_each(_bulk(spark, sf_dir).select("structure_fingerprint", "row_no"))


@query(f"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY structure_fingerprint ORDER BY row_no) AS p FROM ({_CURATED}))
SELECT row_no, chemistry, place FROM (SELECT row_no, chemistry, CAST(row_number() OVER (PARTITION BY chemistry ORDER BY dft_hull, nsites, immutable_id, row_no) AS INTEGER) AS place FROM f WHERE p = 1) WHERE place <= 8""")
def curated_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.snapshot(_bulk(spark, sf_dir), _hull(spark, sf_dir)).select("row_no", "chemistry", "place")


@query("SELECT row_no, material_id FROM lemat_bulk_sample WHERE list_contains(elements, 'Hf')")
def search_element(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.search(_bulk(spark, sf_dir), "Hf").select("row_no", "material_id")


@query("SELECT artifact_no, material_id FROM chgnet_reference WHERE artifact_no = 7")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.point_lookup(table(spark, sf_dir, "chgnet_reference"), 7, "artifact_no").select("artifact_no", "material_id")


@query("SELECT jid FROM jarvis_rows WHERE list_has_any(atoms.elements, ['Ti', 'N'])")
def elements_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "jarvis_rows").where(connectors.elements_any(F.col("atoms.elements"), ["Ti", "N"])).select("jid")


@query("SELECT jid FROM jarvis_rows WHERE list_has_all(atoms.elements, ['Ti', 'N'])")
def elements_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "jarvis_rows").where(connectors.elements_all(F.col("atoms.elements"), ["Ti", "N"])).select("jid")


@query("SELECT vec_id, round(sqrt(sum(CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6) AS norm FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) GROUP BY vec_id")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(normalize.max_force(F.array(F.col("embedding").cast("array<double>"))), 6).alias("norm"))


# --- connectors over saved documents
_JOK = "len(atoms.lattice_mat) = 3 AND len(atoms.elements) > 0 AND len(atoms.elements) = len(atoms.coords)"


@query(f"""SELECT material_id, name, value, unit FROM (SELECT 'jarvis:' || jid AS material_id, unnest(['optb88vdw_total_energy', 'bulk_modulus', 'shear_modulus']) AS name, unnest([{_JN('optb88vdw_total_energy')}, CASE WHEN {_JN('bulk_modulus_kv')} > 0 THEN {_JN('bulk_modulus_kv')} END, CASE WHEN {_JN('shear_modulus_gv')} > 0 THEN {_JN('shear_modulus_gv')} END]) AS value, unnest(['eV', 'GPa', 'GPa']) AS unit FROM jarvis_rows WHERE {_JOK}) WHERE value IS NOT NULL""")
def jarvis_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connectors.jarvis(table(spark, sf_dir, "jarvis_rows")).select("material_id", F.explode("properties").alias("p")).select("material_id", "p.name", "p.value", "p.unit")


@query("""SELECT material_id, name, value, unit FROM (SELECT material_id, unnest(['density', 'energy_above_hull', 'bulk_modulus']) AS name, unnest([density, energy_above_hull, bulk_modulus]) AS value, unnest(['g/cm^3', 'eV/atom', 'GPa']) AS unit FROM lemat_bulk_sample WHERE material_id IS NOT NULL AND formula IS NOT NULL) WHERE value IS NOT NULL AND NOT isnan(value)""")
def materials_project_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = lambda c: F.nanvl(c, F.lit(None))
    docs = _bulk(spark, sf_dir).select(F.to_json(F.struct("material_id", F.col("formula").alias("formula_pretty"), clean("density").alias("density"), clean("energy_above_hull").alias("energy_above_hull"), F.struct(clean("bulk_modulus").alias("vrh")).alias("bulk_modulus"))).alias("body"))
    return connectors.materials_project(docs).select("material_id", F.explode("properties").alias("p")).select("material_id", "p.name", "p.value", "p.unit")


@query("SELECT 'nomad:' || trim(material_id) AS material_id, trim(formula) AS formula FROM materials_sample WHERE trim(material_id) <> '' AND trim(formula) <> ''")
def nomad_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "materials_sample").select(F.to_json(F.struct(F.col("material_id").alias("entry_id"), F.struct(F.struct(F.col("formula").alias("chemical_formula_reduced"), "elements").alias("material")).alias("results"))).alias("body"))
    return connectors.nomad(docs).select("material_id", "formula")


@query()
def optimade_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "materials_sample")
    kinds = F.transform(F.array_distinct("structure.species"), lambda s: F.struct(s.alias("name"), F.array(s).alias("chemical_symbols"), F.array(F.lit(1.0)).alias("concentration")))
    attributes = F.struct(F.col("structure.lattice").alias("lattice_vectors"), F.col("structure.coords").alias("cartesian_site_positions"), F.col("structure.species").alias("species_at_sites"), kinds.alias("species"), F.col("formula").alias("chemical_formula_reduced"), F.lit(3).alias("nperiodic_dimensions"))
    docs = m.select(F.to_json(F.struct(F.col("record_no").cast("string").alias("id"), attributes.alias("attributes"))).alias("body"))
    good, _ = connectors.optimade(docs, "oqmd")
    return good.select("material_id", "formula", F.round(F.get("properties", 0)["value"], 6).alias("density"))


@query()
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as JSON lines, read again by the tolerant decoder."""
    m = table(spark, sf_dir, "materials_sample").select("material_id", "formula", "reduced_formula", "elements", "structure", "source_id")
    where = f"{shared_dir(spark)}/crysmill/jsonl-{Scratch(spark, 'x').base[-12:]}"
    readers.to_jsonl(m, where)
    return readers.from_jsonl(spark, where).select("material_id", "formula", "reduced_formula")


# --- simulation
_EMT = ", ".join(f"'{x}'" for x in simulation.EMT)


@query(f"""SELECT record_no AS material_id, reason IS NULL AS ready, reason FROM (SELECT record_no, CASE WHEN coalesce(len(structure.species), 0) < 1 THEN 'no structure' WHEN NOT list_has_all([{_EMT}], structure.species) THEN 'unsupported: ' || array_to_string(list_sort(list_distinct(list_filter(structure.species, lambda s: s NOT IN ({_EMT})))), ', ') END AS reason FROM materials_sample)""")
def simulation_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "materials_sample").select(F.col("record_no").alias("material_id"), "structure")
    return simulation.readiness(m, installed=True)


@query("SELECT artifact_no, CASE WHEN result IS NULL OR json_type(result) <> 'OBJECT' THEN 'not_object' ELSE 'engine_empty' END AS fault FROM chgnet_reference")
def result_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulation.envelopes(table(spark, sf_dir, "chgnet_reference").select("artifact_no", "result"), "result").select("artifact_no", "fault")


# --- streams
@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n_events FROM events GROUP BY 1, 2")
def stream_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import feeds

    return feeds.counted_hours(spark, sf_dir)


