"""Queries of operators that the screening queries don't reach: converters, reports, connector loops, exports, streams."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, metrics, normalize, simulation
from ..operators.scorecard import Scorecard
from ..runtime import table
from ..sources import catalog, fetch, readers
from ..sources.transport import ConnectorQuery, Policy
from . import curation, oracles, screening

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return keep


_V = "CASE WHEN NOT isnan({0}) THEN {0} END"


@query("""SELECT p_partkey, p_size * CASE p_partkey % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 10.0::DOUBLE WHEN 2 THEN 0.529177210903::DOUBLE END AS length_angstrom,
CASE p_partkey % 4 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN p_size + 273.15::DOUBLE WHEN 2 THEN p_size + 273.15::DOUBLE END AS temperature_k, CASE WHEN p_partkey % 4 = 3 THEN 'unsupported unit: furlong' END AS issue FROM part""")
def unit_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    pick = lambda *units: F.element_at(F.array(*map(F.lit, units)), (F.col("p_partkey") % 4 + 1).cast("int"))
    v, length = F.col("p_size").cast("double"), pick("Angstrom", " nm", "BOHR", "furlong")
    out = normalize.length_angstrom(v, length)
    return p.select("p_partkey", out.alias("length_angstrom"), normalize.temperature_k(v, pick("K", "°C", "celsius", "F")).alias("temperature_k"), normalize.unit_issue(out, v, length).alias("issue"))


@query(f"""SELECT row_no, CASE WHEN f IS NULL AND h IS NULL THEN '' WHEN f > 0.2::DOUBLE OR h > 0.05::DOUBLE THEN 'fail' ELSE 'pass' END AS state, CASE WHEN f IS NULL AND h IS NULL THEN 'no data' WHEN f > 0.2::DOUBLE THEN 'force' WHEN h > 0.05::DOUBLE THEN 'hull' ELSE 'pass' END AS label
FROM (SELECT row_no, {_V.format('max_force')} AS f, {_V.format('energy_above_hull')} AS h FROM lemat_bulk_sample)""")
def constraint_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = catalog.constraint_verdict(F.col("max_force"), F.col("energy_above_hull"), 0.2, 0.05)
    return table(spark, sf_dir, "lemat_bulk_sample").select("row_no", v.alias("v")).select("row_no", "v.*")


_POOLED = f"SELECT * FROM lemat_bulk_sample WHERE {screening._INC} AND {screening._NSITES} <= 12 AND {screening._NEL} <= 3"


@query(f"""WITH s AS ({_POOLED}) SELECT (SELECT count(*) FROM lemat_bulk_sample) AS input_count, count(*) AS output_count, (SELECT count(*) FROM lemat_bulk_sample) - count(*) AS removed_count, 'elements,nelements,nsites' AS columns_used, count(DISTINCT functional) FILTER (trim(functional) <> '') > 1 AS mixed_functionals,
count(*) FILTER (structure IS NULL) AS missing_structure_count, count(*) FILTER (coalesce(len({oracles._faults('structure')}), 1) > 0) AS graph_export_excluded_count, 'allow_duplicate_records' AS duplicate_policy, 'unknown' AS deduplication_basis FROM s""")
def slice_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = screening._dataset(spark, sf_dir).candidate_pool(screening.INCLUDE, None, 12, 3).create_slice("pool", True, True).report()
    keys = ("input_count", "output_count", "removed_count", "mixed_functionals", "missing_structure_count", "graph_export_excluded_count", "duplicate_policy", "deduplication_basis")
    return spark.createDataFrame([(*[r[k] for k in keys], ",".join(r["columns_used"]))], "input_count bigint, output_count bigint, removed_count bigint, mixed_functionals boolean, missing_structure_count bigint, graph_export_excluded_count bigint, duplicate_policy string, deduplication_basis string, columns_used string")


@query(f"""WITH s AS ({_POOLED}), l AS (SELECT material_id, arg_max(coalesce(len({oracles._faults('structure')}), 1) = 0, row_no) AS ready FROM lemat_bulk_sample GROUP BY 1)
SELECT count(*) FILTER (ready) AS included_count, count(*) FILTER (NOT coalesce(ready, false)) AS excluded_count FROM s LEFT JOIN l ON s.material_id = l.material_id""")
def slice_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = screening._dataset(spark, sf_dir).candidate_pool(screening.INCLUDE, None, 12, 3)
    r = catalog.slice_readiness(chosen.df, chosen.root)
    return spark.createDataFrame([(r["included_count"], r["excluded_count"])], "included_count bigint, excluded_count bigint")


@query(f"SELECT (SELECT count(*) FROM lemat_bulk_sample) AS pool_size, count(*) AS ranked_count, (SELECT count(*) FROM lemat_bulk_sample) - count(*) AS excluded_by_constraints, count(*) <= 2 AS binary_normalization, 'density,bulk_modulus' AS effective_objectives, '' AS ignored_objectives FROM lemat_bulk_sample WHERE {screening._OK}")
def scorecard_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Scorecard(screening.CARD, screening.LIMITS).report(table(spark, sf_dir, "lemat_bulk_sample"))
    return spark.createDataFrame([(r["pool_size"], r["ranked_count"], r["excluded_by_constraints"], r["binary_normalization"], ",".join(r["effective_objectives"]), ",".join(r["ignored_objectives"]))], "pool_size bigint, ranked_count bigint, excluded_by_constraints bigint, binary_normalization boolean, effective_objectives string, ignored_objectives string")


@query(f"SELECT row_no FROM ({screening._card_sql('worst')}) ORDER BY score DESC, row_no LIMIT 1")
def default_leader(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = catalog.default_leader(Scorecard(screening.CARD, screening.LIMITS), table(spark, sf_dir, "lemat_bulk_sample"), "row_no")
    return spark.createDataFrame([(first,)], "row_no bigint")


@query(f"SELECT record_no, CAST(len(structure.species) AS INTEGER) AS n_sites, CASE WHEN len(structure.lattice) = 3 AND {oracles._threes('structure.lattice')} AND {oracles._det('structure.lattice')} > 1e-9 THEN round({oracles._det('structure.lattice')}, 6) END AS volume, 'unknown' AS space_group_status FROM materials_sample")
def global_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph.global_features(table(spark, sf_dir, "materials_sample"), "record_no")
    return g.select("record_no", "n_sites", F.round("volume", 6).alias("volume"), "space_group_status")


@query(screening.EDGES + ", o AS (SELECT record_no, src, dst, ia, ib, ic, row_number() OVER (PARTITION BY record_no ORDER BY src, round(dist, 6), dst, ia, ib, ic) - 1 AS edge_no FROM e) SELECT record_no, CAST(edge_no AS INTEGER) AS edge_no, CAST(src AS INTEGER) AS src, CAST(dst AS INTEGER) AS dst, CAST(ia AS INTEGER) AS ia, CAST(ib AS INTEGER) AS ib, CAST(ic AS INTEGER) AS ic FROM o")
def edge_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = graph.numbered(screening._graph(spark, sf_dir), "record_no")
    return e.select("record_no", "edge_no", "src", "dst", "ia", "ib", "ic")


@query(f"SELECT name, count(*) AS n, round(sum(value), 3) AS total FROM ({screening.ORACLE['unpivot_properties']}) GROUP BY name")
def material_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of the nested records of a dataset, by name."""
    p = screening._dataset(spark, sf_dir).to_materials().select(F.explode("properties").alias("p"))
    return p.groupBy("p.name").agg(F.count("*").alias("n"), F.round(F.sum("p.value"), 3).alias("total"))


@query("""SELECT '{"material_id": ' || to_json(material_id) || ', "record_no": ' || record_no || '}' AS line FROM materials_sample WHERE material_id IS NOT NULL UNION ALL SELECT '{"record_no": ' || record_no || '}' FROM materials_sample WHERE material_id IS NULL""")
def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.canonical_lines(table(spark, sf_dir, "materials_sample").select("record_no", "material_id"))


@query("""SELECT row_no, array_to_string(list_sort(list_distinct(list_filter(list_transform(CASE WHEN regexp_full_match(formula, '([A-Z][a-z]?\\d*\\.?\\d*)+') THEN regexp_extract_all(formula, '[A-Z][a-z]?') ELSE regexp_split_to_array(trim(formula), '[,\\-\\s]+') END, lambda x: trim(x)), lambda x: x <> ''))), ',') AS elements FROM lemat_bulk_sample WHERE formula IS NOT NULL""")
def elements_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lemat_bulk_sample").where("formula IS NOT NULL")
    return t.select("row_no", F.array_join(normalize.elements_of_text(F.col("formula")), ",").alias("elements"))


@query("SELECT part, n, total FROM (SELECT 'train_X' AS part, count(*) AS n, NULL::DOUBLE AS total FROM shortlist_example WHERE shortlist_no % 2 = 0 UNION ALL SELECT 'train_y', count(*), round(sum(density), 3) FROM shortlist_example WHERE shortlist_no % 2 = 0 UNION ALL SELECT 'test_X', count(*), NULL FROM shortlist_example WHERE shortlist_no % 2 <> 0 UNION ALL SELECT 'test_y', count(*), round(sum(density), 3) FROM shortlist_example WHERE shortlist_no % 2 <> 0)")
def regression_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "shortlist_example").select("shortlist_no", F.col("density").alias("target"))
    even = F.col("shortlist_no") % 2 == 0
    parts = metrics.regression_arrays(metrics.union_splits(s.where(even), s.where(~even)))
    out = None
    for name, df in parts.items():
        total = F.round(F.sum("target"), 3) if name.endswith("y") else F.lit(None).cast("double")
        one = df.agg(F.count("*").alias("n"), total.alias("total")).withColumn("part", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH f AS (SELECT *, row_number() OVER (PARTITION BY structure_fingerprint ORDER BY row_no) AS p FROM ({screening._CURATED})) SELECT chemistry, least(count(*), 8) AS n FROM f WHERE p = 1 GROUP BY 1")
def cohort_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.snapshot(table(spark, sf_dir, "lemat_bulk_sample"), screening._hull(spark, sf_dir)).groupBy("chemistry").agg(F.count("*").alias("n"))


@query("SELECT record_no AS material_id, 'lammps' AS engine, 'failed' AS status, 'not_implemented' AS error FROM materials_sample")
def simulation_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "materials_sample").select(F.col("record_no").alias("material_id"))
    return simulation.run_job(m, "lammps").select("material_id", "engine", "status", "error")


# --- connector loops, served from the tables a page at a time
def _served(rows: DataFrame, order: str, page):
    """A ``send`` that answers with pages of a table, read in order; ``page`` gives (first place or key, size, answer)."""

    def send(method, url, timeout=None, **options):
        after, size, answer = page(url, options)
        part = rows.where(F.col(order) > F.lit(after)).orderBy(order).limit(size).collect()
        return 200, {}, answer([json.loads(r["body"]) for r in part], part[-1][order] if part else None)

    return send


@query("SELECT 'nomad:' || material_id AS material_id, 'nomad' AS source FROM (SELECT DISTINCT trim(material_id) AS material_id FROM materials_sample WHERE trim(material_id) <> '' AND trim(formula) <> '' ORDER BY 1 LIMIT 45)")
def nomad_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "materials_sample").where("trim(material_id) <> '' AND trim(formula) <> ''").groupBy(F.trim("material_id").alias("id")).agg(F.min("formula").alias("f"))
    rows = m.select("id", F.to_json(F.struct(F.col("id").alias("entry_id"), F.struct(F.struct(F.col("f").alias("chemical_formula_reduced")).alias("material")).alias("results"))).alias("body"))

    def page(url, options):
        p = options["json"]["pagination"]
        return p.get("page_after_value", ""), p["page_size"], lambda got, last: {"data": got, "pagination": {"next_page_after_value": last}}

    got = fetch.nomad(spark, ConnectorQuery(max_records=45, page_size=20), _served(rows, "id", page), Policy())
    return got.records.select("material_id", F.get("provenance", 0)["source"].alias("source"))


@query("SELECT material_id, 'materials_project' AS source FROM (SELECT DISTINCT material_id FROM lemat_bulk_sample WHERE material_id IS NOT NULL AND formula IS NOT NULL AND list_contains(elements, 'Ti') ORDER BY 1 LIMIT 50)")
def materials_project_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "lemat_bulk_sample").where("material_id IS NOT NULL AND formula IS NOT NULL AND array_contains(elements, 'Ti')").groupBy("material_id").agg(F.min("formula").alias("f"))
    rows = b.select("material_id", F.to_json(F.struct("material_id", F.col("f").alias("formula_pretty"))).alias("body")).orderBy("material_id").limit(60)
    bodies = [json.loads(r["body"]) for r in rows.collect()]  # what one query may ask for

    def send(method, url, timeout=None, params=None, **_):
        return 200, {}, {"data": bodies[params["_skip"]: params["_skip"] + params["_limit"]]}

    got = fetch.materials_project(spark, ConnectorQuery(elements=("Ti",), max_records=50, page_size=20), send)
    return got.records.select("material_id", F.get("provenance", 0)["source"].alias("source"))


@query(f"SELECT material_id, 'optimade:oqmd' AS source FROM ({oracles.build(screening.EDGES)['optimade_materials']}) WHERE CAST(material_id[6:] AS BIGINT) IN (SELECT record_no FROM materials_sample ORDER BY record_no LIMIT 60)")
def optimade_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "materials_sample")
    kinds = F.transform(F.array_distinct("structure.species"), lambda s: F.struct(s.alias("name"), F.array(s).alias("chemical_symbols"), F.array(F.lit(1.0)).alias("concentration")))
    attributes = F.struct(F.col("structure.lattice").alias("lattice_vectors"), F.col("structure.coords").alias("cartesian_site_positions"), F.col("structure.species").alias("species_at_sites"), kinds.alias("species"), F.col("formula").alias("chemical_formula_reduced"), F.lit(3).alias("nperiodic_dimensions"))
    rows = m.select("record_no", F.to_json(F.struct(F.col("record_no").cast("string").alias("id"), attributes.alias("attributes"))).alias("body"))

    def page(url, options):
        after = int(url.rsplit("after=", 1)[1]) if "after=" in url else -1
        return after, 25, lambda got, last: {"data": got, "links": {"next": {"href": f"x?after={last}"}}}

    got = fetch.optimade(spark, ConnectorQuery(max_records=60, page_size=25), _served(rows, "record_no", page), "oqmd", "x")
    return got.records.select("material_id", F.get("provenance", 0)["source"].alias("source"))


@query(f"SELECT 'jarvis:' || jid AS material_id, 'jarvis' AS source FROM (SELECT * FROM jarvis_rows ORDER BY jid LIMIT 50) WHERE {screening._JOK}")
def jarvis_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = fetch.jarvis(table(spark, sf_dir, "jarvis_rows"), ConnectorQuery(max_records=50))
    return got.records.select("material_id", F.get("provenance", 0)["source"].alias("source"))


# --- streams
@query("SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL")
def stream_first_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user once, at the first of their events that the stream meets."""
    from ..streaming import feeds

    path = f"{sf_dir}/events.parquet"
    events = feeds.files(spark, f"{path}*", spark.read.parquet(path).schema).withColumn("ts", F.col("ts").cast("timestamp")).where("user_id IS NOT NULL").select("user_id", "ts")
    return feeds.run_to_table(feeds.first_deliveries(events, ["user_id"], "ts", "365 days")).select("user_id")
