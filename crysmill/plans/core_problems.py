"""Queries of the general data problems (nested records, drift, rejects, units) over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift, nested, rejects, units
from ..runtime import Scratch, table


# --- 2: deeply nested records
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.child_links(table(spark, sf_dir, "materials_sample"), table(spark, sf_dir, "chgnet_reference"))


def _both(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    m = nested.flatten(nested.normalized_materials(table(spark, sf_dir, "materials_sample")), "key", kind)
    r = nested.flatten(nested.normalized_results(table(spark, sf_dir, "chgnet_reference")), "key", kind)
    return m.withColumn("parent_table", F.lit("materials_sample")).unionByName(r.withColumn("parent_table", F.lit("chgnet_reference"))).withColumnRenamed("parent", "parent_no")


def p2_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(spark, sf_dir, "lattice")


def p2_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(spark, sf_dir, "site")


def p2_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.flatten(nested.normalized_materials(table(spark, sf_dir, "materials_sample")), "key", "property").drop("extra").withColumnRenamed("parent", "record_no")


def p2_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of each property's map ``extra``, linked to p2_properties by record_no and child_no."""
    return nested.flatten_maps(nested.normalized_materials(table(spark, sf_dir, "materials_sample")), "key", "property", "extra").withColumnRenamed("parent", "record_no")


def p2_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.flatten(nested.normalized_results(table(spark, sf_dir, "chgnet_reference")), "key", "step").withColumnRenamed("parent", "artifact_no").withColumnRenamed("child_no", "step_no")


# --- 6: quantities in different units
def p6_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every property entry that holds a value, in the common unit of its quantity."""
    return units.convert(units.property_entries(table(spark, sf_dir, "materials_sample")), spark, ("record_no", "prop_no"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = p6_common(spark, sf_dir).where("recorded_unit <> common_unit")
    return other.select("record_no", "prop_no", "recorded_unit")


# --- 4: schemas that drift between files
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.changes(table(spark, sf_dir, "lemat_raw_lines")).select("file_no", "field_name", "change")


def p4_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.changes(table(spark, sf_dir, "lemat_raw_lines"))


def p4_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent table, its lists as text and its structures without blanks."""
    t = drift.consistent(table(spark, sf_dir, "lemat_raw_lines"))
    return t.withColumns({"elements": F.array_join("elements", ","), "structure": F.regexp_replace("structure", r"\s", "")})


def p4_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.versions(table(spark, sf_dir, "lemat_raw_lines"))


def p4_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The migration steps of every version of every feed."""
    return drift.steps(table(spark, sf_dir, "lemat_raw_lines"))


def p4_odd_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of files with values of another type or values lost by a cast."""
    return drift.odd_values(table(spark, sf_dir, "lemat_raw_lines"))


# --- 5: rows that fail to parse
def _import_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    # written once, as both the first rows of each id and the rows themselves are read from it
    rows = Scratch(spark, "rejects").put(rejects.judged(table(spark, sf_dir, "import_lines"), table(spark, sf_dir, "import_report")))
    return rejects.with_duplicates(rows)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _import_rows(spark, sf_dir).where("code IS NOT NULL").select("import_no", "row_no", "code")


def p5_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("density", "bulk_modulus", "shear_modulus", "energy_above_hull", "band_gap")
    good = _import_rows(spark, sf_dir).where("code IS NULL")
    return good.select("import_no", "row_no", "material_id", "formula", *[F.col("numbers")[n].alias(n) for n in names], "structure_json", "notes")


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rejects.report(_import_rows(spark, sf_dir), table(spark, sf_dir, "import_report"))
    return r.withColumn("issue_counts", F.coalesce(F.array_join("issue_counts", ";"), F.lit("")))


def p5_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each code has, by who told it: the CSV reader's reject table or the exact check."""
    return _import_rows(spark, sf_dir).where("code IS NOT NULL").groupBy("code", "told_by").agg(F.count("*").alias("n"))


QUERIES = {"p5_reasons": p5_reasons, "p5_found": p5_found, "p5_loaded": p5_loaded, "p5_report": p5_report, "p4_found": p4_found, "p4_changes": p4_changes, "p4_table": p4_table, "p4_versions": p4_versions, "p4_steps": p4_steps, "p4_odd_values": p4_odd_values, "p6_found": p6_found, "p6_common": p6_common, "p2_found": p2_found, "p2_lattice": p2_lattice, "p2_sites": p2_sites, "p2_properties": p2_properties, "p2_extras": p2_extras, "p2_steps": p2_steps}
_KIDS = """
WITH r AS (SELECT artifact_no AS no, CAST(result AS JSON) AS j FROM chgnet_reference WHERE json_valid(result) AND json_type(result) = 'OBJECT'),
s AS (SELECT no, CASE json_type(j, '$.relaxed_structure') WHEN 'OBJECT' THEN json_extract(j, '$.relaxed_structure') WHEN 'VARCHAR' THEN CAST(json_extract_string(j, '$.relaxed_structure') AS JSON) END AS s,
  CASE json_type(j, '$.trajectory') WHEN 'VARCHAR' THEN CAST(json_extract_string(j, '$.trajectory') AS JSON) ELSE json_extract(j, '$.trajectory') END AS t FROM r),
a AS (SELECT no, 'lattice' AS kind, CASE json_type(s, '$.lattice') WHEN 'ARRAY' THEN json_extract(s, '$.lattice') WHEN 'OBJECT' THEN coalesce(json_extract(s, '$.lattice.matrix'), json_array(json_extract(s, '$.lattice.a'), json_extract(s, '$.lattice.b'), json_extract(s, '$.lattice.c'))) END AS x FROM s
  UNION ALL SELECT no, 'site', CASE WHEN json_type(s, '$.coords') = 'ARRAY' THEN json_extract(s, '$.coords') ELSE CAST(to_json(json_extract(s, '$.sites[*].coords')) AS JSON) END FROM s),
n AS (SELECT no, kind, x, coalesce(json_type(x, '$[0]') NOT IN ('ARRAY', 'OBJECT', 'NULL'), false) AS flat FROM a WHERE json_array_length(x) > 0),
i AS (SELECT no, kind, x, flat, unnest(range(CAST(CASE WHEN flat THEN json_array_length(x) // 3 ELSE json_array_length(x) END AS BIGINT))) AS k FROM n),
t AS (SELECT no, t, json_type(t) AS ty, json_type(t, '$.step') AS st FROM s),
steps AS (SELECT no, CAST(json_extract_string(t, '$[' || k || '].step') AS INTEGER) AS k FROM (SELECT no, t, unnest(range(CAST(json_array_length(t) AS BIGINT))) AS k FROM t WHERE ty = 'ARRAY') WHERE json_type(t, '$[' || k || ']') = 'OBJECT'
  UNION SELECT no, CAST(unnest(json_extract_string(t, '$.step[*]')) AS INTEGER) FROM t WHERE ty = 'OBJECT' AND st = 'ARRAY'
  UNION SELECT no, CAST(json_extract_string(t, '$.step') AS INTEGER) FROM t WHERE ty = 'OBJECT' AND st NOT IN ('ARRAY', 'NULL')
  UNION SELECT no, CAST(unnest(json_keys(t)) AS INTEGER) FROM t WHERE ty = 'OBJECT' AND st IS NULL),
m AS (SELECT record_no AS no, 'lattice' AS kind, generate_subscripts(structure.lattice, 1) - 1 AS k, unnest(structure.lattice) IS NOT NULL AS ok FROM materials_sample
  UNION ALL SELECT record_no, 'site', generate_subscripts(structure.coords, 1) - 1, unnest(structure.coords) IS NOT NULL FROM materials_sample
  UNION ALL SELECT record_no, 'property', generate_subscripts(properties, 1) - 1, unnest(properties) IS NOT NULL FROM materials_sample)
SELECT 'materials_sample' AS parent_table, no AS parent_no, kind AS child_kind, CAST(k AS INTEGER) AS child_no FROM m WHERE ok
UNION ALL SELECT 'chgnet_reference', no, kind, CAST(k AS INTEGER) FROM i WHERE flat OR json_type(x, '$[' || k || ']') <> 'NULL'
UNION ALL SELECT 'chgnet_reference', no, 'step', k FROM steps"""
_NAMES = """CASE regexp_replace(lower(key), '[^a-z0-9]', '', 'g')
  WHEN 'materialid' THEN 'material_id' WHEN 'formula' THEN 'formula' WHEN 'chemicalformula' THEN 'formula' WHEN 'formulapretty' THEN 'formula' WHEN 'composition' THEN 'formula' WHEN 'chem' THEN 'formula'
  WHEN 'elements' THEN 'elements' WHEN 'elementlist' THEN 'elements' WHEN 'speciesset' THEN 'elements' WHEN 'elementset' THEN 'elements' WHEN 'numelements' THEN 'nelements' WHEN 'numberofelements' THEN 'nelements' WHEN 'numberofsites' THEN 'nsites' WHEN 'nelements' THEN 'nelements' WHEN 'nsites' THEN 'nsites' WHEN 'numsites' THEN 'nsites'
  WHEN 'immutableid' THEN 'immutable_id' WHEN 'immid' THEN 'immutable_id' WHEN 'uid' THEN 'immutable_id' WHEN 'stableid' THEN 'immutable_id'
  WHEN 'structurefingerprint' THEN 'structure_fingerprint' WHEN 'fingerprint' THEN 'structure_fingerprint' WHEN 'sfp' THEN 'structure_fingerprint' WHEN 'structfp' THEN 'structure_fingerprint' WHEN 'fphash' THEN 'structure_fingerprint' WHEN 'col9' THEN 'structure_fingerprint'
  WHEN 'functional' THEN 'functional' WHEN 'xc' THEN 'functional' WHEN 'xcfunctional' THEN 'functional' WHEN 'dftfunctional' THEN 'functional' WHEN 'level' THEN 'functional'
  WHEN 'density' THEN 'density' WHEN 'rho' THEN 'density' WHEN 'massdensity' THEN 'density' WHEN 'bulkmodulus' THEN 'bulk_modulus' WHEN 'kvrh' THEN 'bulk_modulus'
  WHEN 'energyabovehull' THEN 'energy_above_hull' WHEN 'hulldistance' THEN 'energy_above_hull' WHEN 'eabovehull' THEN 'energy_above_hull' WHEN 'bulkmodulusvrh' THEN 'bulk_modulus' WHEN 'epersite' THEN 'energy_per_site' WHEN 'forcemax' THEN 'max_force' WHEN 'fmax' THEN 'max_force' WHEN 'crystal' THEN 'structure' WHEN 'crystalstructure' THEN 'structure' WHEN 'modifiedat' THEN 'last_modified' WHEN 'updatedat' THEN 'last_modified' WHEN 'matid' THEN 'material_id' WHEN 'entryid' THEN 'material_id' WHEN 'prettyformula' THEN 'formula' WHEN 'reducedformula' THEN 'formula' WHEN 'ehull' THEN 'energy_above_hull' WHEN 'energypersite' THEN 'energy_per_site' WHEN 'maxforce' THEN 'max_force' WHEN 'structure' THEN 'structure' WHEN 'lastmodified' THEN 'last_modified' END"""
_DRIFT = f"""
WITH e AS (SELECT file_no, key, CASE type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'list' WHEN 'OBJECT' THEN 'object' ELSE 'number' END AS ty FROM lemat_raw_lines, json_each(payload) WHERE type <> 'NULL'),
c AS (SELECT file_no, key, ty, count(*) AS n FROM e GROUP BY ALL),
f AS (SELECT file_no, key, ty FROM (SELECT *, row_number() OVER (PARTITION BY file_no, key ORDER BY n DESC, list_position(['string', 'number', 'boolean', 'list', 'object'], ty)) AS p FROM c) WHERE p = 1),
g AS (SELECT file_no, key, ty, coalesce({_NAMES}, key) AS field FROM f),
s AS (SELECT file_no, lag(file_no) OVER (PARTITION BY feed ORDER BY written_at, file_no) AS prev_no FROM (SELECT file_no, min(feed) AS feed, min(written_at) AS written_at FROM lemat_raw_lines GROUP BY file_no)),
x AS (SELECT g.file_no, g.field, g.key, g.ty FROM g JOIN s ON g.file_no = s.file_no WHERE prev_no IS NOT NULL), y AS (SELECT s.file_no, g.field, g.key, g.ty FROM g JOIN s ON g.file_no = s.prev_no),
z AS (SELECT coalesce(x.file_no, y.file_no) AS file_no, coalesce(x.field, y.field) AS field_name, x.key AS k1, x.ty AS t1, y.key AS k0, y.ty AS t0 FROM x FULL JOIN y ON x.file_no = y.file_no AND x.field = y.field)
SELECT * FROM (SELECT file_no, field_name, unnest(list_filter([CASE WHEN k0 IS NULL THEN 'added' END, CASE WHEN k1 IS NULL THEN 'removed' END, CASE WHEN k1 <> k0 THEN 'renamed' END, CASE WHEN t1 <> t0 THEN 'retyped' END], lambda c: c IS NOT NULL)) AS change, k0 AS key_before, k1 AS key_now, t0 AS type_before, t1 AS type_now FROM z)"""
_FIELDS = _DRIFT[: _DRIFT.index("\nx AS (")].rstrip(",")
ORACLE: dict[str, str] = {
    "p4_versions": f"""{_FIELDS}, p AS (SELECT file_no, string_agg(field || ':' || key || ':' || ty, ';' ORDER BY encode(field || ':' || key || ':' || ty)) AS d FROM g GROUP BY file_no),
v AS (SELECT feed, l.file_no, written_at, CASE WHEN d IS NULL THEN NULL ELSE sha256(d) END AS fingerprint FROM (SELECT file_no, min(feed) AS feed, min(written_at) AS written_at FROM lemat_raw_lines GROUP BY file_no) l LEFT JOIN p USING (file_no)),
n AS (SELECT *, CASE WHEN fingerprint IS DISTINCT FROM lag(fingerprint) OVER w OR lag(file_no) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM v WINDOW w AS (PARTITION BY feed ORDER BY written_at, file_no))
SELECT feed, file_no, fingerprint, CAST(sum(new) OVER (PARTITION BY feed ORDER BY written_at, file_no) AS BIGINT) AS version FROM n""",
    "p2_found": _KIDS,
    "p4_changes": _DRIFT,
    "p4_found": f"SELECT file_no, field_name, change FROM ({_DRIFT})",
    "p2_properties": """
WITH e AS (SELECT record_no, unnest(properties) AS p, generate_subscripts(properties, 1) - 1 AS child_no FROM materials_sample)
SELECT record_no, CAST(child_no AS INTEGER) AS child_no, p.name AS name, p.value AS value, p.value_text AS value_text, p.unit AS unit, p.source AS source, p.method AS method FROM e WHERE p IS NOT NULL""",
}
