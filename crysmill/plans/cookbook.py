"""The ten analytical recipes over a bulk table, as Spark SQL; unique tie-breaks make every ranking the same each time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..runtime import table

_POOL = "array('Ti', 'Al', 'Si', 'C', 'N')"
_STIFF = "array('Ti', 'Al', 'Si', 'C', 'N', 'Zr', 'B')"


def _only(pool: str) -> str:
    return f"size(array_except(elements, {pool})) = 0"


_CLEAN = {c: f"nanvl({c}, NULL) AS {c}" for c in ("density", "bulk_modulus", "energy_above_hull")}
_D, _K, _E = (_CLEAN[c] for c in ("density", "bulk_modulus", "energy_above_hull"))

# Recipe -> Spark SQL over {bulk}; the formula stands for the reduced formula, which the table doesn't have. NaN is missing:
# it fails every upper bound by itself, so bounds stay plain for the reader, and is made null where it is shown or ranked.
RECIPES = {
    "cookbook_01_row_counts": "SELECT count(*) AS row_count, count(DISTINCT material_id) AS distinct_material_ids FROM {bulk}",
    "cookbook_02_functional_coverage": "SELECT functional, count(*) AS row_count FROM {bulk} GROUP BY functional",
    "cookbook_03_element_system_counts": "SELECT element, count(DISTINCT material_id) AS material_count FROM (SELECT material_id, explode(elements) AS element FROM {bulk}) GROUP BY element",
    "cookbook_04_formula_duplicates": "SELECT formula AS reduced_formula, count(*) AS row_count, count(DISTINCT immutable_id) AS distinct_immutable_ids, count(DISTINCT structure_fingerprint) AS distinct_structure_fingerprints FROM {bulk} GROUP BY formula HAVING count(*) > 1",
    "cookbook_05_energy_per_site_caveats": "SELECT formula AS reduced_formula, functional, count(*) AS row_count, min(energy_per_site) AS min_energy_per_site, max(energy_per_site) AS max_energy_per_site FROM {bulk} WHERE energy_per_site IS NOT NULL AND NOT isnan(energy_per_site) GROUP BY formula, functional",
    "cookbook_06_force_quality_checks": "SELECT row_no, material_id, formula AS reduced_formula, max_force FROM {bulk} WHERE max_force IS NOT NULL AND NOT isnan(max_force) ORDER BY max_force DESC, row_no LIMIT 100",
    "cookbook_07_candidate_pool": f"SELECT row_no, material_id, formula AS reduced_formula, functional, nelements, nsites, {_D}, {_K}, {_E} FROM {{bulk}} WHERE nelements <= 4 AND nsites <= 80 AND {_only(_POOL)}",
    "cookbook_08_low_density_high_modulus": f"SELECT row_no, material_id, formula AS reduced_formula, functional, {_D}, {_K}, {_E} FROM {{bulk}} WHERE nelements <= 4 AND nsites <= 80 AND density <= 4.5e0 AND energy_above_hull <= 0.05e0 AND {_only(_STIFF)} ORDER BY bulk_modulus DESC NULLS LAST, density ASC, row_no",
    "cookbook_09_lightweight_structural": f"SELECT row_no, material_id, formula AS reduced_formula, functional, {_D}, {_K}, {_E} FROM {{bulk}} WHERE density <= 5.0e0 AND energy_above_hull <= 0.05e0 AND {_only(_POOL)} ORDER BY density ASC, bulk_modulus DESC NULLS LAST, row_no",
    "cookbook_10_top_k_per_system": f"SELECT row_no, material_id, reduced_formula, functional, bulk_modulus, energy_above_hull FROM (SELECT *, row_number() OVER (PARTITION BY reduced_formula ORDER BY bulk_modulus DESC NULLS LAST, energy_above_hull ASC NULLS LAST, row_no) AS rk FROM (SELECT row_no, material_id, formula AS reduced_formula, functional, {_K}, {_E} FROM {{bulk}})) WHERE rk <= 3",
}


def recipe(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(RECIPES[name], bulk=table(spark, sf_dir, "lemat_bulk_sample"))

    return run


def columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [(n,) for n in table(spark, sf_dir, "lemat_bulk_sample").columns]
    return spark.createDataFrame(names, "column_name string")


QUERIES = {name: recipe(name) for name in RECIPES} | {"cookbook_01_columns": columns}
ORACLE = {
    "cookbook_01_columns": "SELECT column_name FROM (DESCRIBE SELECT * FROM lemat_bulk_sample)",
    "cookbook_01_row_counts": "SELECT count(*) AS row_count, (SELECT count(*) FROM (SELECT DISTINCT material_id FROM lemat_bulk_sample WHERE material_id IS NOT NULL)) AS distinct_material_ids FROM lemat_bulk_sample",
    "cookbook_02_functional_coverage": "SELECT DISTINCT functional, count(*) OVER (PARTITION BY functional) AS row_count FROM lemat_bulk_sample",
    "cookbook_03_element_system_counts": "WITH e AS (SELECT DISTINCT material_id, unnest(elements) AS element FROM lemat_bulk_sample) SELECT element, count(material_id) AS material_count FROM e GROUP BY element",
    "cookbook_04_formula_duplicates": """WITH g AS (SELECT formula, list(immutable_id) AS i, list(structure_fingerprint) AS f, count(*) AS n FROM lemat_bulk_sample GROUP BY formula)
SELECT formula AS reduced_formula, n AS row_count, CAST(len(list_distinct(i)) AS BIGINT) AS distinct_immutable_ids, CAST(len(list_distinct(f)) AS BIGINT) AS distinct_structure_fingerprints FROM g WHERE n > 1""",
    "cookbook_05_energy_per_site_caveats": "SELECT formula AS reduced_formula, functional, count(*) AS row_count, min(energy_per_site) AS min_energy_per_site, max(energy_per_site) AS max_energy_per_site FROM lemat_bulk_sample WHERE energy_per_site = energy_per_site AND NOT isnan(energy_per_site) GROUP BY ALL",
    "cookbook_06_force_quality_checks": "SELECT row_no, material_id, formula AS reduced_formula, max_force FROM (SELECT *, row_number() OVER (ORDER BY max_force DESC, row_no) AS p FROM lemat_bulk_sample WHERE max_force IS NOT NULL AND NOT isnan(max_force)) WHERE p <= 100",
    "cookbook_07_candidate_pool": """SELECT row_no, material_id, formula AS reduced_formula, functional, nelements, nsites, CASE WHEN NOT isnan(density) THEN density END AS density, CASE WHEN NOT isnan(bulk_modulus) THEN bulk_modulus END AS bulk_modulus, CASE WHEN NOT isnan(energy_above_hull) THEN energy_above_hull END AS energy_above_hull
FROM lemat_bulk_sample WHERE nelements <= 4 AND nsites <= 80 AND len(list_filter(elements, lambda e: e NOT IN ('Ti', 'Al', 'Si', 'C', 'N'))) = 0""",
    "cookbook_08_low_density_high_modulus": """SELECT row_no, material_id, formula AS reduced_formula, functional, density, CASE WHEN NOT isnan(bulk_modulus) THEN bulk_modulus END AS bulk_modulus, energy_above_hull FROM lemat_bulk_sample
WHERE nelements <= 4 AND nsites <= 80 AND density <= 4.5 AND NOT isnan(density) AND energy_above_hull <= 0.05 AND NOT isnan(energy_above_hull) AND len(list_filter(elements, lambda e: e NOT IN ('Ti', 'Al', 'Si', 'C', 'N', 'Zr', 'B'))) = 0""",
    "cookbook_09_lightweight_structural": """SELECT row_no, material_id, formula AS reduced_formula, functional, density, CASE WHEN NOT isnan(bulk_modulus) THEN bulk_modulus END AS bulk_modulus, energy_above_hull FROM lemat_bulk_sample
WHERE density <= 5.0 AND NOT isnan(density) AND energy_above_hull <= 0.05 AND NOT isnan(energy_above_hull) AND len(list_filter(elements, lambda e: e NOT IN ('Ti', 'Al', 'Si', 'C', 'N'))) = 0""",
    "cookbook_10_top_k_per_system": """WITH b AS (SELECT row_no, material_id, formula AS reduced_formula, functional, CASE WHEN NOT isnan(bulk_modulus) THEN bulk_modulus END AS bulk_modulus, CASE WHEN NOT isnan(energy_above_hull) THEN energy_above_hull END AS energy_above_hull FROM lemat_bulk_sample),
g AS (SELECT row_no, material_id, reduced_formula, functional, bulk_modulus, energy_above_hull, rank() OVER (PARTITION BY reduced_formula ORDER BY coalesce(-bulk_modulus, 1e300), coalesce(energy_above_hull, 1e300), row_no) AS p FROM b)
SELECT row_no, material_id, reduced_formula, functional, bulk_modulus, energy_above_hull FROM g WHERE p < 4""",
}
