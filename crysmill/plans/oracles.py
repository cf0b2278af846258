"""SQL for an independent engine, written by hand, of queries whose SQL is long; values stand in it as text.

Masses, electronegativities and radii are physical constants and come from the one table there is of them.
"""

from __future__ import annotations

from ..functions.elements import ELECTRONEGATIVITY, MASSES, NUMBER, RADIUS, SYMBOLS
from .core_problems import _DRIFT, _FIELDS, _KIDS

_SYMBOLS = ", ".join(f"'{s}'" for s in SYMBOLS)
_HEAVY = ", ".join(f"'{s}'" for s in MASSES)


def _map(table: dict) -> str:
    return "MAP {" + ", ".join(f"'{k}': {v!r}" for k, v in table.items()) + "}"


# --- structures
def _det(l: str) -> str:  # noqa: E741
    return f"abs({l}[1][1] * ({l}[2][2] * {l}[3][3] - {l}[2][3] * {l}[3][2]) - {l}[1][2] * ({l}[2][1] * {l}[3][3] - {l}[2][3] * {l}[3][1]) + {l}[1][3] * ({l}[2][1] * {l}[3][2] - {l}[2][2] * {l}[3][1]))"


def _threes(x: str) -> str:
    """Every entry is a list of three numbers."""
    return f"len(list_filter({x}, lambda r: coalesce(len(r) = 3 AND len(list_filter(r, lambda y: y IS NULL OR isnan(y))) = 0, false))) = len({x})"


def _faults(s: str) -> str:
    square = f"coalesce(len({s}.lattice) = 3 AND {_threes(s + '.lattice')}, false)"
    codes = [
        f"CASE WHEN NOT {square} THEN 'lattice_shape' END",
        f"CASE WHEN {square} AND NOT coalesce({_det(s + '.lattice')} > 1e-9, false) THEN 'lattice_volume' END",
        f"CASE WHEN coalesce(len({s}.species), 0) < 1 THEN 'species_empty' END",
        f"CASE WHEN len({s}.coords) IS DISTINCT FROM len({s}.species) THEN 'coords_count' END",
        f"CASE WHEN NOT coalesce({_threes(s + '.coords')}, false) THEN 'coords_shape' END",
    ]
    return f"CASE WHEN {s} IS NOT NULL THEN list_filter([{', '.join(codes)}], lambda c: c IS NOT NULL) END"


def _density(l: str, sp: str) -> str:  # noqa: E741
    mass = f"list_transform({sp}, lambda x: ({_map(MASSES)})[x])"
    return f"CASE WHEN len({sp}) > 0 AND len(list_filter({mass}, lambda m: m IS NULL)) = 0 AND {_det(l)} > 1e-9 THEN list_sum({mass}) * 1.66053906660::DOUBLE / {_det(l)} END"


_CANON = """CASE replace(replace(lower(trim(p.name)), '-', '_'), ' ', '_')
WHEN 'rho' THEN 'density' WHEN 'mass_density' THEN 'density' WHEN 'k_vrh' THEN 'bulk_modulus' WHEN 'kvrh' THEN 'bulk_modulus' WHEN 'bulk_modulus_kv' THEN 'bulk_modulus'
WHEN 'g_vrh' THEN 'shear_modulus' WHEN 'gvrh' THEN 'shear_modulus' WHEN 'shear_modulus_gv' THEN 'shear_modulus' ELSE replace(replace(lower(trim(p.name)), '-', '_'), ' ', '_') END"""
_NUMBER = r"CASE WHEN regexp_full_match(trim({0}.value_text), '[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?') THEN TRY_CAST(trim({0}.value_text) AS DOUBLE) END"


def _value(p: str) -> str:
    return f"coalesce(CASE WHEN NOT isnan({p}.value) THEN {p}.value END, {_NUMBER.format(p)})"


def _gpa(p: str) -> str:
    return f"{_value(p)} * CASE WHEN coalesce(trim({p}.unit), '') = '' THEN 1.0 ELSE CASE replace(lower(trim({p}.unit)), ' ', '') WHEN 'gpa' THEN 1.0::DOUBLE WHEN 'pa' THEN 1e-9::DOUBLE WHEN 'mpa' THEN 1e-3::DOUBLE WHEN 'kbar' THEN 0.1::DOUBLE END END"


def _modulus_note(p: str, name: str) -> str:
    unit = f"coalesce(trim({p}.unit), '')"
    return f"CASE WHEN {p} IS NULL THEN NULL WHEN {unit} = '' THEN '{name} has no unit; assuming GPa' WHEN replace(lower({unit}), ' ', '') NOT IN ('gpa', 'pa', 'mpa', 'kbar') THEN 'unsupported unit: ' || {unit} END"


_SCHEMES = "k.extra['averaging_scheme'] <> g.extra['averaging_scheme']"
_DUNIT = "coalesce(trim(d.unit), '')"
_ELASTIC = f"""WITH e AS (SELECT record_no, material_id, generate_subscripts(properties, 1) AS i, unnest(properties) AS p FROM materials_sample),
n AS (SELECT record_no, i, p, {_CANON} AS name FROM e WHERE p IS NOT NULL),
f AS (SELECT m.record_no, m.material_id, (SELECT first(p ORDER BY i) FROM n WHERE n.record_no = m.record_no AND name = 'bulk_modulus') AS k, (SELECT first(p ORDER BY i) FROM n WHERE n.record_no = m.record_no AND name = 'shear_modulus') AS g, (SELECT first(p ORDER BY i) FROM n WHERE n.record_no = m.record_no AND name = 'density') AS d FROM materials_sample m),
v AS (SELECT *, {_gpa('k')} AS kv, {_gpa('g')} AS gv,
  {_value('d')} * CASE WHEN {_DUNIT} = '' THEN 1.0 WHEN replace(lower({_DUNIT}), ' ', '') IN ('g/cm^3', 'g/cm3', 'g/cc', 'g/ml') THEN 1.0::DOUBLE WHEN replace(lower({_DUNIT}), ' ', '') IN ('kg/m^3', 'kg/m3') THEN 1e-3::DOUBLE END AS rho FROM f),
s AS (SELECT *, 9.0::DOUBLE * kv * gv / (3.0::DOUBLE * kv + gv) AS y, (3.0::DOUBLE * kv - 2.0::DOUBLE * gv) / (2.0::DOUBLE * (3.0::DOUBLE * kv + gv)) AS nu, coalesce(rho > 0 AND NOT isnan(rho) AND NOT isinf(rho), false) AS usable FROM v WHERE kv > 0 AND gv > 0 AND NOT isnan(kv) AND NOT isnan(gv) AND NOT isinf(kv) AND NOT isinf(gv))"""


# --- uploads
_N = r"-?\d+(\.\d+)?([eE][-+]?\d+)?"
_V3 = rf"\[{_N},{_N},{_N}\]"
_ELEMENT = r"[A-Z][a-z]?(\d+\.?\d*|\.\d+)?"
_ONE = rf"[(\[]({_ELEMENT})+[)\]](\d+\.?\d*|\.\d+)?"
_TWO = rf"[(\[]({_ELEMENT}|{_ONE})+[)\]](\d+\.?\d*|\.\d+)?"
_PLAIN = r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?"
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _formula_bad(f: str) -> str:
    t = _STRIP.format(f)
    return rf"NOT (regexp_full_match({t}, '({_ELEMENT}|{_ONE}|{_TWO})+') AND list_has_all([{_SYMBOLS}], regexp_extract_all({t}, '[A-Z][a-z]?')) AND len(list_filter(regexp_extract_all({t}, '\d+\.?\d*|\.\d+'), lambda n: CAST(n AS DOUBLE) = 0)) = 0)"


def _cell_bad(j: str) -> str:
    """``j`` is JSON, or null where the text is none."""
    cell = f"CAST({j}->'$.lattice' AS DOUBLE[][])"
    shape = f"coalesce(json_type({j}) = 'OBJECT' AND regexp_full_match(CAST({j}->'$.lattice' AS VARCHAR), '\\[{_V3},{_V3},{_V3}\\]') AND json_type({j}, '$.species') = 'ARRAY' AND json_array_length({j}, '$.species') > 0 AND regexp_full_match(CAST({j}->'$.coords' AS VARCHAR), '\\[({_V3}(,{_V3})*)?\\]') AND json_array_length({j}, '$.coords') = json_array_length({j}, '$.species'), false)"
    return f"CASE WHEN NOT {shape} THEN true ELSE {_det(cell)} <= 1e-9 * pow(list_max(list_transform(flatten({cell}), lambda x: abs(x))), 3) END"


_NUMBER_BAD = rf"CASE WHEN {{0}} IS NULL OR {_STRIP.format('{0}')} = '' THEN false ELSE NOT (regexp_full_match({_STRIP.format('{0}')}, '{_PLAIN}') AND NOT isinf(TRY_CAST({_STRIP.format('{0}')} AS DOUBLE))) END"
_TEXTS = "('material_id', 'formula', 'structure_json', 'notes')"
_BLANK = rf"coalesce({_STRIP.format('{0}')} = '', true)"
_UPLOADS = rf"""WITH r AS (SELECT import_no, first(file_format) AS ff, first(coalesce(sep, ',')) AS sep, first(coalesce(header_cols, [])) AS h FROM import_report GROUP BY 1),
l AS (SELECT l.import_no, l.row_no, coalesce(l.line, '') AS line, coalesce(ff, 'csv') AS ff, coalesce(sep, ',') AS sep, coalesce(h, []) AS h FROM import_lines l LEFT JOIN r USING (import_no)),
c1 AS (SELECT import_no, row_no, h, regexp_full_match(sep || line, '([' || sep || ']("([^"]|"")*"|([^"' || sep || '][^' || sep || ']*)?))*') AS ok, list_transform(regexp_extract_all(sep || line, '[' || sep || ']("(?:[^"]|"")*"|[^' || sep || ']*)', 1), lambda f: CASE WHEN f LIKE '"%' THEN replace(f[2:-2], '""', '"') ELSE f END) AS f FROM l WHERE ff <> 'jsonl'),
c2 AS (SELECT *, CASE WHEN NOT ok THEN 'bad_quoting' WHEN len(f) <> len(h) THEN 'column_count' END AS code FROM c1),
c3 AS (SELECT import_no, row_no, h, f, code, f[list_position(h, 'material_id')] AS material_id, f[list_position(h, 'formula')] AS formula, f[list_position(h, 'structure_json')] AS structure_json, f[list_position(h, 'notes')] AS notes FROM c2),
c4 AS (SELECT import_no, row_no, h, material_id, formula, structure_json, notes, list_transform(h, lambda c, i: CASE WHEN code IS NULL THEN f[i] END) AS v, CASE WHEN code IS NOT NULL THEN code WHEN {_BLANK.format('material_id')} OR {_BLANK.format('formula')} THEN 'missing_identity' WHEN {_formula_bad('formula')} THEN 'invalid_formula'
  WHEN NOT {_BLANK.format('structure_json')} AND ({_cell_bad('TRY_CAST(structure_json AS JSON)')}) THEN 'invalid_structure' WHEN len(list_filter(h, lambda c, i: c NOT IN {_TEXTS} AND {_NUMBER_BAD.format('f[i]')})) > 0 THEN 'invalid_value' END AS code FROM c3),
j1 AS (SELECT import_no, row_no, h, line, json_valid(line) AND NOT regexp_matches(regexp_replace(line, '"(\\.|[^"\\])*"', '""', 'g'), 'NaN|Infinity|,\s*[}}\]]') AS ok FROM l WHERE ff = 'jsonl'),
j2 AS (SELECT import_no, row_no, h, CASE WHEN ok AND json_type(line) = 'OBJECT' THEN CAST(line AS JSON) END AS j FROM j1),
j3 AS (SELECT import_no, row_no, h, j, j->>'$.material_id' AS material_id, j->>'$.formula' AS formula, j->>'$.structure_json' AS structure_json, j->>'$.notes' AS notes FROM j2),
j4 AS (SELECT import_no, row_no, h, material_id, formula, structure_json, notes, list_transform(h, lambda c: j->>('$."' || c || '"')) AS v, CASE WHEN j IS NULL THEN 'malformed_json' WHEN coalesce({_BLANK.format('material_id')}, true) OR {_BLANK.format('formula')} THEN 'missing_identity' WHEN json_type(j, '$.formula') <> 'VARCHAR' OR {_formula_bad('formula')} THEN 'invalid_formula'
  WHEN NOT {_BLANK.format('structure_json')} AND ({_cell_bad('TRY_CAST(structure_json AS JSON)')}) THEN 'invalid_structure'
  WHEN len(list_filter(h, lambda c: c NOT IN {_TEXTS} AND CASE WHEN coalesce(json_type(j, '$."' || c || '"'), 'NULL') = 'NULL' THEN false WHEN json_type(j, '$."' || c || '"') IN ('BOOLEAN', 'ARRAY', 'OBJECT') THEN true ELSE {_NUMBER_BAD.format("(j->>('$.' || c))")} END)) > 0 THEN 'invalid_value' END AS code FROM j3),
a AS (SELECT import_no, row_no, h, material_id, formula, structure_json, notes, v, code FROM c4 UNION ALL SELECT import_no, row_no, h, material_id, formula, structure_json, notes, v, code FROM j4),
b AS (SELECT *, CASE WHEN code IS NULL AND row_no > min(row_no) FILTER (code IS NULL) OVER (PARTITION BY import_no, trim(material_id)) THEN 'duplicate_id' ELSE code END AS told FROM a)"""


def _loaded(c: str) -> str:
    t = _STRIP.format(f"v[list_position(h, '{c}')]")
    return f"CAST(nullif({t}, '') AS DOUBLE) AS {c}"


# --- children of nested records
_ENTRY = "json_extract(x, CASE WHEN flat THEN '$[' || (3 * k + {0}) || ']' WHEN json_type(x, '$[' || k || ']') = 'ARRAY' THEN '$[' || k || '][{0}]' ELSE '$[' || k || '].{1}' END)"
_XYZ = ", ".join(f"CAST({_ENTRY.format(i, n)} AS DOUBLE) AS {n}" for i, n in enumerate("xyz"))
_KIDS_CTE = _KIDS[: _KIDS.index("\nSELECT 'materials_sample'")]


def _drop_holes(sql: str) -> str:
    return f"SELECT * FROM ({sql}) WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL"


def build(edges: str) -> dict[str, str]:
    """Query -> SQL; ``edges`` is the screening queries' SQL of neighbour edges (cutoff 4, 8 neighbours)."""
    steps = ", ".join(f"CAST(CAST(json_extract(t, '$[' || k || '].{c}') AS VARCHAR) AS DOUBLE) AS {c}" for c in ("energy_per_atom", "max_force", "max_stress_ev_a3", "volume"))
    cols = ", ".join(f"CAST(json_extract(t, '$.{c}[' || k || ']') AS DOUBLE) AS {c}" for c in ("energy_per_atom", "max_force", "max_stress_ev_a3", "volume"))
    one = ", ".join(f"CAST(json_extract(t, '$.{c}') AS DOUBLE) AS {c}" for c in ("energy_per_atom", "max_force", "max_stress_ev_a3", "volume"))
    keyed = ", ".join(f"CAST(json_extract(t, '$.\"' || k || '\".{c}') AS DOUBLE) AS {c}" for c in ("energy_per_atom", "max_force", "max_stress_ev_a3", "volume"))
    return {
        "record_faults": f"""SELECT record_no, array_to_string(f, ';') AS faults, coalesce(array_to_string(s, ';'), '') AS structure_faults FROM (SELECT record_no, s, list_filter([CASE WHEN coalesce(trim(material_id) = '', true) THEN 'material_id_empty' END, CASE WHEN coalesce(trim(formula) = '', true) THEN 'formula_empty' END,
CASE WHEN len(elements) > 0 AND len(list_filter(elements, lambda e: e IS NULL OR e NOT IN ({_HEAVY}))) > 0 THEN 'elements_unknown' END, CASE WHEN len(list_filter(properties, lambda p: p IS NOT NULL AND coalesce(trim(p.name) = '', true))) > 0 THEN 'property_name_empty' END, CASE WHEN len(s) > 0 THEN 'structure_invalid' END], lambda c: c IS NOT NULL) AS f FROM (SELECT *, {_faults('structure')} AS s FROM materials_sample)) WHERE len(f) > 0 OR len(s) > 0""",
        "density_check": f"""WITH d AS (SELECT row_no, density / ({_density('structure.lattice', 'structure.species')}) AS r FROM lemat_bulk_sample WHERE structure IS NOT NULL), w AS (SELECT row_no, r, CASE WHEN isnan(r) OR isinf(r) THEN 0 ELSE round_even(r, 0) END AS n FROM d)
SELECT row_no, round(r, 6) AS ratio, CASE WHEN r IS NOT NULL THEN abs(r - 1) <= 0.05 AND NOT isnan(r) END AS consistent, CASE WHEN r IS NULL THEN NULL WHEN abs(r - 1) <= 0.05 AND NOT isnan(r) THEN 'consistent' WHEN n >= 2 AND abs(r - n) < 0.1 THEN 'incomplete basis: cell holds about 1/' || CAST(CAST(n AS INTEGER) AS VARCHAR) || ' of the atoms' ELSE 'inconsistent' END AS diagnosis FROM w""",
        "elastic_frame": f"""{_ELASTIC}
SELECT material_id, kv AS bulk_modulus, gv AS shear_modulus, y AS youngs_modulus, nu AS poisson_ratio, gv / kv AS pugh_ratio, CASE WHEN nu >= 0.31::DOUBLE THEN 'ductile' WHEN nu <= 0.2::DOUBLE THEN 'brittle' ELSE 'borderline' END AS ductility, CASE WHEN usable THEN y / rho END AS specific_stiffness, CASE WHEN k.method = g.method THEN k.method ELSE 'unknown' END AS method,
array_to_string(list_filter([{_modulus_note('k', 'bulk_modulus')}, {_modulus_note('g', 'shear_modulus')}, CASE WHEN {_SCHEMES} THEN 'bulk and shear moduli use different averaging schemes' END, CASE WHEN {_DUNIT} <> '' AND replace(lower({_DUNIT}), ' ', '') NOT IN ('g/cm^3', 'g/cm3', 'g/cc', 'g/ml', 'kg/m^3', 'kg/m3') THEN 'unsupported unit: ' || {_DUNIT} END,
CASE WHEN nu < 0 THEN 'negative Poisson ratio' END, CASE WHEN nu > 0.48::DOUBLE THEN 'Poisson ratio near the incompressible limit' END, CASE WHEN rho IS NOT NULL AND NOT usable THEN 'density not usable' END], lambda w: w IS NOT NULL), '; ') AS warnings FROM s""",
        "with_derived_properties": f"{_ELASTIC} SELECT m.record_no, CASE WHEN s.record_no IS NULL THEN CAST(len(m.properties) AS INTEGER) ELSE CAST(coalesce(len(m.properties), 0) + 2 + CASE WHEN usable THEN 1 ELSE 0 END AS INTEGER) END AS n_properties FROM materials_sample m LEFT JOIN s ON m.record_no = s.record_no",
        "graph_summary": f"""{edges}, f AS (SELECT *, min(dist) OVER (PARTITION BY record_no, src) AS d1 FROM e), q AS (SELECT record_no, src, count(*) FILTER (dist <= d1 + 0.1::DOUBLE) AS c FROM f GROUP BY 1, 2), a AS (SELECT record_no, avg(c) AS mean_coordination FROM q GROUP BY 1),
g AS (SELECT record_no, count(*) AS edge_count, count(*) FILTER (NOT EXISTS (SELECT 1 FROM k WHERE k.record_no = e.record_no AND k.src = e.src AND k.dst = e.dst AND k.ia = e.ia AND k.ib = e.ib AND k.ic = e.ic)) AS added_edges, round(min(dist), 6) AS shortest FROM e GROUP BY 1),
t AS (SELECT DISTINCT record_no, src FROM m WHERE NOT coalesce(dist <= lim + 1e-5, true)), tn AS (SELECT record_no, count(*) AS n FROM t GROUP BY 1)
SELECT s.record_no, CAST(len(s.structure.species) AS INTEGER) AS n_sites, g.edge_count, coalesce(g.added_edges, 0) AS added_edges, CAST(0 AS BIGINT) AS zero_distances, CAST(0 AS BIGINT) AS one_way_edges, true AS displacement_consistent, g.shortest, round(a.mean_coordination, 6) AS mean_coordination, coalesce(g.edge_count > 256, false) AS edges_truncated, CAST(least(coalesce(g.edge_count, 0), 256) AS BIGINT) AS n_shown, coalesce(tn.n, 0) AS n_truncated, CASE WHEN coalesce(len({_faults('s.structure')}), 1) > 0 THEN 'excluded' ELSE 'valid' END AS state
FROM materials_sample s LEFT JOIN g USING (record_no) LEFT JOIN a USING (record_no) LEFT JOIN tn USING (record_no)""",
        "node_features": f"""WITH n AS (SELECT record_no, CAST(generate_subscripts(structure.species, 1) - 1 AS INTEGER) AS idx, unnest(structure.species) AS s FROM materials_sample), z AS (SELECT *, coalesce(({_map(NUMBER)})[s], 0) AS z FROM n)
SELECT record_no, idx, s AS species, z AS atomic_number, CASE WHEN z > 0 THEN least(z, 100) ELSE 0 END AS hot_at, CAST(103 AS INTEGER) AS n_features, coalesce(({_map(ELECTRONEGATIVITY)})[s], 0.0)::DOUBLE AS electronegativity, coalesce(({_map(RADIUS)})[s], 0.0)::DOUBLE AS atomic_radius,
CAST(CASE WHEN z = 0 THEN 0 WHEN z = 1 THEN 1 WHEN z = 2 THEN 18 WHEN z BETWEEN 3 AND 18 THEN CASE WHEN (z - 3) % 8 < 2 THEN (z - 3) % 8 + 1 ELSE (z - 3) % 8 + 11 END WHEN z BETWEEN 19 AND 54 THEN (z - 19) % 18 + 1 WHEN (z - 55) % 32 < 2 THEN (z - 55) % 32 + 1 ELSE greatest(3, (z - 55) % 32 - 13) END AS DOUBLE) AS "group" FROM z""",
        "stratified_split": """WITH v AS (SELECT row_no, CASE WHEN NOT isnan(density) THEN density END AS d FROM lemat_bulk_sample), e AS (SELECT list_sort(list_distinct(quantile_cont(d, [0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1]))) AS q FROM v),
b AS (SELECT CAST(coalesce(CASE WHEN d IS NOT NULL THEN len(list_filter(q[2:-2], lambda x: x < d)) END, 0) AS INTEGER) AS bin, count(*) AS n FROM v, e GROUP BY 1)
SELECT bin, 'test' AS split, CAST(round(n * 0.2::DOUBLE) AS BIGINT) AS n FROM b WHERE round(n * 0.2::DOUBLE) > 0 UNION ALL SELECT bin, 'train', n - CAST(round(n * 0.2::DOUBLE) AS BIGINT) FROM b WHERE n > round(n * 0.2::DOUBLE)""",
        "jsonl_round_trip": "SELECT material_id, formula, CASE WHEN coalesce(trim(reduced_formula), '') = '' THEN formula ELSE reduced_formula END AS reduced_formula FROM materials_sample",
        "optimade_materials": f"""WITH m AS (SELECT record_no, structure.lattice AS l, structure.coords AS x, structure.species AS s, nullif(trim(formula), '') AS f, coalesce(len(structure.lattice) > 0 AND len(structure.coords) > 0 AND len(structure.species) > 0 AND len(list_filter(structure.lattice, lambda v: v IS NULL OR len(list_filter(v, lambda y: y IS NULL)) > 0)) = 0, false) AS c FROM materials_sample),
w AS (SELECT *, CASE WHEN len(l) = 3 AND len(list_filter(l, lambda v: len(v) = 3)) = 3 THEN {_det('l')} END AS vol FROM m),
o AS (SELECT *, CASE WHEN c AND len(list_filter(s, lambda e: e IS NULL)) = 0 THEN list_aggregate(list_transform(list_sort(list_distinct(s)), lambda e: e || CAST(len(list_filter(s, lambda y: y = e)) AS VARCHAR)), 'string_agg', '') END AS counted FROM w)
SELECT 'oqmd:' || record_no AS material_id, coalesce(f, nullif(counted, '')) AS formula, CASE WHEN c THEN round({_density('l', 's')}, 6) END AS density FROM o WHERE NOT (c AND coalesce(vol < 1.0, true)) AND NOT (c AND len(s) <> len(x)) AND NOT (c AND len(list_filter(s, lambda e: e IS NULL)) > 0) AND coalesce(f, nullif(counted, '')) IS NOT NULL""",
        "p4_steps": f"""{_FIELDS}, p AS (SELECT file_no, string_agg(field || ':' || key || ':' || ty, ';' ORDER BY encode(field || ':' || key || ':' || ty)) AS d FROM g GROUP BY file_no), w AS (SELECT feed, l.file_no, written_at, d FROM (SELECT file_no, min(feed) AS feed, min(written_at) AS written_at FROM lemat_raw_lines GROUP BY file_no) l LEFT JOIN p USING (file_no)),
o AS (SELECT *, CASE WHEN d IS DISTINCT FROM lag(d) OVER (PARTITION BY feed ORDER BY written_at, file_no) OR lag(file_no) OVER (PARTITION BY feed ORDER BY written_at, file_no) IS NULL THEN 1 ELSE 0 END AS new FROM w), v AS (SELECT feed, file_no, CAST(sum(new) OVER (PARTITION BY feed ORDER BY written_at, file_no) AS BIGINT) AS version FROM o)
SELECT v.feed, v.version, c.field_name, CASE c.change WHEN 'added' THEN 'default' WHEN 'removed' THEN 'drop' WHEN 'renamed' THEN 'rename' ELSE 'cast' END AS step, c.key_before, c.key_now, c.type_before, c.type_now FROM ({_DRIFT}) c JOIN v USING (file_no)""",
        "p5_found": f"{_UPLOADS} SELECT import_no, row_no, told AS code FROM b WHERE told IS NOT NULL",
        "p5_loaded": f"{_UPLOADS} SELECT import_no, row_no, material_id, formula, {', '.join(_loaded(c) for c in ('density', 'bulk_modulus', 'shear_modulus', 'energy_above_hull', 'band_gap'))}, nullif(structure_json, '') AS structure_json, nullif(notes, '') AS notes FROM b WHERE told IS NULL",
        "p5_report": f"""{_UPLOADS}, n AS (SELECT import_no, count(*) AS row_count, count(*) FILTER (told IS NULL) AS loaded_count FROM b GROUP BY 1), i AS (SELECT import_no, string_agg(told || ':' || c, ';' ORDER BY told) AS issue_counts FROM (SELECT import_no, told, count(*) AS c FROM b WHERE told IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
SELECT import_no, coalesce(row_count, 0) AS row_count, coalesce(loaded_count, 0) AS loaded_count, coalesce(row_count - loaded_count, 0) AS rejected_count, coalesce(issue_counts, '') AS issue_counts, q.rejected_count AS claimed_rejected_count, CASE WHEN coalesce(loaded_count, 0) = 0 THEN 'invalid' WHEN row_count > loaded_count THEN 'degraded' ELSE 'ready' END AS status
FROM (SELECT DISTINCT import_no, rejected_count FROM import_report) q FULL JOIN n USING (import_no) LEFT JOIN i USING (import_no)""",
        "p2_lattice": _drop_holes(f"""{_KIDS_CTE} SELECT 'chgnet_reference' AS parent_table, no AS parent_no, CAST(k AS INTEGER) AS child_no, {_XYZ} FROM i WHERE kind = 'lattice' UNION ALL SELECT 'materials_sample', record_no, CAST(k - 1 AS INTEGER), v[1], v[2], v[3] FROM (SELECT record_no, generate_subscripts(structure.lattice, 1) AS k, unnest(structure.lattice) AS v FROM materials_sample)"""),
        "p2_sites": _drop_holes(f"""{_KIDS_CTE}, h AS (SELECT i.no, k, x AS xs, flat, {_XYZ}, s.s AS st FROM i JOIN s ON i.no = s.no WHERE kind = 'site')
SELECT 'chgnet_reference' AS parent_table, no AS parent_no, CAST(k AS INTEGER) AS child_no, CASE WHEN json_type(st, '$.species') = 'ARRAY' THEN json_extract_string(st, '$.species[' || k || ']') ELSE json_extract_string(st, '$.sites[' || k || '].species') END AS species, x, y, z FROM h
UNION ALL SELECT 'materials_sample', record_no, CAST(k - 1 AS INTEGER), sp[k], v[1], v[2], v[3] FROM (SELECT record_no, structure.species AS sp, generate_subscripts(structure.coords, 1) AS k, unnest(structure.coords) AS v FROM materials_sample)"""),
        "p2_steps": f"""{_KIDS_CTE}
SELECT no AS artifact_no, CAST(coalesce(TRY_CAST(json_extract_string(t, '$[' || k || '].step') AS DOUBLE), k) AS INTEGER) AS step_no, {steps} FROM (SELECT no, t, unnest(range(CAST(json_array_length(t) AS BIGINT))) AS k FROM t WHERE ty = 'ARRAY') WHERE json_type(t, '$[' || k || ']') = 'OBJECT'
UNION ALL SELECT no, CAST(coalesce(TRY_CAST(json_extract_string(t, '$.step[' || k || ']') AS DOUBLE), k) AS INTEGER), {cols} FROM (SELECT no, t, unnest(range(CAST(json_array_length(t, '$.step') AS BIGINT))) AS k FROM t WHERE ty = 'OBJECT' AND st = 'ARRAY')
UNION ALL SELECT no, CAST(json_extract_string(t, '$.step') AS INTEGER), {one} FROM t WHERE ty = 'OBJECT' AND st NOT IN ('ARRAY', 'NULL')
UNION ALL SELECT no, CAST(k AS INTEGER), {keyed} FROM (SELECT no, t, unnest(json_keys(t)) AS k FROM t WHERE ty = 'OBJECT' AND st IS NULL) WHERE TRY_CAST(k AS INTEGER) IS NOT NULL""",
        "p2_extras": "SELECT record_no, CAST(k - 1 AS INTEGER) AS child_no, x.key AS key, x.value AS value FROM (SELECT record_no, k, unnest(map_entries(p.extra)) AS x FROM (SELECT record_no, generate_subscripts(properties, 1) AS k, unnest(properties) AS p FROM materials_sample) WHERE p IS NOT NULL)",
    }


# --- units
_SPELLED = "replace(replace(lower(trim({0})), '-', '_'), ' ', '_')"
_ALIAS = """CASE {0} WHEN 'rho' THEN 'density' WHEN 'mass_density' THEN 'density' WHEN 'formation_energy' THEN 'formation_energy_per_atom' WHEN 'formation_energy_pa' THEN 'formation_energy_per_atom' WHEN 'e_form' THEN 'formation_energy_per_atom' WHEN 'eform' THEN 'formation_energy_per_atom'
WHEN 'e_above_hull' THEN 'energy_above_hull' WHEN 'e_hull' THEN 'energy_above_hull' WHEN 'ehull' THEN 'energy_above_hull' WHEN 'energy_above_hull_per_atom' THEN 'energy_above_hull' WHEN 'k_vrh' THEN 'bulk_modulus' WHEN 'kvrh' THEN 'bulk_modulus' WHEN 'bulk_modulus_kv' THEN 'bulk_modulus'
WHEN 'g_vrh' THEN 'shear_modulus' WHEN 'gvrh' THEN 'shear_modulus' WHEN 'shear_modulus_gv' THEN 'shear_modulus' WHEN 'bandgap' THEN 'band_gap' WHEN 'gap' THEN 'band_gap' WHEN 'optb88vdw_bandgap' THEN 'band_gap' WHEN 'young_modulus' THEN 'youngs_modulus' WHEN 'youngs' THEN 'youngs_modulus' WHEN 'e_modulus' THEN 'youngs_modulus'
WHEN 'poisson' THEN 'poisson_ratio' WHEN 'nu' THEN 'poisson_ratio' WHEN 'homogeneous_poisson' THEN 'poisson_ratio' WHEN 'specific_modulus' THEN 'specific_stiffness' ELSE {0} END"""
_TAIL = "_(pcf|megabar|kilobar|terapascal|electronvolt|g_cm3|kg_m3|lb_ft3|gpa|mpa|kbar|pa|tpa|mbar|ev_per_atom|mev_per_atom|ry_per_atom|ha_per_atom|kj_mol_per_atom|ev|mev|ry|ha|kj_mol|j_mol|gigapascal|megapascal|hartree|rydberg|pascal)$"


def _unit(x: str) -> str:
    n = f"regexp_replace(regexp_replace(translate(lower({x}), '⁰¹²³⁴⁵⁶⁷⁸⁹⁻−', '0123456789--'), '[·⋅*^\\s]', '', 'g'), '([a-z0-9-])per([a-z])', '\\1/\\2', 'g')"
    bare = f"regexp_replace({n}, '(/atom|atom-1|_per_atom|_atom)$', '')"
    return f"""CASE {bare} WHEN 'g/cm3' THEN 'g/cm^3' WHEN 'gcm-3' THEN 'g/cm^3' WHEN 'g/ml' THEN 'g/cm^3' WHEN 'g/cc' THEN 'g/cm^3' WHEN 'kg/l' THEN 'g/cm^3' WHEN 'mg/m3' THEN 'g/cm^3' WHEN 'g_cm3' THEN 'g/cm^3'
WHEN 'kg/m3' THEN 'kg/m^3' WHEN 'kgm-3' THEN 'kg/m^3' WHEN 'g/l' THEN 'kg/m^3' WHEN 'mg/cm3' THEN 'kg/m^3' WHEN 'kilogram/cubicmetre' THEN 'kg/m^3' WHEN 'kg_m3' THEN 'kg/m^3'
WHEN 'lb/ft3' THEN 'lb/ft^3' WHEN 'pcf' THEN 'lb/ft^3' WHEN 'lbs/cubicfoot' THEN 'lb/ft^3' WHEN 'lb_ft3' THEN 'lb/ft^3' WHEN 'gpa' THEN 'GPa' WHEN 'gigapascal' THEN 'GPa' WHEN '109pa' THEN 'GPa' WHEN 'kn/mm2' THEN 'GPa'
WHEN 'mpa' THEN 'MPa' WHEN 'megapascal' THEN 'MPa' WHEN '106pa' THEN 'MPa' WHEN 'n/mm2' THEN 'MPa' WHEN 'kbar' THEN 'kbar' WHEN 'kilobar' THEN 'kbar' WHEN 'pa' THEN 'Pa' WHEN 'pascal' THEN 'Pa' WHEN 'n/m2' THEN 'Pa' WHEN 'nm-2' THEN 'Pa'
WHEN 'tpa' THEN 'TPa' WHEN 'terapascal' THEN 'TPa' WHEN '1012pa' THEN 'TPa' WHEN 'mbar' THEN 'Mbar' WHEN 'megabar' THEN 'Mbar' WHEN 'ev' THEN 'eV' WHEN 'electronvolt' THEN 'eV' WHEN 'mev' THEN 'meV' WHEN 'milli-ev' THEN 'meV' WHEN '10-3ev' THEN 'meV'
WHEN 'kj/mol' THEN 'kJ/mol' WHEN 'kjmol-1' THEN 'kJ/mol' WHEN 'kj_mol' THEN 'kJ/mol' WHEN 'j/mol' THEN 'J/mol' WHEN 'jmol-1' THEN 'J/mol' WHEN 'j_mol' THEN 'J/mol' WHEN 'ry' THEN 'Ry' WHEN 'rydberg' THEN 'Ry' WHEN 'ha' THEN 'Hartree' WHEN 'hartree' THEN 'Hartree' WHEN 'eh' THEN 'Hartree' END"""


_QUANTITY = "CASE WHEN {0} IN ('g/cm^3', 'kg/m^3', 'lb/ft^3') THEN 'density' WHEN {0} IN ('GPa', 'MPa', 'kbar', 'Pa', 'TPa', 'Mbar') THEN 'pressure' WHEN {0} IN ('eV', 'meV', 'kJ/mol', 'J/mol', 'Ry', 'Hartree') THEN 'energy' END"
_UNITS = rf"""WITH e AS (SELECT record_no, CAST(generate_subscripts(properties, 1) - 1 AS INTEGER) AS prop_no, unnest(properties) AS p FROM materials_sample),
n AS (SELECT record_no, prop_no, p.value AS v, p.value_text AS t, p.unit AS u, p.name AS name, {_ALIAS.format(_SPELLED.format('p.name'))} AS whole, regexp_extract(p.name, '^(.*?)\s*[(\[]\s*([^()\[\]]+?)\s*[)\]]\s*$', ['a', 'b']) AS br, regexp_extract(p.name, '^(.*?)\s+/\s+(\S.*)$', ['a', 'b']) AS sl, regexp_extract(lower(p.name), '^(.+?){_TAIL}', ['a', 'b']) AS un FROM e WHERE p IS NOT NULL),
q AS (SELECT *, CASE WHEN {_SPELLED.format('name')} <> whole THEN NULL WHEN whole IN ('density', 'bulk_modulus', 'shear_modulus', 'youngs_modulus', 'formation_energy_per_atom', 'energy_above_hull', 'band_gap', 'poisson_ratio', 'specific_stiffness') THEN NULL WHEN br.a <> '' THEN br WHEN sl.a <> '' THEN sl WHEN un.a <> '' THEN un END AS part FROM n),
x AS (SELECT record_no, prop_no, v, u, CASE WHEN part IS NULL THEN whole ELSE {_ALIAS.format(_SPELLED.format('part.a'))} END AS property, part.b AS nu, regexp_replace(translate(regexp_replace(t, '^[^=]*=', ''), '⁰¹²³⁴⁵⁶⁷⁸⁹⁻−', '0123456789--'), '\s*[x×]\s*10\^?([-+]?\d+)', 'e\1') AS t FROM q),
y AS (SELECT *, regexp_extract(t, '^\s*\[([^\]]+)\]', 1) AS tu, regexp_replace(regexp_replace(regexp_replace(t, '^\s*\[[^\]]+\]', ''), '\(card \d+\)', ''), '^\s*(approx\.|~)?\s*', '') AS b0 FROM x), y1 AS (SELECT *, regexp_replace(b0, '(\d) (\d{{3}})(\D|$)', '\1\2\3') AS body FROM y),
z AS (SELECT *, regexp_extract(body, '^([-+]?\d[\d,]*\.?\d*(?:[eE][-+]?\d+)?)\s*(?:±\s*[\d.,]+(?:[eE][-+]?\d+)?)?\s*(.*)$', ['a', 'b']) AS m FROM y1),
w AS (SELECT record_no, prop_no, property, u, nu, CASE WHEN NOT isnan(v) AND NOT isinf(v) THEN v END AS v, TRY_CAST(CASE WHEN regexp_full_match(m.a, '[-+]?\d{{1,3}}(,\d{{3}})+(\.\d*)?([eE][-+]?\d+)?') THEN replace(m.a, ',', '') ELSE replace(m.a, ',', '.') END AS DOUBLE) AS num, CASE WHEN tu <> '' THEN tu ELSE m.b END AS tu FROM z),
r AS (SELECT record_no, prop_no, property, u, nu, coalesce(v, num) AS recorded_value, {_unit('u')} AS u1, {_unit('tu')} AS u2, {_unit('nu')} AS u3, CASE WHEN property = 'density' THEN 'density' WHEN property IN ('bulk_modulus', 'shear_modulus', 'youngs_modulus') THEN 'pressure' WHEN property IN ('formation_energy_per_atom', 'energy_above_hull', 'band_gap') THEN 'energy' END AS pq FROM w),
s AS (SELECT *, coalesce(pq, {_QUANTITY.format('u1')}, {_QUANTITY.format('u2')}, {_QUANTITY.format('u3')}) AS quantity FROM r WHERE recorded_value IS NOT NULL),
f AS (SELECT *, CASE WHEN {_QUANTITY.format('u1')} = quantity THEN u1 END AS f1, CASE WHEN {_QUANTITY.format('u2')} = quantity THEN u2 END AS f2, CASE WHEN {_QUANTITY.format('u3')} = quantity THEN u3 END AS f3, coalesce(trim(u) <> '', false) OR u2 IS NOT NULL OR coalesce(trim(nu) <> '', false) AS given FROM s WHERE quantity IS NOT NULL),
g AS (SELECT record_no, prop_no, property, quantity, recorded_value, coalesce(f1, f2, f3, CASE WHEN NOT given THEN CASE quantity WHEN 'density' THEN CASE WHEN abs(recorded_value) < 60 THEN 'g/cm^3' ELSE 'kg/m^3' END WHEN 'pressure' THEN CASE WHEN abs(recorded_value) < 2000 THEN 'GPa' WHEN abs(recorded_value) < 10000000 THEN 'MPa' ELSE 'Pa' END ELSE 'eV' END END, 'unknown') AS recorded_unit,
  CASE WHEN f1 IS NOT NULL THEN 'unit' WHEN f2 IS NOT NULL THEN 'value_text' WHEN f3 IS NOT NULL THEN 'name' WHEN NOT given THEN 'size' END AS unit_from FROM f),
k AS (SELECT *, CASE recorded_unit WHEN 'g/cm^3' THEN 1.0::DOUBLE WHEN 'kg/m^3' THEN 0.001::DOUBLE WHEN 'lb/ft^3' THEN 0.01601846337396014::DOUBLE WHEN 'GPa' THEN 1.0::DOUBLE WHEN 'MPa' THEN 0.001::DOUBLE WHEN 'Pa' THEN 1e-9::DOUBLE WHEN 'TPa' THEN 1000.0::DOUBLE WHEN 'kbar' THEN 0.1::DOUBLE WHEN 'Mbar' THEN 100.0::DOUBLE
  WHEN 'eV' THEN 1.0::DOUBLE WHEN 'meV' THEN 0.001::DOUBLE WHEN 'kJ/mol' THEN 1.0::DOUBLE / 96.485332123::DOUBLE WHEN 'J/mol' THEN 1.0::DOUBLE / 96485.332123::DOUBLE WHEN 'Ry' THEN 13.6056980659::DOUBLE WHEN 'Hartree' THEN 27.2113961318::DOUBLE END AS a, CASE quantity WHEN 'density' THEN 'g/cm^3' WHEN 'pressure' THEN 'GPa' ELSE 'eV' END AS common_unit FROM g)"""
UNITS = {
    "p6_common": _UNITS + " SELECT record_no, prop_no, property, quantity, recorded_value, recorded_unit, unit_from, recorded_value * a AS common_value, CASE WHEN a IS NOT NULL THEN common_unit END AS common_unit FROM k",
    "p6_found": _UNITS + " SELECT record_no, prop_no, recorded_unit FROM k WHERE recorded_unit <> common_unit AND recorded_unit <> 'unknown'",
}


# --- one table of drifting files
_PLAIN_TEXT = "CASE WHEN lower(trim({0})) NOT IN ('', 'n/a', 'na', 'null', 'none', 'nan') THEN {0} END"
_DRIFTED = {"material_id": "s", "formula": "f", "elements": "a", "nelements": "i", "nsites": "i", "structure": "j", "immutable_id": "s", "structure_fingerprint": "s", "functional": "s", "density": "d", "bulk_modulus": "d", "energy_above_hull": "d", "energy_per_site": "d", "max_force": "d", "last_modified": "s"}


def _drifted(column: str, kind: str) -> str:
    """Value of a column from its JSON value ``v_<column>``."""
    v = f"v_{column}"
    inner = f"CASE json_type({v}) WHEN 'OBJECT' THEN coalesce({v}->>'$.value', {v}->>'$.name', CAST({v} AS VARCHAR)) WHEN 'ARRAY' THEN CAST({v} AS VARCHAR) WHEN 'NULL' THEN NULL ELSE {v}->>'$' END"
    text = _PLAIN_TEXT.format(f"({inner})")
    joined = f"array_to_string(CAST({v} AS VARCHAR[]), '')"
    if kind == "a":
        return f"CASE WHEN json_type({v}) = 'ARRAY' THEN array_to_string(CAST({v} AS VARCHAR[]), ',') WHEN json_type({v}) <> 'OBJECT' THEN array_to_string(regexp_split_to_array({text}, '\\s*[-,;\\s]\\s*'), ',') END"
    if kind == "f":
        pairs = f"array_to_string(list_transform(json_keys({v}), lambda k: k || ({v}->>('$.' || k))), '')"
        return f"CASE json_type({v}) WHEN 'ARRAY' THEN {joined} WHEN 'OBJECT' THEN {pairs} ELSE {text} END"
    if kind == "s":
        return f"CASE WHEN json_type({v}) = 'ARRAY' THEN {joined} ELSE {text} END"
    if kind == "j":
        return f"regexp_replace(CASE WHEN json_type({v}) <> 'NULL' THEN CASE WHEN json_type({v}) = 'VARCHAR' THEN {v}->>'$' ELSE CAST({v} AS VARCHAR) END END, '\\s', '', 'g')"
    return f"CAST(TRY_CAST({text} AS DOUBLE) AS {'INTEGER' if kind == 'i' else 'DOUBLE'})"


def _lost(column: str, kind: str) -> str:
    v = f"v_{column}"
    inner = f"CASE json_type({v}) WHEN 'OBJECT' THEN coalesce({v}->>'$.value', {v}->>'$.name', CAST({v} AS VARCHAR)) WHEN 'ARRAY' THEN CAST({v} AS VARCHAR) WHEN 'NULL' THEN NULL ELSE {v}->>'$' END"
    return f"SELECT file_no, '{column}' AS field_name, count(*) AS n_failed FROM v WHERE {_PLAIN_TEXT.format(f'({inner})')} IS NOT NULL AND ({_drifted(column, kind)}) IS NULL GROUP BY 1"


_ROUTE = f"{_FIELDS}, h AS (SELECT file_no, field, first(key ORDER BY CASE WHEN key = field THEN 0 ELSE 1 END, key) AS key FROM g GROUP BY 1, 2), d AS (SELECT file_no, line_no, feed, CASE WHEN json_valid(payload) AND json_type(payload) = 'OBJECT' THEN CAST(payload AS JSON) END AS j FROM lemat_raw_lines)"
_VALUES = f"{_ROUTE}, v AS (SELECT d.file_no, line_no, feed, " + ", ".join(f"json_extract(j, '$.\"' || (SELECT key FROM h WHERE h.file_no = d.file_no AND h.field = '{c}') || '\"') AS v_{c}" for c in _DRIFTED) + " FROM d)"
DRIFT = {
    "p4_odd_values": _VALUES + ", lost AS (" + " UNION ALL ".join(_lost(c, k) for c, k in _DRIFTED.items()) + "), n AS (SELECT e.file_no, g.field AS field_name, count(*) AS n_values, count(*) FILTER (e.ty <> g.ty) AS n_odd_type FROM e JOIN g ON e.file_no = g.file_no AND e.key = g.key GROUP BY 1, 2) SELECT n.file_no, n.field_name, n_values, n_odd_type, coalesce(n_failed, 0) AS n_failed FROM n LEFT JOIN lost ON n.file_no = lost.file_no AND n.field_name = lost.field_name WHERE n_odd_type > 0 OR n_failed > 0",
    "p4_table": _VALUES + " SELECT file_no, line_no, feed, " + ", ".join(f"{_drifted(c, k)} AS {c}" for c, k in _DRIFTED.items()) + " FROM v",
}
