"""SQL for an independent engine of the queries over training data that SQL can express, written by hand."""

from __future__ import annotations

from ..functions.elements import MASSES
from ..plans.oracles import UNITS, _det, _map

_SYMBOLS = "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr"
_KNOWN = ", ".join(f"'{s}'" for s in _SYMBOLS.split())
_NUM = r"(?:\d+\.?\d*|\.\d+)"
_ATOM = rf"[A-Z][a-z]?{_NUM}?"
_NONE = "'', '-', '--', '?', '.', '0', 'n/a', 'na', 'nan', 'nil', 'none', 'null', 'tbd', 'unknown', 'missing', 'not available', 'undefined'"

# rows tied by fingerprint, immutable id or composition: cc (id, comp), comp the smallest row of the group
P1_GROUPS = rf"""WITH RECURSIVE t AS (SELECT row_no, regexp_replace(translate(formula, '₀₁₂₃₄₅₆₇₈₉', '0123456789'), '</?su[bp]>|\\mathrm|[\s_$' || chr(123) || chr(125) || ']', '', 'gi') AS f, regexp_replace(lower(structure_fingerprint), '\s', '', 'g') AS fp, regexp_replace(lower(immutable_id), '\s', '', 'g') AS im FROM lemat_bulk_sample),
g AS (SELECT row_no, unnest(regexp_extract_all(f, '[(\[](?:{_ATOM})+[)\]]{_NUM}?|{_ATOM}')) AS part FROM t WHERE regexp_full_match(f, '([(\[](?:{_ATOM})+[)\]]{_NUM}?|{_ATOM})+')),
a AS (SELECT row_no, unnest(regexp_extract_all(part, '{_ATOM}')) AS atom, CASE WHEN part[1:1] IN ('(', '[') THEN coalesce(CAST(nullif(regexp_extract(part, '[)\]](.*)$', 1), '') AS DOUBLE), 1) ELSE 1 END AS times FROM g),
s AS (SELECT row_no, regexp_extract(atom, '^[A-Z][a-z]?') AS e, sum(times * coalesce(CAST(nullif(regexp_extract(atom, '^[A-Z][a-z]?(.*)$', 1), '') AS DOUBLE), 1)) AS n FROM a GROUP BY 1, 2),
w AS (SELECT row_no, sum(n) AS whole, bool_and(n > 0 AND e IN ({_KNOWN})) AS ok FROM s GROUP BY 1),
c AS (SELECT row_no, 'c:' || string_agg(e || ':' || CAST(round(n / whole, 9) AS VARCHAR), ' ' ORDER BY e) AS k FROM s JOIN w USING (row_no) WHERE ok GROUP BY row_no),
p AS (SELECT row_no, fp, regexp_replace(regexp_replace(fp, '^(fp|sfp|fingerprint)[:=]', ''), '[-_:]', '', 'g') AS b FROM t),
i AS (SELECT row_no, im, regexp_replace(im, '[^0-9a-z]', '', 'g') AS b FROM t),
d AS (SELECT row_no, im, b, regexp_extract(b, '^[a-z]*([0-9]+)$', 1) AS tail FROM i),
k AS (SELECT row_no, k FROM c UNION ALL SELECT row_no, 'f:' || b FROM p WHERE fp NOT IN ({_NONE}) AND regexp_full_match(b, '[0-9a-z]+') AND regexp_matches(b, '[0-9]') AND replace(b, b[1:1], '') <> ''
  UNION ALL SELECT row_no, 'i:' || b FROM d WHERE im NOT IN ({_NONE}) AND regexp_matches(b, '[0-9]') AND NOT (tail <> '' AND replace(tail, tail[1:1], '') = '' AND (tail[1:1] = '0' OR length(tail) >= 6))),
m AS (SELECT row_no, min(row_no) OVER (PARTITION BY k) AS first FROM k),
e AS (SELECT DISTINCT row_no AS x, first AS y FROM m UNION SELECT DISTINCT first, row_no FROM m),
cc(id, comp) USING KEY (id) AS (SELECT row_no, row_no FROM lemat_bulk_sample UNION (SELECT e.x, min(l.comp) FROM cc l JOIN e ON e.y = l.id JOIN recurring.cc o ON o.id = e.x WHERE l.comp < o.comp GROUP BY e.x))"""


def _composition(rows: str) -> str:
    """(id, comp, grams: mass of an atom on average) of ``rows`` (id, formula)."""
    return rf"""(WITH t AS (SELECT id, regexp_replace(translate(formula, '₀₁₂₃₄₅₆₇₈₉', '0123456789'), '</?su[bp]>|\\mathrm|[\s_$' || chr(123) || chr(125) || ']', '', 'gi') AS f FROM {rows}),
g AS (SELECT id, unnest(regexp_extract_all(f, '[(\[](?:{_ATOM})+[)\]]{_NUM}?|{_ATOM}')) AS part FROM t WHERE regexp_full_match(f, '([(\[](?:{_ATOM})+[)\]]{_NUM}?|{_ATOM})+')),
a AS (SELECT id, unnest(regexp_extract_all(part, '{_ATOM}')) AS atom, CASE WHEN part[1:1] IN ('(', '[') THEN coalesce(CAST(nullif(regexp_extract(part, '[)\]](.*)$', 1), '') AS DOUBLE), 1) ELSE 1 END AS times FROM g),
s AS (SELECT id, regexp_extract(atom, '^[A-Z][a-z]?') AS e, sum(times * coalesce(CAST(nullif(regexp_extract(atom, '^[A-Z][a-z]?(.*)$', 1), '') AS DOUBLE), 1)) AS n FROM a GROUP BY 1, 2),
w AS (SELECT id, sum(n) AS whole, bool_and(n > 0 AND e IN ({_KNOWN})) AS ok FROM s GROUP BY 1)
SELECT id, string_agg(e || ':' || CAST(round(n / whole, 9) AS VARCHAR), ' ' ORDER BY e) AS comp, sum(n * ({_map(MASSES)})[e]) / any_value(whole) AS grams FROM s JOIN w USING (id) WHERE ok GROUP BY id)"""


def _cell(lattice: str) -> str:
    return f"CASE WHEN len({lattice}) = 3 AND len(list_filter({lattice}, lambda r: coalesce(len(r) = 3, false))) = 3 AND {_det(lattice)} > 1e-9 THEN {_det(lattice)} END"


def _cosines(m: str) -> str:
    dot = lambda i, j: " + ".join(f"{m}[{i}][{k}] * {m}[{j}][{k}]" for k in (1, 2, 3))
    return "list_sort([" + ", ".join(f"abs({dot(i, j)}) / sqrt(({dot(i, i)}) * ({dot(j, j)}))" for i, j in ((2, 3), (1, 3), (1, 2))) + "])"


_FLAT = r"nullif(regexp_replace(regexp_replace(lower({0}), '^\s*(prev|formerly|was|old|see|ref|id)[.:\s]+', ''), '[^a-z0-9]', '', 'g'), '')"
_END = r"TRY_CAST(nullif(regexp_extract({0}, '(\d+)\s*$', 1), '') AS BIGINT)"
_SENTINEL = "TRY_CAST({0} AS DOUBLE)"
_POS = "CASE WHEN {0} > 0 AND NOT isnan({0}) AND NOT isinf({0}) THEN {0} END"
_APART = "abs(ln({0} / {1}))"
_AGAIN = ["coalesce(" + t + ", false)" for t in (
    _APART.format("l.v", "r.v") + " > 0.045", _APART.format("l.rho", "r.rho") + " > 0.045", _APART.format("l.k", "r.k") + " > 0.045", _APART.format("l.g", "r.g") + " > 0.045",
    _APART.format("l.rho", "r.rhoc") + " > 0.11", _APART.format("l.rhoc", "r.rho") + " > 0.11", *(f"abs(l.angles[{i}] - r.angles[{i}]) > 0.03" for i in (1, 2, 3)))]
_STEPS = (("l.v", "r.v", 0.045), ("l.rho", "r.rho", 0.045), None, ("l.rhoc", "r.rho", 0.08), ("l.rho", "r.rhoc", 0.08), ("l.k", "r.k", 0.032), ("l.g", "r.g", 0.032))
_RULES = " UNION ALL ".join(
    [f"SELECT 1 AS rule, mid, jid, 0.0 AS d FROM l JOIN r ON l.flat = r.flat AND (l.comp IS NOT DISTINCT FROM r.comp OR r.comp IS NULL AND {_APART.format('l.rho', 'r.rho')} <= 0.045) WHERE r.ref IS NOT NULL AND NOT ({' OR '.join(_AGAIN)})"]
    + [f"SELECT {n} AS rule, mid, jid, {_APART.format(s[0], s[1]) if s else '0.0'} AS d FROM l JOIN r ON l.comp = r.comp AND {f'{_APART.format(s[0], s[1])} <= {s[2]}' if s else 'l.tail = r.tail'} WHERE NOT ({' OR '.join(_AGAIN)})" for n, s in enumerate(_STEPS, 2)])
MATCHED = f"""WITH u AS ({UNITS['p6_common']}), p AS (SELECT record_no, quantile_disc(common_value, 0.5) FILTER (property = 'density') AS rho, quantile_disc(common_value, 0.5) FILTER (property = 'bulk_modulus') AS k, quantile_disc(common_value, 0.5) FILTER (property = 'shear_modulus') AS g FROM u WHERE common_value IS NOT NULL GROUP BY 1),
f AS (SELECT material_id AS mid, min(record_no) AS record_no FROM materials_sample WHERE material_id IS NOT NULL GROUP BY 1),
l0 AS (SELECT f.mid, c.comp, c.grams, {_POS.format(f"({_cell('m.structure.lattice')} / nullif(len(m.structure.species), 0))")} AS v, {_cosines('m.structure.lattice')} AS angles, {_POS.format('p.rho')} AS rho, {_POS.format('p.k')} AS k, {_POS.format('p.g')} AS g, {_FLAT.format('f.mid')} AS flat, {_END.format('f.mid')} AS tail
  FROM f JOIN materials_sample m USING (record_no) LEFT JOIN p USING (record_no) LEFT JOIN {_composition('(SELECT record_no AS id, formula FROM materials_sample)')} c ON c.id = m.record_no),
r0 AS (SELECT j.jid, coalesce(c.comp, e.comp) AS comp, coalesce(c.grams, e.grams) AS grams, {_POS.format(f"({_cell('j.atoms.lattice_mat')} / nullif(len(j.atoms.elements), 0))")} AS v, {_cosines('j.atoms.lattice_mat')} AS angles, {_POS.format('j.density')} AS rho, {_POS.format(_SENTINEL.format('j.bulk_modulus_kv'))} AS k, {_POS.format(_SENTINEL.format('j.shear_modulus_gv'))} AS g, {_FLAT.format('j.legacy_ref')} AS flat, {_END.format('j.legacy_ref')} AS tail, j.legacy_ref AS ref
  FROM jarvis_rows j LEFT JOIN {_composition('(SELECT jid AS id, formula FROM jarvis_rows)')} c ON c.id = j.jid LEFT JOIN {_composition("(SELECT jid AS id, array_to_string(list_transform(atoms.elements, lambda x: trim(x)), '') AS formula FROM jarvis_rows)")} e ON e.id = j.jid WHERE j.jid IS NOT NULL),
l AS (SELECT *, grams * 1.66053906660::DOUBLE / v AS rhoc FROM l0), r AS (SELECT *, grams * 1.66053906660::DOUBLE / v AS rhoc FROM r0),
a AS ({_RULES}), b AS (SELECT *, row_number() OVER (PARTITION BY jid ORDER BY rule, d, mid) AS place FROM a)"""
