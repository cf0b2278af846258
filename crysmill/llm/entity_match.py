"""Matching records of two sources without a common identifier, by a cascade of rules.

Each rule is an equi-join on a combination of attributes, from strong to weak: a trace of the other source's id, cell
volume, reported density, the tail of an id, density of one side against the cell of the other, elastic moduli. All
need the same composition. Numbers are joined on logarithmic buckets, with the neighbouring ones probed, so no rule
compares all pairs of a group; records of a side with the same evidence are one in these joins, so copies are never paired
with copies. A pair that any measured attribute contradicts is dropped by every rule; of several partners the nearest one
stays, then the smaller id; right records resolved by one rule are anti-joined before the next. Left records are not, as one
may be the partner of many.

Records with a trusted trace (one that nothing measured contradicts) are the labelled ones. They run through the other
rules beside the open records, under the same anti-joins; a rule's confidence is its precision on the labelled records
that were left when its turn came, that of the trace is how often the other rules find the same partner for them. Both
are smoothed by one hit and one miss: (hits + 1) / (labels + 2).

Edge cases: null, NaN and sentinel attributes give no evidence and contradict nothing; a record without composition is
matched by a full trace and agreeing density only; of repeated deliveries of a left record the first counts, whole; a right
record has one partner at most, a left one any number; ties go to the smaller id; empty tables give no pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.elements import MASSES
from ..functions.formula import composition_key_udf
from ..functions.lattice import cosines, volume
from ..operators.units import convert, property_entries
from ..runtime import Scratch

# u per cubic angstrom in g/cm^3
DENSITY_UNIT = 1.66053906660
STEP = 0.045


def _grams(comp: Column) -> tuple[Column, Column]:
    """(mass, number of atoms) of one unit of a composition key."""
    parts = F.regexp_extract_all(comp, F.lit(r"([A-Z][a-z]?\d*)"), F.lit(1))
    table = F.create_map(*[F.lit(x) for kv in MASSES.items() for x in kv])
    count = lambda p: F.coalesce(F.nullif(F.regexp_extract(p, r"(\d+)$", 1), F.lit("")).cast("int"), F.lit(1))
    mass = F.aggregate(parts, F.lit(0.0), lambda a, p: a + F.element_at(table, F.regexp_extract(p, r"^([A-Z][a-z]?)", 1)) * count(p))
    return mass, F.aggregate(parts, F.lit(0), lambda a, p: a + count(p))


def _positive(x: Column) -> Column:
    return F.when((x > 0) & ~F.isnan(x) & (x < float("inf")), x)


def left_side(materials: DataFrame) -> DataFrame:
    """(mid, comp, v, angles, rho, k, g, flat, tail): one row for each material_id."""
    one = materials.where("material_id IS NOT NULL").dropDuplicates(["record_no"])
    props = convert(property_entries(one), one.sparkSession, ("record_no", "prop_no"))
    wide = props.where(F.col("property").isin("density", "bulk_modulus", "shear_modulus")).groupBy("record_no").agg(*[F.expr(f"percentile_approx(CASE WHEN property = '{p}' THEN common_value END, 0.5)").alias(n) for p, n in (("density", "rho"), ("bulk_modulus", "k"), ("shear_modulus", "g"))])
    cells = one.select("record_no", "material_id", composition_key_udf("formula").alias("comp"), (volume(F.col("structure.lattice")) / F.nullif(F.size("structure.species"), F.lit(0))).alias("v"), F.array_sort(F.array(*cosines(F.col("structure.lattice")))).alias("angles"))
    whole = F.struct("comp", "v", "angles", "rho", "k", "g")
    per = cells.join(wide, "record_no", "left").groupBy(F.col("material_id").alias("mid")).agg(F.min_by(whole, "record_no").alias("w")).select("mid", "w.*")
    return _finish(per, F.col("mid"))


def right_side(rows: DataFrame) -> DataFrame:
    """(jid, comp, v, angles, rho, k, g, ref, ref_tail): one row for each jid."""
    num = lambda c: F.col(c).try_cast("double")
    atoms = F.array_join(F.transform("atoms.elements", lambda e: F.trim(e)), "")
    base = rows.where("jid IS NOT NULL").select("jid", F.coalesce(composition_key_udf("formula"), composition_key_udf(atoms)).alias("comp"), (volume(F.col("atoms.lattice_mat")) / F.nullif(F.size("atoms.elements"), F.lit(0))).alias("v"), F.array_sort(F.array(*cosines(F.col("atoms.lattice_mat")))).alias("angles"), F.col("density").cast("double").alias("rho"), num("bulk_modulus_kv").alias("k"), num("shear_modulus_gv").alias("g"), F.col("legacy_ref").alias("ref"))
    # ids are unique; of equal ones one record counts, whole
    per = base.groupBy("jid").agg(F.max(F.struct("comp", "v", "angles", "rho", "k", "g", "ref")).alias("w")).select("jid", "w.*")
    return _finish(per, F.col("ref"))


def _finish(df: DataFrame, ident: Column) -> DataFrame:
    mass, n = _grams(F.col("comp"))
    flat = F.regexp_replace(F.regexp_replace(F.lower(ident), r"^\s*(prev|formerly|was|old|see|ref|id)[.:\s]+", ""), "[^a-z0-9]", "")
    tail = F.regexp_extract(ident, r"(\d+)\s*$", 1)
    clean = df.withColumns({c: _positive(F.col(c)) for c in ("v", "rho", "k", "g")}).withColumn("rhoc", mass / n * DENSITY_UNIT / F.col("v"))
    return clean.withColumns({"flat": F.nullif(flat, F.lit("")), "tail": F.when(F.length(tail) > 0, tail.try_cast("bigint"))})


def _apart(a: str, b: str) -> Column:
    return F.abs(F.ln(F.col(a) / F.col(b)))


def _contradicted() -> Column:
    """True where a measured attribute of both sides says that it is another phase."""
    tests = [_apart("l.v", "r.v") > STEP, _apart("l.rho", "r.rho") > STEP, _apart("l.k", "r.k") > 0.045, _apart("l.g", "r.g") > 0.045, _apart("l.rho", "r.rhoc") > 0.11, _apart("l.rhoc", "r.rho") > 0.11]
    tests += [F.abs(F.get("l.angles", i) - F.get("r.angles", i)) > 0.03 for i in range(3)]
    return reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests])


def _bucket(x: str, step: float = STEP) -> Column:
    return F.floor(F.ln(F.col(x)) / step).cast("int")


def _near(left: DataFrame, right: DataFrame, a: str, b: str, step: float) -> DataFrame:
    """Pairs of one composition whose ``a`` and ``b`` are within one step, by bucket and its two neighbours."""
    lb = left.where(F.col(a).isNotNull()).withColumn("_b", _bucket(a, step))
    rb = right.where(F.col(b).isNotNull()).withColumn("_b", F.explode(F.array(*[_bucket(b, step) + d for d in (-1, 0, 1)])))
    return lb.alias("l").join(rb.alias("r"), (F.col("l.comp") == F.col("r.comp")) & (F.col("l._b") == F.col("r._b")) & (_apart(f"l.{a}", f"r.{b}") <= step))


def _by_trace(left, right):
    same = F.col("l.comp").eqNullSafe(F.col("r.comp")) | F.col("r.comp").isNull() & (_apart("l.rho", "r.rho") <= STEP)
    return left.alias("l").join(right.where("ref IS NOT NULL").alias("r"), (F.col("l.flat") == F.col("r.flat")) & same)


def _by_tail(left, right):
    return left.alias("l").join(right.where("tail IS NOT NULL").alias("r"), (F.col("l.tail") == F.col("r.tail")) & (F.col("l.comp") == F.col("r.comp")))


# (rule, its pairs, the distance that ranks partners)
RULES = (
    ("trace", _by_trace, lambda: F.lit(0.0)),
    ("cell_volume", lambda left, right: _near(left, right, "v", "v", STEP), lambda: _apart("l.v", "r.v")),
    ("density", lambda left, right: _near(left, right, "rho", "rho", STEP), lambda: _apart("l.rho", "r.rho")),
    ("id_tail", _by_tail, lambda: F.lit(0.0)),
    ("density_of_cell", lambda left, right: _near(left, right, "rhoc", "rho", 0.08), lambda: _apart("l.rhoc", "r.rho")),
    ("cell_of_density", lambda left, right: _near(left, right, "rho", "rhoc", 0.08), lambda: _apart("l.rho", "r.rhoc")),
    ("bulk_modulus", lambda left, right: _near(left, right, "k", "k", 0.032), lambda: _apart("l.k", "r.k")),
    ("shear_modulus", lambda left, right: _near(left, right, "g", "g", 0.032), lambda: _apart("l.g", "r.g")),
)


EVIDENCE = ("comp", "v", "angles", "rho", "k", "g", "rhoc")


def _print(*cols: str) -> Column:
    """128 bits that stand for the values of the columns."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]
    return F.concat(F.hex(F.xxhash64(*text)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), *text)))


def _best(rule, left: DataFrame, right: DataFrame, item: str) -> DataFrame:
    """(item, mid) with the nearest left partner of each right item that has one."""
    _, pairs, distance = rule
    kept = pairs(left, right).where(~_contradicted()).select(F.col("l.mid").alias("mid"), F.col(f"r.{item}").alias(item), distance().alias("d"))
    return kept.groupBy(item).agg(F.min_by("mid", F.struct("d", "mid")).alias("mid"))


def match(left: DataFrame, right: DataFrame) -> DataFrame:
    """(mid, jid, rule, confidence) from prepared sides."""
    scratch = Scratch(left.sparkSession, "match")
    left, right = scratch.put(left), scratch.put(right)
    trace, *rules = RULES
    traced = scratch.put(_best(trace, left, right, "jid").withColumnRenamed("mid", "label"))
    # copies are one: the smallest id of left records with the same evidence, and a number for such right records
    one = left.groupBy(*EVIDENCE, "tail").agg(F.min("mid").alias("mid"))
    one = scratch.put(one)
    told = right.join(traced, "jid", "left").withColumn("copy", _print(*EVIDENCE, "tail"))
    told = scratch.put(told.select("jid", "label", "copy", *EVIDENCE, "tail"))
    open_ = scratch.put(told.groupBy("copy", *EVIDENCE, "tail").agg(F.lit(1).alias("_n")).drop("_n"))
    found = []
    for rule in rules:
        hit = scratch.put(_best(rule, one, open_, "copy").withColumn("rule", F.lit(rule[0])))
        found.append(hit)
        open_ = open_.join(hit.select("copy"), "copy", "left_anti")
    hits = scratch.put(told.select("jid", "label", "copy").join(reduce(DataFrame.unionByName, found), "copy"))
    labelled = hits.where("label IS NOT NULL").withColumn("hit", (F.col("mid") == F.col("label")).cast("int"))
    precision = labelled.groupBy(F.col("rule")).agg(F.count("*").alias("n"), F.sum("hit").alias("hits"))
    own = labelled.agg(F.count("*").alias("n"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits")).select(F.lit(trace[0]).alias("rule"), "n", "hits")
    # one row for each rule
    confidence = F.broadcast(precision.unionByName(own).select("rule", ((F.col("hits") + 1) / (F.col("n") + 2)).alias("confidence")))
    pairs = traced.select("jid", F.col("label").alias("mid"), F.lit(trace[0]).alias("rule")).unionByName(hits.where("label IS NULL").select("jid", "mid", "rule"))
    return pairs.join(confidence, "rule", "left").select("mid", "jid", "rule", F.coalesce("confidence", F.lit(0.5)).alias("confidence"))
