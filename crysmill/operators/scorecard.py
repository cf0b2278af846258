"""Constraint filtering and pool-relative weighted min-max ranking, compiled to Column expressions.

``rank`` is one job: a one-row aggregate of every objective's minimum and maximum is broadcast to the kept rows, never
an un-partitioned window. Missing values and NaN are the same; ties are broken by the id in ascending order.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import canonical_name
from .normalize import number

FILL = {"worst": 0.0, "neutral": 0.5, "exclude": None}


@dataclass(frozen=True)
class Scorecard:
    """objectives: column -> "maximize", "minimize" or {direction, weight}; constraints: column -> {min, max, equals}."""

    objectives: dict
    constraints: dict = field(default_factory=dict)
    weights: dict = field(default_factory=dict)
    missing: str = "worst"

    def __post_init__(self):
        if self.missing not in FILL:
            raise ValueError(f"missing must be one of {sorted(FILL)}")
        if any(d not in ("maximize", "minimize") for d, _ in self.parsed().values()):
            raise ValueError("directions are maximize and minimize")

    def parsed(self) -> dict[str, tuple[str, float]]:
        """objective -> (direction, weight); an inline weight wins over ``weights``, and that over 1."""
        out = {}
        for name, spec in self.objectives.items():
            inline = spec if isinstance(spec, dict) else {"direction": spec}
            out[name] = (inline.get("direction", "maximize"), float(inline.get("weight", self.weights.get(name, 1.0))))
        return out

    def value(self, df: DataFrame, name: str) -> Column:
        if name not in df.columns and "properties" in df.columns:
            return number(self.listed(name))
        c = F.col(f"`{name}`").cast("double")
        return F.nanvl(c, F.lit(None))

    def passes(self, df: DataFrame) -> Column:
        """The hard constraints; a missing value fails its own."""
        tests, plain = [], []
        for name, c in self.constraints.items():
            listed = name not in df.columns and "properties" in df.columns
            if name not in df.columns and not listed and not ("equals" in c and "metadata" in df.columns):
                return F.lit(False)
            if "min" in c or "max" in c:
                v = self.value(df, name)
                tests += [v >= float(c["min"])] if "min" in c else []
                tests += [v <= float(c["max"])] if "max" in c else []
                if name in df.columns:  # the plain comparison is weaker on NaN only, and reaches the scan
                    plain.append(reduce(lambda a, b: a & b, [F.col(f"`{name}`") >= F.lit(float(c["min"])) if k == "min" else F.col(f"`{name}`") <= F.lit(float(c["max"])) for k in ("min", "max") if k in c]))
            if "equals" in c:
                # a property first, then the metadata
                raw = F.col(f"`{name}`") if name in df.columns else self.listed(name) if listed else F.lit(None).cast("string")
                if "metadata" in df.columns and isinstance(df.schema["metadata"].dataType, T.MapType):
                    raw = F.coalesce(raw.cast("string"), F.try_element_at("metadata", F.lit(name)).cast("string"))
                want = c["equals"]
                tests.append(self.truth(raw) == F.lit(want) if isinstance(want, bool) else raw == F.lit(want))
        return reduce(lambda a, b: a & b, [*plain, *[F.coalesce(t, F.lit(False)) for t in tests]], F.lit(True))

    @staticmethod
    def listed(name: str) -> Column:
        """The first property of a name in the list ``properties``, as text."""
        p = F.get(F.filter("properties", lambda x: x.isNotNull() & (canonical_name(x["name"]) == canonical_name(F.lit(name)))), 0)
        return F.coalesce(F.nanvl(p["value"], F.lit(None)).cast("string"), p["value_text"])

    @staticmethod
    def truth(raw: Column) -> Column:
        """Truth of a value by its text: nothing, zero and words for no are false."""
        return F.when(raw.isNotNull(), ~F.lower(F.trim(raw.cast("string"))).isin("", "0", "0.0", "false", "no", "none"))

    def kept(self, df: DataFrame, policy: bool = True) -> DataFrame:
        """Rows that pass and have an objective; under ``exclude`` (with ``policy``) all of them."""
        if not self.objectives:
            return df.limit(0)
        have = [self.value(df, n).isNotNull() for n in self.objectives]
        both = (lambda a, b: a & b) if policy and self.missing == "exclude" else (lambda a, b: a | b)
        return df.where(self.passes(df) & reduce(both, have))

    def rank(self, df: DataFrame, id_key: str = "material_id") -> DataFrame:
        """id, score and the objectives, best first."""
        spec = self.parsed()
        rows = self.kept(df).select(id_key, *[self.value(df, n).alias(n) for n in spec])
        if not spec:
            return rows.withColumn("score", F.lit(0.0))
        stats = rows.agg(*[f(F.col(f"`{n}`")).alias(f"_{k}{i}") for i, n in enumerate(spec) for k, f in (("lo", F.min), ("hi", F.max))])
        both = rows.crossJoin(F.broadcast(stats))  # one row
        total, weight = F.lit(0.0), F.lit(0.0)
        fill = FILL[self.missing]
        for i, (n, (direction, w)) in enumerate(spec.items()):
            lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
            unit = (F.col(f"`{n}`") - lo) / (hi - lo)
            unit = F.coalesce(F.lit(1.0) - unit if direction == "minimize" else unit, F.lit(fill if fill is not None else 0.0))
            told = hi > lo
            total = total + F.when(told, F.lit(w) * unit).otherwise(F.lit(0.0))
            weight = weight + F.when(told, F.lit(w)).otherwise(F.lit(0.0))
        score = F.when(weight > 0, total / weight).otherwise(total)
        return both.select(id_key, score.alias("score"), *[f"`{n}`" for n in spec]).orderBy(F.desc("score"), F.asc(id_key))

    def audit(self, df: DataFrame) -> DataFrame:
        """(objective, direction, weight, pool_size, ranked_count, coverage, zero_coverage, degenerate, effective)."""
        spec = self.parsed()
        ok = self.passes(df) & reduce(lambda a, b: a | b, [self.value(df, n).isNotNull() for n in spec])
        aggs = [F.count("*").alias("pool_size"), F.count_if(ok).alias("ranked_count")]
        for i, n in enumerate(spec):
            v = F.when(ok, self.value(df, n))
            aggs += [F.count(v).alias(f"c{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
        one = df.agg(*aggs)
        rows = F.explode(F.array(*[F.struct(F.lit(n).alias("objective"), F.lit(d).alias("direction"), F.lit(w).alias("weight"), F.col(f"c{i}").alias("coverage"), F.col(f"lo{i}").alias("lo"), F.col(f"hi{i}").alias("hi")) for i, (n, (d, w)) in enumerate(spec.items())])).alias("o")
        flat = one.select("pool_size", "ranked_count", rows)
        zero = F.col("o.coverage") == 0
        flat_out = ~zero & ~F.coalesce(F.col("o.hi") > F.col("o.lo"), F.lit(False))
        return flat.select("o.objective", "o.direction", "o.weight", "pool_size", "ranked_count", F.col("o.coverage").alias("coverage"), zero.alias("zero_coverage"), flat_out.alias("degenerate"), (~zero & ~flat_out).alias("effective"))

    def report(self, df: DataFrame) -> dict:
        """The audit as one dictionary, from a single aggregate."""
        rows = self.audit(df).collect()  # one row for each objective
        by = {r["objective"]: r for r in rows}
        names = list(self.objectives)
        zero = [n for n in names if by[n]["zero_coverage"]]
        flat = [n for n in names if by[n]["degenerate"]]
        pool, ranked = (rows[0]["pool_size"], rows[0]["ranked_count"]) if rows else (0, 0)
        mixed = mixed_markers(df, names)
        return {
            "pool_size": pool, "ranked_count": ranked, "excluded_by_constraints": pool - ranked, "objectives": names,
            "weights": {n: w for n, (_, w) in self.parsed().items()}, "missing_policy": self.missing,
            "coverage": {n: by[n]["coverage"] for n in names}, "zero_coverage_objectives": zero, "degenerate_objectives": flat,
            "ignored_objectives": sorted({*zero, *flat}), "effective_objectives": [n for n in names if n not in zero and n not in flat],
            "mixed_methods": mixed["method"], "mixed_averaging_schemes": mixed["averaging_scheme"], "mixed_hull_conventions": mixed["hull_convention"],
            "binary_normalization": ranked <= 2, "scores_are_pool_relative": True,
        }


def mixed_markers(df: DataFrame, names: list[str]) -> dict[str, dict[str, list[str]]]:
    """marker -> objective -> its values in the pool where there is more than one.

    Read from a ``properties`` list if the pool has one; a property without a convention marker counts as "unspecified".
    """
    out: dict[str, dict[str, list[str]]] = {"method": {}, "averaging_scheme": {}, "hull_convention": {}}
    if "properties" not in df.columns:
        return out
    for r in mixed_conventions(df, names).collect():  # one row for each objective and marker
        if len(r["conventions"]) > 1:
            out[r["marker"]][r["objective"]] = r["conventions"]
    return out


def mixed_conventions(df: DataFrame, names: list[str]) -> DataFrame:
    """(objective, marker, conventions) of the first property of each name in every record."""
    p = df.select(F.transform(F.filter("properties", lambda x: x.isNotNull()), lambda x: F.struct(canonical_name(x["name"]).alias("name"), x["method"].alias("method"), x["extra"].alias("extra"))).alias("ps"))
    wanted = F.explode(F.array(*[F.struct(F.lit(n).alias("objective"), canonical_name(F.lit(n)).alias("name")) for n in names])).alias("w")
    first = p.select("ps", wanted).select("w.objective", F.get(F.filter("ps", lambda x: x["name"] == F.col("w.name")), 0).alias("p")).where("p IS NOT NULL")
    told = lambda k: F.coalesce(F.try_element_at(F.col("p.extra"), F.lit(k)).cast("string"), F.lit("unspecified"))
    pairs = F.explode(F.array(F.struct(F.lit("method").alias("marker"), F.col("p.method").alias("value")), *[F.struct(F.lit(k).alias("marker"), told(k).alias("value")) for k in ("averaging_scheme", "hull_convention")])).alias("m")
    return first.select("objective", pairs).where("m.value IS NOT NULL").groupBy("objective", "m.marker").agg(F.array_sort(F.collect_set("m.value")).alias("conventions"))
