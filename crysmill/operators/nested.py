"""Nested records to flat child tables, straight from Arrow list buffers.

JVM expressions first bring every way of writing a list (matrix, flat list, named vectors, JSON text ...) to one typed
array. ``flatten`` then emits child rows from the list offsets: parent indices come from ``list_parent_indices``, keys
are propagated with one vectorised ``take``, and no row is visited in Python.

Edge cases: a null or empty list has no children; null entries are left out but keep their place in the numbering;
repeated parents each have their own children; parents with a null key give children with a null parent; text that is
no JSON, or no object, has no children. Extra columns of any name are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _children(lists: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """(parent index, place in the list, value) of every entry of a list array."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    parents = pc.list_parent_indices(lists)
    values = pc.list_flatten(lists)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.zeros(0, np.int64)
    at = parents.to_numpy().astype(np.int64)
    return parents, np.arange(len(at), dtype=np.int64) - starts[at], values


def flatten(df: DataFrame, key: str, lists: str, fields: dict[str, str] | None = None) -> DataFrame:
    """(parent BIGINT, child_no INT, fields...) of each non-null entry of the list column ``lists``.

    Entries are structs; ``fields`` gives the names and types of those of their fields that are kept. A field named
    ``child_no`` replaces the place in the list.
    """
    kind = df.schema[lists].dataType
    if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, T.StructType):
        raise TypeError(f"{lists} must be an array of structs")
    names = [f.name for f in kind.elementType.fields] if fields is None else list(fields)
    types = {f.name: f.dataType.simpleString() for f in kind.elementType.fields}
    payload = [n for n in names if n != "child_no"]
    own_number = "child_no" in types

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            parents, place, values = _children(b.column(1))
            keep = pc.is_valid(values)
            parents, values = parents.filter(keep), values.filter(keep)
            place = pa.array(place[keep.to_numpy(zero_copy_only=False)].astype(np.int32))
            if own_number:
                place = pc.coalesce(pc.cast(pc.struct_field(values, "child_no"), pa.int32()), place)
            yield pa.RecordBatch.from_arrays([b.column(0).take(parents), place, *[pc.struct_field(values, n) for n in payload]], names=["parent", "child_no", *payload])

    schema = "parent BIGINT, child_no INT" + "".join(f", `{n}` {types[n]}" for n in payload)
    return df.select(F.col(key).cast("bigint").alias("parent"), F.col(lists)).mapInArrow(run, schema)


def flatten_maps(df: DataFrame, key: str, lists: str, field: str) -> DataFrame:
    """(parent BIGINT, child_no INT, key, value) of each entry of the map ``field`` in the non-null entries of ``lists``."""
    kind = df.schema[lists].dataType.elementType[field].dataType
    if not isinstance(kind, T.MapType):
        raise TypeError(f"{field} must be a map")

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            parents, place, values = _children(b.column(1))
            maps = pc.struct_field(values, field)
            starts = maps.offsets.to_numpy().astype(np.int64)
            sizes = np.where(pc.is_valid(maps).to_numpy(zero_copy_only=False), np.diff(starts), 0)
            of = np.repeat(np.arange(len(sizes)), sizes)
            at = pa.array(np.repeat(starts[:-1] - np.cumsum(sizes) + sizes, sizes) + np.arange(len(of)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(parents.take(pa.array(of))), pa.array(place[of].astype(np.int32)), maps.keys.take(at), maps.items.take(at)], names=["parent", "child_no", "key", "value"])

    schema = f"parent BIGINT, child_no INT, key {kind.keyType.simpleString()}, value {kind.valueType.simpleString()}"
    return df.select(F.col(key).cast("bigint").alias("parent"), F.col(lists)).mapInArrow(run, schema)


def _vector(v: Column) -> Column:
    """A struct of three numbers, or null unless all three are there."""
    ok = (F.size(v) == 3) & F.forall(v, lambda x: x.isNotNull())
    return F.when(ok, F.struct(F.get(v, 0).alias("x"), F.get(v, 1).alias("y"), F.get(v, 2).alias("z")))


def vectors(rows: Column) -> Column:
    return F.transform(rows, _vector)


def sites(species: Column, rows: Column) -> Column:
    """Sites of coordinates: a struct of the species and three numbers; null where there are no coordinates."""

    def site(v: Column, i: Column) -> Column:
        xyz = _vector(v)
        return F.when(xyz.isNotNull(), F.struct(F.get(species, i).alias("species"), xyz["x"].alias("x"), xyz["y"].alias("y"), xyz["z"].alias("z")))

    return F.transform(rows, site)


def _numbers(text: Column) -> Column:
    return F.from_json(text, "array<double>")


def _starts(text: Column, what: str) -> Column:
    return F.ltrim(text).startswith(what)


def json_vectors(text: Column) -> Column:
    """ARRAY<ARRAY<DOUBLE>> of JSON text: lists of lists, one flat list, lists of {x, y, z}, {matrix} or {a, b, c}."""
    inner = F.coalesce(
        F.get_json_object(text, "$.matrix"),
        F.when(_starts(text, "{"), F.concat(F.lit("["), F.concat_ws(",", *[F.coalesce(F.get_json_object(text, f"$.{k}"), F.lit("null")) for k in "abc"]), F.lit("]"))),
        text,
    )
    parts = F.from_json(inner, "array<string>")

    def part(p: Column) -> Column:
        xyz = F.from_json(p, "struct<x double, y double, z double>")
        return F.when(_starts(p, "["), _numbers(p)).when(_starts(p, "{"), F.array(xyz["x"], xyz["y"], xyz["z"]))

    nested = F.exists(parts, lambda p: _starts(p, "[") | _starts(p, "{"))
    flat = _numbers(inner)
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(flat) / 3) - 1, F.lit(0)).cast("int")), lambda i: F.slice(flat, i * 3 + 1, 3))
    return F.when(F.coalesce(nested, F.lit(False)), F.transform(parts, part)).when(F.size(flat) >= 3, chunks)


_STEP = "energy_per_atom double, max_force double, max_stress_ev_a3 double, volume double"


def json_steps(text: Column) -> Column:
    """Steps of JSON text: a list of steps, an object by step number, an object of columns, or one step."""

    def step(s: Column, number: Column) -> Column:
        return F.when(s.isNotNull(), F.struct(number.try_cast("int").alias("child_no"), *[s[n].alias(n) for n in ("energy_per_atom", "max_force", "max_stress_ev_a3", "volume")]))

    listed = F.transform(F.from_json(text, f"array<struct<step string, {_STEP}>>"), lambda s, i: step(s, F.coalesce(s["step"].try_cast("double"), i.cast("double"))))
    numbers = F.get_json_object(text, "$.step")
    cols = F.from_json(text, "struct<step array<string>, energy_per_atom array<double>, max_force array<double>, max_stress_ev_a3 array<double>, volume array<double>>")
    columnar = F.transform(cols["step"], lambda n, i: F.struct(F.coalesce(n.try_cast("double"), i.cast("double")).cast("int").alias("child_no"), *[F.get(cols[c], i).alias(c) for c in ("energy_per_atom", "max_force", "max_stress_ev_a3", "volume")]))
    single = F.from_json(text, f"struct<step string, {_STEP}>")
    one = F.array(step(single, single["step"].try_cast("double")))
    keyed = F.transform(F.map_entries(F.map_filter(F.from_json(text, f"map<string, struct<{_STEP}>>"), lambda k, v: k.try_cast("int").isNotNull())), lambda e: step(e["value"], e["key"]))
    return F.when(_starts(text, "["), listed).when(_starts(numbers, "["), columnar).when(numbers.isNotNull(), one).when(_starts(text, "{"), keyed)


def normalized_materials(df: DataFrame) -> DataFrame:
    """(key, lattice, sites, properties) lists of nested material records."""
    return df.select(
        F.col("record_no").alias("key"),
        vectors(F.col("structure.lattice")).alias("lattice"),
        sites(F.col("structure.species"), F.col("structure.coords")).alias("site"),
        F.col("properties").alias("property"),
    )


def normalized_results(df: DataFrame) -> DataFrame:
    """(key, lattice, sites, steps) lists of relaxation results kept as JSON text."""
    text = df.select(F.col("artifact_no").alias("key"), F.get_json_object("result", "$.relaxed_structure").alias("s"), F.get_json_object("result", "$.trajectory").alias("t"))
    parts = text.select(
        "key", "t", F.get_json_object("s", "$.lattice").alias("lattice"), F.get_json_object("s", "$.coords").alias("coords"),
        F.from_json(F.get_json_object("s", "$.species"), "array<string>").alias("species"),
        F.from_json(F.get_json_object("s", "$.sites"), "array<struct<species string, coords string>>").alias("sites"),
    )
    listed = F.concat(F.lit("["), F.array_join(F.transform("sites", lambda s: F.coalesce(s["coords"], F.lit("null"))), ","), F.lit("]"))
    coords = F.coalesce(F.col("coords"), F.when(F.size("sites") > 0, listed))
    full = parts.select("key", json_vectors(F.col("lattice")).alias("lattice"), json_vectors(coords).alias("xyz"), F.coalesce("species", F.transform("sites", lambda s: s["species"])).alias("species"), json_steps(F.col("t")).alias("step"))
    return full.select("key", vectors(F.col("lattice")).alias("lattice"), sites(F.col("species"), F.col("xyz")).alias("site"), "step")


def child_links(materials: DataFrame, results: DataFrame) -> DataFrame:
    """(parent_table, parent_no, child_kind, child_no) of every child of both tables."""
    out = None
    for name, df, kinds in (("materials_sample", normalized_materials(materials), ("lattice", "site", "property")), ("chgnet_reference", normalized_results(results), ("lattice", "site", "step"))):
        # one pass over the parents: every list only carries what its child number needs
        # (a step number given twice is one child)
        once = lambda k, c: F.array_distinct(c) if k == "step" else c
        slim = df.select("key", *[once(k, F.transform(k, lambda e: F.when(e.isNotNull(), F.struct((e["child_no"] if k == "step" else F.lit(None).cast("int")).alias("child_no"))))).alias(k) for k in kinds])
        links = _links(slim, name, kinds)
        out = links if out is None else out.unionByName(links)
    return out


def _links(df: DataFrame, name: str, kinds: tuple[str, ...]) -> DataFrame:
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            for i, kind in enumerate(kinds):
                parents, place, values = _children(b.column(1 + i))
                keep = pc.is_valid(values)
                place = pa.array(place[keep.to_numpy(zero_copy_only=False)].astype(np.int32))
                place = pc.coalesce(pc.struct_field(values.filter(keep), "child_no"), place)
                n = len(place)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), b.column(0).take(parents.filter(keep)), pa.array([kind] * n, pa.string()), place], names=["parent_table", "parent_no", "child_kind", "child_no"])

    return df.mapInArrow(run, "parent_table STRING, parent_no BIGINT, child_kind STRING, child_no INT")
