"""Schemas that drift between the files of a feed.

Every file gets a schema: for each key the type of most of its non-null values. Its fingerprint gives it a version in its
feed, which goes up whenever the fingerprint changes; the schema of each version is kept with the field that every key
holds, and each version with the migration steps that lead to it from the one before: rename, default (a field that came
or went is null where it is not), cast. What a key holds is told by its name, if that is a column's in any case and with
any separators; else by content: a key that appears in a step and one that goes away hold the same field when records
delivered again carry the same content under both, and such ties carry over from key to key; only where content tells
nothing, by a list of other names. Files are routed through the steps of their version into one table; changes are read
off the steps of the version that begins with a file, and values that no cast can save are counted.

Edge cases: payloads that are null, no JSON or no object take no part in schemas and give rows of nulls in the table;
JSON nulls are no values; files without any value have no fields; ties between types go to the first of string, number,
boolean, list, object; of two keys for one column in a file, the column's own name wins and the other keeps its name;
tied keys of which none is a column's go by the one written first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import Scratch

# Columns of the consistent table and their types.
COLUMNS = {
    "material_id": "string", "formula": "string", "elements": "array<string>", "nelements": "int", "nsites": "int",
    "structure": "string", "immutable_id": "string", "structure_fingerprint": "string", "functional": "string",
    "density": "double", "bulk_modulus": "double", "energy_above_hull": "double", "energy_per_site": "double",
    "max_force": "double", "last_modified": "string",
}
# Other names of these columns, for keys that content tells nothing about.
RENAMES = {
    "material_id": "mat_id entry_id",
    "formula": "formula_pretty chem chemical_formula composition pretty_formula reduced_formula",
    "elements": "element_list species_set element_set",
    "nelements": "n_elements num_elements number_of_elements",
    "nsites": "n_sites num_sites number_of_sites",
    "structure": "crystal crystal_structure",
    "immutable_id": "imm_id stable_id",
    "structure_fingerprint": "fp_hash struct_fp sfp fingerprint structure_hash",
    "functional": "xc xc_functional dft_functional",
    "density": "rho mass_density",
    "bulk_modulus": "k_vrh kvrh bulk_modulus_vrh",
    "energy_above_hull": "e_hull ehull hull_distance e_above_hull",
    "energy_per_site": "e_per_site",
    "max_force": "force_max fmax",
    "last_modified": "modified_at updated_at",
}
TYPES = ("string", "number", "boolean", "list", "object")


def _bare(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def _lookup(rules: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in rules.items() for x in kv]), _bare(key))


def by_name(key: Column) -> Column:
    """Column that a key names itself, in any case and with any separators, or null."""
    return _lookup({c.replace("_", ""): c for c in COLUMNS}, key)


def by_rule(key: Column) -> Column:
    """Column that a key is another name of, or null."""
    return _lookup({alias.replace("_", ""): c for c, words in RENAMES.items() for alias in words.split()}, key)


def _type_of(text: Column) -> Column:
    """Type of a JSON value from its text, null for null."""
    head = F.substring(F.ltrim(text), 1, 1)
    return F.when(head == '"', "string").when(head == "[", "list").when(head == "{", "object").when(head.isin("t", "f"), "boolean").when(head != "n", "number")


def _opened(lines: DataFrame, what: str) -> DataFrame:
    """One row for each key of each JSON object, with ``what`` of d (the file's columns and doc) and e (key, value)."""
    doc = lines.select("file_no", "feed", "written_at", F.try_parse_json("payload").alias("doc")).where("doc IS NOT NULL AND schema_of_variant(doc) LIKE 'OBJECT%'")
    return lines.sparkSession.sql(f"SELECT {what} FROM {{docs}} d, LATERAL variant_explode(d.doc) e", docs=doc)


def typed_keys(lines: DataFrame) -> DataFrame:
    """(file_no, key, type) of every non-null value, without its text."""
    kind = F.col("kind")
    name = F.when(kind.startswith("ARRAY"), "list").when(kind.startswith("OBJECT"), "object").when(kind == "BOOLEAN", "boolean").when(kind == "STRING", "string").when(kind != "VOID", "number")
    return _opened(lines, "d.file_no, e.key, schema_of_variant(e.value) AS kind").select("file_no", "key", name.alias("type")).where("type IS NOT NULL")


def entries(lines: DataFrame) -> DataFrame:
    """(file_no, feed, written_at, key, type, value, id) of every non-null value; value and id are JSON text."""
    e = _opened(lines, "d.file_no, d.feed, d.written_at, e.key, to_json(e.value) AS value, try_variant_get(d.doc, '$.material_id', 'string') AS id")
    return e.withColumn("type", _type_of(F.col("value"))).where("type IS NOT NULL")


def file_fields(e: DataFrame) -> DataFrame:
    """(file_no, key, type) with the type of most values."""
    order = F.create_map(*[F.lit(x) for i, t in enumerate(TYPES) for x in (t, -i)])
    counts = e.groupBy("file_no", "key", "type").agg(F.count("*").alias("n"))
    return counts.groupBy("file_no", "key").agg(F.max_by("type", F.struct("n", F.element_at(order, F.col("type")))).alias("type"))


def files(lines: DataFrame) -> DataFrame:
    """(file_no, feed, written_at, prev_no): each file with the one of its feed last written before it."""
    one = lines.groupBy("file_no").agg(F.min("feed").alias("feed"), F.min("written_at").alias("written_at"))
    return one.withColumn("prev_no", F.lag("file_no").over(W.partitionBy("feed").orderBy("written_at", "file_no")))


def _content(value: Column) -> Column:
    """Text that is the same for the same content in any of its forms."""
    inner = F.coalesce(F.get_json_object(value, "$.value"), F.get_json_object(value, "$.name"), value)
    pairs = F.transform(F.map_entries(F.from_json(inner, "map<string,string>")), lambda p: F.concat(p["key"], p["value"]))
    listed = F.from_json(inner, "array<string>")
    text = F.when(F.ltrim(inner).startswith("["), F.array_join(listed, "")).when(F.ltrim(inner).startswith("{"), F.array_join(F.array_sort(pairs), "")).otherwise(inner)
    plain = F.lower(F.regexp_replace(text, '[\\s"]', ""))
    return F.when(plain.rlike(r"^[-+]?[0-9]{1,15}(\.[0-9]+)?$"), plain.try_cast("double").cast("string")).otherwise(plain)


def learned(lines: DataFrame, fields: DataFrame, chain: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, learned) for keys that are no column's name, by records that two files in a row both deliver.

    Only files of steps in which a key appears and one goes away, at least one of them no column's name, are read again,
    and only values of these keys are compared; two keys (or a key and a column) are tied when at least 3 records agree
    and at least 4 of 5 do, two keys without a column also need 3 different contents. Ties are a few names, whatever the
    input's size, and are followed on the driver.
    """
    keyed = fields.select("file_no", "key", by_name(F.col("key")).alias("column"))
    step = chain.where("prev_no IS NOT NULL").select("file_no", "prev_no")
    before = step.join(keyed.select(F.col("file_no").alias("prev_no"), "key", "column"), "prev_no").select("file_no", "key", "column", "prev_no")
    now = keyed.join(step.select("file_no"), "file_no")
    came = now.join(before, ["file_no", "key"], "left_anti").join(before, ["file_no", "column"], "left_anti").select("file_no", "key", "column")
    went = before.join(now, ["file_no", "key"], "left_anti").join(now, ["file_no", "column"], "left_anti").select("file_no", "prev_no", F.col("key").alias("old"), F.col("column").alias("old_column"))
    pairs = scratch.put(came.join(went, "file_no").where("column IS NULL OR old_column IS NULL"))
    read = pairs.select("file_no", "key").unionByName(pairs.select(F.col("prev_no").alias("file_no"), F.col("old").alias("key"))).distinct()
    e = entries(lines.join(read.select("file_no").distinct(), "file_no", "left_semi")).join(read, ["file_no", "key"], "left_semi")
    values = scratch.put(e.select("file_no", "key", "id", _content(F.col("value")).alias("content")).where("id IS NOT NULL"))
    new = pairs.join(values, ["file_no", "key"])
    old = values.select(F.col("file_no").alias("prev_no"), F.col("key").alias("old"), "id", F.col("content").alias("was"))
    ends = new.join(old, ["prev_no", "old", "id"]).select(F.coalesce("column", "key").alias("a"), F.coalesce("old_column", "old").alias("b"), (F.col("column").isNotNull() | F.col("old_column").isNotNull()).alias("ruled"), F.when(F.col("content") == F.col("was"), F.pmod(F.xxhash64("content"), F.lit(1024))).alias("agreed"))
    seen = ends.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("n"), F.count("agreed").alias("same"), F.size(F.collect_set("agreed")).alias("kinds"), F.first("ruled").alias("ruled"))
    ties = seen.where("same >= 3 AND same * 5 >= n * 4 AND (ruled OR kinds >= 3)").select("a", "b", "same").collect()
    free = {x for t in ties for x in (t["a"], t["b"]) if x not in COLUMNS}
    written = fields.where(F.col("key").isin(*free)).join(chain, "file_no").groupBy("key").agg(F.min(F.struct("written_at", "file_no")).alias("at")).orderBy("at", "key").collect() if free else []
    names = follow([(t["a"], t["b"], t["same"]) for t in ties], [r["key"] for r in written])
    return lines.sparkSession.createDataFrame(sorted(names.items()), "key STRING, learned STRING")


def follow(ties: list[tuple[str, str, int]], first: list[str]) -> dict[str, str]:
    """Field of each tied key that is no column: the column it is tied to by most records, over other keys if need be;
    else the first, in the order of ``first``, of the keys tied to each other."""
    near: dict[str, list[tuple[int, str]]] = {}
    for a, b, same in ties:
        near.setdefault(a, []).append((same, b))
        near.setdefault(b, []).append((same, a))
    names = {c: c for c in near if c in COLUMNS}
    while True:
        reached = {k: max((same, names[x]) for same, x in xs if x in names)[1] for k, xs in near.items() if k not in names and any(x in names for _, x in xs)}
        if not reached:
            break
        names |= reached
    for k in first:
        todo = [] if k in names else [k]
        while todo:
            x = todo.pop()
            if x not in names:
                names[x] = k
                todo += [y for _, y in near[x]]
    return {k: c for k, c in names.items() if k not in COLUMNS}


def mapped_fields(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((file_no, field, key, type), files) with every key led to its field."""
    scratch = Scratch(lines.sparkSession, "drift")
    chain = scratch.put(files(lines))
    fields = scratch.put(file_fields(typed_keys(lines)))  # one row for each file and key
    # names learned from content are a handful of keys, whatever the input's size
    known = fields.join(learned(lines, fields, chain, scratch), "key", "left").withColumn("column", F.coalesce(by_name(F.col("key")), "learned", by_rule(F.col("key"))))
    first = W.partitionBy("file_no", "column").orderBy(F.desc(F.col("key") == F.col("column")), F.desc(F.col("learned").isNull()), "key")
    place = F.when(F.col("column").isNotNull(), F.row_number().over(first))
    named = known.withColumn("place", place).select("file_no", F.when(F.col("place") == 1, F.col("column")).otherwise(F.col("key")).alias("field"), "key", "type")
    return scratch.put(named), chain


def registry(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((feed, file_no, fingerprint, version, begins) of each file, (feed, version, field, key, type) of each version).

    A feed's version goes up whenever the fingerprint of its files changes; ``begins`` marks the file it begins with.
    """
    fields, chain = mapped_fields(lines)
    prints = fields.groupBy("file_no").agg(F.sha2(F.concat_ws(";", F.array_sort(F.collect_list(F.concat_ws(":", "field", "key", "type")))), 256).alias("fingerprint"))
    w = W.partitionBy("feed").orderBy("written_at", "file_no")
    both = chain.join(prints, "file_no", "left").withColumn("begins", ~F.col("fingerprint").eqNullSafe(F.lag("fingerprint").over(w)) | F.col("prev_no").isNull())
    scratch = Scratch(lines.sparkSession, "schemas")
    files_ = scratch.put(both.select("feed", "file_no", "fingerprint", F.sum(F.col("begins").cast("int")).over(w).alias("version"), "begins"))
    return files_, scratch.put(fields.join(files_.where("begins").select("file_no", "feed", "version"), "file_no").select("feed", "version", "field", "key", "type"))


def migrations(schemas: DataFrame, files_: DataFrame) -> DataFrame:
    """(feed, version, field_name, step, key_before, key_now, type_before, type_now): how each version but a feed's first
    comes from the one before; step is rename, cast, default (the field came) or drop (it went)."""
    later = files_.where("begins AND version > 1").select("feed", "version")
    now = schemas.where("version > 1").select("feed", "version", F.col("field").alias("field_name"), F.col("key").alias("key_now"), F.col("type").alias("type_now"))
    before = schemas.select("feed", (F.col("version") + 1).alias("version"), F.col("field").alias("field_name"), F.col("key").alias("key_before"), F.col("type").alias("type_before")).join(later, ["feed", "version"], "left_semi")
    both = now.join(before, ["feed", "version", "field_name"], "full")
    steps = F.array_compact(F.array(
        F.when(F.col("key_before").isNull(), "default"),
        F.when(F.col("key_now").isNull(), "drop"),
        F.when(F.col("key_now") != F.col("key_before"), "rename"),
        F.when(F.col("type_now") != F.col("type_before"), "cast"),
    ))
    return both.select("feed", "version", "field_name", F.explode(steps).alias("step"), "key_before", "key_now", "type_before", "type_now")


def changes(lines: DataFrame) -> DataFrame:
    """(file_no, field_name, change, key_before, key_now, type_before, type_now) of each file against the one before:
    the migration steps of the version that begins with it."""
    files_, schemas = registry(lines)
    steps = migrations(schemas, files_).join(files_.where("begins").select("feed", "version", "file_no"), ["feed", "version"])
    told = F.when(F.col("step") == "default", "added").when(F.col("step") == "drop", "removed").when(F.col("step") == "rename", "renamed").otherwise("retyped")
    return steps.select("file_no", "field_name", told.alias("change"), "key_before", "key_now", "type_before", "type_now")


def versions(lines: DataFrame) -> DataFrame:
    """(feed, file_no, fingerprint, version) of each file."""
    return registry(lines)[0].select("feed", "file_no", "fingerprint", "version")


def steps(lines: DataFrame) -> DataFrame:
    """The migration steps of all versions of all feeds."""
    files_, schemas = registry(lines)
    return migrations(schemas, files_)


def _plain(text: Column) -> Column:
    inner = F.coalesce(F.get_json_object(text, "$.value"), F.get_json_object(text, "$.name"), text)
    return F.when(~F.lower(F.trim(inner)).isin("", "n/a", "na", "null", "none", "nan"), inner)


def _structured(text: Column) -> Column:
    return F.ltrim(text).startswith("[") | F.ltrim(text).startswith("{")


def _cast(name: str, kind: str, text: Column) -> Column:
    """The value of a column from the JSON text of a value in any of its forms; null where it can't be had."""
    if kind == "array<string>":
        return F.coalesce(F.from_json(text, "array<string>"), F.split(F.when(~_structured(text), _plain(text)), r"\s*[-,;\s]\s*"))
    if name == "formula":
        listed = F.array_join(F.from_json(text, "array<string>"), "")
        counted = F.array_join(F.transform(F.map_entries(F.from_json(text, "map<string,string>")), lambda p: F.concat(p["key"], p["value"])), "")
        return F.when(F.ltrim(text).startswith("["), listed).when(F.ltrim(text).startswith("{"), counted).otherwise(_plain(text))
    if kind == "string" and name != "structure":
        return F.when(F.ltrim(text).startswith("["), F.array_join(F.from_json(text, "array<string>"), "")).otherwise(_plain(text))
    if kind == "string":
        return text
    number = _plain(text).try_cast("double")
    return number.try_cast("int") if kind == "int" else number


def routed(lines: DataFrame) -> DataFrame:
    """file_no, line_no, feed, version, the columns of ``COLUMNS`` through the rules of each file's version, and failed:
    the columns whose value no cast could save (placeholders for nothing are none)."""
    files_, schemas = registry(lines)
    # a version's steps down to the table's columns, composed once: which key each column is read from
    route = schemas.where(F.col("field").isin(*COLUMNS)).groupBy("feed", "version").agg(F.map_from_entries(F.collect_list(F.struct("field", "key"))).alias("route"))
    by_file = files_.select("feed", "file_no", "version").join(route, ["feed", "version"], "left").drop("feed")
    parsed = lines.select("file_no", "line_no", "feed", F.from_json("payload", "map<string,string>").alias("m")).join(by_file, "file_no", "left")
    raw = parsed.select("file_no", "line_no", "feed", "version", *[F.col("m")[F.col("route")[c]].alias(f"_{c}") for c in COLUMNS])
    cast = raw.select("file_no", "line_no", "feed", "version", *[f"_{c}" for c in COLUMNS], *[_cast(c, k, F.col(f"_{c}")).alias(c) for c, k in COLUMNS.items()])
    lost = [F.when(F.col(c).isNull() & _plain(F.col(f"_{c}")).isNotNull(), c) for c in COLUMNS]
    return cast.select("file_no", "line_no", "feed", "version", *COLUMNS, F.array_compact(F.array(*lost)).alias("failed"))


def consistent(lines: DataFrame) -> DataFrame:
    """All records in one table: file_no, line_no, feed, and the columns of ``COLUMNS`` through rename, default and cast rules."""
    return routed(lines).drop("version", "failed")


def odd_values(lines: DataFrame) -> DataFrame:
    """(file_no, field_name, n_values, n_odd_type, n_failed) where values have another type than their field or were lost by its cast."""
    fields, _ = mapped_fields(lines)
    counts = typed_keys(lines).groupBy("file_no", "key", "type").agg(F.count("*").alias("n"))
    typed = counts.join(fields.select("file_no", "key", "field", F.col("type").alias("of_most")), ["file_no", "key"])
    per = typed.groupBy("file_no", F.col("field").alias("field_name")).agg(F.sum("n").alias("n_values"), F.sum(F.when(F.col("type") != F.col("of_most"), F.col("n")).otherwise(0)).alias("n_odd_type"))
    lost = routed(lines).select("file_no", F.explode("failed").alias("field_name")).groupBy("file_no", "field_name").agg(F.count("*").alias("n_failed"))
    both = per.join(lost, ["file_no", "field_name"], "left").withColumn("n_failed", F.coalesce("n_failed", F.lit(0)))
    return both.where("n_odd_type > 0 OR n_failed > 0")
