"""File and record sources, and sinks, of material records."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRUCTURE = "struct<lattice: array<array<double>>, species: array<string>, coords: array<array<double>>, site_properties: string>"
PROPERTY = "struct<name: string, value: string, unit: string, source: string, method: string, confidence: double, uncertainty: double, source_id: string, extra: map<string,string>>"
PROPERTY_KEYS = ("name", "value", "unit", "source", "method", "confidence", "uncertainty", "source_id", "extra", "context", "source_artifact")


def jsonl_lines(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """Lines of text files, blank ones left out; ``max_rows`` counts physical lines, blank ones included, in file order."""
    lines = spark.read.text(path)
    if max_rows is not None:
        lines = lines.limit(max_rows)
    return lines.where(F.trim("value") != "").withColumnRenamed("value", "line")


def demo_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Records of the first path that is there; none of them gives an empty table."""
    from ..runtime import _fs

    for p in paths:
        fs, where = _fs(spark, p)
        if fs.exists(where):
            return from_jsonl(spark, p)
    return decode_materials(spark.createDataFrame([], "line string"))


def text_lines(spark: SparkSession, content: str, max_rows: int | None = None) -> DataFrame:
    """Lines of a text; ``max_rows`` counts physical lines, blank ones included."""
    lines = content.splitlines()[: max_rows if max_rows is not None else None]
    return spark.createDataFrame([(x,) for x in lines if x.strip()], "line string")


def decode_materials(lines: DataFrame, line: str = "line") -> DataFrame:
    """Material records of JSON lines: unknown top-level keys are ignored, unknown property keys go into ``extra``,
    and an empty reduced formula falls back to the formula. Lines that are no JSON object give rows of nulls."""
    top = "material_id string, formula string, reduced_formula string, elements array<string>, dimensionality int, source_id string, metadata string, structure " + STRUCTURE + ", properties array<string>, provenance array<string>"
    doc = lines.select(F.from_json(line, top).alias("d")).select("d.*")

    def entry(p):
        known = F.from_json(p, PROPERTY)
        rest = F.map_filter(F.from_json(p, "map<string,string>"), lambda k, v: ~k.isin(*PROPERTY_KEYS))
        extra = F.map_zip_with(F.coalesce(known["extra"], F.create_map().cast("map<string,string>")), rest, lambda k, a, b: F.coalesce(a, b))
        return known.withField("extra", extra)

    text = F.col("reduced_formula")
    return doc.withColumns({"properties": F.transform("properties", entry), "reduced_formula": F.when(F.coalesce(F.trim(text), F.lit("")) == "", F.col("formula")).otherwise(text)})


def from_jsonl(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    return decode_materials(jsonl_lines(spark, path, max_rows))


def from_csv(spark: SparkSession, path: str, id_col: str = "material_id", formula_col: str = "formula", property_columns: list[str] | None = None) -> DataFrame:
    """(material_id, formula, name, value_text, value) of a wide CSV: every other column but structure_json is a
    property; empty values are left out; units are unknown."""
    df = spark.read.csv(path, header=True, escape='"', multiLine=True)
    missing = [c for c in (id_col, formula_col) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    names = property_columns or [c for c in df.columns if c not in (id_col, formula_col, "structure_json")]
    long = df.select(F.col(id_col).alias("material_id"), F.col(formula_col).alias("formula"), *[F.col(f"`{n}`").cast("string").alias(n) for n in names]).unpivot(["material_id", "formula"], names, "name", "value_text")
    return long.where("value_text IS NOT NULL").withColumn("value", F.col("value_text").try_cast("double"))


def csv_structures(spark: SparkSession, path: str, id_col: str = "material_id") -> DataFrame:
    """(material_id, structure) of a wide CSV's column structure_json; null where there is none, or none that is valid."""
    from ..operators.normalize import structure_faults

    df = spark.read.csv(path, header=True, escape='"', multiLine=True)
    if "structure_json" not in df.columns:
        return df.select(F.col(id_col).alias("material_id"), F.lit(None).cast(STRUCTURE).alias("structure"))
    s = F.from_json("structure_json", STRUCTURE)
    return df.select(F.col(id_col).alias("material_id"), F.when(F.coalesce(F.size(structure_faults(s)) == 0, F.lit(False)), s).alias("structure"))


def from_parquet(spark: SparkSession, path: str, source_dataset: str, subset: str | None = None):
    """A dataset with strict guardrails of a bulk source's files; the subset is named after the file unless it is given."""
    from ..operators.dataset import MaterialsDataset

    return MaterialsDataset.bulk(spark.read.parquet(path), source_dataset, subset or path.rstrip("/").rsplit("/", 1)[-1].split(".")[0])


def from_bulk_records(spark: SparkSession, records: list[dict], schema, source_dataset: str, subset: str | None = None):
    """As ``from_parquet``, of records at hand."""
    from ..operators.dataset import MaterialsDataset

    return MaterialsDataset.bulk(spark.createDataFrame(records, schema), source_dataset, subset or "local_records")


def bulk_scan(spark: SparkSession, paths: list[str], columns: list[str], predicate) -> DataFrame:
    """Columns of many parquet shards behind one predicate; both reach the scan."""
    return spark.read.parquet(*paths).where(predicate).select(*columns)


def to_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line, nulls left out."""
    df.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def canonical_lines(df: DataFrame) -> DataFrame:
    """(line) with sorted keys, nulls left out and ", " and ": " between parts, byte for byte as Python's json writes."""

    def run(batches):
        import pandas as pd

        def clean(v):
            if isinstance(v, dict):
                return {k: clean(x) for k, x in v.items() if x is not None}
            return [clean(x) for x in v] if isinstance(v, list) else v

        for pdf in batches:
            yield pd.DataFrame({"line": [json.dumps(clean(json.loads(t)), sort_keys=True) for t in pdf["t"]]})

    return df.select(F.to_json(F.struct(*[f"`{c}`" for c in df.columns])).alias("t")).mapInPandas(run, "line string")


def lines_digest(lines: DataFrame, line: str = "value") -> tuple[int, str]:
    """(lines, sha256) of a table of lines, whatever its partitions and order: the 256-bit digests of the lines, taken as
    eight numbers of 32 bits each, are summed, and the sums are hashed with the count."""
    h = F.sha2(F.col(line), 256)
    parts = [F.sum(F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")) for i in range(8)]
    one = lines.agg(F.count("*"), *parts).first()
    return one[0], hashlib.sha256("|".join(str(x or 0) for x in one).encode()).hexdigest()


def content_id(df: DataFrame, order: list[str]) -> str:
    """``mg_ds_`` and 16 hex digits of a table's content, whatever its partitions."""
    text = df.select(F.to_json(F.struct(*[f"`{c}`" for c in sorted(df.columns)])).alias("value"))
    count, digest = lines_digest(text)
    return "mg_ds_" + hashlib.sha256(f"{','.join(order)}|{count}|{digest}".encode()).hexdigest()[:16]


def schema_document(schema: T.StructType, name: str) -> str:
    """JSON Schema of a table, sorted and indented by two."""
    kinds = {"string": "string", "double": "number", "float": "number", "int": "integer", "bigint": "integer", "boolean": "boolean"}

    def of(t):
        if isinstance(t, T.StructType):
            return {"type": "object", "properties": {f.name: of(f.dataType) for f in t.fields}, "required": sorted(f.name for f in t.fields if not f.nullable)}
        if isinstance(t, T.ArrayType):
            return {"type": "array", "items": of(t.elementType)}
        if isinstance(t, T.MapType):
            return {"type": "object", "additionalProperties": of(t.valueType)}
        return {"type": kinds.get(t.simpleString(), "string")}

    return json.dumps(of(schema) | {"$id": f"urn:crysmill:{name}", "title": name}, indent=2, sort_keys=True)


def to_ranked_csv(ranked: DataFrame, path: str, digits: int = 4) -> None:
    """Ranking with a rank column from 1 and rounded scores, as one CSV file; a ranking is a report of bounded size."""
    cols = [F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in ranked.dtypes]
    ranked.select(*cols).coalesce(1).write.mode("overwrite").option("header", "true").csv(path)
