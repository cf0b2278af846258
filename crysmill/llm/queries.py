"""Queries of the operators for training data, over the whole tables of a data folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import shared_dir, table, temporary
from . import entity_match, mixing, packing, spam
from .sql import MATCHED, P1_GROUPS
from .splits import SplitTable, material_keys, read_targets
from .tokens import default_vocabulary
from .top_groups import top_n


# --- 1: splits that keep related records together
def _split_table(spark: SparkSession, sf_dir: str) -> SplitTable:
    where = temporary(spark, f"{shared_dir(spark)}/crysmill/split-table-{uuid.uuid4().hex[:12]}")
    return SplitTable(spark, where, read_targets(table(spark, sf_dir, "split_targets")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_splits(spark, sf_dir).where("row_no <> first_row_no").select("first_row_no", "row_no")


def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with its component and split."""
    done = _split_table(spark, sf_dir).add(material_keys(table(spark, sf_dir, "lemat_bulk_sample")))
    return done.select(F.col("id").alias("row_no"), F.col("component_id").alias("first_row_no"), "split")


def p1_split_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actual against target share of each split."""
    done = p1_splits(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n_rows"), F.count_distinct("first_row_no").alias("n_groups"))
    whole = done.agg(F.sum("n_rows").alias("all_rows"))
    targets = table(spark, sf_dir, "split_targets").select(F.col("split_name").alias("split"), "target_share")
    return done.crossJoin(F.broadcast(whole)).join(targets, "split", "left").select("split", "n_rows", "n_groups", (F.col("n_rows") / F.col("all_rows")).alias("actual_share"), "target_share")


def p1_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the older half of the ingestion times first, then the later ones against the persisted table; splits
    as they stand after both."""
    t = table(spark, sf_dir, "lemat_bulk_sample")
    at = t.agg(F.expr("percentile_approx(ingested_at, 0.5)")).first()[0]
    late = F.col("ingested_at") > F.lit(at).cast(t.schema["ingested_at"].dataType)
    store = _split_table(spark, sf_dir)
    store.add(material_keys(t.where(~F.coalesce(late, F.lit(False)))))
    # opened again, as the next day's job would
    store = SplitTable(spark, store.path, store.targets)
    store.add(material_keys(t.where(late)))
    return store.present().select(F.col("id").alias("row_no"), "split", "batch")


def p1_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row over both batches of p1_incremental: rows, groups that the tied rows form, and groups that lie in two splits."""
    t = table(spark, sf_dir, "lemat_bulk_sample")
    groups = _split_table(spark, sf_dir).add(material_keys(t)).select(F.col("id").alias("row_no"), "component_id")
    per = p1_incremental(spark, sf_dir).join(groups, "row_no").groupBy("component_id").agg(F.count("*").alias("n"), (F.min("split") != F.max("split")).alias("parted"))
    return per.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_groups"), F.count_if(F.col("parted")).alias("n_parted"))


# --- 3: top N items within every group
def element_set(c) -> F.Column:
    """Distinct symbols, properly written, in alphabetical order, joined by '-'; null where there are none."""
    named = F.filter(F.transform(c, lambda x: F.initcap(F.trim(F.regexp_replace(x, r"\s", "")))), lambda x: x != "")
    joined = F.array_join(F.array_sort(F.array_distinct(named)), "-")
    return F.when(joined != "", joined)


def scored_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each (element_set, material_id) with the material's highest score and lowest energy above the hull."""
    bulk = table(spark, sf_dir, "lemat_bulk_sample").where("material_id IS NOT NULL")
    per = bulk.groupBy("material_id").agg(F.min(F.nanvl("energy_above_hull", F.lit(None))).alias("energy"), F.collect_set(element_set(F.col("elements"))).alias("sets"))
    score = table(spark, sf_dir, "shortlist_example").where("material_id IS NOT NULL").groupBy("material_id").agg(F.max(F.nanvl("score", F.lit(None))).alias("score")).where("score IS NOT NULL")
    return per.join(score, "material_id").select("material_id", "score", "energy", F.explode("sets").alias("element_set"))


def p3_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_n(scored_materials(spark, sf_dir), "element_set", "score", "material_id", 3, ("energy",))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_top(spark, sf_dir).select("element_set", "material_id")


# --- 10: keyword-stuffed and link-list pages
def p10_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.judged(table(spark, sf_dir, "documents"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_pages(spark, sf_dir).where("is_spam").select("doc_id")


# --- 7: matching entities across sources without keys
def p7_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = entity_match.match(entity_match.left_side(table(spark, sf_dir, "materials_sample")), entity_match.right_side(table(spark, sf_dir, "jarvis_rows")))
    return pairs.withColumnRenamed("mid", "material_id")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_matches(spark, sf_dir).select("material_id", "jid")


# --- 8: filling containers
def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "container_sizes"), default_vocabulary())


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p8_packed(spark, sf_dir))


def p8_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(container_kind, n_documents, n_split, over, cut_small): texts packed whole or in a row of pieces, containers above
    their capacity, and texts cut though they fit one."""
    packed = p8_packed(spark, sf_dir)
    boxes = packed.groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("t"), F.max("capacity_tokens").alias("cap")).groupBy("container_kind").agg(F.count_if(F.col("t") > F.col("cap")).alias("over"))
    texts = packed.groupBy("container_kind", "doc_id").agg(F.count("*").alias("pieces"), F.max("piece_no").alias("last"), F.sum("n_tokens").alias("t"), F.max("capacity_tokens").alias("cap"))
    whole = texts.groupBy("container_kind").agg(F.count("*").alias("n_documents"), F.count_if(F.col("pieces") != F.col("last") + 1).alias("n_broken"), F.count_if((F.col("pieces") > 1) & (F.col("t") <= F.col("cap"))).alias("n_cut_small"))
    return whole.join(boxes, "container_kind")


# --- 9: mixing sources
def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), default_vocabulary())


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(p9_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p9_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mix_name, source, drawable, drawn, over_repeated): targets whose source has texts, those drawn from, and documents
    drawn too often."""
    targets = table(spark, sf_dir, "mix_targets")
    drawn = p9_mix(spark, sf_dir).groupBy("mix_name", "source", "doc_id").agg(F.count("*").alias("times")).groupBy("mix_name", "source").agg(F.max("times").alias("most"))
    texts = table(spark, sf_dir, "documents").where(F.length("text") > 0).groupBy("source").agg(F.lit(True).alias("has"))
    out = targets.join(texts, "source", "left").join(drawn, ["mix_name", "source"], "left")
    return out.select("mix_name", "source", F.coalesce("has", F.lit(False)).alias("drawable"), F.col("most").isNotNull().alias("drawn"), F.coalesce(F.col("most") > F.col("max_repeats"), F.lit(False)).alias("over_repeated"))


QUERIES = {"p1_integrity": p1_integrity, "p8_accounting": p8_accounting, "p9_accounting": p9_accounting, "p8_packed": p8_packed, "p8_fill": p8_fill, "p9_mix": p9_mix, "p9_shares": p9_shares, "p7_found": p7_found, "p7_matches": p7_matches, "p10_found": p10_found, "p10_pages": p10_pages, "p1_found": p1_found, "p1_splits": p1_splits, "p1_split_shares": p1_split_shares, "p1_incremental": p1_incremental, "p3_found": p3_found, "p3_top": p3_top}

_P3 = """
WITH sets AS (
  SELECT material_id, energy_above_hull AS e,
    list_aggregate(list_sort(list_distinct(list_filter(list_transform(elements, lambda x: upper(trim(x)[1:1]) || lower(trim(x)[2:])), lambda y: y <> ''))), 'string_agg', '-') AS element_set
  FROM lemat_bulk_sample WHERE material_id IS NOT NULL),
energy AS (SELECT material_id, min(e) FILTER (WHERE NOT isnan(e)) AS energy FROM sets GROUP BY 1),
score AS (SELECT material_id, max(score) AS score FROM shortlist_example WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY 1),
ranked AS (
  SELECT s.element_set, s.material_id, c.score, row_number() OVER (PARTITION BY s.element_set ORDER BY c.score DESC, e.energy ASC NULLS LAST, s.material_id) AS place
  FROM (SELECT DISTINCT element_set, material_id FROM sets WHERE element_set IS NOT NULL AND element_set <> '') s
  JOIN score c USING (material_id) JOIN energy e USING (material_id))
"""
ORACLE = {
    "p1_found": P1_GROUPS + " SELECT comp AS first_row_no, id AS row_no FROM cc WHERE comp <> id",
    "p1_integrity": P1_GROUPS + " SELECT count(*) AS n_rows, count(DISTINCT comp) AS n_groups, CAST(0 AS BIGINT) AS n_parted FROM cc",
    "p7_found": MATCHED + " SELECT mid AS material_id, jid FROM b WHERE place = 1",
    "p7_matches": MATCHED + """, t AS (SELECT jid, mid FROM b WHERE place = 1 AND rule = 1), o AS (SELECT jid, mid, rule FROM (SELECT *, row_number() OVER (PARTITION BY jid ORDER BY rule, d, mid) AS q FROM a WHERE rule > 1) WHERE q = 1),
n AS (SELECT o.rule, count(*) AS n, count(*) FILTER (o.mid = t.mid) AS hits FROM o JOIN t USING (jid) GROUP BY 1), w AS (SELECT rule, (hits + 1) / (n + 2) AS c FROM n UNION ALL SELECT 1, (coalesce(sum(hits), 0) + 1) / (coalesce(sum(n), 0) + 2) FROM n)
SELECT mid AS material_id, jid, ['trace', 'cell_volume', 'density', 'id_tail', 'density_of_cell', 'cell_of_density', 'bulk_modulus', 'shear_modulus'][b.rule] AS rule, coalesce(c, 0.5::DOUBLE) AS confidence FROM b LEFT JOIN w ON b.rule = w.rule WHERE place = 1""",
    "p8_accounting": "SELECT container_kind, n AS n_documents, CAST(0 AS BIGINT) AS n_broken, CAST(0 AS BIGINT) AS n_cut_small, CAST(0 AS BIGINT) AS over FROM container_sizes, (SELECT count(*) AS n FROM documents WHERE length(text) > 0)",
    "p9_accounting": "SELECT mix_name, source, source IN (SELECT source FROM documents WHERE length(text) > 0 AND source IS NOT NULL) AS drawable, source IN (SELECT source FROM documents WHERE length(text) > 0 AND source IS NOT NULL) AS drawn, false AS over_repeated FROM mix_targets",
    "p3_found": _P3 + "SELECT element_set, material_id FROM ranked WHERE place <= 3",
    "p3_top": _P3 + "SELECT element_set, material_id, score, CAST(place AS INTEGER) AS place FROM ranked WHERE place <= 3",
}
