from pathlib import Path

import pytest

from crysmill.llm import queries

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries(spark, name):
    df = queries.QUERIES[name](spark, SMALL)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_found_columns_are_as_defined(spark):
    want = {"p1_found": {"first_row_no": "bigint", "row_no": "bigint"}, "p3_found": {"element_set": "string", "material_id": "string"}, "p7_found": {"material_id": "string", "jid": "string"}, "p10_found": {"doc_id": "bigint"}}
    for name, kinds in want.items():
        assert dict(queries.QUERIES[name](spark, SMALL).dtypes) == kinds


def test_groups_come_from_the_split_table(spark):
    from crysmill.runtime import shared_dir

    where = Path(shared_dir(spark)) / "crysmill"
    had = set(where.glob("split-table-*"))
    found = {(r["first_row_no"], r["row_no"]) for r in queries.p1_found(spark, SMALL).collect()}
    (new,) = set(where.glob("split-table-*")) - had
    rows = spark.read.parquet(f"{new}/rows/b1").where("id <> component_id").collect()
    assert found == {(r["component_id"], r["id"]) for r in rows} and found


def test_no_split_parts_a_group(spark):
    splits = queries.p1_splits(spark, SMALL)
    assert splits.groupBy("first_row_no").agg({"split": "max", "row_no": "count"}).count() == splits.select("first_row_no", "split").distinct().count()


def test_no_component_of_two_batches_lies_in_two_splits(spark):
    from crysmill.llm.splits import components, material_keys
    from crysmill.runtime import Scratch, table

    splits = queries.p1_incremental(spark, SMALL)
    ids, _ = components(material_keys(table(spark, SMALL, "lemat_bulk_sample")), Scratch(spark, "t"))
    both = splits.join(ids, splits.row_no == ids.id).groupBy("root").agg({"split": "approx_count_distinct"}).toDF("root", "n")
    assert splits.count() == ids.count() and both.where("n > 1").count() == 0
