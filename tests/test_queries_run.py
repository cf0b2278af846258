from pathlib import Path

import pytest

from crysmill.plans import core_problems, screening

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(core_problems.QUERIES))
def test_problem_queries(spark, name):
    df = core_problems.QUERIES[name](spark, SMALL)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


@pytest.mark.parametrize("name", ["schema_report", "scorecard_worst", "neighbour_edges", "mixed_methods", "graph_summary"])
def test_screening_queries(spark, name):
    assert screening.QUERIES[name](spark, SMALL).count() > 0


def test_found_columns_are_as_defined(spark):
    want = {"p2_found": {"parent_table": "string", "parent_no": "bigint", "child_kind": "string", "child_no": "int"}, "p4_found": {"file_no": "bigint", "field_name": "string", "change": "string"}, "p5_found": {"import_no": "bigint", "row_no": "int", "code": "string"}, "p6_found": {"record_no": "bigint", "prop_no": "int", "recorded_unit": "string"}}
    for name, kinds in want.items():
        assert dict(core_problems.QUERIES[name](spark, SMALL).dtypes) == kinds
