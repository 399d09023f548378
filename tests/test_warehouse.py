"""Landing files keep values; a day is replaced for all tables or for none."""

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shopstream.operators import warehouse

ODD = st.text(alphabet=st.sampled_from(list("\t\n\r\\N na\"',;\x00é日")), max_size=6) | st.none()


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(ODD, ODD, ODD), min_size=20, max_size=60))
def test_landed_values_come_back(spark, tmp_path_factory, rows):
    root = f"file://{tmp_path_factory.mktemp('land')}"
    warehouse.land(spark.createDataFrame(rows, "id string, name string, category2_id string"), root, "base_category3", "d")
    found = warehouse.read_landed(spark, root, "base_category3", "d").collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, rows))


def test_a_table_that_fails_leaves_the_day_of_all(spark, tmp_path):
    root, house = f"file://{tmp_path}/land", f"file://{tmp_path}/ods"
    source = lambda v: lambda name: spark.createDataFrame([(str(v), f"n{v}", "2024-01-01 10:00:00")], "id string, name string, create_time string")
    warehouse.import_source(source(1), root, "first", "d")
    warehouse.load_ods(spark, root, house, "first", "d")
    own = lambda: {r.id for name in ("order_info", "base_category1", "activity_rule") for r in spark.read.parquet(f"{house}/ods_{name}").collect()}
    assert own() == {"1"}
    bad = lambda name: source(2)(name).withColumn("id", F.raise_error("no source")) if list(warehouse.ODS_SPECS).index(name) == 19 else source(2)(name)
    with pytest.raises(Exception):
        warehouse.import_source(bad, root, "first", "d")
    warehouse.import_source(source(2), root, "first", "d")
    broken = tmp_path / "land/cart_info/d"
    (broken.rename(tmp_path / "kept"))
    with pytest.raises(Exception):
        warehouse.load_ods(spark, root, house, "first", "d")
    assert own() == {"1"}
    (tmp_path / "kept").rename(broken)
    warehouse.load_ods(spark, root, house, "first", "d")
    assert own() == {"2"} and not (tmp_path / "ods/_staging/d").exists()


def test_values_of_a_table_are_escaped_by_one_short_function(spark, tmp_path):
    """Code for all columns in one method is too long to be compiled, and regular expressions are slow."""
    root = f"file://{tmp_path}"
    odd = ["\\b", "\\\nb", "\nb", "\\n", "\\\\n", "b\\", "\r\\r", "\t\\t", "\\N", "", None]
    warehouse.land(spark.createDataFrame([(v, v, "x") for v in odd], "id string, name string, category2_id string"), root, "base_category3", "d")
    found = warehouse.read_landed(spark, root, "base_category3", "d")
    assert sorted(map(repr, [r.id for r in found.collect()])) == sorted(map(repr, odd))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("replace(") <= 6 and plan.count("split(") == 1


def test_fields_of_many_rows_are_escaped_at_once(spark, tmp_path, monkeypatch):
    """Not one by one in the plan; in blocks, whatever rows a batch begins with, and with escapes that others wrote."""
    monkeypatch.setattr(warehouse, "_BLOCK", 100)
    own = [["a\\", "\\b\t", None], ["", "\n\\N\r"], ["\\N", "日\\\\"], [None], ["x" * 300, "\\"], ["n", "tr"]]
    batch = pa.RecordBatch.from_arrays([pa.array([["\\"], *own, ["\t"]])], ["value"]).slice(1, len(own))
    lines = [b for b in warehouse._each_field(warehouse._escaped, True, [batch])]
    assert len(lines) > 1
    written = [x for b in lines for x in b.column(0).to_pylist()]
    assert written[:4] == ["a\\\\\t\\\\b\\t\t\\N", "\t\\n\\\\N\\r", "\\\\N\t日\\\\\\\\", "\\N"]
    foreign = ["\\x", "\\", "\\\\\\", "t\\\\t", "\\N\\N", "\\\\N"]
    fields = pa.RecordBatch.from_arrays([pa.array([*(x.split("\t") for x in written), foreign])], ["value"])
    read = [x for b in warehouse._each_field(warehouse._unescaped, False, [fields]) for x in b.column(0).to_pylist()]
    assert read == [*own, ["\\x", "\\", "\\\\", "t\\t", "\\N\\N", "\\N"]]
    root = f"file://{tmp_path}"
    warehouse.land(spark.createDataFrame([("1", "a\tb", None)], "id string, name string, category2_id string"), root, "base_category3", "d")
    plan = warehouse.read_landed(spark, root, "base_category3", "d")._jdf.queryExecution().optimizedPlan().toString()
    assert "replace(" not in plan and "transform(" not in plan
