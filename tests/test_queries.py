import pytest
from compare import same

from tidemark.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, sf_dir, duck, name):
    same(catalog.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(catalog.ORACLES[name]).df())


def test_rows_only(spark, sf_dir):
    sizes = catalog.QUERIES["codec_sizes"](spark, sf_dir).toPandas()
    assert len(sizes) and (sizes.diff_bytes <= sizes.full_bytes + 2).all() and sizes.diff_bytes.min() == 2


def test_entry(spark, sf_dir):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_scans_are_pruned(spark, sf_dir):
    plan = catalog.QUERIES["cascade_delete"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(c_mktsegment), EqualTo(c_mktsegment,BUILDING)" in plan
    assert "o_totalprice" not in plan


def test_mutators_over_whole_arrays(spark, sf_dir):
    sizes = catalog.table(spark, sf_dir, "events").groupBy("user_id").count().collect()
    out = catalog.QUERIES["array_mutators"](spark, sf_dir).where("edit = 'push'").collect()
    assert {r.user_id: r.size for r in out} == {r.user_id: r["count"] + 1 for r in sizes}


def test_operators_asked_in_full(spark, sf_dir):
    events = catalog.table(spark, sf_dir, "events")
    assert catalog.QUERIES["interpolate_asof"](spark, sf_dir).count() == events.count()
    equal = catalog.QUERIES["array_equals"](spark, sf_dir)
    assert equal.where("user_id >= 0 and equal").count() == 0 and equal.where("user_id < 0 and not equal").count() == 0


def test_baselines_without_user_0(spark, sf_dir, tmp_path):
    catalog.table(spark, sf_dir, "events").where("user_id <> 0").write.parquet(str(tmp_path / "events.parquet"))
    assert catalog.QUERIES["baseline_full_or_diff"](spark, str(tmp_path)).where("message = 'diff'").count() > 0
