"""Every query of the catalogue against its SQL, and properties of those without."""

import pytest
from support import same

from keelson.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, data, duck, name):
    same(catalog.queries()[name](spark, data), duck, catalog.oracle_sql()[name])


def test_zipf_is_skewed_and_in_range(spark, data):
    rows = {r.k: r.n for r in catalog.queries()["zipf_keys"](spark, data).collect()}
    assert sum(rows.values()) == 20_000 and min(rows) == 0 and max(rows) < 1000
    assert rows[0] > rows[1] > rows[5] > 50
    spread = {r.k: r.n for r in catalog.queries()["scrambled_zipf_keys"](spark, data).collect()}
    assert sum(spread.values()) == 20_000 and 0 <= min(spread) and max(spread) < 1000 and max(spread.values()) >= max(rows.values())
    latest = {r.k: r.n for r in catalog.queries()["latest_keys"](spark, data).collect()}
    assert latest[1000] == max(latest.values())


def test_uniform_keys(spark, data):
    rows = {r.k: r.n for r in catalog.queries()["uniform_keys"](spark, data).collect()}
    assert set(rows) == set(range(5, 15)) and min(rows.values()) > 1700


def test_bloom_false_positives(spark, data):
    rows = catalog.queries()["bloom_false_positives"](spark, data).collect()
    assert all(r.missed == 0 for r in rows)
    assert sum(r.false_positives for r in rows) <= 0.03 * sum(r["keys"] for r in rows)


def test_adaptive_ranges_carry_all_load(spark, data):
    rows = sorted(catalog.queries()["construct_ranges"](spark, data).collect())
    keys = spark.read.parquet(f"{data}/lineitem.parquet").select("l_orderkey").distinct().count()
    assert keys > 1000 and sum(r.rate for r in rows) == spark.read.parquet(f"{data}/lineitem.parquet").count()
    assert all(a.upper < b.lower for a, b in zip(rows, rows[1:], strict=False))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["k", "seq", "v"]


def test_plans_have_no_nested_loops(spark, data):
    for name in ("route_fragment", "overlap_pairs", "kv_seek", "approx_sizes"):
        plan = catalog.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_point_read_is_pushed_down(spark, data):
    plan = catalog.queries()["kv_get"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user_id,7)" in plan
