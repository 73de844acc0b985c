"""Every registered query against its SQL on the small tables."""

import pytest

import oracle
from __spark_entry__ import entry, oracle_sql, queries
from ringfence.operators.fit import batch_stats, fit_steps
from ringfence.plans import catalog
from ringfence.plans.boundary_sql import batch_counts, boundary_walk, model_digest
from ringfence.plans.catalog_sql import BY_FLAG, BY_LABEL

SQLS, FNS = oracle_sql(), queries()


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


def test_every_sql_has_a_query():
    assert set(SQLS) <= set(FNS)


@pytest.mark.parametrize("name", sorted(SQLS))
def test_query_equals_sql(spark, sf, con, name):
    assert oracle.compare(FNS[name](spark, sf), con, SQLS[name]) is None


@pytest.mark.parametrize("name", ["iforest", "plane_certificates", "grid_best"])
def test_query_without_sql_gives_rows(spark, sf, name):
    assert FNS[name](spark, sf).count() > 0


@pytest.mark.parametrize("chunk_rows", [150, 1100])
def test_chunked_fit_equals_sql(spark, sf, con, chunk_rows):
    """The recursive SQL knows no chunks; models and batches are the same for any size of them."""
    flag = ["l_returnflag"]
    rows = catalog._item_vectors(spark, sf, flag)
    models, steps = fit_steps(
        rows, catalog.ITEM_FEATURES, flag, "l_orderkey", catalog.ITEM_TIES, 1.66, batch_rows=50, chunk_rows=chunk_rows, rows_per_bucket=700,
    )
    assert oracle.compare(catalog._digest(models, flag), con, SQLS["fit_models"]) is None
    assert oracle.compare(batch_stats(steps, flag), con, batch_counts(BY_FLAG, 1.66, "l_returnflag", 50)) is None


@pytest.mark.parametrize("ahead", [7, 100_000])
def test_look_ahead_of_the_sql_is_no_matter(sf, con, ahead):
    """The oracle itself: how far a round scans does not change what is accepted."""
    wide = con.execute(model_digest(BY_LABEL, 1.0, "label", 3) + " order by 1").fetchall()
    other = f"with recursive {boundary_walk(BY_LABEL, 1.0, ahead)} select key, len(sv), round(radius, 8) from fitted order by 1"
    assert [r[:3] for r in wide] == con.execute(other).fetchall()


def test_entry(spark):
    out = entry(spark)
    assert out.count() == 6000 and 0 < out.filter("is_anomaly = 1").count() < 900
