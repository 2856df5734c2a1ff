"""Every query against its SQL on the smallest tables; those without SQL must run."""

import duckdb
import pytest

from tests.conftest import SF

from tessera.plans.catalogue import ORACLES, QUERIES


#: On the smallest tables some languages have fewer rows than a regression has weights, and
#: the SQL, which solves by determinants, has no answer there; the library takes the least one.
DETERMINED = {"oof_regression", "oof_metrics", "oof_regression_by_fold"}


@pytest.mark.parametrize("name", sorted(set(ORACLES) - DETERMINED))
def test_against_sql(name, spark, duck, same):
    same(QUERIES[name](spark, SF), duck.sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(DETERMINED))
def test_regressions_against_sql(name, spark, same):
    folder = "/root/testdata/sf0.01"
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    same(QUERIES[name](spark, folder), c.sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(name, spark):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 4
    assert set(e.oracle_sql()) <= set(e.queries())


def test_word_error_tables_compute_distances_once(spark):
    """Cells, rank sums and correlation read stored distances; none works them out again."""
    plan = QUERIES["wer_table_cells"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "levenshtein" not in plan.lower()
