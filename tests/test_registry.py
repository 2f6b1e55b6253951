"""Every registered query against its SQL twin on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, compare

# the text operators have their own tests
QUERIES = {k: v for k, v in entry.queries().items() if k not in entry.TEXT_QUERIES}
ORACLES = {k: v for k, v in entry.oracle_sql().items() if k in QUERIES}
MODELS = {"gbt_primary", "gbt_secondary", "gbt_plain", "mlp", "voting_soft", "stacking", "train_tuned", "tune", "tuning_history",
          "feature_importance", "top_features", "score_rows", "model_store", "early_stop", "live_model_alerts", "training_flow"}


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def test_only_model_fits_lack_sql():
    assert set(QUERIES) - set(ORACLES) == MODELS and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, db, name):
    got = QUERIES[name](spark, sf).toPandas()
    assert len(got) and compare(got, db.execute(ORACLES[name]).df()) == "ok"


def test_entry(spark):
    assert entry.entry(spark).count() == 1
