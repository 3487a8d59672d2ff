"""Driver contract: entry smoke, every registered query runs, oracle keys are queries."""
import pytest

import __spark_entry__ as E
from tests.conftest import SF001


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 3
    assert df.columns == ["model_id", "n", "accuracy", "mean_confidence", "overconfidence_gap", "ece",
                          "conf_sd", "pct_conf_ge_95"]


def test_oracle_keys_are_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 60


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_every_query_runs_at_smallest_scale(spark, name):
    df = E.queries()[name](spark, SF001)
    assert len(df.columns) == len(set(df.columns))
    df.write.format("noop").mode("overwrite").save()
