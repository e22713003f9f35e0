import duckdb
import pytest

from corpuskiln.operators import evaluation as E

_NAMES = [f"{run}_{c}" for run in ("full", "plain") for c in ("top_score", "keyword_rate", "fact_rate")]


@pytest.mark.parametrize("full, plain", [(0.825, 0.585), (0.815, 0.575), (0.995, 0.005), (1.0, 0.0)])
def test_percent_of_the_verdict_is_rounded_as_in_sql(spark, full, plain):
    got = E.report(spark.createDataFrame([(1.0, 1.0, full, 1.0, 1.0, plain)], _NAMES), "full", "plain").first().verdict
    a, b = duckdb.execute("SELECT printf('%.0f', 100 * ?::DOUBLE), printf('%.0f', 100 * ?::DOUBLE)", [full, plain]).fetchone()
    assert got == f"W1 L0 T0  ({a}% vs {b}%)"


def test_no_questions_give_no_verdict(spark):
    got = E.report(spark.createDataFrame([], ", ".join(f"{c} double" for c in _NAMES)), "full", "plain").first()
    assert (got.n_questions, got.wins, got.full_avg_fact_rate, got.verdict) == (0, 0, None, None)
