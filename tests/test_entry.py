"""Driver contract: entry() runs, and every registered query equals its DuckDB oracle at sf0.001."""
import os

import pytest

import __spark_entry__ as entry
from quizmart.plans.queries import QUERIES
from quizmart.plans.verify import compare_one, duck

SMOKE = "/root/testdata/sf0.001"
ROWS_ONLY: set[str] = set()  # every registered query has an oracle


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"username", "game_id", "course_name", "total_answers", "correct_answers"}


def test_every_query_has_an_oracle():
    missing = set(QUERIES) - set(entry.oracle_sql()) - ROWS_ONLY
    assert not missing, missing


@pytest.mark.skipif(not os.path.isdir(SMOKE), reason="driver test data not present")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, name):
    qs, oracle = entry.queries(), entry.oracle_sql()
    if name not in oracle:
        assert qs[name](spark, SMOKE).count() >= 0
        return
    r = compare_one(spark, _con(), name, qs[name], oracle[name], SMOKE)
    assert r["ok"], r


_CON = []


def _con():
    if not _CON:
        _CON.append(duck(SMOKE))
    return _CON[0]
