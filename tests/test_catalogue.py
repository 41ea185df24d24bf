import pytest

import __spark_entry__
from nearfold.plans import catalogue

from .oracle import connect, same_rows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_gives_what_its_sql_gives(spark, engine, name):
    same_rows(engine, catalogue.oracle_sql()[name], catalogue.queries()[name](spark, FOLDER))


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalogue.queries()[name](spark, FOLDER).count() >= 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_similarity_joins_plan_no_nested_loops(spark):
    for name in ("image_pairs", "audio_pairs", "video_candidates", "name_hints_fuzzy"):
        plan = catalogue.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name
