"""No join of two sides that grow with the data is a broadcast, which would go through the driver whole."""

import pytest

from gradeloom.jobs import match_queries, paper_queries
from gradeloom.operators import extraction as X
from gradeloom.operators import matching as M

SF = "/root/testdata/sf0.001"


@pytest.fixture
def seeing(monkeypatch):
    """For a module: (name, plan) of each step that it stores from now on. Small tables are broadcast unless told otherwise."""

    def steps(module):
        seen, stored = [], module.stored
        monkeypatch.setattr(module, "stored", lambda df, name: (seen.append((name, plan(df))), stored(df, name))[1])
        return seen

    return steps


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def broadcasts(seen):
    return [name for name, text in seen if "BroadcastHashJoin" in text or "BroadcastNestedLoopJoin" in text]


def test_extracted_questions_join_without_broadcasts(spark, seeing):
    seen = seeing(X)
    df = paper_queries.extracted_questions(spark, SF)
    assert broadcasts([*seen, ("questions", plan(df))]) == [] and len(seen) > 4


def test_extracted_stats_join_without_broadcasts(spark):
    assert broadcasts([("stats", plan(paper_queries.extracted_stats(spark, SF)))]) == []


def test_question_regions_join_without_broadcasts(spark, seeing):
    """The questions that the boxes are made from are read once."""
    seen = seeing(X)
    df = paper_queries.question_regions(spark, SF)
    assert broadcasts([*seen, ("regions", plan(df))]) == [] and "FlatMapGroupsInPandas" not in plan(df)


def test_question_pairs_join_without_broadcasts(spark):
    assert broadcasts([("pairs", plan(match_queries.question_pairs(spark, SF)))]) == []


def test_transfer_summary_joins_without_broadcasts(spark, seeing):
    """With the stored steps, which transferred_answers has as well."""
    seen = seeing(M)
    df = match_queries.transfer_summary(spark, SF)
    assert broadcasts([*seen, ("summary", plan(df))]) == [] and len(seen) > 1


def test_transferred_answers_join_without_broadcasts(spark):
    assert broadcasts([("answers", plan(match_queries.transferred_answers(spark, SF)))]) == []
