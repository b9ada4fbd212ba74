"""Plans: no Cartesian products, columns pruned and filters pushed to the scans, heavy keys bounded."""

import re

import pytest

from loomframe.plans import events, films, quality, relational, retrieval

SF = "/root/testdata/sf0.001"
# One side of these is a single row or a short list of parameters.
ONE_ROW = {"sql03_rating_percentiles", "rel07_above_average", "joi04_not_in", "joi04_not_in_null", "flt13_get_or_create", "eva07_grid_sweep", "eva08_best_params", "ret01_cosine_topk", "ret11_film_search", "ret06_rrf", "ret08_hybrid"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("module", [relational, films, events, quality], ids=lambda m: m.__name__)
def test_no_products(spark, module):
    for name, f in module.QUERIES.items():
        p = plan(f(spark, SF))
        assert "CartesianProduct" not in p, name
        if name not in ONE_ROW:
            assert "BroadcastNestedLoopJoin" not in p, name


def schemas(p):
    return [set(re.findall(r"(\w+):", s)) for s in re.findall(r"ReadSchema: struct<([^\n]*)>", p)]


def test_columns_are_pruned(spark):
    assert all("embedding" not in s and "content" not in s for s in schemas(plan(quality.QUERIES["p3_found"](spark, SF))))
    assert all(s <= {"source_type", "content"} for s in schemas(plan(films.QUERIES["agg10_text_stats"](spark, SF))))
    assert all(s <= {"ts", "event_type"} for s in schemas(plan(events.QUERIES["str06_error_ratio"](spark, SF))))


def test_filters_reach_the_scan(spark):
    p = plan(retrieval.QUERIES["ret01_cosine_topk"](spark, SF))
    assert "GreaterThanOrEqual(vote_count,10)" in p
    assert "GreaterThan(event_id,500)" in plan(events.QUERIES["str10_resume"](spark, SF))
    assert "EqualTo(film_id,268)" in plan(films.QUERIES["flt09_children"](spark, SF))


def test_top_k_is_pruned_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(relational.QUERIES["sql07_top_with_context"](spark, SF))
    assert "TakeOrderedAndProject" in plan(relational.QUERIES["sql08_genre_groups"](spark, SF))


def test_counts_are_partial(spark):
    p = plan(films.QUERIES["agg02_count_by"](spark, SF))
    assert "partial_count" in p
