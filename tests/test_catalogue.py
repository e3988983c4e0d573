"""Catalogue queries against DuckDB on the smallest data (check_catalog.py runs all)."""

from importlib.util import find_spec

import duckdb
import pytest

import __spark_entry__ as entry
from catalog.oracles import ORACLES
from catalog.queries import CATALOGUE
from check_catalog import TABLES, rows_of

NAMES = [
    "binary_scan", "pattern_compaction", "itemset_counts_3", "valid_splits", "entropy_gain", "best_split_prefix",
    "depth1_exact", "greedy_objective_parity", "lookahead_objective_d3", "admitted_leaves", "admitted_splits",
    "budgets_multipass", "rule_list_histogram", "root_histogram", "root_histogram_d3", "trees_per_split",
    "tree_objectives", "tree_paths", "tree_nodes", "frontier_scores", "predict_tree", "predict_up_to_objective",
    "majority_vote", "leaf_usage", "correct_counts", "reliance_cdf", "requested_counts", "root_histogram_d3_requested",
    "predict_packed", "saved_trees_per_split", "lookahead_styles_d4", "budgets_greedy_d3", "histogram_style2_scattered",
    "histogram_depth5",
]


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    result = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, result.fetchall())


def test_styles_and_budgets_differ(duck):
    """The SQL of these would not match if styles or rounds of budgets were left out."""
    styles = dict(duck.execute(ORACLES["lookahead_styles_d4"]).fetchall())
    assert styles[0] < styles[1] == styles[2] < styles[3]
    found = duck.execute(ORACLES["budgets_greedy_d3"])
    names = [d[0] for d in found.description]
    budgets = [dict(zip(names, r)) for r in found.fetchall()]
    by = {
        a: {(r["itemset"], r["budget"], r["feature"], r["left_budget"], r["right_budget"]) for r in budgets if r["allocation"] == a}
        for a in ("multipass", "singlepass")
    }
    assert len(by["multipass"] - by["singlepass"]) > 100


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(CATALOGUE) == set(ORACLES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 3


def test_entry_without_the_text_operators(monkeypatch):
    """The rest works where their folder is deleted, whether or not the pipeline's file is there."""
    monkeypatch.setattr(entry, "find_spec", lambda module: None if module == "grovelight.llm" else find_spec(module))
    assert set(entry.queries()) == set(CATALOGUE) and set(entry.oracle_sql()) == set(ORACLES)
    monkeypatch.setattr(entry, "find_spec", lambda module: None)
    assert set(entry.queries()) == set(CATALOGUE) and set(entry.oracle_sql()) == set(ORACLES)
