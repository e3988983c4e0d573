"""The near-optimal set as tables of subproblems and admitted splits.

A node is ``(itemset, budget)``.  ``frontier`` tables hold the nodes of a level,
``split`` tables the admitted splits with the budgets handed to both sides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..functions.budgets import lower_envelope, settle, single_step, split_steps
from ..functions.columns import child_itemset, leaf_options, names, sql

MULTIPASS, SINGLEPASS, RULE_LIST = "multipass", "singlepass", "rule_list"

SIDES = f"""{child_itemset("itemset", "feature", 1)} left_itemset,
    {child_itemset("itemset", "feature", 0)} right_itemset"""


def _with_child_steps(splits: str, has_steps: bool, keys: Sequence[str]) -> str:
    """Query text: attach the step function of both sides.  Most sides have the
    single step given by their estimate and are not stored."""
    left, right = single_step("v_l"), single_step("v_r")
    if not has_steps:
        return f"SELECT *, {left} left_steps, {right} right_steps FROM ({splits})"

    def stored(side: str, alias: str) -> str:
        same = [f"c.{k} = {alias}.{k}" for k in keys]
        return f"LEFT JOIN {{steps}} AS {alias} ON " + " AND ".join([*same, f"c.{side}_itemset = {alias}.itemset"])

    return f"""SELECT c.*, coalesce(ls.steps, {left}) left_steps, coalesce(rs.steps, {right}) right_steps
        FROM ({splits}) c {stored("left", "ls")} {stored("right", "rs")}"""


def min_steps(
    splits: DataFrame, estimates: DataFrame, child_steps: DataFrame | None, own_value: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Least reachable objective per budget, where it is not the trivial step.

    ``own_value`` is the estimate a parent holds for these itemsets.  A group
    gathers a few points per feature.
    """
    node = names(keys, "itemset")
    rows = f"SELECT {node}, v_l, v_r, {SIDES} FROM {{splits}} WHERE n_l > 0 AND n_r > 0"
    joined = _with_child_steps(rows, child_steps is not None, keys)
    tables = {"splits": splits, "estimates": estimates} | ({} if child_steps is None else {"steps": child_steps})
    leaf = "struct(leaf AS b, leaf AS m)"
    return sql(
        f"""WITH points AS (
            SELECT {node}, flatten(collect_list({split_steps("v_l", "v_r", "left_steps", "right_steps")})) points
            FROM ({joined}) GROUP BY {node})
        SELECT {node}, steps FROM (
            SELECT {node}, {single_step(own_value)} own,
                {lower_envelope(f"array_append(points, {leaf})")} steps
            FROM {{estimates}} JOIN points USING ({node}))
        WHERE steps <> own""",
        **tables,
    )


def expand(
    frontier: DataFrame,
    splits: DataFrame,
    lam_n: int,
    allocation: str,
    child_steps: DataFrame | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Admitted splits of a frontier with the budgets of both sides."""
    node = names(keys, "itemset")
    if allocation == RULE_LIST:
        admitted = f"v_l <= budget - {lam_n}L OR v_r <= budget - {lam_n}L"
    else:
        admitted = "v_l + v_r <= budget"
    # two leaves must be affordable; nodes that can only be leaves never join
    rows = f"""SELECT *, {SIDES} FROM (
            SELECT {node}, budget, feature, n_l, p_l, v_l, n_r, p_r, v_r
            FROM (SELECT {node}, budget FROM {{frontier}} WHERE budget >= {max(2 * lam_n, 0)}L)
            JOIN {{splits}} USING ({node}) WHERE n_l > 0 AND n_r > 0 AND ({admitted}))"""
    tables = {"frontier": frontier, "splits": splits}
    if allocation == MULTIPASS and child_steps is not None:
        tables["steps"] = child_steps
        rows = _with_child_steps(rows, True, keys)
        end = settle("budget", "v_r", "left_steps", "right_steps")
        rows = f"SELECT *, end.bl left_budget, end.br right_budget FROM (SELECT *, {end} end FROM ({rows}))"
    else:
        rows = f"SELECT *, budget - v_r left_budget, budget - v_l right_budget FROM ({rows})"
    return sql(
        f"""SELECT {node}, budget, feature, left_itemset, left_budget, n_l, p_l, right_itemset, right_budget, n_r, p_r
        FROM ({rows}) WHERE left_budget >= 0 AND right_budget >= 0""",
        **tables,
    )


def next_frontier(splits: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct child nodes of admitted splits."""
    node = names(keys, "itemset", "budget")
    return sql(
        f"""SELECT {node}, max(n) n, max(p) p FROM (
            SELECT {names(keys)}{", " if keys else ""}inline(array(
                struct(left_itemset AS itemset, left_budget AS budget, n_l AS n, p_l AS p),
                struct(right_itemset AS itemset, right_budget AS budget, n_r AS n, p_r AS p)))
            FROM {{splits}})
        GROUP BY {node}""",
        splits=splits,
    )


def admitted_leaves(frontier: DataFrame, lam_n: int, majority_only: bool, keys: Sequence[str] = ()) -> DataFrame:
    options = leaf_options("n", "p", "budget", lam_n, majority_only)
    return frontier.selectExpr(*keys, "itemset", "budget", f"inline({options})")
