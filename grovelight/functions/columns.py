"""SQL expressions shared by the operators.

A *literal* is the integer ``2 * feature + value`` (value 1 = feature is true =
left branch).  An *itemset* is a sorted array of literals: the conjunction of
conditions on the way from the root to a subproblem.

Expressions are SQL text: an operator is one statement, built and parsed once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

# Fixed value that decides results: entropy clamp.
ENTROPY_EPS = "1e-12D"

COUNT = "decimal(38,0)"
NO_LITERALS = "cast(array() AS array<int>)"


def sql(statement: str, **tables: DataFrame) -> DataFrame:
    """Run a statement over DataFrames named in it as ``{name}``."""
    spark = next(iter(tables.values())).sparkSession
    return spark.sql(statement, **tables)


def names(keys: Sequence[str], *columns: str, prefix: str = "") -> str:
    """Comma-separated column list."""
    return ", ".join(f"{prefix}{c}" for c in (*keys, *columns))


def quoted(name: str) -> str:
    """A column name as SQL text, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def child_itemset(itemset: str, feature: str, value: int) -> str:
    """Canonical key of one side of a split."""
    return f"array_sort(array_append({itemset}, cast({feature} * 2 + {value} AS int)))"


def leaf_objective(n: str, p: str, lam_n: int) -> str:
    return f"if({n} = 0, 0L, {lam_n}L + least({p}, {n} - {p}))"


def is_cheap(leaf: str, lam_n: int) -> str:
    """No split can beat this leaf: two leaves alone already cost as much."""
    return f"{leaf} <= {2 * lam_n}L"


def entropy(p: str) -> str:
    q = f"greatest({ENTROPY_EPS}, least(1D - {ENTROPY_EPS}, {p}))"
    return f"-({q} * log2({q}) + (1D - {q}) * log2(1D - {q}))"


def entropy_gain(n_l: str, p_l: str, n_r: str, p_r: str) -> str:
    n = f"({n_l} + {n_r})"
    return (
        f"({entropy(f'({p_l} + {p_r}) / {n}')} - (({n_l} / {n}) * {entropy(f'{p_l} / {n_l}')}"
        f" + ({n_r} / {n}) * {entropy(f'{p_r} / {n_r}')}))"
    )


def gain_rank(gain: str, feature: str) -> str:
    """Sorts by gain descending, then feature ascending.

    Gains are compared as they are: the expression is symmetric in the two sides,
    so twin features and complements have bit-equal gains and the lower one wins.
    """
    return f"struct(-({gain}), {feature})"


def loss_rank(loss: str, feature: str, n_features: int) -> str:
    """One BIGINT that sorts by loss ascending, then feature ascending."""
    return f"({loss} * {n_features}L + {feature})"


def objective_bound(best: str, mult: float, slack: float = 0.0) -> str:
    return f"cast(round({best} * {float(1.0 + mult)!r}D * {float(1.0 + slack)!r}D) AS bigint)"


def leaf_options(n: str, p: str, budget: str, lam_n: int, majority_only: bool) -> str:
    """Array of ``(prediction, loss)`` leaves that fit into the budget."""
    zero = f"struct(0 AS prediction, {p} + {lam_n}L AS loss)"
    one = f"struct(1 AS prediction, {n} - {p} + {lam_n}L AS loss)"
    options = f"array(if({n} - {p} <= {p}, {one}, {zero}))" if majority_only else f"array({zero}, {one})"
    return f"filter({options}, x -> x.loss <= {budget})"


# Stretches of values that a running sum is taken over in two steps.
STRETCHES = 1024


def running_sum(table: str, group: str, order: str, value: str, before_only: bool, kept: str) -> str:
    """Query text: ``kept`` columns of ``{table}`` and ``running``, the sum of ``value`` by
    ascending whole number ``order`` in each ``group``, without the row itself if ``before_only``.

    Sums of equal stretches of ``order`` come first, then running sums inside each,
    so no window holds a whole group.
    """
    own = "1 PRECEDING" if before_only else "CURRENT ROW"
    return f"""WITH span AS (
            SELECT {group}, min({order}) low, (max({order}) - min({order})) div {STRETCHES} + 1 width FROM {table} GROUP BY {group}),
        placed AS (SELECT *, ({order} - low) div width stretch FROM {table} JOIN span USING ({group})),
        earlier AS (SELECT {group}, stretch, sum(part) OVER (
                PARTITION BY {group} ORDER BY stretch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) before
            FROM (SELECT {group}, stretch, sum({value}) part FROM placed GROUP BY {group}, stretch))
        SELECT {kept}, coalesce(before, 0) + coalesce(sum({value}) OVER (
                PARTITION BY {group}, stretch ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND {own}), 0) running
        FROM placed JOIN earlier USING ({group}, stretch)"""


# Hash draws have 60 bits: 15 hex digits fit a BIGINT and reach any row count.
DRAW_DIGITS = 15
DRAW_BITS = 4 * DRAW_DIGITS


def hash_draw(*parts: str) -> str:
    """Uniform 60-bit draw from text parts; equal in every SQL engine with md5."""
    text = ", ".join(f"cast({p} AS string)" for p in parts)
    return f"cast(conv(substr(md5(concat_ws('|', {text})), 1, {DRAW_DIGITS}), 16, 10) AS bigint)"
