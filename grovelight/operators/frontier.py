"""Frontier scores: what the best continuation of a partly built tree would cost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..functions.columns import names, sql


def members(nodes: DataFrame, depth: int, keys: Sequence[str] = ()) -> DataFrame:
    """``(tree_id, node_no, depth, itemset)``: the frontier of every internal node, in preorder.

    The frontier of a node is both its children and the siblings along its path;
    nodes deeper than ``depth`` are left out.
    """
    code = "cast(2 * (abs(s) - 1) + if(s > 0, 1, 0) AS int)"
    tree = names(keys, "tree_id")
    return sql(
        f"""WITH internal AS (
            SELECT {tree}, prefix, depth, feature,
                cast(row_number() OVER (
                    PARTITION BY {tree} ORDER BY transform(prefix, x -> if(x > 0, 0, 1))) - 1 AS int) node_no
            FROM {{nodes}} WHERE feature IS NOT NULL AND depth <= {depth}),
        member AS (
            SELECT {tree}, node_no, depth, explode(concat(
                transform(prefix, (x, i) -> array_append(slice(prefix, 1, i), -x)),
                array(array_append(prefix, feature + 1), array_append(prefix, -(feature + 1))))) path
            FROM internal)
        SELECT {tree}, node_no, depth, array_sort(transform(path, s -> {code})) itemset FROM member""",
        nodes=nodes,
    )


def frontier_scores(nodes: DataFrame, estimates: DataFrame, depth: int, keys: Sequence[str] = ()) -> DataFrame:
    """``(tree_id, node_no, depth, score)`` of internal nodes, in preorder.

    Every member of a node's frontier has ``depth - size`` levels left and members below
    zero count nothing.  ``estimates`` maps itemsets to the lookahead-1 estimate.
    """
    tree = names(keys, "tree_id")
    return sql(
        f"""SELECT {tree}, node_no, depth, cast(coalesce(sum(v1), 0) AS bigint) score
        FROM {{keyed}} LEFT JOIN {{estimates}} USING ({names(keys, "itemset")})
        GROUP BY {tree}, node_no, depth""",
        keyed=members(nodes, depth, keys),
        estimates=estimates,
    )
