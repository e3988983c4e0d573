"""Bottom-up folds over the set: how many trees have which objective.

A fold counts trees by objective and, if asked, by further integer measures that
add up over the leaves of a tree.  Trees are never enumerated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..functions.columns import COUNT, names, sql


# Stretches of left objectives into which the pairs of one split are dealt.
STRETCHES = 32


def pair_children(keys: Sequence[str] = (), measures: Sequence[str] = ()) -> str:
    """Query text over ``{splits}`` and ``{hist}``: all affordable combinations of
    a left and a right objective per split.

    Each side is cut first by what the other side costs at least.  The pairs of a
    split are then dealt by stretches of the left objective, and a right objective
    goes to those stretches it can be paid with, so no key holds all pairs of a
    split, however long its histograms are.
    """
    split = names(keys, "itemset", "budget", "feature")
    children = names((), "left_itemset", "left_budget", "right_itemset", "right_budget")

    def least(s: str) -> str:
        node = names(keys, f"itemset AS {s}_itemset", f"budget AS {s}_budget")
        return f"""(SELECT {node}, min(obj) least_{s[0]} FROM {{hist}} GROUP BY {names(keys, "itemset", "budget")})"""

    def side(s: str) -> str:
        carried = [f"obj AS obj_{s[0]}", f"cnt AS cnt_{s[0]}", *(f"{m} AS {m}_{s[0]}" for m in measures)]
        node = names(keys, f"itemset AS {s}_itemset", f"budget AS {s}_budget", *carried)
        return f"(SELECT {node} FROM {{hist}}) USING ({names(keys, f'{s}_itemset', f'{s}_budget')})"

    open_splits = f"""(SELECT *, (budget - least_r - least_l) div {STRETCHES} + 1 width
        FROM (SELECT {split}, {children} FROM {{splits}})
        JOIN {least("left")} USING ({names(keys, "left_itemset", "left_budget")})
        JOIN {least("right")} USING ({names(keys, "right_itemset", "right_budget")})
        WHERE least_l + least_r <= budget)"""
    left = f"""SELECT {split}, {children}, obj_l, cnt_l, {names([f"{m}_l" for m in measures], "(obj_l - least_l) div width stretch")}
        FROM {open_splits} JOIN {side("left")} WHERE obj_l + least_r <= budget"""
    right = f"""SELECT {split}, obj_r, cnt_r, {names([f"{m}_r" for m in measures],
        "explode(sequence(0L, (budget - obj_r - least_l) div width)) stretch")}
        FROM {open_splits} JOIN {side("right")} WHERE obj_r + least_l <= budget"""
    return f"SELECT * FROM ({left}) JOIN ({right}) USING ({split}, stretch) WHERE obj_l + obj_r <= budget"


def fold_level(
    leaves: DataFrame,
    splits: DataFrame | None,
    child_hist: DataFrame | None,
    keys: Sequence[str] = (),
    measures: Sequence[str] = (),
) -> DataFrame:
    """``(keys, itemset, budget, obj, measures) -> cnt`` of one level.

    ``leaves`` carries ``loss`` and one column per measure.
    """
    node = names(keys, "itemset", "budget")
    group = names(keys, "itemset", "budget", "obj", *measures)
    rows = f"SELECT {names(keys, 'itemset', 'budget', 'loss AS obj', *measures)}, cast(1 AS {COUNT}) cnt FROM {{leaves}}"
    tables = {"leaves": leaves}
    if splits is not None:
        tables |= {"splits": splits, "hist": child_hist}
        sums = ["obj_l + obj_r AS obj", *(f"{m}_l + {m}_r AS {m}" for m in measures)]
        rows += f""" UNION ALL SELECT {node}, {names((), *sums)}, cast(cnt_l * cnt_r AS {COUNT}) cnt
            FROM ({pair_children(keys, measures)})"""
    return sql(f"SELECT {group}, cast(sum(cnt) AS {COUNT}) cnt FROM ({rows}) GROUP BY {group}", **tables)


def split_counts(splits: DataFrame, child_hist: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Number of trees under every split (0 where no pair is affordable)."""
    split = names(keys, "itemset", "budget", "feature")
    return sql(
        f"""SELECT {split}, cast(coalesce(cnt, 0) AS {COUNT}) cnt
        FROM (SELECT {split} FROM {{splits}}) LEFT JOIN (
            SELECT {split}, sum(cnt_l * cnt_r) cnt FROM ({pair_children(keys)}) GROUP BY {split})
        USING ({split})""",
        splits=splits,
        hist=child_hist,
    )
