"""Materialising trees of the set by rank.

Rank order: objective ascending; at each node leaves before splits (prediction 0
before 1), splits by feature, then by left objective, then left rank before right
rank.  Ranks are 0-based.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..functions.columns import COUNT, NO_LITERALS, child_itemset, running_sum, sql
from .histogram import pair_children

CHUNK = 1 << 16


def objective_ranges(root_hist: DataFrame) -> DataFrame:
    """Rank range ``[first, first + cnt)`` per objective of the whole set.

    Sums run over distinct objectives, not over trees.
    """
    summed = running_sum("{hist}", "budget", "obj", "cnt", True, "budget, obj, cnt")
    return sql(summed, hist=root_hist).selectExpr("budget", "obj", "cnt", f"cast(running AS {COUNT}) AS first")


def ranks(
    ranges: DataFrame, start: int = 0, stop: int | None = None, max_obj: int | None = None, ids: Sequence[int] | None = None
) -> DataFrame:
    """``(tree_id, budget, obj, k)`` for tree ids in ``[start, stop)``, or for those listed in ``ids``.

    Ranks are compared as decimals; a set may hold more trees than a BIGINT counts,
    but ``tree_id`` is a BIGINT, so only the first 2^63 trees can be asked for.

    Ids are generated in chunks that are spread over the cluster before they are
    unrolled, so one objective with very many trees is not one task's work.
    """
    wanted = "true" if max_obj is None else f"obj <= {int(max_obj)}"
    if ids is not None:
        spark = ranges.sparkSession
        asked = spark.createDataFrame([(int(i),) for i in sorted(set(ids)) if i >= 0], "tree_id bigint")
        return sql(
            f"""SELECT tree_id, budget, obj, cast(tree_id - first AS {COUNT}) k
            FROM {{asked}} JOIN {{ranges}} ON tree_id >= first AND tree_id < first + cnt WHERE {wanted}""",
            ranges=ranges,
            asked=asked,
        )
    end = f"cast({(1 << 63) - 1 if stop is None else min(int(stop), (1 << 63) - 1)} AS {COUNT})"
    begin = f"cast({max(int(start), 0)} AS {COUNT})"
    return sql(
        f"""WITH bounds AS (
            SELECT budget, obj, first, cast(greatest(first, {begin}) AS bigint) lo, cast(least(first + cnt, {end}) AS bigint) hi
            FROM (SELECT * FROM {{ranges}} WHERE {wanted} AND first < {end} AND first + cnt > {begin})),
        chunks AS (
            SELECT /*+ REPARTITION(lo) */ * FROM (
                SELECT budget, obj, first, hi, explode(sequence(lo, hi - 1, {CHUNK}L)) lo FROM bounds WHERE lo < hi)),
        ids AS (
            SELECT budget, obj, first, explode(sequence(lo, least(hi, lo + {CHUNK}L) - 1)) tree_id FROM chunks)
        SELECT tree_id, budget, obj, cast(tree_id - first AS {COUNT}) k FROM ids""",
        ranges=ranges,
    )


def first_requests(ids: DataFrame) -> DataFrame:
    return ids.selectExpr(
        "tree_id",
        f"{NO_LITERALS} AS path",
        f"{NO_LITERALS} AS itemset",
        "budget",
        "obj",
        "k",
        "cast(NULL AS int) AS prediction",
    )


def node_entries(leaves: DataFrame, splits: DataFrame | None, child_hist: DataFrame | None) -> DataFrame:
    """Per node and objective, the ordered choices with their rank offsets."""
    rows = f"""SELECT itemset, budget, loss obj, prediction, -1 feature, cast(NULL AS bigint) obj_l,
            cast(NULL AS bigint) left_budget, cast(NULL AS bigint) right_budget,
            cast(1 AS {COUNT}) cnt_r, cast(1 AS {COUNT}) cnt
        FROM {{leaves}}"""
    tables = {"leaves": leaves}
    if splits is not None:
        tables |= {"splits": splits, "hist": child_hist}
        rows += f""" UNION ALL SELECT itemset, budget, obj_l + obj_r obj, cast(NULL AS int) prediction, feature, obj_l,
            left_budget, right_budget, cnt_r, cast(cnt_l * cnt_r AS {COUNT}) cnt FROM ({pair_children()})"""
    return sql(
        f"""SELECT *, cast(coalesce(sum(cnt) OVER (
                PARTITION BY itemset, budget, obj ORDER BY feature, prediction, obj_l
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS {COUNT}) first
        FROM ({rows})""",
        **tables,
    )


def descend(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """One level down: a request becomes a leaf or the requests of both sides.

    Requests that already are leaves (``prediction`` is set) pass through, so all
    levels are one chain of joins.  They keep their itemset as join key and find
    no partner, because entries of a level are longer.
    """

    def request(step: str, value: int, budget: str, obj: str, rank: str) -> str:
        return f"""struct(array_append(path, {step}) AS path, {child_itemset("itemset", "feature", value)} AS itemset,
            {budget} AS budget, {obj} AS obj, cast({rank} AS {COUNT}) AS k, cast(NULL AS int) AS prediction)"""

    left = request("feature + 1", 1, "left_budget", "obj_l", "(at - at % cnt_r) / cnt_r")
    right = request("-(feature + 1)", 0, "right_budget", "obj - obj_l", "at % cnt_r")
    same = "struct(path, itemset, budget, obj, k, coalesce(prediction, leaf) AS prediction)"
    return sql(
        f"""SELECT tree_id, inline(if(feature >= 0, array({left}, {right}), array({same}))) FROM (
            SELECT r.*, e.prediction leaf, e.feature, e.obj_l, e.left_budget, e.right_budget, e.cnt_r,
                cast(r.k - e.first AS {COUNT}) at
            FROM {{requests}} r LEFT JOIN {{entries}} e
            ON r.itemset = e.itemset AND r.budget = e.budget AND r.obj = e.obj
                AND r.k >= e.first AND r.k < e.first + e.cnt)""",
        requests=requests,
        entries=entries,
    )


def number_leaves(leaves: DataFrame) -> DataFrame:
    """Leaf number inside its tree, depth first, true side first.

    A tree has at most 2^depth leaves, which bounds the window partition.
    """
    return leaves.selectExpr(
        "tree_id",
        """cast(row_number() OVER (PARTITION BY tree_id ORDER BY transform(path, x -> if(x > 0, 0, 1))) - 1 AS int)
        AS leaf_no""",
        "path",
        "itemset",
        "prediction",
        "obj AS loss",
    )


def path_text(path: str) -> str:
    """``[+0, -1]``: 0-based features, the sign kept for feature 0."""
    step = f"transform({path}, x -> concat(if(x > 0, '+', '-'), cast(abs(x) - 1 AS string)))"
    return f"concat('[', array_join({step}, ', '), ']')"


def tree_nodes(leaves: DataFrame, feature_names: Sequence[str] | None = None) -> DataFrame:
    """Explicit nodes of trees given by their leaves.

    ``prefix`` is the path to the node; ``feature`` is NULL at leaves.
    """
    nodes = sql(
        """SELECT tree_id, prefix, max(depth) depth, max(feature) feature, max(prediction) prediction, count(*) leaves
        FROM (
            SELECT tree_id, slice(path, 1, depth) prefix, depth, abs(try_element_at(path, depth + 1)) - 1 feature,
                if(depth = size(path), prediction, NULL) prediction
            FROM (SELECT *, explode(sequence(0, size(path))) depth FROM {leaves}))
        GROUP BY tree_id, prefix""",
        leaves=leaves,
    )
    if feature_names is None:
        return nodes
    labels = ", ".join("'" + str(n).replace("'", "\\'") + "'" for n in feature_names)
    return nodes.selectExpr("*", f"try_element_at(array({labels}), feature + 1) AS name")
