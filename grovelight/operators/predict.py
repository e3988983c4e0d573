"""Applying trees to rows.

Rows are reduced to their distinct feature patterns first; which leaves a pattern
falls into is worked out once per (pattern, leaf itemset) and shared by all trees.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..functions.columns import NO_LITERALS, names, sql
from ..sources.tables import bit, truth
from .histogram import pair_children
from .patterns import WORD_BITS, words


def tree_expression(df: DataFrame, features: Sequence[str], leaves: Sequence) -> str:
    """One tree as nested IFs: at most depth tests per row.

    ``leaves`` has at most 2^depth rows.  NULL in any feature raises an error, also
    in those that the row's branch does not test.
    """

    def node(below: Sequence, depth: int) -> str:
        if len(below) == 1 and len(below[0]["path"]) == depth:
            return str(below[0]["prediction"])
        feature = abs(below[0]["path"][depth]) - 1
        sides = [[leaf for leaf in below if (leaf["path"][depth] > 0) == side] for side in (True, False)]
        return f"if({bit(df, features[feature])} = 1, {node(sides[0], depth + 1)}, {node(sides[1], depth + 1)})"

    checks = " + ".join(truth(df, name) for name in features)
    return f"if({checks} >= 0, {node(list(leaves), 0)}, NULL)"


def itemset_edges(itemsets: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Prefix tree of itemsets: ``(prefix) -> next literal``; NULL ends one."""
    return sql(
        f"""SELECT DISTINCT {names(keys, "slice(itemset, 1, at) AS prefix")}, try_element_at(itemset, at + 1) literal
        FROM (SELECT *, explode(sequence(0, size(itemset))) at FROM {{itemsets}})""",
        itemsets=itemsets,
    )


def match_itemsets(
    patterns: DataFrame, itemsets: DataFrame, depth: int, n_features: int, keys: Sequence[str] = (), carried: Sequence[str] = ()
) -> DataFrame:
    """``(keys, words, carried, itemset)`` for every wanted itemset a pattern meets.

    Patterns walk down the prefix tree of the itemsets, so the work is in
    proportion to the matches, not to patterns times itemsets.  What has arrived
    passes through the further steps, so all steps are one chain of joins and the
    patterns are read once.  ``keys`` must agree on both sides; ``carried`` columns
    come from the patterns.
    """
    edges = itemset_edges(itemsets, keys)
    kept = names(keys, *words(n_features), *carried)
    word = f"element_at(array({names((), *words(n_features))}), cast(shiftright(literal, 1) div {WORD_BITS} AS int) + 1)"
    holds = f"(shiftright({word}, cast(shiftright(literal, 1) % {WORD_BITS} AS int)) & 1L) = (literal & 1)"
    state = f"SELECT {kept}, {NO_LITERALS} prefix, false there FROM {{patterns}}"
    met = " AND ".join([*(f"s.{k} = e.{k}" for k in keys), "s.prefix = e.at", "NOT s.there"])
    own = names((), *(f"s.{c}" for c in (*keys, *words(n_features), *carried)))
    edges = edges.withColumnRenamed("prefix", "at")
    for _ in range(depth + 1):
        state = f"""SELECT {kept}, if(there OR literal IS NULL, prefix, array_append(prefix, literal)) prefix,
                there OR literal IS NULL there
            FROM (SELECT {own}, s.prefix, s.there, e.at, e.literal FROM ({state}) s LEFT JOIN {{edges}} e ON {met})
            WHERE there OR (at IS NOT NULL AND (literal IS NULL OR {holds}))"""
    return sql(f"SELECT {kept}, prefix itemset FROM ({state}) WHERE there", patterns=patterns, edges=edges)


def itemset_weights(
    patterns: DataFrame, itemsets: DataFrame, depth: int, n_features: int, keys: Sequence[str] = (), extra: Sequence[str] = ()
) -> DataFrame:
    """Rows and positive rows of the wanted itemsets on any weighted patterns."""
    matched = match_itemsets(patterns, itemsets, depth, n_features, keys, [*extra, "n", "p"])
    group = names(keys, *extra, "itemset")
    return sql(f"SELECT {group}, sum(n) n, sum(p) p FROM {{matched}} GROUP BY {group}", matched=matched)


def pass_down(context: DataFrame, splits: DataFrame, child_hist: DataFrame) -> DataFrame:
    """Ways to complete a tree around a child node of a given objective.

    ``context`` holds ``(itemset, budget, obj) -> ways`` of one level; a side of a
    split gains the parent's ways times the number of trees on the other side.
    """
    return sql(
        f"""SELECT itemset, budget, obj, cast(sum(ways) AS decimal(38,0)) ways FROM (
            SELECT inline(array(
                struct(left_itemset AS itemset, left_budget AS budget, obj_l AS obj, ways * cnt_r AS ways),
                struct(right_itemset AS itemset, right_budget AS budget, obj_r AS obj, ways * cnt_l AS ways)))
            FROM (SELECT *, obj_l + obj_r obj FROM ({pair_children()})) JOIN {{context}} USING (itemset, budget, obj))
        GROUP BY itemset, budget, obj""",
        context=context,
        splits=splits,
        hist=child_hist,
    )


def used_leaves(context: DataFrame, leaves: DataFrame) -> DataFrame:
    """Number of trees in which a leaf occurs, per node it can occur at."""
    return sql(
        """SELECT itemset, prediction, ways FROM {context} c
        JOIN (SELECT itemset, budget, loss obj, prediction FROM {leaves}) USING (itemset, budget, obj)""",
        context=context,
        leaves=leaves,
    )


#: Rows of one block of packed predictions: what one bitmap of Spark's aggregates holds.
BLOCK_ROWS = 1 << 15


def leaf_bitmaps(rows: DataFrame, covered: DataFrame, n_features: int) -> DataFrame:
    """``(itemset, block, bits)``: which rows of a block meet an itemset; bit ``i`` of a
    bitmap is in byte ``i div 8``, lowest first.

    ``rows`` has ``(block, bit, words)``.  Partial bitmaps are made before the shuffle.
    """
    return sql(
        f"""SELECT itemset, block, bitmap_construct_agg(cast(bit AS bigint)) bits
        FROM {{rows}} JOIN {{covered}} USING ({names((), *words(n_features))}) GROUP BY itemset, block""",
        rows=rows,
        covered=covered,
    )


def tree_bitmaps(leaves: DataFrame, bitmaps: DataFrame, objs: DataFrame, blocks: int) -> DataFrame:
    """``(tree_id, obj, block, bits)``: rows that a tree predicts 1 for.

    A row is in one leaf of a tree, so a tree's bitmap is the union of those of its
    leaves that say 1, and a tree without such leaves has empty ones.
    """
    return sql(
        f"""SELECT tree_id, obj, block, bitmap_or_agg(bits) bits FROM (
            SELECT tree_id, block, bits FROM {{bitmaps}} JOIN (SELECT tree_id, itemset FROM {{leaves}} WHERE prediction = 1) USING (itemset)
            UNION ALL
            SELECT tree_id, explode(sequence(0L, {blocks - 1}L)) block, cast(NULL AS binary) bits FROM {{objs}})
        JOIN (SELECT tree_id, obj FROM {{objs}}) USING (tree_id)
        GROUP BY tree_id, obj, block""",
        bitmaps=bitmaps,
        leaves=leaves,
        objs=objs,
    )
