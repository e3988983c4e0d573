"""Row counts of conjunctions.

The data is passed once, over conjunctions of *rare* literals only: each feature
contributes the one value that fewer rows have.  All other sign combinations
follow by inclusion-exclusion from these counts, on a table whose size depends
on the number of features, not on the rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..functions.columns import NO_LITERALS, names, sql
from .patterns import held_literals, spread


def _grow(source: str, kept: str, chosen: str, may_pick: str, may_stop: str) -> str:
    """One step of subset growth: add a later element of ``rest``, or stop."""
    stop = f"if({may_stop}, array(cast(NULL AS int)), {NO_LITERALS})"
    return f"""SELECT {kept}, if(pick IS NULL, {chosen}, array_append({chosen}, pick)) {chosen},
        if(pick IS NULL, {NO_LITERALS}, slice(rest, at + 2, size(rest))) rest
        FROM (SELECT *, posexplode(concat(if({may_pick}, rest, {NO_LITERALS}), {stop})) AS (at, pick) FROM ({source}))"""


def rare_cube(patterns: DataFrame, rare: Sequence[int], depth: int, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, rare_set) -> (n, p)`` for all sets of at most ``depth`` rare literals.

    Subsets are generated per pattern and summed map-side, so the shuffle carries
    at most one row per set and task, whatever the number of patterns.
    """
    kept = names(keys, "n", "p")
    rows = f"SELECT {kept}, {NO_LITERALS} rare_set, {held_literals(rare)} rest FROM {{patterns}}"
    for _ in range(depth):
        rows = _grow(rows, kept, "rare_set", "true", "true")
    group = names(keys, "rare_set")
    return sql(f"SELECT {group}, sum(n) n, sum(p) p FROM ({rows}) GROUP BY {group}", patterns=patterns)


def signed_counts(
    cube: DataFrame, rare: Sequence[int], depth: int, keys: Sequence[str] = (), exact_size: bool = False
) -> DataFrame:
    """``(keys, itemset) -> (n, p)`` for every non-empty conjunction of at most
    (or, with ``exact_size``, exactly) ``depth`` literals of either sign.

    All sign patterns of one feature set come from its rare sub-sets: every rare
    set is sent to the feature sets around it, where ``held`` marks its features;
    a conjunction sums the sub-sets that hold at least its rare literals, with
    alternating signs.  A feature set has at most ``2^depth`` sub-sets.
    """
    universe = f"array({names((), *map(str, rare))})"
    kept = names(keys, "n", "p", "rare_set")
    rows = f"SELECT {kept}, {NO_LITERALS} extra, array_except({universe}, rare_set) rest FROM {{cube}}"
    room = f"size(rare_set) + size(extra) < {depth}"
    for _ in range(depth):
        rows = _grow(rows, kept, "extra", room, f"NOT ({room})" if exact_size else "true")

    def signed(column: str, wanted: int) -> str:
        sign = f"if(bit_count(held ^ {wanted}) % 2 = 0, {column}, -{column})"
        return f"sum(if(held & {wanted} = {wanted}, {sign}, 0L))"

    cells = ", ".join(
        f"struct({wanted} AS wanted, {signed('n', wanted)} AS n, {signed('p', wanted)} AS p)" for wanted in range(1 << depth)
    )
    group = names(keys, "features")
    return sql(
        f"""WITH around AS (
            SELECT {names(keys, "n", "p", "rare_set")}, transform(rare_set, x -> shiftright(x, 1)) held_features,
                array_sort(transform(concat(rare_set, extra), x -> shiftright(x, 1))) features FROM ({rows})),
        placed AS (
            SELECT /*+ REPARTITION({group}) */ {group}, n, p, aggregate(held_features, 0,
                (acc, f) -> acc | shiftleft(1, cast(array_position(features, f) - 1 AS int))) held FROM around),
        summed AS (SELECT {group}, inline(array({cells})) FROM placed GROUP BY {group})
        SELECT {names(keys)}{", " if keys else ""}transform(features, (f, i) ->
                element_at({universe}, f + 1) ^ (1 - (shiftright(wanted, i) & 1))) itemset, n, p
        FROM summed WHERE n > 0 AND wanted < shiftleft(1, size(features))""",
        cube=cube,
    )


def itemset_counts(
    patterns: DataFrame, rare: Sequence[int], depth: int, keys: Sequence[str] = (), exact_size: bool = False
) -> DataFrame:
    cube = rare_cube(patterns, rare, depth, keys)
    # each rare set is about to be sent to all feature sets around it
    cube = spread(cube, math.comb(len(rare), min(depth, len(rare))) * float(1 << depth))
    return signed_counts(cube, rare, depth, keys, exact_size)


def to_parents(children: str, keys: Sequence[str], *carried: str) -> str:
    """Query text: one row per (child, literal), giving the parent conjunction
    and the split that leads from it to the child."""
    return f"""SELECT {names(keys)}{", " if keys else ""}array_remove(itemset, literal) itemset,
        shiftright(literal, 1) feature, literal & 1 value, {names((), *carried)}
        FROM (SELECT *, explode(itemset) literal FROM {children})"""


def side_sums(**columns: str) -> str:
    """``<name>_l`` and ``<name>_r``: sums over the true and the false side."""
    return ", ".join(
        f"sum(if(value = {v}, {source}, 0L)) {name}_{s}" for s, v in (("l", 1), ("r", 0)) for name, source in columns.items()
    )


def split_contingency(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``(n_l, p_l, n_r, p_r)`` per parent conjunction and feature."""
    group = names(keys, "itemset", "feature")
    return sql(
        f"""SELECT {group}, {side_sums(n="n", p="p")} FROM ({to_parents("{counts}", keys, "n", "p")})
        GROUP BY {group}""",
        counts=counts,
    )


def valid_splits(contingency: DataFrame) -> DataFrame:
    """Drop splits that leave a side empty."""
    return contingency.where("n_l > 0 AND n_r > 0")
