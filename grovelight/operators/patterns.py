"""Pattern compaction: rows with equal features become one weighted row.

Only row counts matter to the search, so this is exact.  Features are packed
into BIGINT words first: the shuffle key is 8 bytes per 62 features.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..functions.columns import names, quoted, sql
from ..sources.tables import truth

WORD_BITS = 62


def words(n_features: int) -> list[str]:
    return [f"w{i}" for i in range((n_features + WORD_BITS - 1) // WORD_BITS)]


def pack(bits: Sequence[str]) -> list[str]:
    """0/1 expressions, in feature order, as BIGINT word columns."""
    packed = []
    for i, name in enumerate(words(len(bits))):
        chunk = bits[i * WORD_BITS : (i + 1) * WORD_BITS]
        packed.append(" | ".join(f"shiftleft(cast({b} AS bigint), {j})" for j, b in enumerate(chunk)) + f" AS {name}")
    return packed


def bit(feature: int, prefix: str = "") -> str:
    """Value of one feature of a packed row."""
    return f"(shiftright({prefix}w{feature // WORD_BITS}, {feature % WORD_BITS}) & 1L)"


def held_literals(literals: Sequence[int]) -> str:
    """Those of the given literals that a packed row satisfies, in given order."""
    options = ", ".join(f"if({bit(lit // 2)} = {lit % 2}, {lit}, NULL)" for lit in literals)
    return f"array_compact(array({options}))"


def packed_rows(df: DataFrame, features: Sequence[str], label: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    columns = [*map(quoted, keep), *pack([truth(df, c) for c in features])]
    if label is not None:
        columns.append(f"cast({truth(df, label)} AS bigint) AS y")
    return df.selectExpr(*columns)


def compact(rows: DataFrame, n_features: int, keys: Sequence[str] = (), weight: str = "1L") -> DataFrame:
    """``(keys, words) -> (n, p)``; one shuffle with map-side combine."""
    group = names(keys, *words(n_features))
    return sql(f"SELECT {group}, sum({weight}) n, sum({weight} * y) p FROM {{rows}} GROUP BY {group}", rows=rows)


@dataclass(frozen=True)
class Totals:
    """Sizes of a pattern table: a handful of numbers, whatever its length."""

    patterns: int
    rows: int
    ones: list[int]  # rows in which each feature is true

    @property
    def rare(self) -> list[int]:
        """For each feature the literal that fewer rows satisfy."""
        return [2 * f + (1 if 2 * count <= self.rows else 0) for f, count in enumerate(self.ones)]

    def subsets(self, depth: int) -> float:
        """Estimated number of rare-literal sets over all patterns."""
        held = sum(min(count, self.rows - count) for count in self.ones) / max(self.rows, 1)
        k = math.ceil(held)
        return self.patterns * float(sum(math.comb(k, s) for s in range(min(depth, k) + 1)))


def pattern_totals(patterns: DataFrame, n_features: int) -> Totals:
    held = held_literals([2 * f + 1 for f in range(n_features)])
    rows = sql(
        f"""SELECT slot, count(*) patterns, sum(n) n
        FROM (SELECT n, explode(array_append({held}, -1)) slot FROM {{patterns}}) GROUP BY slot""",
        patterns=patterns,
    ).collect()
    slots = {row["slot"]: row for row in rows}
    if -1 not in slots:
        return Totals(0, 0, [0] * n_features)
    counts = {slot: int(row["n"]) for slot, row in slots.items()}
    return Totals(slots[-1]["patterns"], counts[-1], [counts.get(2 * f + 1, 0) for f in range(n_features)])


SPREAD_ROWS = 100_000


def spread(patterns: DataFrame, work: float) -> DataFrame:
    """Spread a compact table over more tasks if each of its rows is about to
    become very many; small work stays where it is."""
    tasks = math.ceil(work / SPREAD_ROWS)
    return patterns.repartition(tasks) if tasks > 1 else patterns
