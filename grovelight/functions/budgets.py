"""Budget arithmetic of a split, as SQL array expressions.

``m(b)``, the least objective reachable in a subproblem under budget ``b``, is a
non-increasing step function.  It is stored as ``array<struct<b, m>>`` sorted by
``b``; below the first ``b`` nothing is reachable.
"""

from __future__ import annotations

STEPS = "array<struct<b:bigint,m:bigint>>"


def single_step(value: str) -> str:
    return f"array(struct({value} AS b, {value} AS m))"


def reach(steps: str, budget: str) -> str:
    """``m(budget)``; NULL where the budget reaches nothing."""
    return f"array_min(transform(filter({steps}, s -> s.b <= {budget}), s -> s.m))"


def settle(budget: str, v_r: str, left: str, right: str) -> str:
    """Alternate the two sides until neither can hand budget to the other.

    The left side starts with what the right side's estimate leaves over; then
    each side gets what the other's found minimum leaves over.  Returns
    ``struct<bl, ml, br, mr>``; ``ml``/``mr`` are NULL where a side is empty.
    """

    def state(bl: str, ml: str, br: str) -> str:
        return (
            f"struct(cast({bl} AS bigint) AS bl, {ml} AS ml, cast({br} AS bigint) AS br, {reach(right, br)} AS mr)"
        )

    start = f"({budget} - {v_r})"
    ml = reach(left, start)
    bl_next = f"greatest(acc.bl, {budget} - acc.mr)"
    ml_next = reach(left, bl_next)
    advance = state(bl_next, ml_next, f"greatest(acc.br, {budget} - {ml_next})")
    # every useful round crosses at least one step of either side
    rounds = f"sequence(0, size({left}) + size({right}))"
    return f"aggregate({rounds}, {state(start, ml, f'({budget} - {ml})')}, (acc, i) -> {advance})"


def turning_points(v_l: str, v_r: str, left: str, right: str) -> str:
    """Budgets of the parent at which the settled minimum of a split can change."""
    points = f"""flatten(array(
        array({v_l} + {v_r}),
        transform({left}, x -> x.b + {v_r}),
        flatten(transform({left}, x -> transform({right}, y -> x.b + y.m))),
        flatten(transform({right}, y -> transform({left}, x -> y.b + x.m)))))"""
    return f"filter(array_distinct({points}), q -> q >= {v_l} + {v_r})"


def split_steps(v_l: str, v_r: str, left: str, right: str) -> str:
    """Unmerged ``(b, m)`` points of one split."""
    end = settle("t", v_r, left, right)
    points = f"""transform(
        transform({turning_points(v_l, v_r, left, right)}, t -> struct(t AS b, {end} AS e)),
        z -> struct(z.b AS b, z.e.ml + z.e.mr AS m))"""
    return f"filter({points}, w -> w.m IS NOT NULL)"


def lower_envelope(points: str) -> str:
    """Sort points by budget and keep those that lower the minimum."""
    return f"""aggregate(array_sort({points}), cast(array() AS {STEPS}), (acc, x) ->
        if(size(acc) = 0 OR x.m < try_element_at(acc, -1).m, array_append(acc, x), acc))"""
