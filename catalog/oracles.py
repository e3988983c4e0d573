"""DuckDB side of the catalogue: brute force over the same tables.

With depth at most lookahead + 1 every estimate the search prunes with is an exact
optimum, so the set is *every* tree within the bound and brute force is a full
check.  (Depth 3 with lookahead 1 prunes exactly too; only its bound comes from
the lookahead tree, which has its own statement.)
"""

from __future__ import annotations

from .views import BINS, DUCK, FEATURES

# Fixed value: the entropy clamp of the result's definition.
EPS = "1e-12::double"


def items(*pairs: str) -> str:
    """Text key of a conjunction given as ``feature value`` column pairs."""
    codes = [f"2 * {p.split()[0]} + {p.split()[1]}" for p in pairs]
    return f"array_to_string(list_sort([{', '.join(codes)}]), ',')"


def ctes(view: str, lam: float, depth: int, source: str | None = None) -> str:
    """Counts of all conjunctions up to ``depth`` literals; ``b`` numbers
    independent data sets (0 where there is only one)."""
    fl = ", ".join(f"f{i}" for i in range(FEATURES[view]))
    x = source or f"x AS (SELECT 0 b, {fl}, y FROM ({DUCK[view]}) v)"
    out = f"""WITH {x},
    pat AS (SELECT row_number() OVER () pid, * FROM (SELECT b, {fl}, count(*) n, sum(y) p FROM x GROUP BY b, {fl})),
    lng AS (SELECT b, pid, n, p, cast(substr(name, 2) AS int) f, v FROM (UNPIVOT pat ON {fl} INTO NAME name VALUE v)),
    s0 AS (SELECT b, cast(sum(n) AS bigint) n, cast(sum(p) AS bigint) p FROM pat GROUP BY b),
    lam AS (SELECT DISTINCT cast(round({lam}::double * n) AS bigint) k FROM s0),
    s1 AS (SELECT b, f, v, cast(sum(n) AS bigint) n, cast(sum(p) AS bigint) p FROM lng GROUP BY b, f, v)"""
    if depth >= 2:
        out += """,
    s2 AS (SELECT l.b, l.f, l.v, r.f g, r.v w, cast(sum(l.n) AS bigint) n, cast(sum(l.p) AS bigint) p
        FROM lng l JOIN lng r ON l.pid = r.pid AND l.f <> r.f GROUP BY ALL)"""
    if depth >= 3:
        out += """,
    s3 AS (SELECT l.b, l.f, l.v, m.f g, m.v w, r.f h, r.v u, cast(sum(l.n) AS bigint) n, cast(sum(l.p) AS bigint) p
        FROM lng l JOIN lng m ON l.pid = m.pid AND l.f <> m.f
        JOIN lng r ON l.pid = r.pid AND r.f <> l.f AND r.f <> m.f GROUP BY ALL)"""
    return out


def leaf(n: str = "n", p: str = "p", k: str = "k") -> str:
    return f"({k} + least({p}, {n} - {p}))"


def exact(depth: int, searched: int = 99) -> str:
    """``x1`` per one-literal (and two-literal) conjunction, ``x2``, ``x3``."""
    out = f"""
    l0 AS (SELECT b, {leaf()} c FROM s0, lam),
    l1 AS (SELECT b, f, v, {leaf()} c FROM s1, lam),
    x1root AS (SELECT l0.b, least(min(l0.c), min(a.c + z.c)) c
        FROM l0 LEFT JOIN l1 a ON a.v = 1 AND a.b = l0.b AND a.f < {searched}
        LEFT JOIN l1 z ON z.v = 0 AND z.b = a.b AND z.f = a.f GROUP BY l0.b)"""
    if depth >= 2:
        out += f""",
    l2 AS (SELECT b, f, v, g, w, {leaf()} c FROM s2, lam),
    x1 AS (SELECT l1.b, l1.f, l1.v, least(min(l1.c), min(a.c + z.c)) c
        FROM l1 LEFT JOIN l2 a ON a.b = l1.b AND a.f = l1.f AND a.v = l1.v AND a.w = 1 AND a.g < {searched}
        LEFT JOIN l2 z ON z.b = a.b AND z.f = a.f AND z.v = a.v AND z.g = a.g AND z.w = 0 GROUP BY ALL),
    x2root AS (SELECT l0.b, least(min(l0.c), min(a.c + z.c)) c
        FROM l0 LEFT JOIN x1 a ON a.v = 1 AND a.b = l0.b AND a.f < {searched}
        LEFT JOIN x1 z ON z.v = 0 AND z.b = a.b AND z.f = a.f GROUP BY l0.b)"""
    if depth >= 3:
        out += f""",
    l3 AS (SELECT b, f, v, g, w, h, u, {leaf()} c FROM s3, lam),
    x1two AS (SELECT l2.b, l2.f, l2.v, l2.g, l2.w, least(min(l2.c), min(a.c + z.c)) c
        FROM l2 LEFT JOIN l3 a ON a.b = l2.b AND a.f = l2.f AND a.v = l2.v AND a.g = l2.g AND a.w = l2.w
            AND a.u = 1 AND a.h < {searched}
        LEFT JOIN l3 z ON z.b = a.b AND z.f = a.f AND z.v = a.v AND z.g = a.g AND z.w = a.w AND z.h = a.h AND z.u = 0
        GROUP BY ALL),
    x2 AS (SELECT l1.b, l1.f, l1.v, least(min(l1.c), min(a.c + z.c)) c
        FROM l1 LEFT JOIN x1two a ON a.b = l1.b AND a.f = l1.f AND a.v = l1.v AND a.w = 1 AND a.g < {searched}
        LEFT JOIN x1two z ON z.b = a.b AND z.f = a.f AND z.v = a.v AND z.g = a.g AND z.w = 0 GROUP BY ALL),
    x3root AS (SELECT l0.b, least(min(l0.c), min(a.c + z.c)) c
        FROM l0 LEFT JOIN x2 a ON a.v = 1 AND a.b = l0.b AND a.f < {searched}
        LEFT JOIN x2 z ON z.v = 0 AND z.b = a.b AND z.f = a.f GROUP BY l0.b)"""
    return out


def entropy(p: str) -> str:
    q = f"greatest({EPS}, least(1 - {EPS}, {p}))"
    return f"(-({q} * log2({q}) + (1 - {q}) * log2(1 - {q})))"


def gain(n_l: str, p_l: str, n_r: str, p_r: str) -> str:
    n = f"({n_l} + {n_r})"
    return (
        f"({entropy(f'({p_l} + {p_r}) / {n}')} - ({n_l} / {n} * {entropy(f'{p_l} / {n_l}')}"
        f" + {n_r} / {n} * {entropy(f'{p_r} / {n_r}')}))"
    )


# splits of the whole problem and of one-literal conjunctions, both sides present
SCORES = f"""
    parts AS (
        SELECT '' itemset, a.f feature, a.n n_l, a.p p_l, z.n n_r, z.p p_r
        FROM s1 a JOIN s1 z ON a.f = z.f AND a.v = 1 AND z.v = 0
        UNION ALL
        SELECT {items("a.f a.v")}, a.g, a.n, a.p, z.n, z.p
        FROM s2 a JOIN s2 z ON a.f = z.f AND a.v = z.v AND a.g = z.g AND a.w = 1 AND z.w = 0),
    scores AS (SELECT itemset, feature, {gain("n_l", "p_l", "n_r", "p_r")} gain,
        {leaf("n_l", "p_l")} + {leaf("n_r", "p_r")} loss FROM parts, lam)"""


def best(order: str, where: str = "true") -> str:
    return f"""{ctes("ord_score", 0.01, 2)}, {SCORES}
    SELECT itemset, feature FROM (
        SELECT *, row_number() OVER (PARTITION BY itemset ORDER BY {order}, feature) r FROM scores WHERE {where})
    WHERE r = 1"""


def greedy(mode: int) -> str:
    """Greedy trees of depth 3, 2 (children) and 1 (grandchildren); the depth-1
    tree is the exact one unless the mode is purely entropy-driven."""
    order = "loss" if mode == 2 else "round(-gain, 12)"
    split = f"{{n}} AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY {{by}} ORDER BY {order}, {{f}}) r FROM {{t}}) WHERE r = 1)"

    def pairs(name: str, table: str, by: list[str], f: str, side: str) -> str:
        same = " AND ".join(f"a.{c} = z.{c}" for c in [*by, f])
        cols = ", ".join(f"a.{c}" for c in [*by, f])
        return f"""{name} AS (SELECT {cols}, {gain("a.n", "a.p", "z.n", "z.p")} gain,
            {leaf("a.n", "a.p")} + {leaf("z.n", "z.p")} loss
            FROM {table} a JOIN {table} z ON {same} AND a.{side} = 1 AND z.{side} = 0, lam)"""

    def value(name: str, leaves: str, by: list[str], chosen: str, f: str, child: str, side: str) -> str:
        keys = ", ".join(f"l.{c}" for c in by)
        on = " AND ".join(f"l.{c} = q.{c}" for c in by)
        kid = lambda t, v: " AND ".join([*(f"{t}.{c} = q.{c}" for c in [*by, f]), f"{t}.{side} = {v}"])
        return f"""{name} AS (SELECT {keys}, CASE WHEN l.c <= 2 * k OR q.{f} IS NULL THEN l.c
            ELSE least(l.c, a.c + z.c) END c
            FROM {leaves} l LEFT JOIN {chosen} q ON {on} LEFT JOIN {child} a ON {kid("a", 1)}
            LEFT JOIN {child} z ON {kid("z", 0)}, lam)"""

    two, one = ["b", "f", "v", "g", "w"], ["b", "f", "v"]
    out = [
        pairs("d0", "s1", ["b"], "f", "v"),
        split.format(n="q0", by="b", f="f", t="d0"),
        pairs("d1", "s2", one, "g", "w"),
        split.format(n="q1", by="b, f, v", f="g", t="d1"),
    ]
    if mode == 0:
        out += [
            pairs("d2", "s3", two, "h", "u"),
            split.format(n="q2", by="b, f, v, g, w", f="h", t="d2"),
            value("g1", "l2", two, "q2", "h", "l3", "u"),
        ]
    else:
        out.append("g1 AS (SELECT * FROM x1two)")
    out += [value("g2", "l1", one, "q1", "g", "g1", "w"), value("g3", "l0", ["b"], "q0", "f", "g2", "v")]
    return ", ".join(out)


def greedy_objectives(view: str, lam: float) -> str:
    return " UNION ALL ".join(
        f"SELECT * FROM ({ctes(view, lam, 3)}, {exact(3)}, {greedy(mode)} SELECT {mode} AS mode, c obj FROM g3)"
        for mode in (0, 1, 2)
    )


# root choice by greedy children, then both children exactly (depth 2)
LOOKAHEAD = """
    la_split AS (SELECT b, f FROM (
        SELECT a.b, a.f, row_number() OVER (PARTITION BY a.b ORDER BY a.c + z.c, a.f) r
        FROM g2 a JOIN g2 z ON a.b = z.b AND a.f = z.f AND a.v = 1 AND z.v = 0) WHERE r = 1),
    la AS (SELECT l0.b, CASE WHEN l0.c <= 2 * k OR q.f IS NULL THEN l0.c ELSE least(l0.c, a.c + z.c) END c
        FROM l0 LEFT JOIN la_split q ON q.b = l0.b LEFT JOIN x2 a ON a.b = q.b AND a.f = q.f AND a.v = 1
        LEFT JOIN x2 z ON z.b = q.b AND z.f = q.f AND z.v = 0, lam)"""


def lookahead(view: str, lam: float) -> str:
    return f"{ctes(view, lam, 3)}, {exact(3)}, {greedy(1)}, {LOOKAHEAD}"


def options(majority: bool = False) -> str:
    """All depth-1 trees of every one-literal conjunction and all depth-2 trees.

    ``opt1`` numbers a side's trees of equal objective in rank order.
    """
    both = "lab AS (SELECT unnest([0, 1]) l)"
    keep = "CASE WHEN {t}.n - {t}.p <= {t}.p THEN 1 ELSE 0 END = {l}" if majority else "true"
    k1, k2a, k2z = keep.format(t="s1", l="l"), keep.format(t="a", l="ll"), keep.format(t="z", l="rl")
    return f"""{both},
    opt1 AS (SELECT *, row_number() OVER (PARTITION BY b, f, v, obj ORDER BY g, obj_l, ll, rl) idx FROM (
        SELECT b, f, v, -1 g, 0 obj_l, l ll, 0 rl, k + CASE l WHEN 0 THEN p ELSE n - p END obj, 0 obj_r
        FROM s1, lab, lam WHERE {k1}
        UNION ALL
        SELECT b, f, v, g, ol, ll, rl, ol + orr, orr FROM (
            SELECT a.b, a.f, a.v, a.g, xl.l ll, xr.l rl,
                k + CASE xl.l WHEN 0 THEN a.p ELSE a.n - a.p END ol, k + CASE xr.l WHEN 0 THEN z.p ELSE z.n - z.p END orr,
                a.n an, a.p ap, z.n zn, z.p zp
            FROM s2 a JOIN s2 z ON a.b = z.b AND a.f = z.f AND a.v = z.v AND a.g = z.g AND a.w = 1 AND z.w = 0,
                lab xl, lab xr, lam)
        WHERE {k2a.replace("a.n", "an").replace("a.p", "ap")} AND {k2z.replace("z.n", "zn").replace("z.p", "zp")})),
    root_leaf AS (SELECT b, l, k + CASE l WHEN 0 THEN p ELSE n - p END obj FROM s0, lab, lam
        WHERE {keep.format(t="s0", l="l")})"""


def small_set(view: str = "ord_score", lam: float = 0.01, mult: float = 0.15, bound: str | None = None,
              majority: bool = False, source: str | None = None, pairs: str = "true") -> str:
    """All depth-2 trees within the bound, numbered in rank order."""
    limit = bound or f"cast(round(c * (1 + {mult}::double)) AS bigint)"
    return f"""{ctes(view, lam, 2, source)}, {exact(2)}, {options(majority)},
    bd AS (SELECT b, {limit} bound FROM x2root),
    allt AS (
        SELECT b, -1 f, 0 obj_l, l li, 0 ri, obj FROM root_leaf
        UNION ALL
        SELECT a.b, a.f, a.obj, a.idx, z.idx, a.obj + z.obj
        FROM opt1 a JOIN opt1 z ON a.b = z.b AND a.f = z.f AND a.v = 1 AND z.v = 0 JOIN bd ON bd.b = a.b
        WHERE a.obj + z.obj <= bound AND {pairs}),
    tree AS (SELECT allt.*, row_number() OVER (PARTITION BY allt.b ORDER BY obj, f, obj_l, li, ri) - 1 tree_id
        FROM allt JOIN bd USING (b) WHERE obj <= bound)"""


HISTOGRAM = " SELECT obj, count(*) cnt FROM tree GROUP BY obj"

# leaves of every tree: path as signed 1-based features, conjunction key, loss
LEAVES = f""",
    side AS (
        SELECT b, tree_id, f, 1 v, obj_l obj, li idx FROM tree WHERE f >= 0
        UNION ALL SELECT b, tree_id, f, 0, obj - obj_l, ri FROM tree WHERE f >= 0),
    tleaf0 AS (
        SELECT b, tree_id, 0 turn1, 0 turn2, '' path, '[]' path_text, '' itemset, li prediction, obj loss
        FROM tree WHERE f < 0
        UNION ALL
        SELECT s.b, s.tree_id, 1 - s.v, 0, CASE s.v WHEN 1 THEN '' ELSE '-' END || (s.f + 1),
            '[' || CASE s.v WHEN 1 THEN '+' ELSE '-' END || s.f || ']', {items("s.f s.v")}, o.ll, o.obj
        FROM side s JOIN opt1 o USING (b, f, v, obj, idx) WHERE o.g < 0
        UNION ALL
        SELECT s.b, s.tree_id, 1 - s.v, 1 - w,
            CASE s.v WHEN 1 THEN '' ELSE '-' END || (s.f + 1) || ',' || CASE w WHEN 1 THEN '' ELSE '-' END || (o.g + 1),
            '[' || CASE s.v WHEN 1 THEN '+' ELSE '-' END || s.f || ', ' || CASE w WHEN 1 THEN '+' ELSE '-' END || o.g || ']',
            {items("s.f s.v", "o.g w")}, CASE w WHEN 1 THEN o.ll ELSE o.rl END, CASE w WHEN 1 THEN o.obj_l ELSE o.obj_r END
        FROM side s JOIN opt1 o USING (b, f, v, obj, idx), (SELECT unnest([0, 1]) w) WHERE o.g >= 0),
    tleaf AS (SELECT *, row_number() OVER (PARTITION BY b, tree_id ORDER BY turn1, turn2) - 1 leaf_no FROM tleaf0)"""

FL = ", ".join(f"f{i}" for i in range(9))
# which leaf conjunctions a row meets
COVER = f""",
    xrow AS (SELECT row_id, cast(substr(name, 2) AS int) f, v FROM (
        UNPIVOT (SELECT row_id, {FL} FROM ({DUCK["ord_score"]}) v) ON {FL} INTO NAME name VALUE v)),
    cover AS (
        SELECT DISTINCT row_id, '' itemset FROM xrow
        UNION ALL SELECT row_id, {items("f v")} FROM xrow
        UNION ALL SELECT a.row_id, {items("a.f a.v", "z.f z.v")} FROM xrow a JOIN xrow z ON a.row_id = z.row_id AND a.f < z.f),
    predicted AS (SELECT tree_id, row_id, prediction FROM tleaf JOIN cover USING (itemset))"""

SMALL = small_set()
SMALL_LEAVES = SMALL + LEAVES


def depth3_histogram(reference: str) -> str:
    """All depth-3 trees within a bound of a reference objective ``ref(b, c)``."""
    return f"""{lookahead("ord_score", 0.01)}, {reference},
    bd AS (SELECT b, cast(round(c * (1 + 0.15::double)) AS bigint) bound FROM ref),
    lab AS (SELECT unnest([0, 1]) l),
    h2 AS (SELECT b, f, v, g, w, obj, sum(cnt) cnt FROM (
        SELECT b, f, v, g, w, k + CASE l WHEN 0 THEN p ELSE n - p END obj, 1 cnt FROM s2, lab, lam
        UNION ALL
        SELECT a.b, a.f, a.v, a.g, a.w, 2 * k + CASE xl.l WHEN 0 THEN a.p ELSE a.n - a.p END
            + CASE xr.l WHEN 0 THEN z.p ELSE z.n - z.p END, 1
        FROM s3 a JOIN s3 z ON a.b = z.b AND a.f = z.f AND a.v = z.v AND a.g = z.g AND a.w = z.w AND a.h = z.h
            AND a.u = 1 AND z.u = 0, lab xl, lab xr, lam) JOIN bd USING (b) WHERE obj <= bound GROUP BY ALL),
    h1 AS (SELECT b, f, v, obj, sum(cnt) cnt FROM (
        SELECT b, f, v, k + CASE l WHEN 0 THEN p ELSE n - p END obj, 1 cnt FROM s1, lab, lam
        UNION ALL
        SELECT a.b, a.f, a.v, a.obj + z.obj, a.cnt * z.cnt
        FROM h2 a JOIN h2 z ON a.b = z.b AND a.f = z.f AND a.v = z.v AND a.g = z.g AND a.w = 1 AND z.w = 0
        JOIN bd ON bd.b = a.b WHERE a.obj + z.obj <= bound) GROUP BY ALL),
    least1 AS (SELECT b, f, v, min(obj) m FROM h1 GROUP BY ALL),
    able AS (SELECT h1.* FROM h1 JOIN least1 o ON o.b = h1.b AND o.f = h1.f AND o.v = 1 - h1.v
        JOIN bd ON bd.b = h1.b WHERE h1.obj + o.m <= bound),
    h0 AS (SELECT b, k + CASE l WHEN 0 THEN p ELSE n - p END obj, 1 cnt FROM s0, lab, lam
        UNION ALL SELECT a.b, a.obj + z.obj, a.cnt * z.cnt
        FROM able a JOIN able z ON a.b = z.b AND a.f = z.f AND a.v = 1 AND z.v = 0)
    SELECT cast(obj AS bigint) obj, cast(sum(cnt) AS bigint) cnt FROM h0 JOIN bd USING (b) WHERE obj <= bound GROUP BY obj"""


def coded(view: str, lam: float, depth: int) -> str:
    """All conjunctions by code: a base-3 digit per feature, 0 free, else 1 + value.

    ``feat`` has the weight of a feature's digit, so ``code + 2 * w`` and ``code + w`` are
    the sides of a split; ``x<s>`` are least objectives of conjunctions of ``s`` literals.
    """
    fs = range(FEATURES[view])
    fl = ", ".join(f"f{f}" for f in fs)
    code = " + ".join(f"((mask >> {f}) & 1) * (1 + f{f}) * {3**f}" for f in fs)
    out = f"""WITH pat AS (SELECT {fl}, count(*) n, sum(y) p FROM ({DUCK[view]}) v GROUP BY {fl}),
    lam AS (SELECT cast(round({lam}::double * sum(n)) AS bigint) k FROM pat),
    conj AS (SELECT code, size, cast(sum(n) AS bigint) n, cast(sum(p) AS bigint) p FROM (
        SELECT n, p, bit_count(mask) size, cast({code} AS bigint) code
        FROM pat, (SELECT unnest(range({1 << len(fs)})) mask) WHERE bit_count(mask) <= {depth}) GROUP BY code, size),
    feat AS (SELECT unnest([{", ".join(map(str, fs))}]) f, unnest([{", ".join(str(3**f) for f in fs)}]) w),
    lab AS (SELECT unnest([0, 1]) l),
    leaves AS (SELECT code, size, {leaf()} c FROM conj, lam),
    x{depth} AS (SELECT code, c FROM leaves WHERE size = {depth})"""
    for s in range(depth - 1, -1, -1):
        out += f""",
    x{s} AS (SELECT c.code, least(any_value(c.c), min(a.c + z.c)) c
        FROM leaves c JOIN feat ON {FREE}
        LEFT JOIN x{s + 1} a ON a.code = c.code + 2 * w LEFT JOIN x{s + 1} z ON z.code = c.code + w
        WHERE size = {s} GROUP BY c.code)"""
    return out


FREE = "(c.code // w) % 3 = 0"


def chosen(name: str, size: int, value: str, by: str | None = None) -> str:
    """``name``: take the split with the least sum of ``by`` (the most information gain
    if None), then the sum of ``value`` over its sides, or the leaf where that is less."""
    rank = f"round(-{gain('l.n', 'l.p', 'r.n', 'r.p')}, 12)" if by is None else "bl.c + br.c"
    more = "" if by is None else f"JOIN {by} bl ON bl.code = l.code JOIN {by} br ON br.code = r.code"
    return f""",
    {name}_split AS (SELECT code, w FROM (
        SELECT c.code, w, row_number() OVER (PARTITION BY c.code ORDER BY {rank}, w) r
        FROM leaves c JOIN feat ON {FREE} JOIN conj l ON l.code = c.code + 2 * w JOIN conj r ON r.code = c.code + w {more}
        WHERE c.size = {size}) WHERE r = 1),
    {name} AS (SELECT c.code, CASE WHEN c.c <= 2 * k OR a.c IS NULL THEN c.c ELSE least(c.c, a.c + z.c) END c
        FROM leaves c JOIN lam ON true LEFT JOIN {name}_split q ON q.code = c.code
        LEFT JOIN {value} a ON a.code = c.code + 2 * q.w LEFT JOIN {value} z ON z.code = c.code + q.w WHERE c.size = {size})"""


def exact_set(view: str, lam: float, depth: int, mult: float, more: str = "", reference: str = "x0",
              fits: dict[int, str] | None = None, first: str | None = None) -> str:
    """Objectives of every tree within the bound, counted upwards over conjunctions.

    ``x`` are least objectives, ``u`` what the rest of a tree leaves over, ``h`` histograms.
    With ``fits`` conjunctions of a size may only split where these estimates of the sides
    fit together; with ``first`` the sides of the root have their budgets from there.
    """
    errors = "k + CASE l WHEN 0 THEN p ELSE n - p END"
    sides = "JOIN {t} a ON a.code = c.code + 2 * w JOIN {t} z ON z.code = c.code + w"
    out = f"{coded(view, lam, depth)}{more}, u0 AS (SELECT code, cast(round(c * (1 + {mult}::double)) AS bigint) u FROM {reference})"
    open_splits = {}
    for s in range(depth):
        fit = (fits or {}).get(s)
        fit = f"JOIN {fit} fa ON fa.code = c.code + 2 * w JOIN {fit} fz ON fz.code = c.code + w AND fa.c + fz.c <= u" if fit else ""
        open_splits[s] = f"u{s} c JOIN feat ON {FREE} {fit}"
        given = f"SELECT code, u FROM {first}" if first and s == 0 else f"""
            SELECT unnest([a.code, z.code]) code, unnest([u - z.c, u - a.c]) u FROM {open_splits[s]} {sides.format(t=f"x{s + 1}")}"""
        out += f", u{s + 1} AS (SELECT code, max(u) u FROM ({given}) WHERE u >= 0 GROUP BY code)"
    for s in range(depth, -1, -1):
        rows = f"SELECT code, {errors} obj, 1 cnt FROM conj, lab, lam WHERE size = {s}"
        if s < depth:
            rows += f" UNION ALL SELECT c.code, a.obj + z.obj, a.cnt * z.cnt FROM {open_splits[s]} {sides.format(t=f'h{s + 1}')}"
        out += f", h{s} AS (SELECT code, obj, sum(cnt) cnt FROM ({rows}) JOIN u{s} USING (code) WHERE obj <= u GROUP BY code, obj)"
    return f"{out} SELECT cast(obj AS bigint) obj, cast(cnt AS bigint) cnt FROM h0"


# Estimates of depth-4 problems with lookahead 2, after which the styles differ: on a child (three
# levels left) they choose by greedy grandchildren and go on exactly (la1) or greedily (lg1).
LOOK_CHILDREN = chosen("g2", 2, "x3") + chosen("la1", 1, "x2", "g2") + chosen("lg1", 1, "g2", "g2")


def lookahead_styles(view: str, lam: float) -> str:
    """Style 0 keeps its lookahead, 1 and 2 count it down and start again, 3 ends greedily."""
    ways = {0: ("x1", "la1"), 1: ("la1", "la1"), 2: ("la1", "la1"), 3: ("lg1", "lg1")}
    return f"{coded(view, lam, 4)}{LOOK_CHILDREN}" + "".join(chosen(f"v{i}", 0, *way) for i, way in ways.items()) + (
        " " + " UNION ALL ".join(f"SELECT {i} AS style, c obj FROM v{i}" for i in ways)
    )


def style2_set(view: str, lam: float, mult: float) -> str:
    """By the lookahead of their depth, children of the root are estimated by la1, deeper ones exactly."""
    return exact_set(view, lam, 4, mult, LOOK_CHILDREN + chosen("v2", 0, "la1", "la1"), "v2", {0: "la1"})


#: Every useful round of the fixpoint passes a step of either side: a leaf and a point per feature.
ROUNDS = 22


def split_pairs(estimates: str) -> str:
    """Splits of ``c``: the estimates of both sides, and their least objectives."""
    return f"""JOIN feat ON {FREE} JOIN {estimates} a ON a.code = c.code + 2 * w JOIN {estimates} z ON z.code = c.code + w
        JOIN x2 xa ON xa.code = a.code JOIN x2 xz ON xz.code = z.code"""


def settled(reference: str, mult: float, children: str, grandchildren: str) -> str:
    """Budgets of the root's sides, ``settled``, where sets of two literals are complete.

    A one-literal problem has a stair of least objectives: the leaf, and per split the exact
    sides from the budget on that their estimates need.  The root's sides hand budget to each
    other until nothing changes.
    """
    least = lambda side, budget: f"(SELECT min(m) FROM stairs WHERE stairs.code = {side} AND stairs.b <= {budget})"
    out = f""",
    bd AS (SELECT cast(round(c * (1 + {mult}::double)) AS bigint) budget FROM {reference}),
    stairs AS (SELECT code, c b, c m FROM leaves WHERE size = 1
        UNION ALL SELECT c.code, a.c + z.c, xa.c + xz.c FROM leaves c {split_pairs(grandchildren)} WHERE size = 1),
    start AS (SELECT f, w, budget, budget - z.c bl, budget - a.c single FROM bd, feat
        JOIN {children} a ON a.code = 2 * w JOIN {children} z ON z.code = w WHERE a.c + z.c <= budget),
    round0 AS (SELECT *, budget - {least("2 * w", "bl")} br FROM start)"""
    for i in range(ROUNDS):
        out += f""",
    round{i + 1} AS (SELECT f, w, budget, bl, single, greatest(br, budget - {least("2 * w", "bl")}) br FROM (
        SELECT f, w, budget, greatest(bl, budget - {least("w", "br")}) bl, br, single FROM round{i}))"""
    return f"{out}, settled AS (SELECT * FROM round{ROUNDS})"


def greedy_budgets(view: str, lam: float, mult: float) -> str:
    """Budgets of a depth-3 set whose estimates are greedy trees by information gain alone.

    Below the root exact sides are always reached.
    """
    digit = f"(code // [{', '.join(str(3**f) for f in range(FEATURES[view]))}][i + 1]) % 3"
    key = f"array_to_string([2 * i + {digit} - 1 for i in range({FEATURES[view]}) if {digit} > 0], ',')"
    return f"""{coded(view, lam, 3)}{chosen("g2", 2, "x3")}{chosen("g1", 1, "g2")}{chosen("g0", 0, "g1")}{settled("g0", mult, "g1", "g2")},
    top AS (SELECT 'multipass' allocation, * FROM settled
        UNION ALL SELECT 'singlepass', f, w, budget, bl, single, single FROM start),
    nodes1 AS (SELECT allocation, 2 * w code, bl budget FROM top UNION SELECT allocation, w, br FROM top),
    split1 AS (SELECT allocation, c.code, w, f, budget, a.code left_code, z.code right_code,
        budget - CASE allocation WHEN 'multipass' THEN xz.c ELSE z.c END bl, budget - CASE allocation WHEN 'multipass' THEN xa.c ELSE a.c END br
        FROM nodes1 c JOIN lam ON true {split_pairs("g2")} WHERE a.c + z.c <= budget AND budget >= 2 * k),
    nodes2 AS (SELECT allocation, left_code code, bl budget FROM split1 UNION SELECT allocation, right_code, br FROM split1),
    split2 AS (SELECT allocation, c.code, f, budget, budget - z.c bl, budget - a.c br
        FROM nodes2 c JOIN lam ON true JOIN feat ON {FREE} JOIN x3 a ON a.code = c.code + 2 * w JOIN x3 z ON z.code = c.code + w
        WHERE a.c + z.c <= budget AND budget >= 2 * k),
    found AS (SELECT allocation, 0 code, f, budget, bl, br FROM top
        UNION ALL SELECT allocation, code, f, budget, bl, br FROM split1 UNION ALL SELECT * FROM split2)
    SELECT allocation, {key} itemset, cast(budget AS bigint) budget, f feature, cast(bl AS bigint) left_budget, cast(br AS bigint) right_budget
    FROM found"""


def depth5_set(view: str, lam: float, mult: float) -> str:
    """Lookahead 1 at depth 5: estimates of one and two literals (a1, a2) miss the optimum, deeper ones are exact."""
    greedy_trees = chosen("g3", 3, "x4") + chosen("g2", 2, "g3") + chosen("g1", 1, "g2")
    estimates = chosen("a2", 2, "x3", "g3") + chosen("a1", 1, "a2", "g2") + chosen("a0", 0, "a1", "g1")
    first = """, sides AS (SELECT 2 * w code, bl u FROM settled UNION ALL SELECT w, br FROM settled)"""
    more = greedy_trees + estimates + settled("a0", mult, "a1", "a2") + first
    return exact_set(view, lam, 5, mult, more, "a0", {0: "a1", 1: "a2"}, "sides")


# Conjunctions asked for in a list: of every row three and two of its values, and one that no row meets.
REQUESTED = f"""WITH v AS ({DUCK["li_score"]}),
    wanted AS (
        SELECT DISTINCT f0, f4, f7, NULL::int f1, NULL::int f9 FROM v UNION ALL SELECT DISTINCT NULL, NULL, NULL, f1, f9 FROM v)
    SELECT CASE WHEN w.f0 IS NULL THEN (2 + w.f1) || ',' || (18 + w.f9) ELSE w.f0 || ',' || (8 + w.f4) || ',' || (14 + w.f7) END itemset,
        count(*) n, cast(sum(y) AS bigint) p
    FROM wanted w JOIN v ON (w.f0 IS NULL OR (v.f0 = w.f0 AND v.f4 = w.f4 AND v.f7 = w.f7))
        AND (w.f1 IS NULL OR (v.f1 = w.f1 AND v.f9 = w.f9)) GROUP BY ALL
    UNION ALL SELECT '0,1', 0, 0"""

# -- bootstraps -----------------------------------------------------------------


def draw(*parts: str) -> str:
    text = " || '|' || ".join(f"cast({p} AS varchar)" for p in parts)
    return f"cast('0x' || substr(md5({text}), 1, 15) AS bigint)"


OWNER = "CASE " + " ".join(f"WHEN {{f}} IN ({', '.join(map(str, fs))}) THEN {v}" for v, fs in BINS.items()) + " END"

SAMPLE = f"""positioned AS (SELECT {FL}, y, row_number() OVER (ORDER BY row_id) - 1 pos FROM ({DUCK["ord_score"]}) v),
    slot AS (SELECT b, i, {draw("7", "b", "i")} % (SELECT count(*) FROM positioned) pos
        FROM (SELECT unnest(range(2)) b), (SELECT pos i FROM positioned)),
    x AS (SELECT b, i, {FL}, y FROM slot JOIN positioned USING (pos))"""

MOVED = ", ".join(f"CASE WHEN var = {v} THEN d.f{f} ELSE o.f{f} END f{f}" for v, fs in BINS.items() for f in fs)
PERMUTED = f"""perm AS (SELECT b, var, i donor, row_number() OVER (PARTITION BY b, var ORDER BY {draw("7", "b", "var", "i")}, i) - 1 i
        FROM (SELECT b, i FROM x), (SELECT unnest(range(6)) var)),
    moved AS (SELECT perm.b, var, {MOVED}, o.y
        FROM perm JOIN x o ON o.b = perm.b AND o.i = perm.i JOIN x d ON d.b = perm.b AND d.i = perm.donor)"""

RELIANCE = f"""{small_set(mult=0.4, source=SAMPLE)}{LEAVES}, {PERMUTED},
    mpat AS (SELECT row_number() OVER () pid, * FROM (SELECT b, var, {FL}, count(*) n, sum(y) p FROM moved GROUP BY b, var, {FL})),
    mlng AS (SELECT b, var, pid, n, p, cast(substr(name, 2) AS int) f, v FROM (UNPIVOT mpat ON {FL} INTO NAME name VALUE v)),
    after AS (
        SELECT b, var, '' itemset, sum(n) n, sum(p) p FROM mpat GROUP BY ALL
        UNION ALL SELECT b, var, {items("f v")}, sum(n), sum(p) FROM mlng GROUP BY ALL
        UNION ALL SELECT a.b, a.var, {items("a.f a.v", "z.f z.v")}, sum(a.n), sum(a.p)
        FROM mlng a JOIN mlng z ON a.pid = z.pid AND a.f < z.f GROUP BY ALL),
    before AS (
        SELECT b, '' itemset, n, p FROM s0 UNION ALL SELECT b, {items("f v")}, n, p FROM s1
        UNION ALL SELECT b, {items("f v", "g w")}, n, p FROM s2 WHERE f < g),
    delta AS (SELECT t.b, tree_id, vars.var, sum(
            CASE prediction WHEN 1 THEN o.p ELSE o.n - o.p END
            - CASE prediction WHEN 1 THEN coalesce(a.p, 0) ELSE coalesce(a.n, 0) - coalesce(a.p, 0) END) delta
        FROM tleaf t CROSS JOIN (SELECT unnest(range(6)) var) vars JOIN before o ON o.b = t.b AND o.itemset = t.itemset
        LEFT JOIN after a ON a.b = t.b AND a.var = vars.var AND a.itemset = t.itemset GROUP BY ALL),
    totals AS (SELECT b, count(*) trees, min(obj) least FROM tree GROUP BY b),
    mass AS (SELECT var, delta, sum(1.0::double / (2.0 * trees)) mass
        FROM delta JOIN tree USING (b, tree_id) JOIN totals USING (b)
        WHERE obj <= cast(round((1 + 0.4::double) * least) AS bigint) GROUP BY var, delta)"""

TWO_LEVEL = f"""
    SELECT '' itemset, n, p FROM s0 UNION ALL SELECT {items("f v")}, n, p FROM s1
    UNION ALL SELECT {items("f v", "g w")}, n, p FROM s2 WHERE f < g"""

LI = ctes("li_score", 0.01, 2)
ORD = ctes("ord_score", 0.01, 2)

CONTINGENCY = f"""
    contingency AS (
        SELECT '' itemset, f feature, sum(CASE v WHEN 1 THEN n ELSE 0 END) n_l, sum(CASE v WHEN 1 THEN p ELSE 0 END) p_l,
            sum(CASE v WHEN 0 THEN n ELSE 0 END) n_r, sum(CASE v WHEN 0 THEN p ELSE 0 END) p_r FROM s1 GROUP BY f
        UNION ALL
        SELECT {items("f v")}, g, sum(CASE w WHEN 1 THEN n ELSE 0 END), sum(CASE w WHEN 1 THEN p ELSE 0 END),
            sum(CASE w WHEN 0 THEN n ELSE 0 END), sum(CASE w WHEN 0 THEN p ELSE 0 END) FROM s2 GROUP BY f, v, g)"""

NODES = """,
    nodes AS (
        SELECT b, '' itemset, bound budget, n, p, 0 size FROM bd JOIN s0 USING (b)
        UNION
        SELECT a.b, {own}, bound - o.c, s1.n, s1.p, 1 FROM x1 a JOIN x1 o ON a.b = o.b AND a.f = o.f AND a.v = 1 - o.v
        JOIN s1 ON s1.b = a.b AND s1.f = a.f AND s1.v = a.v JOIN bd ON bd.b = a.b WHERE a.c + o.c <= bound)""".format(
    own=items("a.f a.v")
)

BOUNDED = f"{ORD}, {exact(2)}, bd AS (SELECT b, cast(round(c * (1 + 0.15::double)) AS bigint) bound FROM x2root){NODES}"

# both sides keep what the other side's exact optimum leaves over
BUDGETS = f"""{BOUNDED}
    SELECT itemset, budget, a.f feature, budget - z.c left_budget, budget - a.c right_budget
    FROM nodes JOIN x1 a ON a.v = 1 JOIN x1 z ON z.f = a.f AND z.v = 0 WHERE size = 0 AND a.c + z.c <= budget
    UNION ALL
    SELECT itemset, budget, a.g, budget - z.c, budget - a.c FROM nodes JOIN l2 a ON a.w = 1 AND itemset = {items("a.f a.v")}
    JOIN l2 z ON z.f = a.f AND z.v = a.v AND z.g = a.g AND z.w = 0 WHERE size = 1 AND a.c + z.c <= budget"""

# nodes of two literals too: each side of a split of a one-literal node
DEEP = f"""{BOUNDED},
    deep AS (SELECT itemset, budget, n, p FROM nodes UNION
        SELECT {items("a.f a.v", "a.g a.w")}, budget - o.c, s2.n, s2.p
        FROM nodes JOIN l2 a ON itemset = {items("a.f a.v")}
        JOIN l2 o ON o.f = a.f AND o.v = a.v AND o.g = a.g AND o.w = 1 - a.w
        JOIN s2 ON s2.f = a.f AND s2.v = a.v AND s2.g = a.g AND s2.w = a.w WHERE size = 1 AND a.c + o.c <= budget)"""

ADMITTED_SPLITS = f"""{BOUNDED}
    SELECT itemset, budget, a.f feature FROM nodes JOIN x1 a ON a.v = 1 JOIN x1 z ON z.f = a.f AND z.v = 0
    WHERE size = 0 AND a.c + z.c <= budget
    UNION ALL
    SELECT itemset, budget, a.g FROM nodes JOIN l2 a ON a.w = 1 AND itemset = {items("a.f a.v")}
    JOIN l2 z ON z.f = a.f AND z.v = a.v AND z.g = a.g AND z.w = 0 WHERE size = 1 AND a.c + z.c <= budget"""

# greedy depth-2 tree of the whole problem sets the bound; leaves of the sides split the budget
RULE_LIST = f"""{ORD}, {exact(2)}, {options()}, {SCORES},
    g AS (SELECT feature f FROM (SELECT *, row_number() OVER (ORDER BY round(-gain, 12), feature) r FROM scores
        WHERE itemset = '') WHERE r = 1),
    gref AS (SELECT CASE WHEN l0.c <= 2 * k THEN l0.c ELSE least(l0.c, a.c + z.c) END c
        FROM l0, lam, g JOIN x1 a ON a.f = g.f AND a.v = 1 JOIN x1 z ON z.f = g.f AND z.v = 0),
    bd AS (SELECT cast(round(c * (1 + 0.15::double)) AS bigint) bound FROM gref),
    side AS (SELECT a.f, a.v, bound - o.c budget, o.c other FROM l1 a JOIN l1 o ON o.f = a.f AND o.v = 1 - a.v, bd),
    h1 AS (
        SELECT o.f, o.v, o.obj, o.g FROM opt1 o JOIN side USING (f, v), lam
        WHERE o.obj <= budget AND (o.g < 0 OR budget >= 2 * k)),
    fits AS (SELECT a.f, a.v, a.g FROM l2 a JOIN l2 z ON z.f = a.f AND z.v = a.v AND z.g = a.g AND a.w = 1 AND z.w = 0
        JOIN side ON side.f = a.f AND side.v = a.v, lam
        WHERE (a.c <= budget - k OR z.c <= budget - k) AND a.c <= budget AND z.c <= budget),
    good AS (SELECT h1.* FROM h1 WHERE g < 0 OR EXISTS (
        SELECT 1 FROM fits WHERE fits.f = h1.f AND fits.v = h1.v AND fits.g = h1.g)),
    open AS (SELECT a.f FROM l1 a JOIN l1 z ON z.f = a.f AND a.v = 1 AND z.v = 0, bd, lam
        WHERE (a.c <= bound - k OR z.c <= bound - k) AND a.c <= bound AND z.c <= bound AND bound >= 2 * k),
    rt AS (SELECT obj, 1 cnt FROM root_leaf
        UNION ALL SELECT a.obj + z.obj, 1 FROM good a JOIN good z ON z.f = a.f AND a.v = 1 AND z.v = 0 JOIN open ON open.f = a.f)
    SELECT cast(obj AS bigint) obj, cast(sum(cnt) AS bigint) cnt FROM rt, bd WHERE obj <= bound GROUP BY obj"""

FRONTIER = f"""{SMALL_LEAVES},
    v1 AS (SELECT {items("f v")} itemset, c FROM x1 UNION ALL SELECT {items("f v", "g w")}, c FROM l2 WHERE f < g),
    inner_node AS (
        SELECT tree_id, f, NULL sv, NULL g, 0 depth, 0 turn FROM tree WHERE f >= 0
        UNION ALL
        SELECT s.tree_id, s.f, s.v, o.g, 1, 1 - s.v FROM side s JOIN opt1 o USING (b, f, v, obj, idx) WHERE o.g >= 0),
    member AS (
        SELECT tree_id, f, depth, turn, {items("f u")} itemset FROM inner_node, (SELECT unnest([0, 1]) u) WHERE depth = 0
        UNION ALL
        SELECT tree_id, f, depth, turn, unnest([{items("f (1-sv)")}, {items("f sv", "g 1")}, {items("f sv", "g 0")}])
        FROM inner_node WHERE depth = 1),
    scored AS (SELECT tree_id, depth, turn, cast(sum(c) AS bigint) score FROM member JOIN v1 USING (itemset) GROUP BY ALL)
    SELECT tree_id, row_number() OVER (PARTITION BY tree_id ORDER BY depth, turn) - 1 node_no, depth, score FROM scored"""

TREE_NODES = f"""{SMALL_LEAVES},
    prefixes AS (
        SELECT tree_id, '' prefix, 0 depth, CASE WHEN path = '' THEN NULL ELSE abs(cast(split_part(path, ',', 1) AS int)) - 1 END feature,
            CASE WHEN path = '' THEN prediction END prediction FROM tleaf
        UNION ALL
        SELECT tree_id, split_part(path, ',', 1), 1,
            CASE WHEN contains(path, ',') THEN abs(cast(split_part(path, ',', 2) AS int)) - 1 END,
            CASE WHEN NOT contains(path, ',') THEN prediction END FROM tleaf WHERE path <> ''
        UNION ALL
        SELECT tree_id, path, 2, NULL, prediction FROM tleaf WHERE contains(path, ','))
    SELECT tree_id, prefix, depth, max(feature) feature, max(prediction) prediction, count(*) leaves, 'f' || max(feature) AS name
    FROM prefixes GROUP BY tree_id, prefix, depth"""

ORACLES: dict[str, str] = {
    "binary_scan": """SELECT o_orderkey row_id, CAST(o_custkey % 3 <> 0 AS INT) a, CAST(month(o_orderdate) <> 6 AS INT) b,
        CAST(o_orderstatus = 'F' AS INT) c, CAST(o_orderkey % 5 <> 2 AS INT) y FROM orders""",
    "pattern_compaction": f"{LI} SELECT f0, f1, f2, f3, f4, f5, f6, f7, f8, f9, n, cast(p AS bigint) p FROM pat",
    "literal_counts": f"{LI} SELECT f feature, v AS value, n, p FROM s1",
    "itemset_counts_2": LI + TWO_LEVEL,
    "itemset_counts_3": f"""{ctes("ord_score", 0.01, 3)} {TWO_LEVEL}
        UNION ALL SELECT {items("f v", "g w", "h u")}, n, p FROM s3 WHERE f < g AND g < h""",
    "split_contingency": f"""{LI}, {CONTINGENCY}
        SELECT itemset, feature, cast(n_l AS bigint) n_l, cast(p_l AS bigint) p_l, cast(n_r AS bigint) n_r, cast(p_r AS bigint) p_r
        FROM contingency""",
    "valid_splits": f"""{LI}, {CONTINGENCY}
        SELECT itemset, feature, cast(n_l AS bigint) n_l, cast(n_r AS bigint) n_r FROM contingency WHERE n_l > 0 AND n_r > 0""",
    "leaf_objectives": f"{ORD} SELECT itemset, {leaf()} leaf FROM ({TWO_LEVEL}), lam",
    "entropy_gain": f"{ORD}, {SCORES} SELECT itemset, feature, round(gain, 9) gain, loss FROM scores",
    "best_split_entropy": best("round(-gain, 12)"),
    "best_split_loss": best("loss"),
    "best_split_prefix": best("round(-gain, 12)", "feature < 6"),
    "depth1_exact": f"{ORD}, {exact(2)} SELECT {items('f v')} itemset, c obj FROM x1",
    "depth2_exact": f"{ctes('ord_score', 0.01, 3)}, {exact(3)} SELECT {items('f v')} itemset, c obj FROM x2",
    "depth3_exact": f"{ctes('ord_score', 0.01, 3)}, {exact(3)} SELECT c obj FROM x3root",
    "depth3_exact_prefix": f"{ctes('ord_score', 0.01, 3)}, {exact(3, 5)} SELECT c obj FROM x3root",
    "greedy_objective_d3": greedy_objectives("ord_score", 0.01),
    "greedy_objective_parity": greedy_objectives("li_parity", 0.005),
    "lookahead_objective_d3": " UNION ALL ".join(
        f"SELECT * FROM ({lookahead(view, lam)} SELECT '{view}' dataset, c obj FROM la)"
        for view, lam in (("ord_score", 0.01), ("li_parity", 0.005), ("doc_labels", 0.01))
    ),
    "rashomon_bound": f"""{ORD}, {exact(2)} SELECT slack, c reference,
        cast(round(c * (1 + 0.15::double) * (1 + slack)) AS bigint) bound
        FROM x2root, (SELECT unnest([0.0::double, 0.1::double]) slack)""",
    "admitted_leaves": f"""{DEEP}
        SELECT itemset, budget, prediction, loss FROM (
            SELECT itemset, budget, l prediction, k + CASE l WHEN 0 THEN p ELSE n - p END loss
            FROM deep, (SELECT unnest([0, 1]) l), lam) WHERE loss <= budget""",
    "admitted_splits": ADMITTED_SPLITS,
    "budgets_singlepass": BUDGETS,
    "budgets_multipass": BUDGETS,
    "rule_list_histogram": RULE_LIST,
    "majority_leaf_histogram": small_set(majority=True) + HISTOGRAM,
    "root_histogram": SMALL + HISTOGRAM,
    "root_histogram_lineitem": small_set("li_score") + HISTOGRAM,
    "root_histogram_documents": small_set("doc_labels", mult=0.1) + HISTOGRAM,
    "root_histogram_user_budget": small_set(bound="(SELECT n // 5 FROM s0)") + HISTOGRAM,
    "root_histogram_d3": depth3_histogram("ref AS (SELECT * FROM la)"),
    "root_histogram_d3_exact": depth3_histogram("ref AS (SELECT * FROM x3root)"),
    "root_histogram_d4_exact": exact_set("ord_score", 0.01, 4, 0.03),
    "root_histogram_d4_requested": exact_set("ord_score", 0.01, 4, 0.03),
    "root_histogram_d3_requested": depth3_histogram("ref AS (SELECT * FROM la)"),
    "requested_counts": REQUESTED,
    "budgets_greedy_d3": greedy_budgets("li_scattered", 0.001, 0.3),
    "lookahead_styles_d4": lookahead_styles("li_scattered", 0.002),
    "histogram_depth5": depth5_set("ord_score", 0.01, 0.02),
    "histogram_depth5_scattered": depth5_set("li_scattered", 0.003, 0.01),
    "histogram_style2": style2_set("li_score", 0.01, 0.02),
    "histogram_style2_scattered": style2_set("li_scattered", 0.002, 0.02),
    "count_trees": f"{SMALL} SELECT count(*) cnt FROM tree",
    "count_leq": f"{SMALL} SELECT count(*) cnt FROM tree, s0 WHERE obj <= n // 5",
    "min_objective": f"{SMALL} SELECT min(obj) obj FROM tree",
    "trees_per_split": f"""{SMALL}{NODES}
        SELECT '' itemset, bound budget, f feature, count(*) cnt FROM tree JOIN bd USING (b) WHERE f >= 0 GROUP BY ALL
        UNION ALL
        SELECT itemset, budget, o.g, count(*) FROM nodes JOIN opt1 o ON itemset = {items("o.f o.v")}
        WHERE size = 1 AND o.g >= 0 AND o.obj <= budget GROUP BY ALL""",
    "saved_trees_per_split": f"""{SMALL}{NODES}
        SELECT '' itemset, bound budget, f feature, count(*) cnt FROM tree JOIN bd USING (b) WHERE f >= 0 GROUP BY ALL
        UNION ALL
        SELECT itemset, budget, o.g, count(*) FROM nodes JOIN opt1 o ON itemset = {items("o.f o.v")}
        WHERE size = 1 AND o.g >= 0 AND o.obj <= budget GROUP BY ALL""",
    "tree_objectives": f"{SMALL} SELECT tree_id, obj, round(obj / n, 9) obj_norm FROM tree, s0",
    "tree_leaves": f"{SMALL_LEAVES} SELECT tree_id, leaf_no, itemset, prediction, loss FROM tleaf",
    "tree_paths": f"{SMALL_LEAVES} SELECT tree_id, leaf_no, path, prediction FROM tleaf",
    "tree_path_strings": f"{SMALL_LEAVES} SELECT tree_id, leaf_no, path_text, prediction FROM tleaf",
    "tree_nodes": TREE_NODES,
    "frontier_scores": FRONTIER,
    "root_lookahead": " UNION ALL ".join(
        f"SELECT * FROM ({lookahead('ord_score', 0.01)} SELECT {d} AS depth, c obj FROM {t})"
        for d, t in ((1, "x1root"), (2, "x2root"), (3, "la"))
    ),
    "predict_tree": f"{SMALL_LEAVES}{COVER} SELECT row_id, prediction FROM predicted WHERE tree_id = 20",
    "predict_all": f"{SMALL_LEAVES}{COVER} SELECT tree_id, row_id, prediction FROM predicted",
    "predict_packed": f"""{SMALL_LEAVES}{COVER},
        placed AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 pos FROM ({DUCK["ord_score"]}) v),
        bytes AS (SELECT tree_id, pos // 32768 block, pos % 32768 // 8 AS place, cast(sum(prediction << (pos % 8)) AS bigint) v
            FROM predicted JOIN placed USING (row_id) GROUP BY ALL),
        grid AS (SELECT tree_id, obj, block, place
            FROM tree, (SELECT DISTINCT pos // 32768 block FROM placed), (SELECT unnest(range(4096)) AS place))
        SELECT tree_id, obj, block, cast(sum(bit_count(coalesce(v, 0))) AS bigint) ones,
            md5(string_agg(printf('%02X', coalesce(v, 0)), '' ORDER BY place)) digest
        FROM grid LEFT JOIN bytes USING (tree_id, block, place) GROUP BY tree_id, obj, block""",
    "predict_up_to_objective": f"""{SMALL_LEAVES}{COVER} SELECT tree_id, obj, row_id, prediction
        FROM predicted JOIN tree USING (tree_id), lam WHERE obj <= (SELECT min(obj) FROM tree) + k""",
    "majority_vote": f"""{SMALL_LEAVES}{COVER} SELECT row_id, round(avg(prediction), 9) share,
        CAST(avg(prediction) >= 0.5 AS INT) prediction FROM predicted GROUP BY row_id""",
    "majority_vote_divided": f"""{small_set(mult=0.7)}{LEAVES}{COVER},
        used AS (SELECT itemset, prediction, count(*) cnt FROM tleaf GROUP BY ALL),
        votes AS (SELECT row_id, coalesce(sum(cnt) FILTER (prediction = 1), 0) ones, sum(cnt) total
            FROM cover JOIN used USING (itemset) GROUP BY row_id)
        SELECT row_id, round(ones::double / total::double, 9) share, CAST(ones >= total - ones AS INT) prediction FROM votes""",
    "tree_paths_by_id": f"{SMALL_LEAVES} SELECT tree_id, leaf_no, path, prediction FROM tleaf WHERE tree_id IN (0, 3, 17, 40)",
    "leaf_usage": f"{SMALL_LEAVES} SELECT itemset, prediction, count(*) cnt FROM tleaf GROUP BY ALL",
    "correct_counts": f"""{SMALL_LEAVES}{COVER} SELECT tree_id, count(*) FILTER (prediction = y) correct, count(*) total
        FROM predicted JOIN (SELECT row_id, y FROM ({DUCK["ord_score"]}) v) USING (row_id) GROUP BY tree_id""",
    "bootstrap_weights": f"WITH {SAMPLE} SELECT b, {FL}, count(*) n, cast(sum(y) AS bigint) p FROM x GROUP BY b, {FL}",
    "block_permutation": f"""WITH {SAMPLE}, {PERMUTED}
        SELECT b, var, {FL}, count(*) n, cast(sum(y) AS bigint) p FROM moved GROUP BY b, var, {FL}""",
    "reliance_mean": f"""{RELIANCE} SELECT var,
        round(sum(mass * delta) / (SELECT count(*) FROM positioned), 9) mean_sub_mr FROM mass GROUP BY var""",
    "reliance_cdf": f"""{RELIANCE} SELECT var, round(delta / (SELECT count(*) FROM positioned), 9) x,
        round(sum(mass) OVER (PARTITION BY var ORDER BY delta ROWS UNBOUNDED PRECEDING), 9) p FROM mass""",
}

# Columns that DuckDB types as INTEGER; both sides compare whole numbers as BIGINT.
_F9 = " ".join(f"f{i}" for i in range(9))
INTEGERS = {
    "budgets_greedy_d3": "feature",
    "lookahead_styles_d4": "style",
    "binary_scan": "a b c y",
    "pattern_compaction": f"{_F9} f9",
    "literal_counts": "feature value",
    "split_contingency": "feature",
    "valid_splits": "feature",
    "entropy_gain": "feature",
    "best_split_entropy": "feature",
    "best_split_loss": "feature",
    "best_split_prefix": "feature",
    "greedy_objective_d3": "mode",
    "greedy_objective_parity": "mode",
    "admitted_leaves": "prediction",
    "admitted_splits": "feature",
    "budgets_singlepass": "feature",
    "budgets_multipass": "feature",
    "trees_per_split": "feature",
    "saved_trees_per_split": "feature",
    "tree_nodes": "depth feature",
    "frontier_scores": "depth",
    "root_lookahead": "depth",
    "majority_vote": "prediction",
    "majority_vote_divided": "prediction",
    "bootstrap_weights": _F9,
    "block_permutation": _F9,
}
for _name, _columns in INTEGERS.items():
    _casts = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in _columns.split())
    ORACLES[_name] = f"SELECT * REPLACE ({_casts}) FROM ({ORACLES[_name]})"
