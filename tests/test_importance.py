import hashlib
from collections import Counter

import pytest
from small_model import SmallModel

from grovelight import subtractive_reliance
from grovelight.operators import resample
from grovelight.operators.patterns import bit
from grovelight.plans.importance import variable_columns


def rows_of(df, *keys, weight="n"):
    out = {}
    for r in df.collect():
        pattern = tuple(r[f"f{i}"] for i in range(4))
        out.setdefault(tuple(r[k] for k in keys), []).append((pattern, r[weight], r["p"]))
    return out


def predict(tree, x):
    while isinstance(tree, tuple):
        tree = tree[1] if x[tree[0]] else tree[2]
    return tree


@pytest.fixture(scope="module")
def table(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.integers(0, 2, (80, 4))
    y = (x[:, 0] | (x[:, 1] & x[:, 2])) ^ (rng.random(80) < 0.1)
    rows = [(i, *map(int, r), int(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id int, f0 int, f1 int, f2 int, f3 int, y int")


def test_mass_equals_enumeration_over_the_drawn_tables(spark, table):
    bins = {5: [0, 3], 2: [1], 9: [2]}
    got = subtractive_reliance(
        table, ["f0", "f1", "f2", "f3"], "y", "id", n_boot=2, lambda_reg=0.03, depth_budget=3, rashomon_mult=0.2,
        seed=4, binning_map=bins,
    )
    order, columns = variable_columns(4, bins)
    assert order == [2, 5, 9]
    unpacked = [f"cast({bit(i)} AS int) AS f{i}" for i in range(4)]
    drawn = rows_of(got.sample.groupBy("b", "w0").agg({"*": "count", "y": "sum"}).selectExpr(
        "b", *unpacked, "`count(1)` AS n", "`sum(y)` AS p"), "b")
    moved = rows_of(got.permuted.selectExpr("b", "var", *unpacked, "n", "p"), "b", "var")

    mass = {}
    for b in (0, 1):
        rows, labels = [], []
        for pattern, n, p in drawn[(b,)]:
            rows += [pattern] * n
            labels += [1] * p + [0] * (n - p)
        assert len(rows) == 80
        model = SmallModel(rows, labels, lam=0.03, depth=3, mult=0.2)
        limit = int(1.2 * model.trees[0][0] + 0.5)
        for objective, tree in model.trees:
            if objective > limit:
                continue
            before = sum(p if predict(tree, x) else n - p for x, n, p in drawn[(b,)])
            for v in range(3):
                after = sum(p if predict(tree, x) else n - p for x, n, p in moved[(b, v)])
                key = (order[v], before - after)
                mass[key] = mass.get(key, 0) + 1 / (2 * len(model.trees))
    found = {(r["var"], r["delta"]): r["mass"] for r in got.mass.collect()}
    assert found == pytest.approx(mass)

    means = {r["var"]: r["mean_sub_mr"] for r in got.mean.collect()}
    for v in order:
        assert means[v] == pytest.approx(sum(d * m for (w, d), m in mass.items() if w == v) / 80)
    tops = {}
    for r in got.cdf.orderBy("var", "x").collect():
        assert r["p"] > tops.get(r["var"], 0)
        tops[r["var"]] = r["p"]
    for v in order:
        assert tops[v] == pytest.approx(sum(m for (w, _), m in mass.items() if w == v))


def test_permutations_keep_every_column_count(spark, table):
    """Moving a block keeps its joint counts and everything else's."""
    got = subtractive_reliance(
        table.drop("id"), ["f0", "f1", "f2", "f3"], "y", n_boot=1, lambda_reg=0.05, depth_budget=1, normalize=True
    )
    totals = {r["var"]: (r["n"], r["p"]) for r in got.permuted.groupBy("var").agg({"n": "sum", "p": "sum"}).selectExpr(
        "var", "`sum(n)` AS n", "`sum(p)` AS p").collect()}
    assert set(totals.values()) == {(80, next(iter(totals.values()))[1])} and len(totals) == 4
    tops = got.cdf.groupBy("var").max("p").collect()
    assert all(r["max(p)"] == pytest.approx(1.0) for r in tops)


def test_binning_map_is_checked():
    with pytest.raises(ValueError, match="does not exist"):
        variable_columns(3, {0: [3]})
    with pytest.raises(ValueError, match="two variables"):
        variable_columns(3, {0: [1], 1: [1]})


def test_permutation_moves_packed_rows(spark, tmp_path, monkeypatch):
    """Many buckets and blocks of two words of features; what moves is a row per bucket, not one per slot."""
    for name, value in (("HELD_VALUES", 120), ("BUCKET_SLOTS", 50), ("BLOCK_SLOTS", 64)):
        monkeypatch.setattr(resample, name, value)
    n, variables, cuts = 700, [[0, 65], [], [1]], {}
    rows = [(b, i, (i * 7 + b) % 4, (i * i) % 11, (i // 3) % 2) for b in (0, 1) for i in range(n)]
    spark.createDataFrame(rows, "b int, i long, w0 long, w1 long, y long").repartition(3).write.parquet(f"{tmp_path}/sample")

    def cut(df, name):
        df.write.parquet(f"{tmp_path}/{name}")
        cuts[name] = spark.read.parquet(f"{tmp_path}/{name}")
        return cuts[name]

    got = resample.permuted_patterns(spark.read.parquet(f"{tmp_path}/sample"), variables, n, 70, 5, cut)
    words, expected = {(b, i): (w0, w1, y) for b, i, w0, w1, y in rows}, Counter()
    for b in (0, 1):
        for var, (m0, m1) in enumerate(((1, 1 << 3), (0, 0), (2, 0))):
            draw = lambda i: (int(hashlib.md5(f"5|{b}|{var}|{i}".encode()).hexdigest()[:15], 16), i)  # noqa: B023, E731
            for i, donor in enumerate(sorted(range(n), key=draw)):
                (k0, k1, y), (d0, d1, _) = words[b, i], words[b, donor]
                key = (b, var, k0 & ~m0 | d0 & m0, k1 & ~m1 | d1 & m1)
                expected[(*key, "n")] += 1
                expected[(*key, "p")] += y
    assert {(*tuple(r)[:4], k): r[k] for r in got.collect() for k in "np"} == dict(expected)
    assert cuts["donors"].count() == 2 * 3 * 16 and cuts["donors"].agg({"n": "sum"}).first()[0] == 2 * 3 * n
