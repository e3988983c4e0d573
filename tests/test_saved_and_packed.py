import pytest
from pyspark.errors import AnalysisException

from grovelight import fit, load, subtractive_reliance

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def table(spark):
    import numpy as np

    rng = np.random.default_rng(11)
    x = rng.integers(0, 2, (300, 4))
    y = (x[:, 0] ^ x[:, 1]) ^ (rng.random(300) < 0.1)
    rows = [(int(i) * 3 - 400, *map(int, r), int(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id int, a int, b int, c int, d int, y int")


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("search", ["eager", "lazy"])
def test_a_saved_set_answers_without_a_fit(spark, table, tmp_path, search):
    path = f"file://{tmp_path}/set"
    with fit(table, FEATURES, "y", lambda_reg=0.02, depth_budget=3, rashomon_mult=0.2, search=search) as model:
        wanted = {
            "histogram": rows_of(model.root_histogram()),
            "bound": rows_of(model.bound()),
            "splits": rows_of(model.trees_per_split()),
            "paths": rows_of(model.tree_paths(0, 5)),
            "votes": rows_of(model.majority_vote(table, "id")),
            "frontier": rows_of(model.frontier_scores(3, 0, 3)),
            "estimate": rows_of(model.root_lookahead(3)),
            "subproblems": rows_of(model.subproblems()),
            "correct": rows_of(model.correct_counts(table, 0, 5)),
        }
        model.save(path)
        with pytest.raises(AnalysisException):
            model.save(path)
        folder = model.folder
        assert folder.exists()
    assert not folder.exists()
    # another session, which knows nothing but the path
    other = spark.newSession()
    again = load(other, path)
    same = other.createDataFrame(table.collect(), table.schema)
    assert {
        "histogram": rows_of(again.root_histogram()),
        "bound": rows_of(again.bound()),
        "splits": rows_of(again.trees_per_split()),
        "paths": rows_of(again.tree_paths(0, 5)),
        "votes": rows_of(again.majority_vote(same, "id")),
        "frontier": rows_of(again.frontier_scores(3, 0, 3)),
        "estimate": rows_of(again.root_lookahead(3)),
        "subproblems": rows_of(again.subproblems()),
        "correct": rows_of(again.correct_counts(same, 0, 5)),
    } == wanted
    assert (again.features, again.label, again.n_rows) == (FEATURES, "y", 300)
    again.close()
    assert load(spark, path).count_trees().first()["cnt"] > 0


def test_a_broken_save_is_no_set(spark, table, tmp_path):
    path = f"file://{tmp_path}/set"
    with fit(table, FEATURES, "y", lambda_reg=0.05, depth_budget=1) as model:
        model.patterns.write.parquet(f"{path}/patterns")
    with pytest.raises(AnalysisException):
        load(spark, path)


def test_closing_leaves_other_sets(table):
    first = fit(table, FEATURES, "y", lambda_reg=0.05, depth_budget=1)
    second = fit(table, FEATURES, "y", lambda_reg=0.05, depth_budget=1)
    first.close()
    first.close()
    assert second.count_trees().first()["cnt"] > 0
    second.close()


def test_importance_removes_its_tables(table):
    got = subtractive_reliance(table, FEATURES, "y", "id", n_boot=1, lambda_reg=0.05, depth_budget=1)
    assert got.folder.exists() and got.mean.count() == 4
    got.close()
    assert not got.folder.exists()


def bits_of(packed, row_id):
    """{(tree, row): prediction} out of the bitmaps."""
    at = {}
    for r in packed.rows.collect():
        assert (r["block"], r["bit"]) not in at
        at[r["block"], r["bit"]] = r[row_id]
    found = {}
    for r in packed.bits.collect():
        assert len(r["bits"]) == 4096
        ones = {i for i in range(32768) if r["bits"][i // 8] >> (i % 8) & 1}
        assert all((r["block"], i) in at for i in ones)
        for (block, i), row in at.items():
            if block == r["block"]:
                found[r["tree_id"], row] = int(i in ones)
    return found


def test_packed_predictions_equal_rows(table):
    with fit(table, FEATURES, "y", lambda_reg=0.02, depth_budget=3, rashomon_mult=0.2) as model:
        for some in ({}, {"start": 2, "stop": 6}, {"ids": [1, 7]}, {"max_obj": model.tree_objective(3)[0]}):
            plain = {(r["tree_id"], r["id"]): r["prediction"] for r in model.predict_all(table, "id", **some).collect()}
            packed = model.predict_packed(table, "id", **some)
            assert bits_of(packed, "id") == plain and plain
        # rows are numbered in the order of their id
        placed = model.predict_packed(table, "id").rows.orderBy("id").collect()
        assert [r["block"] * 32768 + r["bit"] for r in placed] == list(range(300))


def test_packed_predictions_over_blocks_and_without_rows(spark, table):
    with fit(table, FEATURES, "y", lambda_reg=0.05, depth_budget=2, rashomon_mult=0.1) as model:
        many = spark.range(70_000).selectExpr("id AS key", "id % 2 AS a", "id div 2 % 2 AS b", "id div 4 % 2 AS c", "0 AS d")
        packed = model.predict_packed(many, "key")
        sums = packed.bits.selectExpr("tree_id", "bitmap_count(bits) ones").groupBy("tree_id").sum("ones").collect()
        plain = model.predict_all(many, "key").groupBy("tree_id").sum("prediction").collect()
        assert {tuple(r) for r in sums} == {tuple(r) for r in plain}
        assert packed.bits.select("block").distinct().count() == 3
        none = model.predict_packed(many.where("key < 0"), "key")
        assert none.rows.count() == 0 and none.bits.count() == 0


def test_a_tree_that_says_zero_has_empty_bitmaps(spark):
    df = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "id int, a int, y int")
    with fit(df, ["a"], "y", lambda_reg=0.1, depth_budget=1) as model:
        got = model.predict_packed(df, "id").bits.selectExpr("block", "bitmap_count(bits) ones").collect()
        assert [tuple(r) for r in got] == [(0, 0)]
