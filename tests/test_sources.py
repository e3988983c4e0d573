import pytest

from grovelight import binary_table, fit, read_binary_csv, split_columns
from grovelight.plans.model import penalty
from grovelight.plans.storage import work_dir


def test_csv_with_label_last(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b,label\n0,1,0\n1,0,1\n1,1,1\n")
    df = read_binary_csv(spark, f"file://{path}")
    features, label = split_columns(df)
    assert (features, label) == (["a", "b"], "label")
    assert [tuple(r) for r in df.collect()] == [(0, 1, 0), (1, 0, 1), (1, 1, 1)]


def test_any_nonzero_value_is_true(spark):
    df = spark.createDataFrame([(0, -1, 2.5, True), (7, 0, 0.0, False)], "a int, b int, c double, y boolean")
    assert [tuple(r) for r in binary_table(df, ["a", "b", "c"], "y").collect()] == [(0, 1, 1, 1), (1, 0, 0, 0)]


def test_scan_reads_only_the_named_columns(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    plan = binary_table(orders, ["o_custkey"], "o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan


@pytest.mark.parametrize(
    "features, label, message",
    [
        ([], "y", "at least one"),
        (["a", "a"], "y", "repeat"),
        (["a", "y"], "y", "also a feature"),
        (["nope"], "y", "not found"),
        (["s"], "y", "expected a number"),
    ],
)
def test_bad_columns_raise_before_any_job(spark, features, label, message):
    df = spark.createDataFrame([(1, "x", 0)], "a int, s string, y int")
    with pytest.raises(ValueError, match=message):
        fit(df, features, label)


def test_null_is_rejected(spark):
    df = spark.createDataFrame([(1, 0), (None, 1)], "a int, y int")
    with pytest.raises(Exception, match="NULL in column a"):
        binary_table(df, ["a"], "y").collect()


def test_bad_options_raise(spark):
    df = spark.createDataFrame([(1, 0)], "a int, y int")
    for bad in ({"oracle_style": 4}, {"greedy_split_mode": 3}, {"depth_budget": -1}):
        with pytest.raises(ValueError):
            fit(df, ["a"], "y", **bad)


def test_evaluation_needs_the_same_features(spark):
    df = spark.createDataFrame([(1, 0, 0), (0, 1, 1), (0, 1, 1)], "a int, b int, y int")
    model = fit(df, ["a", "b"], "y", lambda_reg=0.4, depth_budget=1)
    with pytest.raises(ValueError, match="lacks"):
        model.predict(df.select("a"), 0)


def test_penalty_rounds_half_away_from_zero():
    assert [penalty(0.5, n) for n in (1, 2, 3, 5)] == [1, 1, 2, 3]
    assert penalty(0.49999999999999994, 1) == 0
    assert penalty(0.01, 15000) == 150


def test_a_cluster_session_needs_a_shared_folder():
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master, applicationId = "yarn", "app"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_dir(Session())
