from grovelight import fit
from grovelight.streaming import score_stream


def test_a_stream_is_scored_like_a_batch(spark, tmp_path):
    rows = [(i, i % 2, (i // 2) % 2, (i % 2) | ((i // 2) % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, a int, b int, y int")
    df.write.parquet(f"file://{tmp_path}/in")
    model = fit(df, ["a", "b"], "y", lambda_reg=0.02, depth_budget=2)
    stream = spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in")
    query = (
        score_stream(model, stream, 0)
        .writeStream.format("memory")
        .queryName("scored")
        .option("checkpointLocation", f"file://{tmp_path}/ck")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(120)
    got = {r["id"]: r["prediction"] for r in spark.table("scored").collect()}
    assert got == {r["id"]: r["prediction"] for r in model.predict(df, 0).collect()}
    assert got == {i: y for i, _, _, y in rows}
