"""The table of roles by turns takes in all turns, on a small table of its own."""

from tallyframe import registry


def test_crosstab_table_takes_all_turns(spark, tmp_path):
    rows = [("user", 0), ("user", 2), ("assistant", 1), ("assistant", 11), ("assistant", 11), ("system", 7)]
    spark.createDataFrame(rows, "role string, turn int").write.parquet(f"{tmp_path}/conversations.parquet")
    got = registry.QUERIES["crosstab_table"](spark, str(tmp_path))
    assert got.columns == ["role", "t0", "t1", "t2", "t7", "t11"]
    assert {tuple(r) for r in got.collect()} == {("user", 1, 0, 1, 0, 0), ("assistant", 0, 1, 0, 0, 2), ("system", 0, 0, 0, 1, 0)}
