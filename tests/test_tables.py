import pytest
from pyspark.errors import PySparkException

from earshot.functions.tables import register_table_functions


@pytest.fixture(scope="module")
def sql(spark):
    register_table_functions(spark)
    rows = [("a", 1, 100), ("a", 2, 35), ("b", 1, 5), ("b", 2, None), ("c", 1, 0)]
    spark.createDataFrame(rows, "call_id string, win_idx int, n int").createOrReplaceTempView("udtf_clips")
    return spark.sql


def test_all_columns_pass_and_names_do_not_clash(sql):
    got = sql("SELECT * FROM sliding_windows(TABLE(udtf_clips), 'n', 30, 10)")
    assert got.columns == ["call_id", "win_idx", "n", "win_idx_out", "start_sample", "padded"]
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == sorted([("a", 1, 100, k, 10 * k, False) for k in range(8)] + [("a", 2, 35, 0, 0, False), ("b", 1, 5, 0, 0, True), ("c", 1, 0, 0, 0, True)])


def test_windows_are_numbered_over_a_partition(sql):
    got = sql("SELECT call_id, win_idx_out FROM sliding_windows(TABLE(udtf_clips) PARTITION BY (call_id) ORDER BY (win_idx), 'n', 30, 10, true)")
    assert sorted(tuple(r) for r in got.collect()) == [*[("a", k) for k in range(9)], ("b", 0), ("c", 0)]


@pytest.mark.parametrize("call", ["TABLE(udtf_clips), 'm', 30, 10", "TABLE(udtf_clips), 'call_id', 30, 10", "TABLE(udtf_clips), 'n', 0, 10", "1, 'n', 30, 10"])
def test_wrong_arguments_are_refused(sql, call):
    with pytest.raises(PySparkException):
        sql(f"SELECT * FROM sliding_windows({call})").collect()
